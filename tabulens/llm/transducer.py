"""A byte-pair tokenizer as a deterministic finite-state transducer that counts tokens.

Reading a text left to right, the last token of every prefix's tokenization is unique, and a token
may follow another if and only if the two strings joined tokenize to just these two. A state
therefore needs only the part of the text that a piece could still continue (bounded by the longest
piece) and the last token at each boundary inside it. A transition over a character carries the
change of the token count. States are made on demand, as many as the texts reach, and the table is
started anew when it is full; the counts do not depend on that.

Text is cut into chunks. The map of a chunk says, for whatever state it is entered in, how many
tokens it emits and which state it leaves: up to its first boundary that no piece crosses the map
depends on the entry, so these characters are kept (the head); beyond it the count and the exit state
are known. Composing two maps is associative, so the maps of the chunks of a text are combined by a
parallel prefix scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

SPACE = "▁"
CHUNK_CHARS = 1 << 16
MAX_STATES = 200_000
MAX_WORDS = 400_000

START = ("", ((None, 0),))


class State(dict):
    """Transitions by character: the next state and the change of the count; made when first asked for.

    ``key`` is the text that a piece could still continue and, for each boundary inside it where an
    open piece starts, the last token before it and the count there against the count here.
    """

    __slots__ = ("key", "machine")

    def __init__(self, key: tuple, machine: TokenTransducer) -> None:
        self.key, self.machine = key, machine

    def __missing__(self, char: str) -> tuple[State, int]:
        key, change = self.machine.arc(self.key, char)
        found = self[char] = (self.machine.state(key), change)
        return found


class ChunkMap(NamedTuple):
    """``head`` must be read from the entry state; ``state`` is None if the whole chunk is head."""

    head: str
    count: int
    state: State | None


class TokenTransducer:
    """Counts the tokens of score-ordered byte-pair encoding with byte fallback.

    ``scores`` maps each piece to its merge priority: the neighbours whose join has the highest score
    are merged first, the leftmost at a tie.
    """

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.open = {p[:k] for p in scores for k in range(1, len(p))}
        self.glued = {p[k : k + 2] for p in scores for k in range(len(p) - 1)}
        self.known = {c for p in scores for c in p}
        self.states: dict[tuple, State] = {}
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self.words: dict[str, int] = {}
        # Characters in no piece are their bytes, whatever stands beside them.
        self.breaks = "".join(c for c in "\n\r\t" if c not in self.known)
        self.by_words = not any(pair[0] != SPACE and pair[1] == SPACE for pair in self.glued)
        inner = f"[^{SPACE}{re.escape(self.breaks)}]"
        breaks = f"|[{re.escape(self.breaks)}]" if self.breaks else ""
        self.cut: Callable[[str], list[str]] = re.compile(
            f"{SPACE}+{inner}*|{inner}+{breaks}", re.DOTALL
        ).findall

    def merged(self, text: str) -> list[str]:
        """The tokens of a short string by merging, the definition that the states are built on."""
        parts = list(text)
        while True:
            joined = [
                (self.scores[a + b], -i)
                for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))
                if a + b in self.scores
            ]
            if not joined:
                return parts
            i = -max(joined)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def fits(self, last: str | None, token: str) -> bool:
        """Whether ``token`` stays whole, and apart from ``last``, when it follows it."""
        key = (last, token)
        if key not in self.pairs:
            if len(self.pairs) >= 4 * MAX_STATES:
                self.pairs.clear()
            parts = self.merged((last or "") + token)
            self.pairs[key] = parts == ([token] if last is None else [last, token])
        return self.pairs[key]

    def state(self, key: tuple = START) -> State:
        """The one state of a key; a full table is started anew."""
        found = self.states.get(key)
        if found is None:
            if len(self.states) >= MAX_STATES:
                for state in self.states.values():
                    state.clear()
                self.states.clear()
            found = self.states[key] = State(key, self)
        return found

    def arc(self, key: tuple, char: str) -> tuple[tuple, int]:
        """Where ``char`` leads from a state, and the change of the count."""
        if char not in self.known:
            return START, len(char.encode("utf-8", "surrogatepass"))
        window, ends = key
        if window and window[-1] + char not in self.glued:
            window, ends = START
        seen = window + char
        for k, end in enumerate(ends):
            if end is None:
                continue
            last, before = end
            token = seen[k:]
            if token in self.scores:
                cost = 1
            elif len(token) == 1:
                cost = len(token.encode())
            else:
                continue
            if self.fits(last, token):
                change = before + cost
                break
        else:
            raise AssertionError(f"no tokenization ends in {seen!r}")
        first = next((k for k in range(len(seen)) if seen[k:] in self.open), None)
        if first is None:
            return START, change
        kept = tuple(
            (ends[k][0], ends[k][1] - change) if seen[k:] in self.open else None
            for k in range(first, len(seen))
        )
        return (seen[first:], (*kept, (token, 0))), change

    def run(self, state: State, text: str) -> tuple[State, int]:
        """The state after ``text`` and the change of the count."""
        total = 0
        for char in text:
            state, change = state[char]
            total += change
        return state, total

    def word(self, text: str) -> int:
        """The count of a string that no piece reaches into or out of; remembered for repeats."""
        count = self.words.get(text)
        if count is None:
            count = self.run(self.state(), text)[1]
            if len(text) <= 64:
                if len(self.words) >= MAX_WORDS:
                    self.words.clear()
                self.words[text] = count
        return count

    def chunk(self, text: str, at_start: bool = False) -> ChunkMap:
        """The map of one chunk; ``at_start``: it is entered in the start state."""
        begin = 0
        if not at_start:
            begin = next(
                (
                    k + 1
                    for k in range(len(text) - 1)
                    if text[k : k + 2] not in self.glued
                ),
                0,
            )
            if not begin:
                return ChunkMap(text, 0, None)
        if not self.by_words:
            state, count = self.run(self.state(), text[begin:])
            return ChunkMap(text[:begin], count, state)
        words = self.cut(text, begin)
        if not words:
            return ChunkMap(text[:begin], 0, self.state())
        known, word = self.words, self.word
        count = 0
        for piece in words[:-1]:
            found = known.get(piece)
            count += word(piece) if found is None else found
        state, last = self.run(self.state(), words[-1])
        return ChunkMap(text[:begin], count + last, state)

    def compose(self, left: ChunkMap, right: ChunkMap) -> ChunkMap:
        """The map of two neighbouring chunks; associative."""
        if left.state is None:
            return ChunkMap(left.head + right.head, right.count, right.state)
        state, count = self.run(left.state, right.head)
        if right.state is None:
            return ChunkMap(left.head, left.count + count, state)
        return ChunkMap(left.head, left.count + count + right.count, right.state)

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """All prefixes of ``maps`` composed: neighbours first, then the scan of the pairs."""
        if len(maps) < 2:
            return maps
        pairs = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
        ends = self.scan(pairs)
        out = [maps[0]]
        for k in range(1, len(maps)):
            out.append(ends[k // 2] if k % 2 else self.compose(ends[k // 2 - 1], maps[k]))
        return out

    def offsets(self, text: str, chunk_chars: int = CHUNK_CHARS) -> list[int]:
        """Tokens up to the end of each chunk, as if the text ended there."""
        parts = [text[k : k + chunk_chars] for k in range(0, len(text), chunk_chars)]
        maps = [self.chunk(part, at_start=k == 0) for k, part in enumerate(parts)]
        return [m.count for m in self.scan(maps)]

    def count(self, text: str, chunk_chars: int = CHUNK_CHARS) -> int:
        """Tokens of a text that is already in the form the pieces are written in."""
        return self.offsets(text, chunk_chars)[-1] if text else 0


@lru_cache(maxsize=2)
def from_sentencepiece(path: str) -> TokenTransducer:
    """The transducer of a byte-pair model file; a model of another kind is refused."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = " Ａ  ﬁ\t b "
    if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
        raise ValueError(f"{path}: only models that keep texts as they are can be compiled")
    pieces = range(model.get_piece_size())
    scores = {
        model.id_to_piece(i): model.get_score(i)
        for i in pieces
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    }
    if not all(model.is_byte(model.piece_to_id(f"<0x{b:02X}>")) for b in range(256)):
        raise ValueError(f"{path}: the model has no byte pieces")
    return TokenTransducer(scores)


def written_form(text: str) -> str:
    """A text as the pieces of a sentencepiece model see it."""
    return SPACE + text.replace(" ", SPACE) if text else ""
