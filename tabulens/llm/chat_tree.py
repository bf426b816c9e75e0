"""Conversations as one prefix tree: turns that conversations begin with in common are emitted once.

A node of the tree is a turn after the turns before it; conversations that agree up to a turn share
its node. The least of the conversations through a node owns it, so each conversation owns the end
of its path, its *chain*, and finds the beginning in chains of others. Chains laid out in the order of
their branches are the tree depth first. Each comes with its offset in its tree, the position of
its first token on the path, and the intervals of the tree that its tokens attend to besides
the chain itself: those of its ancestors.

Only digests and lengths of turns take part in finding the tree. Texts are shuffled once, to bring
the turns of a conversation together; a conversation is one training example and fits into a row.
Nodes that very many conversations share are spread over copies in joins, never gathered.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b
from itertools import accumulate
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import map_rows, map_stream, text_of, written

# The marks of the template.
START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
TAUGHT = "assistant"
# Keys of more rows than this, and than a 4,096th of all rows, are spread over copies in joins.
SPREAD, SPREAD_PARTS = 256, 4096
# Conversations, or pieces of them, that a task holds as Python lists at once.
HELD = 64
INTERVALS = "array<struct<start:long,end:long>>"


def escape(text: str) -> str:
    """The text without any mark of the template: each ``<|`` gets one more bar."""
    return re.sub(r"<\|+", lambda m: m.group() + "|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\|\|+", lambda m: m.group()[:-1], text)


@lru_cache(maxsize=2)
class Template:
    """Turns as token ids and back. The marks are ids of their own, which no text can spell."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.start = max(ranks.values()) + 1
        self.end = self.start + 1
        self.encoding = tiktoken.Encoding(
            "chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
            special_tokens={START: self.start, END: self.end},
        )
        self.tail = [self.end, *self._plain("\n")]
        self.heads: dict[str, list[int]] = {}

    def _plain(self, text: str) -> list[int]:
        """Ids of a text in which nothing is a mark."""
        return self.encoding.encode_ordinary(text)

    def head(self, role: str) -> list[int]:
        if role not in self.heads:
            if len(self.heads) > 1000:
                self.heads.clear()
            self.heads[role] = [self.start, *self._plain(escape(role).replace("\n", LINE) + "\n")]
        return self.heads[role]

    def turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        """Ids of a turn, and where its text begins and ends among them."""
        head, body = self.head(role), self._plain(escape(text))
        return head + body + self.tail, len(head), len(head) + len(body)

    def text(self, ids: list[int]) -> str:
        return self.encoding.decode_bytes(ids).decode("utf-8")


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    found, at = [], 0
    for turn in re.finditer(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", formatted, re.S):
        if turn.start() != at:
            raise ValueError(f"no turn at {at}")
        role, text = turn.groups()
        found.append((unescape(role.replace(LINE, "\n")), unescape(text)))
        at = turn.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return found


def digest(*parts: bytes) -> bytes:
    """Sixteen bytes that stand for the parts and where they are cut."""
    hashed = blake2b(digest_size=16)
    for part in parts:
        hashed.update(len(part).to_bytes(8, "little") + part)
    return hashed.digest()


def order(turn: Any, role: str, text_digest: bytes) -> tuple:
    """Turns come by number, those without one first; ties by role, then by the digest of the text."""
    return turn is not None, turn if turn is not None else 0, role, text_digest


def segments(owners: list[str], ends: list[int]) -> list[tuple[str, int, int, int]]:
    """``owner, first turn, first token, last token`` of each stretch of a path with one owner."""
    found: list[tuple[str, int, int, int]] = []
    for turn, (owner, end) in enumerate(zip(owners, ends, strict=True)):
        begin = ends[turn - 1] if turn else 0
        if found and found[-1][0] == owner:
            found[-1] = (*found[-1][:3], end)
        else:
            found.append((owner, turn, begin, end))
    return found


def spread_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, rows: int, how: str) -> DataFrame:
    """``left`` with the one row of ``right`` of its key; keys of very many rows are spread over
    copies by the conversation.

    ``counts(key, n)`` says how many rows of ``left`` a key has. At most ``SPREAD_PARTS`` keys can be
    over the bound, so their list is small whatever the input.
    """
    most = max(SPREAD, rows // SPREAD_PARTS)
    heavy = counts.where(F.col("n") > most).select(
        F.col(key).alias("heavy_key"), F.ceil(F.col("n") / most).cast("int").alias("copies")
    )

    def with_copies(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(heavy), F.col(key) == F.col("heavy_key"), "left").drop("heavy_key")

    salt = F.pmod(F.xxhash64("conv"), F.coalesce("copies", F.lit(1))).cast("int")
    salted = with_copies(left).withColumn("salt", salt).drop("copies")
    all_salts = F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))
    copied = with_copies(right).withColumn("salt", all_salts).drop("copies")
    return salted.join(copied, [key, "salt"], how).drop("salt")


def offsets(chains: DataFrame, parts: int) -> DataFrame:
    """``conv, offset``: the tokens of all chains before, in the order of ``branch``.

    Chains are sorted into ranges, summed within them, and shifted by the sums of the ranges before.
    """
    ranged = chains.repartitionByRange(parts, "branch").withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "chat-order")
    within = Window.partitionBy("part").orderBy("branch").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("part").agg(F.sum("tokens").alias("part_tokens"))
    # As many rows as there are ranges.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("base"))
    return ranged.join(F.broadcast(base), "part").select(
        "conv", (F.col("base") + F.coalesce(F.sum("tokens").over(within), F.lit(0))).alias("offset")
    )


@dataclass(frozen=True)
class ChatTree:
    """``layout`` has a row per conversation; ``rows`` are its turns, grouped; ``kind`` its id's type."""

    layout: DataFrame
    rows: DataFrame
    tokenizer: str
    kind: str

    def chains(self, chosen: Column | None = None) -> DataFrame:
        """The tree's tokens, each once: a row for each conversation that owns any.

        ``tree_id, conv_id, first_turn, offset`` (in the tree, gapless), ``position`` (of the first
        token on its path), ``ids, loss`` (spans of the ids to learn), ``attends`` (intervals of the
        tree before the chain), ``lent`` (how many of its first ids others go on from).
        """
        return self.built(
            lambda chain: chain,
            f"tree_id string, conv string, first_turn int, offset long, position long, ids array<int>,"
            f" loss {INTERVALS}, attends {INTERVALS}, lent long",
            chosen,
        )

    def built(self, finish: Callable[[tuple], tuple], schema: str, chosen: Column | None = None) -> DataFrame:
        """What ``finish`` makes of each chain, in the task that encodes it."""
        path = self.tokenizer
        layout = self.layout.where("own_turn is not null")
        layout = layout if chosen is None else layout.where(chosen)

        def build(columns: list) -> Iterator[tuple]:
            template = Template(path)
            for key, tree, turns, own, offset, position, attends, lent in zip(*columns, strict=True):
                turns.sort(key=lambda t: order(t["turn"], t["role"], digest(t["text"].encode())))
                ids: list[int] = []
                loss = []
                for t in turns[own:]:
                    told, begin, end = template.turn(t["role"], t["text"])
                    if t["role"] == TAUGHT and end > begin:
                        loss.append((len(ids) + begin, len(ids) + end))
                    ids += told
                attends = [(a["start"], a["end"]) for a in attends]
                yield finish((tree, key, own, offset, position, ids, loss, attends, lent))

        joined = self.rows.join(layout, "conv")
        picked = joined.select("conv", "tree", "turns", "own_turn", "offset", "position", "attends", "lent")
        return map_stream(
            picked,
            lambda batches: (row for columns in batches for row in build(columns)),
            schema,
            slice_rows=HELD,
            take_rows=HELD,
        )


def prefix_tree(
    conversations: DataFrame,
    tokenizer: str,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> ChatTree:
    """The prefix tree of all conversations; ``tokenizer`` is the path of a rank file.

    Turns come by ``turn_col`` (ties by role, then by a digest of the text). A null role or text is
    empty. Rows without an id are one conversation, of id null. Repeated rows are turns like any
    other. Equal conversations share all nodes; the one with the least id owns them. Other columns are
    not read; an empty table gives an empty tree.
    """
    kind = conversations.schema[id_col].dataType.simpleString()
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{id_col}`").cast("string")), F.lit(""))
    rows = conversations.select(
        key.alias("conv"), F.col(f"`{turn_col}`").alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text")
    )
    turn_kind = dict(rows.dtypes)["turn"]

    def measure(columns: list) -> Iterator[tuple]:
        template = Template(tokenizer)
        for conv, turn, role, text in zip(*columns, strict=True):
            yield conv, turn, role, digest(text.encode()), len(template.turn(role, text)[0])

    slim = map_rows(rows, measure, f"conv string, turn {turn_kind}, role string, own binary, tokens long", 4 * HELD)

    def walk(columns: list) -> Iterator[tuple]:
        for conv, turns in zip(*columns, strict=True):
            turns.sort(key=lambda t: order(t["turn"], t["role"], t["own"]))
            node = b""
            for k, t in enumerate(turns):
                node = digest(node, t["role"].encode(), t["own"])
                yield conv, k, node, t["tokens"]

    gathered = slim.groupBy("conv").agg(F.collect_list(F.struct("turn", "role", "own", "tokens")).alias("turns"))
    paths = written(map_rows(gathered, walk, "conv string, at int, node binary, tokens long"), "chat-paths")
    nodes = written(
        paths.groupBy("node").agg(F.min("conv").alias("owner"), F.count("*").alias("n")).where("n > 1"),
        "chat-nodes",
    )
    n_rows = paths.count()
    owned = spread_join(paths, nodes.select("node", "owner"), "node", nodes, n_rows, "left")

    def lay(columns: list) -> Iterator[tuple]:
        for conv, turns in zip(*columns, strict=True):
            turns.sort(key=lambda t: t["at"])
            ends = list(accumulate(t["tokens"] for t in turns))
            found = segments([t["owner"] or conv for t in turns], ends)
            shared = [e for t, e in zip(turns, ends, strict=True) if t["owner"]]
            last = found[-1]
            own = last if last[0] == conv else None
            position = own[2] if own else ends[-1]
            lent = max(0, shared[-1] - position) if own and shared else 0
            # Branches late on a path come before earlier ones: the order depth first.
            branch = [(-s[1], s[0]) for s in found]
            yield conv, len(turns), found, own and own[1], position, ends[-1] - position, lent, branch

    members = written(
        map_rows(
            owned.groupBy("conv").agg(F.collect_list(F.struct("at", "owner", "tokens")).alias("turns")),
            lay,
            "conv string, n_turns long, segments array<struct<owner:string,turn:int,begin:long,end:long>>,"
            " own_turn int, position long, tokens long, lent long, branch array<struct<turn:int,owner:string>>",
        ),
        "chat-members",
    )
    parts = max(1, int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    starts = written(offsets(members.where("own_turn is not null").select("conv", "branch", "tokens"), parts), "chat-offsets")
    # Where each path goes through the tree: the owners' offsets say so.
    through = members.select("conv", F.posexplode("segments").alias("k", "s")).select("conv", "k", "s.*")
    first = members.select(F.col("conv").alias("owner"), F.col("position").alias("owner_position"))
    placed = starts.withColumnRenamed("conv", "owner").join(first, "owner")
    branching = through.join(members.where("own_turn is null or position > 0").select("conv"), "conv")
    owners = branching.groupBy("owner").agg(F.count("*").alias("n"))
    found = spread_join(branching, placed, "owner", owners, n_rows, "inner")
    begin = F.col("offset") + F.col("begin") - F.col("owner_position")
    at = found.select("conv", "k", "owner", "turn", begin.alias("start"), (begin + F.col("end") - F.col("begin")).alias("end"))
    intervals = F.array_sort(F.collect_list(F.struct("k", "start", "end", "owner")))
    ways = at.groupBy("conv").agg(intervals.alias("ways"))
    base = F.coalesce(F.col("ways")[0]["start"], F.col("offset"))
    own = F.expr("filter(ways, w -> w.owner != conv)")
    attends = F.transform(F.coalesce(own, F.array()), lambda w: F.struct((w.start - F.col("base")).alias("start"), (w.end - F.col("base")).alias("end")))
    layout = (
        members.drop("tokens", "branch")
        .join(starts, "conv", "left")
        .join(ways, "conv", "left")
        .withColumn("base", base)
        .select(
            "conv", F.col("segments")[0]["owner"].alias("tree"), "n_turns", "segments", "own_turn", "position",
            "lent", (F.col("offset") - F.col("base")).alias("offset"), attends.cast(INTERVALS).alias("attends"),
        )
    )
    grouped = rows.groupBy("conv").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    return ChatTree(written(layout, "chat-layout"), grouped, tokenizer, kind)


def spans(loss: list) -> list[tuple[int, int]]:
    return [(s["start"], s["end"]) for s in loss]


def told_by(tree: ChatTree, finish: Callable[[tuple], tuple], schema: str) -> DataFrame:
    """What ``finish`` makes of ``conv, formatted, learnt`` of each conversation.

    A conversation that owns its whole path is read from its own row. The others get the beginning from
    chains that lend it; only those pieces are moved. Between two shuffles a row passes one Python
    function, so a task needs one worker and one copy of the vocabulary.
    """
    path = tree.tokenizer

    def told(conv: str, ids: list[int], loss: list[tuple[int, int]]) -> tuple:
        template = Template(path)
        return finish((conv, template.text(ids), [unescape(template.text(ids[a:b])) for a, b in loss]))

    def whole(chain: tuple) -> tuple:
        _, conv, _, _, _, ids, loss, _, _ = chain
        return told(conv, ids, loss)

    def gather(columns: list) -> Iterator[tuple]:
        for conv, parts in zip(*columns, strict=True):
            ids: list[int] = []
            loss: list[tuple[int, int]] = []
            for part in sorted(parts, key=lambda p: p["k"]):
                loss += [(a + len(ids), b + len(ids)) for a, b in spans(part["loss"])]
                ids += part["ids"]
            yield told(conv, ids, loss)

    alone = tree.built(whole, schema, F.col("position") == 0)
    ends = tree.chains(F.col("position") > 0).select("conv", F.lit(2**30).alias("k"), "ids", "loss")
    borrowed = (
        tree.layout.where("own_turn is null or position > 0")
        .select("conv", F.posexplode("segments").alias("k", "s"))
        .select("conv", "k", "s.owner", "s.begin", "s.end")
        .where("owner != conv")
    )
    lent = tree.chains(F.col("lent") > 0).select(
        F.col("conv").alias("owner"), F.col("position").alias("first"),
        F.slice("ids", F.lit(1), F.col("lent").cast("int")).alias("ids"), "loss",
    )
    owners = borrowed.groupBy("owner").agg(F.count("*").alias("n"))
    rows = tree.layout.count()
    joined = spread_join(borrowed, lent, "owner", owners, rows, "inner")
    begin, end = F.col("begin") - F.col("first"), F.col("end") - F.col("first")
    cut = F.slice("ids", (begin + 1).cast("int"), (end - begin).cast("int")).alias("ids")
    learnt = F.transform(
        "loss",
        lambda s: F.struct((F.greatest(s.start, begin) - begin).alias("start"), (F.least(s.end, end) - begin).alias("end")),
    )
    begins = joined.select("conv", "k", cut, F.filter(learnt, lambda s: s.start < s.end).alias("loss"))
    parts = begins.unionByName(ends).groupBy("conv").agg(F.collect_list(F.struct("k", "ids", "loss")).alias("parts"))
    return alone.unionByName(map_rows(parts, gather, schema, HELD))


def named(tree: ChatTree) -> Column:
    """The conversation's id as it was."""
    return F.when(F.col("conv") != "", F.substring("conv", 2, 2**31 - 1)).cast(tree.kind).alias("conv_id")


def conversations_of(tree: ChatTree) -> DataFrame:
    """Every conversation read back from the chains: ``conv_id, formatted, learnt`` (its taught texts)."""
    told = told_by(tree, lambda row: row, "conv string, formatted string, learnt array<string>")
    return told.select(named(tree), "formatted", "learnt")


def read_back(tree: ChatTree) -> DataFrame:
    """``conv_id, turns`` (role and text), ``formatted`` and ``learnt`` of every conversation."""

    def parse(row: tuple) -> tuple:
        conv, formatted, learnt = row
        return conv, turns_of(formatted), formatted, learnt

    told = told_by(
        tree, parse, "conv string, turns array<struct<role:string,text:string>>, formatted string, learnt array<string>"
    )
    return told.select(named(tree), "turns", "formatted", "learnt")
