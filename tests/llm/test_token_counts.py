import random

import public_tokenizers
import pytest
import sentencepiece
from frames import SF, no_docs, odd_docs, texts

from tabulens.llm.queries import op7_token_counts
from tabulens.llm.token_counts import token_counts
from tabulens.llm.transducer import TokenTransducer, from_sentencepiece, written_form

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_query_counts_as_the_library_does(spark, library):
    found = {r.doc_id: r for r in op7_token_counts(spark, SF).collect()}
    for key, text in texts():
        n = len(library.encode(text))
        r = found.pop(key)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 4096)
    assert not found


def test_any_text_and_any_chunks(library):
    machine = from_sentencepiece(PATH)
    draw = random.Random(3)
    odd = ["", " ", "   ", "\n", "a\nb", "日本語", "<s> </s> <0x0A> <unk>", "▁▁ x", "\x00a", "é🎉​", "ab" * 2000, " " * 3000]
    odd += ["".join(draw.choices("abcdefghinrstoe  \n▁.,é日本0123", k=draw.randint(0, 60))) for _ in range(1500)]
    odd += ["".join(draw.choices(list(machine.scores), k=draw.randint(1, 12))) for _ in range(1500)]
    for text in odd:
        n = len(library.encode(text))
        assert machine.count(written_form(text)) == machine.count(written_form(text), 7) == n, text


def test_composition_is_associative():
    machine = from_sentencepiece(PATH)
    parts = ["▁in", "ter", "nation", "al▁house", "hold", "s\n", "▁x"]
    maps = [machine.chunk(p, at_start=k == 0) for k, p in enumerate(parts)]
    left = maps[0]
    for m in maps[1:]:
        left = machine.compose(left, m)
    right = maps[-1]
    for m in maps[-2::-1]:
        right = machine.compose(m, right)
    assert left.count == right.count == machine.run(machine.state(), "".join(parts))[1]
    assert [m.count for m in machine.scan(maps)][-1] == left.count


def test_a_small_vocabulary_against_merging():
    machine = TokenTransducer({"a": -9, "b": -9, "ab": -1, "ba": -2, "aba": -3, "bab": -0.5})
    draw = random.Random(1)
    for _ in range(500):
        text = "".join(draw.choices("abc", k=draw.randint(1, 12)))
        assert machine.run(machine.state(), text)[1] == len(machine.merged(text))


def test_odd_rows(spark, library):
    rows = token_counts(odd_docs(spark), PATH).collect()
    assert len(rows) == 9
    told = {r.doc_id: r for r in rows}
    assert (told[2].n_tokens, told[2].n_bytes, told[2].chunk_ends) == (0, 0, [])
    assert told[7].n_tokens == len(library.encode("x" * 30000))
    assert token_counts(no_docs(spark), PATH).count() == 0
