import zlib

import numpy as np
import public_tokenizers
from frames import SF, no_docs, odd_docs, texts
from tokenizers import Tokenizer

from tabulens.llm.packing import encoder, pack, pack_documents, pack_histogram
from tabulens.llm.queries import op5_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_places(rows):
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    return len(by)


def test_query_against_the_library(spark):
    own = Tokenizer.from_file(PATH)
    rows = op5_packing(spark, SF).collect()
    found = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    total = 0
    for key, text in texts():
        ids = np.array([*own.encode(text, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        first = len(ids) % 2048 or 2048
        for k, start in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[start : first if k == 0 else start + 2048]
            assert found.pop((key, k)) == (start, len(part), zlib.crc32(part.tobytes()))
    assert not found
    assert check_places(rows) <= -(-total // 2048) + 3


def test_fast_ids_are_the_library_s():
    own, fast = Tokenizer.from_file(PATH), encoder(PATH)
    for text in ["", " ", "it's  <|endoftext|> \n\n x", "Ünï ß ſ 日本 🎉", "a b c\u0085d\x1ce", "  \n  \n", "1²3 ½", "x" * 5000]:
        assert fast.ids(text).tolist() == own.encode(text, add_special_tokens=False).ids


def test_histograms_are_packed_whole_and_tight():
    draw = np.random.default_rng(2)
    for lengths in (draw.integers(1, 2049, 4000), draw.lognormal(6, 1, 6000).astype(int).clip(1, 2048), np.full(300, 700), np.array([2048, 1, 1025, 1025])):
        counts = np.bincount(lengths, minlength=2049)
        bins = pack_histogram(counts)
        held = np.zeros(2049, int)
        for chosen, n in bins:
            assert sum(chosen) <= 2048
            np.add.at(held, list(chosen), n)
        assert (held == counts).all()
        over_half = int((lengths > 1024).sum())
        bound = max(-(-int(lengths.sum()) // 2048), over_half, -(-len(lengths) // 2) if (lengths == 700).all() else 0)
        assert sum(n for _, n in bins) <= bound * 1.01 + 1


def test_a_hot_length(spark):
    rows = spark.range(9000).selectExpr("id AS doc_id", "0 AS piece", "if(id % 3 = 0, 600L, id % 700 + 1) AS length", "1 AS rank")
    found = pack(rows).collect()
    assert len(found) == 9000
    check_places(found)


def test_odd_rows(spark):
    rows = pack_documents(odd_docs(spark), PATH, keep_ids=True).collect()
    check_places(rows)
    told = {}
    for r in rows:
        told.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
    assert [r.length for r in told[2]] == [r.length for r in told[3]] == [1]
    assert len(told[1]) == 2 and len(told[None]) == 1 and len(told[6]) == 2
    assert pack_documents(no_docs(spark), PATH).count() == 0
