import hashlib
import random
import zlib

import numpy as np
import pytest
from frames import SF, no_docs, odd_docs, texts

import tabulens.llm.periods as periods
from tabulens.llm.periods import collapse, fragments, joined, long_enough, periodic_runs, planted, tiles
from tabulens.llm.queries import op11_periodic_runs


def every_run(words):
    """All runs by comparing the words one period apart, for each period."""
    found, n = [], len(words)
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            end = j + p
            shorter = any(
                all(words[k] == words[k + q] for k in range(i, end - q)) for q in range(1, p) if p % q == 0
            )
            if end - i >= max(6, 4 * p) and not shorter:
                found.append((i, end - i, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def tiled(words):
    ids = np.array(words, np.int32)
    found = []
    for low, high, at, stop, left, right in tiles(len(words)):
        found += fragments(ids[left:right], low, high, at, stop, left)
    runs = [(s, e - s, p) for p, s, e in joined(found) if long_enough(p, s, e)]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def some_words(rng, n):
    words, kinds = [], rng.choice([1, 2, 3, 5])
    while len(words) < n:
        if rng.random() < 0.5:
            root = [rng.randrange(kinds) for _ in range(rng.randint(1, 20))]
            words += (root * rng.randint(1, 12))[: rng.randint(1, 150)]
        else:
            words += [rng.randrange(kinds + 3) for _ in range(rng.randint(1, 10))]
    return words[:n]


@pytest.mark.parametrize("sizes", [(2048, 1 << 14, 8), (4, 16, 2), (2, 4, 2), (8, 16, 4), (4, 4, 1)])
def test_tiles_of_any_size_find_all_runs(monkeypatch, sizes):
    for name, size in zip(("FINEST", "CORE", "CORE_SPANS"), sizes, strict=True):
        monkeypatch.setattr(periods, name, size)
    rng = random.Random(sizes[0])
    for _ in range(150):
        words = some_words(rng, rng.choice([0, 1, 5, 6, 7, 20, 60, 200]))
        assert tiled(words) == every_run(words)


def test_query_against_brute_force(spark):
    found = {r.doc_id: r for r in op11_periodic_runs(spark, SF).collect()}
    for key, text in texts():
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(key).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [*words[:a], *[words[a + (i - a) % p] for i in range(a, n)]]
        runs = every_run(words)
        r = found.pop(key)
        assert r.n_runs == len(runs)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        assert r.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
    assert not found


def test_long_texts_are_dealt_by_tile(spark, monkeypatch):
    rng = random.Random(3)
    root = [f"w{rng.randrange(50)}" for _ in range(5000)]
    words = [f"a{k}" for k in range(700)] + root * 5 + ["x", "y"] * 30000 + [f"b{k}" for k in range(900)]
    docs = spark.createDataFrame([(1, " ".join(words)), (1, " ".join(words)), (2, "z " * 50000)], "doc_id long, text string")
    rows = periodic_runs(docs).orderBy("doc_id").collect()
    assert [r.n_words for r in rows] == [86600, 86600, 50000]
    for r in rows[:2]:
        assert [tuple(x) for x in r.runs] == [(700, 25000, 5000), (25700, 60000, 2)]
        assert r.collapsed == " ".join(words[:5700] + ["x", "y"] + words[-900:])
    assert [tuple(x) for x in rows[2].runs] == [(0, 50000, 1)] and rows[2].collapsed == "z"


def test_collapse_keeps_the_first_period():
    runs = [{"start": 1, "length": 8, "period": 2}]
    assert collapse("q a b a b a b a b c".split(), runs) == "q a b c"


def test_white_space_is_ascii_only(spark):
    text = "a b   " * 6
    docs = spark.createDataFrame([(5, text)], "doc_id long, text string")
    row = periodic_runs(docs).first()
    assert row.n_words == 12 and [tuple(r) for r in row.runs] == [(0, 12, 2)]
    assert planted(docs).count() == 1


def test_odd_rows(spark):
    rows = periodic_runs(planted(odd_docs(spark))).collect()
    assert len(rows) == 9
    told = {r.doc_id: r for r in rows}
    assert told[2].n_words == told[3].n_words == told[4].n_words == 0 and told[2].collapsed == ""
    assert [tuple(r) for r in told[6].runs] == [(0, 3000, 1)] and told[6].collapsed == "word"
    assert told[None].runs == [] and told[7].collapsed == "x" * 30000
    assert periodic_runs(no_docs(spark)).collect() == []
