import re

import numpy as np
import xxhash
from frames import SF, no_docs, odd_docs, texts

from tabulens.llm.components import components
from tabulens.llm.queries import op10_simhash_components
from tabulens.llm.simhash import fingerprint_links, plan_parts, simhash_components


def brute(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), seed=42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(nodes: dict[int, int], radius: int) -> dict[int, int]:
    label = {k: k for k in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if label[b] < label[a] and (nodes[a] ^ nodes[b]).bit_count() <= radius:
                    label[a], changed = label[b], True
    return label


def test_query_against_brute_force(spark):
    marks = {key: brute(text) for key, text in texts()}
    label = least_reachable(marks, 3)
    found = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in op10_simhash_components(spark, SF).collect()}
    assert found == {k: (marks[k], label[k]) for k in marks}


def test_links_join_what_is_near(spark):
    draw = np.random.default_rng(5)
    values = {}
    for k in range(0, 400, 8):
        base = int(draw.integers(0, 1 << 63))
        for j in range(8):
            base ^= sum(1 << int(b) for b in draw.choice(63, draw.integers(1, 6), replace=False))
            values[k + j] = base
    frame = spark.createDataFrame(list(values.items()), "node long, fingerprint long")
    # A block of a few rows makes every bucket a hot one.
    for block in (8192, 2):
        found = {r.node: r.component for r in components(fingerprint_links(frame, 3, block)).collect()}
        label = least_reachable(values, 3)
        assert {k: found.get(k, k) for k in values} == label


def test_thresholds_add_up():
    sample = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    for rows in (1000, 10**7, 10**12):
        parts = plan_parts(sample, rows, 3)
        assert sum(p.threshold + 1 for p in parts) == 4
        bits = [b for p in parts for b in p.bits]
        assert len(bits) == len(set(bits))


def test_components_of_chains_and_loops(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 100), (200, 201), (201, 200), (None, 3)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    rows = simhash_components(odd_docs(spark)).collect()
    assert len(rows) == 9
    told = {r.doc_id: r for r in rows}
    assert {told[k].fingerprint for k in (2, 3, 4)} == {"0" * 16}
    assert {told[k].component_id for k in (2, 3, 4)} == {2}
    assert told[None].component_id is None
    assert simhash_components(no_docs(spark)).count() == 0
