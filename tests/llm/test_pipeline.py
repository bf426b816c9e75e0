import numpy as np
from frames import SF, no_docs, odd_docs, table, texts

import corpus_pipeline
from tabulens.llm.near_copies import LIKENESS, forest, hidden_links, shingles, without_near_copies


def kept_by_brute_force(rows: list[tuple]) -> set:
    marks = {key: set(shingles(text).tolist()) for key, text in rows}
    label = {key: key for key, _ in rows}
    plain = dict(rows)
    links = []
    for a in marks:
        for b in marks:
            both = len(marks[a] & marks[b])
            near = marks[a] and marks[b] and both >= LIKENESS * (len(marks[a]) + len(marks[b]) - both)
            if a < b and (near or plain[a] == plain[b]):
                links.append((a, b))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(label[a], label[b])
            changed = changed or label[a] != label[b]
            label[a] = label[b] = least
    return set(label.values())


def test_near_copies_against_brute_force(spark):
    rows = texts()
    base = [t for _, t in rows if len(t.split()) > 120][:8]
    draw = np.random.default_rng(3)
    for k, text in enumerate(base):
        for j in range(6):
            words = text.split(" ")
            words[int(draw.integers(len(words)))] = f"changed{j}"
            rows.append((10_000 + 10 * k + j, " ".join(words)))
    frame = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, node string, n int")
    kept = without_near_copies(frame)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == kept_by_brute_force(rows)


def test_forests_are_least_and_split_buckets_lose_none():
    draw = np.random.default_rng(1)
    base = draw.integers(0, 1 << 62, (3, 4)).astype(np.uint64)
    values = np.concatenate([base] * 60)
    for k in range(len(values)):
        for b in draw.choice(250, 6):
            values[k, b // 64] ^= np.uint64(1 << int(b % 64))
    groups = np.zeros(len(values), np.int64)
    # One group in one piece, as one hot group, and as three groups of two blocks.
    whole = forest(groups, np.full(len(values), 2, np.int32), values)
    assert len(whole[0]) == len(values) - 3
    split = forest(groups[:90], np.repeat([0, 1], 45).astype(np.int32), values[:90])
    assert len(split[0]) == 90 - 3
    small = forest(groups[:30], np.full(30, 2, np.int32), values[:30])
    assert len(small[0]) == 27


def edited_copies(groups: int, size: int) -> list[tuple]:
    """Copies of made-up texts, most two of which have a likeness near the bound."""
    draw = np.random.default_rng(5)
    rows = []
    for g in range(groups):
        base = [f"w{draw.integers(5000)}" for _ in range(300)]
        for k in range(size):
            words = list(base)
            for at in draw.choice(300, int(draw.integers(4, 9)), replace=False):
                words[at] = f"e{g}x{k}y{at}"
            rows.append((100 * g + k, " ".join(words)))
    return rows


def test_links_behind_failed_edges(spark):
    rows = edited_copies(6, 40)
    kept = without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == kept_by_brute_force(rows)


def test_pools_in_blocks_lose_no_link(spark):
    rows = edited_copies(2, 40)
    texts = spark.createDataFrame(rows, "node long, text string")
    pairs = spark.createDataFrame([(k, k + 1) for g in (0, 100) for k in range(g, g + 39)], "a long, b long")
    # One piece of many texts, whose links to the other texts are not told.
    links = spark.createDataFrame([(0, k) for k in range(1, 20)], "a long, b long")
    sizes = texts.selectExpr("node", "300L AS n")
    marks = {k: set(shingles(t).tolist()) for k, t in rows}
    for most in (1024, 8):
        label = {k: 0 if k < 20 else k for k in marks}
        for a, b in hidden_links(pairs, links, texts, sizes, rows=most).collect():
            both = len(marks[a] & marks[b])
            assert both >= LIKENESS * (len(marks[a]) + len(marks[b]) - both)
            one, two = sorted((label[a], label[b]))
            label = {k: one if x == two else x for k, x in label.items()}
        for a in marks:
            for b in marks:
                both = len(marks[a] & marks[b])
                if a // 100 == b // 100 and both >= LIKENESS * (len(marks[a]) + len(marks[b]) - both):
                    assert label[a] == label[b]


def test_odd_rows_of_near_copies(spark):
    rows = without_near_copies(odd_docs(spark)).collect()
    # Equal texts are copies, null and empty ones too; blank texts differ; a row without an id stays.
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(["1", "1", "2", "4", "5", "6", "7", "None"])
    assert without_near_copies(no_docs(spark)).count() == 0


def test_stages_and_their_columns(spark, tmp_path):
    docs = table(spark, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near-duplicates", "pii", "mixing", "packing"]
    before = {r.doc_id: r for r in docs.collect()}
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held[name] = docs.collect()
        if name != "packing":
            assert docs.columns == table(spark, "documents").columns
    good = {r.doc_id for r in held["quality rules"]}
    labels = dict(table(spark, "labels").where("quality = 1").select("doc_id", "quality").collect())
    assert len(good) < len(before)
    assert sum(k in good for k in labels) >= 0.9 * len(labels)
    kept = {r.doc_id for r in held["near-duplicates"]}
    assert kept == kept_by_brute_force([(r.doc_id, r.text) for r in held["quality rules"]])
    assert {r.doc_id for r in held["pii"]} == kept == {r.doc_id for r in held["mixing"]}
    pieces = held["packing"]
    copies = {}
    for r in held["mixing"]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    firsts = [r.doc_id for r in pieces if r.piece == 0]
    assert {k: firsts.count(k) for k in copies} == copies


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_near_copies_by_components_of_simhash(spark, monkeypatch):
    """The stage's groups are those of op10, told by exact likeness, even where other fingerprints find none."""
    import corpus_pipeline
    from tabulens.llm import near_copies

    words = [f"w{k}" for k in range(3000)]
    changed = [*words[:1500], "other", *words[1501:]]
    rows = [(5, " ".join(words)), (3, " ".join(changed)), (9, " ".join(words)), (7, " ".join(words[::-1])), (None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(
        near_copies, "near_links", lambda marks: marks.selectExpr("node AS a", "node AS b").limit(0)
    )
    left = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(str(r.doc_id) for r in left.collect()) == ["3", "7", "None"]


def test_components_are_verified(spark):
    """Texts of one component that are not alike all stay; those alike go, whoever is the least."""
    from tabulens.llm.near_copies import without_near_copies

    one, two = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    docs = spark.createDataFrame([(1, "c d e f g h"), (2, one), (3, two), (4, one + " z"), (5, two)], "doc_id long, text string")
    found = spark.createDataFrame([(k, 1) for k in range(1, 6)], "doc_id long, component_id long")
    assert sorted(r.doc_id for r in without_near_copies(docs, found=found).collect()) == [1, 2, 3]
