import re
from collections import Counter

from frames import SF, no_docs, odd_docs, table, texts

from tabulens.llm.quality import counts, keep_good, labelled_sample, quality_rules, read
from tabulens.llm.queries import op1_quality_rules


def brute(text: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    times = Counter(windows)
    repeated = {j for k, w in enumerate(windows) if times[w] > 1 for j in range(k, k + 8)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated)


def test_query_against_brute_force(spark):
    found = {r.doc_id: r for r in op1_quality_rules(spark, SF).collect()}
    labels = dict(table(spark, "labels").select("doc_id", "quality").collect())
    right = judged = 0
    for key, text in texts():
        r = found.pop(key)
        told = brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == told
        assert r.base_failed == (told[0] < 20 or 100 * told[4] > 30 * told[0])
        assert not (r.base_failed and r.kept)
        if key in labels and not r.base_failed:
            judged += 1
            right += r.kept == (labels[key] == 1)
    assert not found
    assert right >= 0.9 * judged


def test_held_out_accuracy(spark):
    """Fitted on the ids that are not divisible by 4, judged on the others, at a larger size."""
    folder = SF.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    fitted = labels.where("doc_id % 4 <> 0")
    asked = docs.join(labels.where("doc_id % 4 = 0"), "doc_id")
    rows = quality_rules(docs, fitted).join(asked.select("doc_id", "quality"), "doc_id").where("NOT base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.995 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_repeated_windows():
    for text in ("a " * 9, "a " * 8, "a b c d e f g h i " * 2, "a b c d e f g h a b c d e f g h", "", "x"):
        assert counts(text, read(text)) == brute(text)


def test_odd_rows_and_missing_labels(spark):
    none = table(spark, "labels").limit(0)
    docs = odd_docs(spark)
    rows = quality_rules(docs, none).collect()
    assert len(rows) == 9
    told = {r.doc_id: r for r in rows}
    assert told[2].base_failed and told[2].n_words == 0 and told[6].base_failed
    assert all(r.probability == 1.0 for r in rows)
    kept = keep_good(docs, docs, none)
    assert kept.schema == docs.schema
    assert kept.count() == sum(r.kept for r in rows)
    assert quality_rules(no_docs(spark), none).count() == 0
    odd = spark.createDataFrame([(1, None, 0), (None, 1, 1), (6, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_rules(docs, odd).count() == 9


def test_sample_is_bounded_under_repeated_ids(spark):
    docs = spark.range(5000).selectExpr("7L AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(7, 1)] * 50 + [(7, 0)], "doc_id long, quality int")
    rows = labelled_sample(docs, labels, "doc_id", "quality", 3000).collect()
    assert [(r.id, r.label) for r in rows] == [(7, 0)]
