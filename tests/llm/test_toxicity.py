import zlib
from itertools import product

import numpy as np
from frames import SF, no_docs, odd_docs, table

from tabulens.llm.queries import op4_toxicity
from tabulens.llm.toxicity import chain, fit, labelled_texts, tokens, toxicity


def test_query_scores_held_out_documents(spark):
    folder = SF.replace("0.001", "0.1")
    labels = dict(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").collect())
    rows = op4_toxicity(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    asked = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    toxic = np.array([s for y, s in asked if y])
    clean = np.array([s for y, s in asked if not y])
    assert (toxic[:, None] > clean[None, :]).mean() > 0.95
    assert np.mean([(s >= 0.5) == y for y, s in asked]) > 0.97


def test_chain_against_all_taggings():
    draw = np.random.default_rng(4)
    turn = draw.normal(size=(2, 2))
    sizes = np.array([3, 0, 5, 1, 4])
    emission = draw.normal(size=sizes.sum()) * 2
    marginal, pairs, _, total = chain(emission, sizes, turn)
    at, logs = 0, 0.0
    for n in sizes.tolist():
        if not n:
            continue
        e = emission[at : at + n]
        weight = {
            tags: np.exp(sum(e[k] * t for k, t in enumerate(tags)) + sum(turn[a, b] for a, b in zip(tags, tags[1:], strict=False)))
            for tags in product((0, 1), repeat=n)
        }
        z = sum(weight.values())
        logs += np.log(z)
        for k in range(n):
            assert np.isclose(marginal[at + k], sum(w for t, w in weight.items() if t[k]) / z)
            if k:
                for a, b in product((0, 1), repeat=2):
                    share = sum(w for t, w in weight.items() if (t[k - 1], t[k]) == (a, b)) / z
                    assert np.isclose(pairs[at + k, a, b], share)
        at += n
    assert np.isclose(total, logs)


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    swapped = labels.selectExpr(
        "doc_id", "quality", "if(crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0, 1 - toxic, toxic) AS toxic"
    )
    one = {r.doc_id: r.score for r in toxicity(docs, labels).collect()}
    two = {r.doc_id: r.score for r in toxicity(docs, swapped).collect()}
    assert one == two


def test_spans_point_at_the_words():
    draw = np.random.default_rng(1)
    words = [f"w{k}" for k in range(300)]
    sample = []
    for k in range(200):
        text = draw.choice(words, 40).tolist()
        if k % 4 == 0:
            text[5:5] = ["Vile!", "rotten"]
        sample.append((int(k % 4 == 0), " ".join(text)))
    tagger = fit(sample)
    from tabulens.llm.toxicity import Emissions

    text = "w1 w2 VILE w3"
    marginal, score = tagger.tag([tokens(text), tokens("w1 w2 w3"), []], Emissions(tagger.weights))
    assert marginal[2] > 0.5 and marginal[[0, 1, 3]].max() < 0.5
    assert score[0] > 0.5 > score[1] and 0 <= score[2] < 0.5


def test_odd_rows(spark):
    none = table(spark, "labels").limit(0)
    rows = toxicity(odd_docs(spark), none).collect()
    assert len(rows) == 9 and all(r.score == 0 and r.spans == [] for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    told = toxicity(odd_docs(spark).select("doc_id", "text"), table(spark, "labels")).collect()
    assert len(told) == 9
    assert toxicity(no_docs(spark), table(spark, "labels")).count() == 0


def test_sample_is_bounded_under_repeated_ids(spark):
    docs = spark.range(5000).selectExpr("7L AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(7, 1)] * 50 + [(7, 0)], "doc_id long, toxic int")
    rows = labelled_texts(docs, labels, "doc_id", "text", "toxic", 2000, 1 << 22)
    assert sorted(label for label, _ in rows) == [0, 1] and len({text for _, text in rows}) == 1
