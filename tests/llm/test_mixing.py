import math

from frames import SF, no_docs, odd_docs, table, texts
from pyspark.sql import functions as F

from tabulens.llm.mixing import exponent, mixed, mixture, source_weights
from tabulens.llm.queries import op3_mixing


def entropy(weights):
    return -sum(w * math.log(w) for w in weights)


def raised(shares, a):
    power = [p**a for p in shares]
    return [x / sum(power) for x in power]


def test_query_against_brute_force(spark):
    rows = op3_mixing(spark, SF).collect()
    docs = texts("documents", "doc_id, text, source")
    tokens = {key: max(1, len(text.split())) for key, text, _ in docs}
    sources = {key: source for key, _, source in docs}
    assert {r.doc_id for r in rows} == set(tokens)
    assert all(r.mix_source == sources[r.doc_id] and 0 <= r.mix_position <= 1 for r in rows)
    used: dict[str, int] = {}
    for r in rows:
        used[r.mix_source] = used.get(r.mix_source, 0) + tokens[r.doc_id]
    whole = {s: sum(t for k, t in tokens.items() if sources[k] == s) for s in used}
    weight = {r.mix_source: r.mix_weight for r in rows}
    budget = max(whole[s] / weight[s] for s in whole)
    longest = max(tokens.values())
    for s in used:
        # Budgets are met to within one document.
        assert weight[s] * budget - longest <= used[s] <= weight[s] * budget + 1e-6 * budget
    # Each round uses a document once.
    assert len({(r.doc_id, r.mix_round) for r in rows}) == len(rows)


def test_exponent_meets_the_target_or_the_limit(spark):
    shares = [0.4, 0.3, 0.15, 0.1, 0.05]
    frame = spark.createDataFrame([(str(k), p) for k, p in enumerate(shares)], "source string, share double")
    a = exponent(frame, evenness=0.5, repeats=100.0)
    target = entropy(shares) + 0.5 * (math.log(5) - entropy(shares))
    assert abs(entropy(raised(shares, a)) - target) < 1e-4
    a = exponent(frame, evenness=1.0, repeats=2.0)
    most = [w / p for w, p in zip(raised(shares, a), shares, strict=True)]
    assert abs(max(most) / min(most) - 2.0) < 1e-3
    assert exponent(frame, evenness=0.0, repeats=5.0) > 0.999
    assert exponent(frame.limit(1)) == 1.0 and exponent(frame.limit(0)) == 1.0


def test_a_hot_source_is_whole_and_a_budget_is_kept(spark):
    docs = spark.range(3000).selectExpr(
        "id AS doc_id", "repeat('w ', 1 + cast(id % 50 AS int)) AS text", "if(id % 10 < 7, 'hot', concat('s', id % 10)) AS source"
    )
    rows = mixed(docs).collect()
    assert len({r.doc_id for r in rows}) == 3000
    assert max(r.mix_round for r in rows) <= 2
    half = mixed(docs, budget=20000.0).collect()
    assert 19500 <= sum(r.mix_tokens for r in half) <= 20000
    # The mixture is even: any part of it has about the weights of the whole.
    early = [r for r in rows if r.mix_position < 0.5]
    share = sum(r.mix_tokens for r in early if r.mix_source == "hot") / sum(r.mix_tokens for r in early)
    assert abs(share - rows[0].mix_weight if rows[0].mix_source == "hot" else 0) < 0.1


def test_weights_add_up(spark):
    counted = spark.createDataFrame([("a", 1000), ("b", 10)], "source string, tokens long")
    rows = source_weights(counted).collect()
    assert math.isclose(sum(r.weight for r in rows), 1.0)
    assert all(r.budget >= r.tokens - 1e-6 for r in rows)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = mixed(docs).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, None}
    assert set(docs.columns) - {"mix_source"} <= set(rows[0].asDict())
    assert {r.mix_source for r in rows} == {"a", ""}
    assert mixed(no_docs(spark)).count() == 0
    assert table(spark, "documents").count() == 200


def test_columns_named_as_the_operator_s_own(spark):
    rows = mixed(odd_docs(spark)).collect()
    assert {(r.blocks, r.block, r.turn, r.mix_name, r.mix_row) for r in rows} == {(7, 8, "t", "m", "r")}
    kept = mixture(odd_docs(spark).withColumn("mix_round", F.lit("own"))).select("mix_row.*")
    assert kept.columns == [*odd_docs(spark).columns, "mix_round"]
    assert {r.mix_round for r in kept.collect()} == {"own"}


def test_one_source_holds_all_rows_many_of_them_equal(spark):
    same = [(1, "five words of one text", "a")] * 400
    docs = spark.createDataFrame(same + [(k, f"text {k} of some words", "a") for k in range(2, 600)], "doc_id long, text string, source string")
    whole = mixed(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in whole} == {1: 400, **dict.fromkeys(range(2, 600), 1)}
    rows = mixed(docs, budget=1495.0).collect()
    assert 0 <= 1495 - sum(r.mix_tokens for r in rows) <= 2000
