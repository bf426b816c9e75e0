"""Charts, governed SQL, as-of join, history, sources."""

from __future__ import annotations

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tabulens.functions.topk import first_rows
from tabulens.operators.joins import asof_join
from tabulens.plans import charts, history
from tabulens.plans.chart_spec import (
    ChartFilter,
    ChartSpec,
    ChartSpecError,
    auto_spec,
    check_spec,
    filter_condition,
    filter_operators,
    normalise_spec,
)
from tabulens.plans.charts import chart_pivot, chart_result
from tabulens.plans.governed import GovernedQueryError, GovernedSession
from tabulens.plans.profile import infer_structure, profile
from tabulens.sources import checks, readers, samples, writers
from tabulens.sources.catalog import Catalog, list_datasets, view_names, view_slug

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def orders(spark):
    """Names with blanks, as in exported spreadsheets."""
    return spark.createDataFrame(
        [("North", "a", 10, 2, "2024-01-05", 5), ("North", "b", 20, 3, "2024-01-20", 3),
         ("South", "a", 30, 3, "2024-02-01", 4), ("South", None, 40, 5, "2024-02-10", 5),
         ("East", "b", 50, 6, "2024-03-01", 1), (None, "a", 60, 7, "2024-03-02", 2)],
        "region string, team string, `gross revenue` int, profit int, d string, rating int",
    ).withColumn("order date", F.to_date("d"))


# --- charts -------------------------------------------------------------------------------------


def test_line_split_by_month(orders):
    spec = ChartSpec("line", x_column="order date", x_bucketable=True,
                     y_columns=("gross revenue",), aggregation="sum", bucket="month",
                     split_by="team")
    found = [(str(r.x)[:7], r.split, r.value) for r in charts.chart_frame(orders, spec).collect()]
    assert found == [("2024-01", "a", 10), ("2024-01", "b", 20), ("2024-02", "a", 30),
                     ("2024-03", "a", 60), ("2024-03", "b", 50)]


def test_bars_rank_only_rows_with_a_split_value(orders):
    spec = ChartSpec("bar", x_column="region", aggregation="count", split_by="team", top_n=1)
    found = charts.chart_frame(orders, spec).collect()
    # South has two rows but one without a team, so North leads.
    assert [(r.x, r.split, r["count"]) for r in found] == [("North", "a", 1), ("North", "b", 1)]


def test_bar_percentile_of_hot_groups_equals_the_direct_one(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("k"),
        F.hash("id").alias("v"),
    )
    spec = ChartSpec("bar", x_column="k", y_columns=("v",), aggregation="p75", top_n=100)
    a = charts.bar_chart(df, spec).collect()
    b = charts.bar_chart(df, spec, direct_limit=60).collect()
    assert a == b and len(a) == 51


def test_histogram_split_fills_empty_bins(spark):
    df = spark.createDataFrame([(1, "a"), (10, "a"), (5, "b"), (7, None)], "v int, s string")
    spec = ChartSpec("histogram", value_column="v", bin_count=3, split_by="s")
    found = [(r.bin_index, r.lower_bound, r.upper_bound, r.split, r["count"])
             for r in charts.chart_frame(df, spec).collect()]
    assert found == [(0, 1, 4, "a", 1), (0, 1, 4, "b", 0), (1, 5, 7, "a", 0), (1, 5, 7, "b", 1),
                     (2, 8, 10, "a", 1), (2, 8, 10, "b", 0)]


@pytest.mark.parametrize(
    ("values", "expected"),
    [([2.5, 2.5], [(0, 2.5, 2.5, 2)]), ([], []), ([None], []),
     ([0.0, 1.0, 2.0, float("nan"), float("inf")], [(0, 0.0, 1.0, 1), (1, 1.0, 2.0, 2)])],
)
def test_float_histogram_is_left_closed(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    spec = ChartSpec("histogram", value_column="v", bin_count=2)
    found = charts.chart_frame(df, spec).collect()
    assert [(r.bin_index, r.lower_bound, r.upper_bound, r["count"]) for r in found] == expected


def test_pivot_names_blank_splits(spark):
    series = spark.createDataFrame(
        [(1, "a", "2.5"), (1, None, "3"), (2, "a", "n/a")], "x int, split string, value string"
    )
    found = {r.x: r for r in charts.chart_pivot(series).collect()}
    assert found[1]["a"] == 2.5 and found[1]["(blank)"] == 3.0 and found[2]["a"] is None


def test_filters(orders):
    def kept(column, operator, value=""):
        condition = filter_condition(orders, ChartFilter(column, operator, value))
        return None if condition is None else orders.where(condition).count()

    assert kept("gross revenue", "gt", "20") == 4 and kept("gross revenue", "lte", "20.5") == 2
    assert kept("region", "in", "North, East,") == 3 and kept("region", "in", " , ") is None
    assert kept("region", "contains", "OUT") == 2 and kept("team", "is_null") == 1
    assert kept("order date", "gte", "2024-02-10") == 3
    assert kept("region", "eq", "5") == 0  # text that is no number never equals one
    assert kept("rating", "eq", " ") is None and kept("", "eq", "x") is None
    assert filter_operators("text")[2] == "contains" and "gt" not in filter_operators("categorical")


def test_filters_reach_the_scan(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    for f in (ChartFilter("o_totalprice", "gt", "100"), ChartFilter("o_orderdate", "lt", "1996-01-01"),
              ChartFilter("o_custkey", "eq", "5"), ChartFilter("o_orderstatus", "eq", "F")):
        plan = orders.where(filter_condition(orders, f))._jdf.queryExecution().toString()
        assert f.column in plan.split("PushedFilters: ")[-1].split("ReadSchema")[0]


@pytest.mark.parametrize(
    "spec",
    [
        ChartSpec("pie"),
        ChartSpec("histogram"),
        ChartSpec("histogram", value_column="v", bin_count=101),
        ChartSpec("bar", x_column="a", aggregation="none"),
        ChartSpec("bar", x_column="a", aggregation="sum"),
        ChartSpec("bar", x_column="a", aggregation="count", top_n=0),
        ChartSpec("scatter", x_column="a", y_columns=("a",)),
        ChartSpec("line", x_column="a"),
        ChartSpec("line", x_column="a", y_columns=("b", "c"), split_by="d", aggregation="sum"),
        ChartSpec("line", y_columns=("b",)),
        ChartSpec("line", x_column="a", y_columns=("b",), filters=(ChartFilter("a", "like", "x"),)),
    ],
)
def test_bad_specs(spec):
    with pytest.raises(ChartSpecError):
        check_spec(spec)


def test_normalised_specs():
    fixed = normalise_spec(ChartSpec("bar", y_columns=("a", "b", "a", ""), split_by="s", bin_count=0,
                                     top_n=900))
    assert (fixed.y_columns, fixed.bin_count, fixed.top_n) == (("a",), 12, 100)
    assert normalise_spec(ChartSpec("scatter", aggregation="sum", bucket="day")).aggregation == "none"


def test_auto_specs(orders):
    s = infer_structure(orders.drop("d"), "orders")
    parts = (s.columns, s.measures, s.temporal, s.primary_temporal)
    assert auto_spec(*parts).chart_type == "histogram"
    line = auto_spec(*parts, chart_type="line")
    assert line.x_column == "order date" and line.bucket == "month"
    assert line.y_columns == ("profit", "rating")
    bar = auto_spec(*parts, chart_type="bar")
    assert bar.x_column in {"region", "team"} and bar.aggregation == "sum"
    scatter = auto_spec(*parts, chart_type="scatter")
    assert check_spec(scatter, s.columns) is scatter
    with pytest.raises(ChartSpecError):
        check_spec(ChartSpec("bar", x_column="profit", aggregation="count"), s.columns)


def test_first_rows_equal_a_plain_top_k(spark):
    df = spark.range(0, 50_000, 1, 40).select(
        F.hash("id").alias("x"), (F.col("id") % 7).alias("few"), F.hash(F.col("id") + 1).alias("y"),
        F.when(F.col("id") < 300, F.col("id")).alias("gaps"), F.col("id").cast("string").alias("text"),
    )
    for order in (["x", "y"], ["few", "x"], ["gaps", "x"], ["text"]):
        expected = df.orderBy(*[F.asc_nulls_last(c) for c in order]).limit(900).collect()
        assert first_rows(df, order, 900).collect() == expected


def test_first_rows_order_only_what_a_bound_lets_through(spark, tmp_path):
    spark.range(0, 400_000, 1, 8).select(F.hash("id").alias("x")).write.parquet(str(tmp_path / "t"))
    found = first_rows(spark.read.parquet(str(tmp_path / "t")), ["x"], 5_000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "TakeOrderedAndProject" in plan
    assert "LessThanOrEqual(x," in plan
    assert found.count() == 5_000


def test_a_chart_tells_that_it_was_cut(spark):
    df = spark.range(300).select(F.col("id").alias("x"), (F.col("id") * 2).alias("y"))
    spec = ChartSpec("scatter", x_column="x", y_columns=("y",))
    cut, whole = chart_result(df, spec, max_rows=100), chart_result(df, spec, max_rows=300)
    assert cut.truncated and cut.frame.count() == 100
    assert not whole.truncated and whole.frame.count() == 300


def test_a_pivot_leaves_no_split_out(spark):
    long = spark.range(40).selectExpr("id % 2 AS x", "concat('s', id) AS split", "id AS value")
    assert len(chart_pivot(long).columns) == 41
    with pytest.raises(ChartSpecError):
        chart_pivot(long, max_columns=39)


def test_filters_of_truth_values_times_and_wide_numbers(spark):
    df = spark.createDataFrame(
        [(True, 5, "2024-01-02"), (False, 6, "2023-05-05"), (None, None, None)], "b boolean, n long, d string"
    ).withColumn("t", F.col("d").cast("timestamp"))

    def kept(column, operator, value):
        return df.where(filter_condition(df, ChartFilter(column, operator, value))).count()

    assert (kept("b", "eq", "1"), kept("b", "eq", "false"), kept("b", "neq", "0"), kept("b", "eq", "x")) == (1, 1, 1, 0)
    assert (kept("t", "gte", "2024"), kept("t", "lt", "2024-01-02"), kept("t", "eq", "never")) == (1, 1, 0)
    assert kept("n", "lt", "99999999999999999999") == 2
    with pytest.raises(ChartSpecError):
        kept("n", "eq", "9" * 60)
    with pytest.raises(ChartSpecError):
        kept("n", "eq", "many")


# --- governed SQL -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def governed(spark):
    session = GovernedSession(spark)
    session.register("orders", lambda s: s.read.parquet(f"{SF}/orders.parquet"))
    session.register("lineitem", lambda s: s.read.parquet(f"{SF}/lineitem.parquet"))
    return session


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT count(*) AS n FROM orders",
        "  select 1 FROM Orders ;  ",
        "WITH a AS (SELECT * FROM orders), b AS (SELECT * FROM a) SELECT count(*) FROM b -- end",
        "/* note */ SELECT 'drop table; --' AS text FROM orders",
        'SELECT "o_orderkey" AS "update" FROM "orders"',
        "SELECT 1 FROM orders UNION ALL SELECT 2 FROM lineitem",
        "SELECT transform(array(1, 2), x -> x + 1) FROM orders",
        "SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)",
        "SELECT 'reflect(1)' AS reflect, 'identifier(x)' AS \"identifier\" FROM orders",
        "WITH " + ", ".join(f"c{i} AS (SELECT * FROM {f'c{i - 1}' if i else 'orders'})" for i in range(40))
        + " SELECT count(*) FROM c39",
        "SELECT r'\\' AS a, '[' AS b, 'it\\'s' AS c FROM orders",
    ],
)
def test_allowed(governed, sql):
    assert governed.execute(sql, 3, timeout=60).error is None


@pytest.mark.parametrize(
    "sql",
    [
        "",
        "   ;",
        "DROP TABLE orders",
        "INSERT INTO orders SELECT * FROM orders",
        "CREATE VIEW v AS SELECT 1",
        "SELECT 1 FROM orders; SELECT 2 FROM orders",
        "SELECT 1 FROM orders; DROP TABLE orders",
        "WITH a AS (SELECT 1) INSERT INTO orders SELECT * FROM a",
        "SELECT 1 FROM orders) x CROSS JOIN (SELECT 2",
        "SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`",
        "SELECT * FROM secrets",
        "SELECT * FROM orders JOIN default.secrets ON true",
        "SELECT 1",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM orders",
        "SELECT `java_method`('java.lang.System', 'lineSeparator') FROM orders",
        "SELECT TRANSFORM (o_orderkey) USING 'cat' AS (k) FROM orders",
        "EXPLAIN SELECT 1 FROM orders",
        "SET spark.sql.runSQLOnFiles=true",
        "SELECT * FROM orders /* open",
        "SELECT nothing FROM orders",
        "SELECT h.id FROM orders o JOIN IDENTIFIER('default.stored_t') h ON true",
        "SELECT * FROM orders, IDENTIFIER('global_temp.hidden')",
        "SELECT * FROM orders JOIN IDENTIFIER /* x */ ('default.' || 'stored_t') h ON true",
        "SELECT 'UnresolvedRelation [orders]' AS a",
        "SELECT 1 AS `UnresolvedRelation [orders]`",
        "SELECT r'\\', java_method('java.lang.System', 'lineSeparator') FROM orders",
    ],
)
def test_refused(governed, sql):
    found = governed.execute(sql, 3, timeout=60)
    assert found.error and not found.rows


def test_row_cap_and_flag(governed):
    found = governed.execute("SELECT o_orderkey FROM orders", 7, timeout=60)
    assert found.row_count == 7 and found.truncated and found.columns == [("o_orderkey", "bigint")]
    exact = governed.execute("SELECT o_orderkey FROM orders LIMIT 7", 7, timeout=60)
    assert exact.row_count == 7 and not exact.truncated
    with pytest.raises(GovernedQueryError):
        governed.frame("SELECT 1")


def test_slow_queries_are_stopped(governed):
    slow = "SELECT sum(sqrt(a.l_tax * b.l_tax * c.l_tax)) FROM lineitem a, lineitem b, lineitem c"
    started = time.time()
    assert governed.execute(slow, timeout=2).error == "the query took too long"
    assert time.time() - started < 30
    assert governed.execute("SELECT count(*) FROM orders", timeout=60).error is None


def test_other_views_of_the_parent_session_are_unknown(spark, governed):
    spark.range(3).createOrReplaceTempView("hidden_numbers")
    assert "not registered" in governed.execute("SELECT * FROM hidden_numbers", timeout=60).error


# --- as-of join ---------------------------------------------------------------------------------


def test_asof_join_against_brute_force(spark):
    rng = random.Random(3)
    key = lambda: rng.choice(["hot", "hot", "hot", "b", "c", None])
    left = [(key(), rng.choice([None, *[rng.randrange(10_000)] * 9]), i) for i in range(400)]
    times = rng.sample(range(10_000), 300)
    right = [(key(), t if t % 9 else None, f"r{t}") for t in times]

    def frame(rows, schema):
        return spark.createDataFrame(rows, schema).withColumn("t", F.timestamp_seconds("t"))

    found = asof_join(frame(left, "k string, t long, id int"),
                      frame(right, "k string, t long, name string"), ["k"], "t", slices=16)
    got = {r.id: r.right_name for r in found.collect()}
    assert len(got) == len(left)
    for k, t, i in left:
        known = k is not None and t is not None
        before = [(rt, name) for rk, rt, name in right if known and rk == k and rt is not None and rt <= t]
        assert got[i] == (max(before)[1] if before else None)


# --- history ------------------------------------------------------------------------------------


def test_history_round_trip(spark, tmp_path):
    path = str(tmp_path / "history")
    before = spark.createDataFrame([(1, "x"), (2, None), (3, "z"), (4, "z")], "a_id int, old string")
    after = spark.createDataFrame([(1, 5.0), (None, None)], "a_id int, fresh double")
    for day, df in (("2024-01-01", before), ("2024-01-02", after)):
        history.save_profile(path, profile(df, "t"), F.to_timestamp(F.lit(day)))
    history.save_profile(path, profile(before, "u"), F.to_timestamp(F.lit("2024-01-01")))
    saved = history.load_history(spark, path)
    assert saved.count() == 3
    listed = history.profile_history(saved, "t").collect()
    assert [str(r.created_at)[:10] for r in listed] == ["2024-01-02", "2024-01-01"]
    changes, score = history.profile_diff(saved, "t")
    found = {(r.change, r.column_name): r for r in changes.collect()}
    assert set(found) == {("new", "fresh"), ("removed", "old"), ("null_pct", "a_id")}
    assert found[("null_pct", "a_id")].null_pct_delta == 50.0
    expected = listed[0].quality_score - listed[1].quality_score
    assert score.first().quality_score_delta == expected
    with pytest.raises(ValueError):
        history.profile_diff(saved, "u")
    with pytest.raises(ValueError):
        history.profile_diff(saved, "t", "nope", listed[0].history_id)
    history.rewrite_pruned(spark, path, keep=1)
    spark.catalog.refreshByPath(path)
    kept = history.load_history(spark, path)
    assert {(r.dataset, str(r.created_at)[:10]) for r in kept.collect()} == {
        ("t", "2024-01-02"), ("u", "2024-01-01")}
    assert history.stale_profiles(kept).count() == 0
    assert history.stale_profiles(kept, version="v7").count() == 2


# --- sources ------------------------------------------------------------------------------------


def test_view_names():
    assert view_slug("My file (1)--v2", "ds_001") == "My_file_1_v2"
    assert view_slug("???", "ds_002") == "dataset_ds_002"
    assert view_slug("select", "ds_003", frozenset({"select"})) == "select_view"
    assert len(view_slug("x" * 300, "ds_004")) == 120
    wanted = [("a", "ds_001"), ("b", "ds_002"), ("b", "ds_003"), ("b", "ds_003")]
    assert view_names(wanted, {"a", "a_ds_001"}) == ["a_ds_001_2", "b", "b_ds_003", "b_ds_003_2"]


def test_quoted_line_breaks_are_read_back(spark, tmp_path):
    texts = ["x\ny", "ok", 'say "so",\nthen go', "\n", "tab\there"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for write, read in ((writers.export_csv, readers.scan_csv), (writers.export_tsv, readers.scan_tsv)):
        path = str(tmp_path / write.__name__)
        write(df, path)
        back = read(spark, path)
        assert back.schema == df.schema
        assert [r.text for r in back.orderBy("id").collect()] == texts


def test_register_folder(spark, tmp_path):
    (tmp_path / "b.csv").write_text("id,day\n1,2024-01-05\n2,2024-01-06\n")
    (tmp_path / "b.tsv").write_text("id\tname\n1\tx, y\n")
    (tmp_path / "a.jsonl").write_text('{"n": 1}\n{"n": 2}\n{"n": 3}\n')
    (tmp_path / "notes.txt").write_text("skip me")
    spark.range(5).write.parquet(str(tmp_path / "parts.parquet"))
    sub = tmp_path / "sub"
    sub.mkdir()
    (sub / "deep.json").write_text('[{"n": 1}, {"n": 2}]')
    flat = Catalog(spark)
    assert [d.file_name for d in flat.register_folder(str(tmp_path))] == [
        "a.jsonl", "b.csv", "b.tsv", "parts.parquet"]
    deep = Catalog(spark)
    entries = deep.register_folder(str(tmp_path), recursive=True)
    assert [d.view_name for d in entries] == ["a", "b", "b_ds_003", "parts", "deep"]
    deep.refresh_all_counts()
    counts = [deep.datasets[d.dataset] for d in entries]
    assert [(c.row_count, c.column_count) for c in counts] == [(3, 1), (2, 2), (1, 2), (5, 1), (2, 1)]
    assert dict(spark.table("b").dtypes) == {"id": "int", "day": "date"}
    assert spark.table("b_ds_003").first().name == "x, y"
    with pytest.raises(ValueError):
        deep.register_view(str(tmp_path / "notes.txt"))
    scores = spark.createDataFrame([("ds_001", 87.9)], "dataset string, quality_score double")
    listed = {r.dataset: r.quality_score for r in list_datasets(deep.frame(), scores).collect()}
    assert listed["ds_001"] == 87 and listed["ds_002"] is None


def test_exports_quote_what_needs_it(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 'say "hi", you', [1, 2]), (2, "", None), (3, None, [])], "id int, t string, n array<int>"
    )
    path = str(tmp_path / "out")
    writers.export_csv(df.coalesce(1), path)
    text = "".join(p.read_text() for p in Path(path).glob("*.csv"))
    assert text == 'id,t,n\n1,"say ""hi"", you","[1,2]"\n2,,\n3,,[]\n'
    back = readers.scan_csv(spark, path, "id int, t string, n string").orderBy("id").collect()
    assert [(r.id, r.t) for r in back] == [(1, 'say "hi", you'), (2, None), (3, None)]


def test_malformed_files_are_named(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n' * 150 + "{bad\n[1]\n")
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "binary.jsonl").write_bytes(b"\x00\x01\n\xff\xfe\n")
    found = {r.file_name: r for r in
             checks.malformed_record_scan(spark, str(tmp_path), json_lines=True).collect()}
    assert found["good.jsonl"].usable and found["good.jsonl"].content_lines == 2
    bad = found["bad.jsonl"]
    assert (bad.usable, bad.invalid_json, bad.not_an_object) == (False, 1, 1)
    assert found["empty.jsonl"].is_empty and not found["empty.jsonl"].usable
    assert found["binary.jsonl"].nul_byte == 1 and found["binary.jsonl"].invalid_utf8 == 1
    lines = checks.malformed_lines(spark, str(tmp_path / "bad.jsonl"), json_lines=True).collect()
    assert {(r.value, *r.problems) for r in lines} == {
        ("{bad", "invalid_json"), ("[1]", "not_an_object")}


def test_unreadable_parquet(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "t"))
    part = next((tmp_path / "t").glob("*.parquet"))
    (tmp_path / "t" / "broken.parquet").write_bytes(b"PAR1" + b"x" * 50)
    found = [r.file_name for r in checks.unreadable_parquet(spark, str(tmp_path / "t")).collect()]
    assert found == ["broken.parquet"] and part.exists()


def test_pages_neither_overlap_nor_skip(spark):
    df = spark.range(250).select((F.lit(249) - F.col("id")).alias("k"))
    pages = [[r.k for r in samples.sample_page(df, ["k"], p, 100).collect()] for p in (1, 2, 3)]
    assert [n for page in pages for n in page] == list(range(250))
    assert [r.k for r in samples.page_after(df, "k", 99, 5).collect()] == [100, 101, 102, 103, 104]
    for page, size in ((0, 10), (1, 501), (1, 0)):
        with pytest.raises(ValueError):
            samples.sample_page(df, ["k"], page, size)
    assert samples.lookup_by_value(df, "k", None).count() == 0


def test_count_reads_no_columns(spark):
    from tabulens.sources.catalog import metadata_row_count

    plan = metadata_row_count(spark.read.parquet(f"{SF}/lineitem.parquet"))
    assert "ReadSchema: struct<>" in plan._jdf.queryExecution().toString()
