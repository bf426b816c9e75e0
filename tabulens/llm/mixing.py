"""Mixing sources by temperature, realised as permutations of blocks within a budget of tokens.

A source with share p of all tokens gets the weight p ** a, normalised. The exponent a is the least
one from 0 (all alike) to 1 (as they are) at which the weights are no more even than the target and no
source repeats more than the limit. A source's budget is its weight of the whole; it is spent on whole
rounds over the source and a last one that ends where the budget does. In each round the blocks of a
source come in a new order, and so do the documents of a block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import text_of, written

# How far the entropy of the weights may go from that of the shares (0) to the highest there is (1),
# and how often a document may be used at most.
EVENNESS, REPEATS = 0.8, 2.0
# A source of t tokens has sqrt(t) / SPREAD blocks of SPREAD * sqrt(t) tokens, so that neither the list of its
# blocks nor the one block that its budget cuts grows as the source does.
SPREAD = 16
CUTS, TURNS = 32, 5


def n_tokens(text_col: str = "text") -> Column:
    """Words between white space, at least 1: the tokens that shares and budgets are counted in."""
    return F.greatest(F.lit(1), F.regexp_count(text_of(text_col), F.lit(r"\S+"))).cast("long")


def source_of(source_col: str = "source") -> Column:
    return F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))


def exponent(shares: DataFrame, evenness: float = EVENNESS, repeats: float = REPEATS) -> float:
    """The least exponent that ``shares(source, share)`` may be raised to.

    Entropy falls and repetition falls as the exponent rises, so the bound is found by cutting the
    range into ``CUTS`` parts, ``TURNS`` times. Sums over sources stay in Spark, however many.
    """
    p = F.col("share")
    told = shares.agg(
        F.count("*"), F.min("share"), F.max("share"), -F.sum(p * F.log(p))
    ).first()
    n, least, most, entropy = told
    if not n or n < 2:
        return 1.0
    target = entropy + evenness * (math.log(n) - entropy)
    # Budgets are such that the source used least is used once; see ``source_weights``.
    low, high = 0.0, 1.0
    if most > least:
        low = max(low, 1 - math.log(repeats) / math.log(most / least))
    if low >= high:
        return 1.0
    for _ in range(TURNS):
        tried = [low + (high - low) * k / CUTS for k in range(CUTS + 1)]
        raised = shares.select(p, F.explode(F.array(*map(F.lit, tried))).alias("a"))
        power = F.pow(p, F.col("a"))
        found = raised.groupBy("a").agg(F.sum(power).alias("s"), F.sum(power * F.log(p)).alias("t"))
        even = {a: math.log(s) - a * t / s for a, s, t in found.collect()}
        first = next((k for k, a in enumerate(tried) if even[a] <= target), CUTS)
        if first == 0:
            return low
        low, high = tried[first - 1], tried[first]
    return high


def source_weights(
    counted: DataFrame, evenness: float = EVENNESS, repeats: float = REPEATS, budget: float | None = None
) -> DataFrame:
    """``source, tokens, share, weight, budget`` from ``counted(source, tokens)``.

    Without a ``budget`` of tokens for the whole mixture it is the least at which every document is
    used at least once; then none is used more often than ``repeats`` rounds up to.
    """
    whole = counted.agg(F.sum("tokens")).first()[0] or 0
    shares = counted.withColumn("share", F.col("tokens") / F.lit(float(whole)))
    a = exponent(shares, evenness, repeats)
    raised = shares.withColumn("raised", F.pow("share", F.lit(a)))
    total, need = raised.agg(F.sum("raised"), F.max(F.col("tokens") / F.col("raised"))).first()
    size = float(budget) if budget is not None else float((need or 0) * (total or 0))
    return raised.withColumn("weight", F.col("raised") / F.lit(total or 1.0)).select(
        "source", "tokens", "share", "weight", (F.col("weight") * F.lit(size)).alias("budget")
    )


def _unit(*parts: Column) -> Column:
    """A number from 0 up to 1 drawn by the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def block_plan(docs: DataFrame, seed: int, **targets: float | None) -> tuple[DataFrame, DataFrame]:
    """The blocks with their rounds, and the sources with their number of blocks.

    ``docs`` has ``mix_source``, ``mix_mark`` and ``mix_tokens``; only these are shuffled.
    """
    narrow = written(docs.select("mix_source", "mix_mark", "mix_tokens"), "mix")
    counted = narrow.groupBy(F.col("mix_source").alias("source")).agg(F.sum("mix_tokens").alias("tokens"))
    weights = source_weights(written(counted, "sources"), **targets)
    rounds = F.floor(F.col("budget") / F.col("tokens") + 1e-9).cast("int")
    sources = written(
        weights.select(
            "*",
            rounds.alias("rounds"),
            F.ceil(F.sqrt("tokens") / SPREAD).cast("int").alias("blocks"),
        ).withColumn("rest", F.col("budget") - F.col("rounds") * F.col("tokens")),
        "weights",
    )
    placed = narrow.join(sources.withColumnRenamed("source", "mix_source"), "mix_source").withColumn(
        "block", block_of(seed)
    )
    sizes = placed.groupBy("mix_source", "block", "rounds", "rest", "budget", "tokens", "weight").agg(
        F.sum("mix_tokens").alias("block_tokens")
    )
    # In its last round a source's blocks are used up to the budget.
    order = Window.partitionBy("mix_source").orderBy(F.xxhash64(F.lit(seed), "rounds", "block"), "block")
    upto = F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    sizes = sizes.withColumn("room", F.col("rest") - (upto - F.col("block_tokens")))
    sizes = written(sizes, "blocks")
    cut = sizes.where("room > 0 AND room < block_tokens").select("mix_source", "block", "room")
    # Equal rows share their place, so they are one row of the window.
    within = (
        placed.join(cut, ["mix_source", "block"])
        .groupBy("mix_source", "block", "room", unit_of(seed, F.col("rounds")).alias("at"))
        .agg(F.sum("mix_tokens").alias("mix_tokens"))
    )
    taken = Window.partitionBy("mix_source").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    ends = (
        within.withColumn("used", F.sum("mix_tokens").over(taken))
        .where("used <= room")
        .groupBy("mix_source", "block")
        .agg(F.max("at").alias("last"))
    )
    whole = F.when(F.col("room") >= F.col("block_tokens"), 1.0).otherwise(-1.0)
    plan = sizes.join(ends, ["mix_source", "block"], "left").select(
        "mix_source", "block", "rounds", "budget", "weight", "tokens", "block_tokens",
        F.coalesce("last", whole).alias("last"),
    )
    return written(plan, "plan"), sources


def block_of(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), "mix_mark"), F.col("blocks")).cast("int")


def unit_of(seed: int, turn: Column) -> Column:
    """Where a document comes in its block in a round."""
    return _unit(F.lit(seed), F.lit("document"), turn, F.col("mix_mark"))


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 1,
    evenness: float = EVENNESS,
    repeats: float = REPEATS,
    budget: float | None = None,
) -> DataFrame:
    """``mix_row``, a struct of a row of ``docs``, as often as the mixture uses it, with five columns about its use.

    ``mix_source``, ``mix_tokens``, ``mix_weight``, ``mix_round`` (from 0) and ``mix_position``: sorted
    by it, from 0 to 1, the rows are the mixture, each source spread over the whole. Null and empty
    sources are one source, null and empty texts count one token. Rows that are equal in id and text
    share their place. An empty table gives an empty result.
    """
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row"),
        source_of(source_col).alias("mix_source"),
        F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("mix_mark"),
        n_tokens(text_col).alias("mix_tokens"),
    )
    plan, sources = block_plan(marked, seed, evenness=evenness, repeats=repeats, budget=budget)
    blocks = sources.select(F.col("source").alias("mix_source"), "blocks")
    placed = marked.join(blocks, "mix_source").withColumn("block", block_of(seed)).drop("blocks")
    # A round's blocks come in an order of their own; a block starts where those before it end.
    turns = plan.withColumn("mix_round", F.explode(F.sequence(F.lit(0), F.col("rounds"))))
    turns = turns.where("mix_round < rounds OR last >= 0")
    order = Window.partitionBy("mix_source", "mix_round").orderBy(F.xxhash64(F.lit(seed), "mix_round", "block"), "block")
    before = F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_tokens")
    turns = turns.withColumn("before", F.col("mix_round") * F.col("tokens") + before)
    used = turns.groupBy("mix_source", "block").agg(
        F.collect_list(F.struct("mix_round", "before", "block_tokens", "budget", "weight", "rounds", "last")).alias("turns")
    )
    joined = placed.join(used, ["mix_source", "block"]).withColumn("turn", F.explode("turns")).drop("turns")
    at = unit_of(seed, F.col("turn.mix_round"))
    joined = joined.where((F.col("turn.mix_round") < F.col("turn.rounds")) | (at <= F.col("turn.last")))
    return joined.select(
        "mix_row",
        "mix_source",
        "mix_tokens",
        F.col("turn.weight").alias("mix_weight"),
        F.col("turn.mix_round").alias("mix_round"),
        F.least(
            F.lit(1.0), (F.col("turn.before") + at * F.col("turn.block_tokens")) / F.col("turn.budget")
        ).alias("mix_position"),
    )


USE = ("mix_source", "mix_tokens", "mix_weight", "mix_round", "mix_position")


def mixed(docs: DataFrame, **options: str | float | None) -> DataFrame:
    """The rows of ``mixture`` with the columns of ``docs`` on their own; those named as one of ``USE`` are replaced."""
    own = [F.col("mix_row").getField(c).alias(c) for c in docs.columns if c not in USE]
    return mixture(docs, **options).select(*own, *USE)
