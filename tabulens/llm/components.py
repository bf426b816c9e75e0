"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; the component is its smallest node.

    In each round every node points at the node of least random rank among its neighbours and itself,
    and links are carried over to the nodes pointed at. As the ranks of a round are drawn anew, a
    fixed share of the nodes falls away in each, so the rounds grow as the logarithm of the longest
    chain. Each round is written to the shared folder. Self links make single nodes; null ends are
    dropped; an empty table gives an empty result.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna()
    current = written(links.distinct(), "links")
    rounds: list[DataFrame] = []
    while not current.isEmpty():
        seed = len(rounds)
        both = current.union(current.select(F.col("b"), F.col("a"))).toDF("node", "other")
        least = F.least(_ranked("node", seed), _ranked("other", seed))
        points = written(
            both.groupBy("node").agg(F.min(least).alias("least")).select("node", "least.id"),
            f"points{seed}",
        ).withColumnRenamed("id", "root")
        rounds.append(points)
        ends = points.withColumnsRenamed({"node": "a", "root": "ra"})
        carried = current.where("a <> b").join(ends, "a")
        ends = points.withColumnsRenamed({"node": "b", "root": "rb"})
        carried = carried.join(ends, "b").where("ra <> rb")
        current = written(
            carried.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            f"links{seed}",
        )
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    found = rounds[0]
    for points in rounds[1:]:
        later = points.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = found.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    names = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(names, "root").select("node", "component")


def _ranked(name: str, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(seed), F.col(name)).alias("rank"), F.col(name).alias("id"))
