"""Connected components of large graphs by alternating large-star and small-star steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.lineage import discard
from plumbline.llm.store import new_path

MOST_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the smallest node it is linked to directly or not, for every node of ``edges`` but the roots.

    Loops, repeated edges and edges in both directions are fine; edges with a null end are ignored. Every step only takes
    minima per node, combined before the shuffle, and joins them back to the edges, which adaptive execution can split, so
    a node with a large share of all edges does not end in one task. Each round is written to the shared folder; the rounds
    grow with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    root = new_path(spark, "components")

    written: list[str] = []

    def write(df: DataFrame) -> DataFrame:
        """Write a round's edges; those of the round before are no longer needed then."""
        path = f"{root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        for old in written:
            discard(spark, old)
        written[:] = [path]
        return spark.read.schema(df.schema).parquet(path)

    # every edge as (larger, smaller)
    links = write(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a).isNull() | F.col(b).isNull()).alias("bad")).where("not bad and u <> v").select("u", "v").distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: a node's larger neighbours are linked to its smallest
        large = links.select(F.col("v").alias("u"), F.col("u").alias("far")).join(least, "u").select(F.col("far").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: its smaller neighbours are linked to the smallest of them, and so is the node
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        links = write(large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
