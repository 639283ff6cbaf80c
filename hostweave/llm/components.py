"""Connected components of an edge table by alternating large and small stars.

Every round is two grouped minima and two equi-joins over edges, which deal a node of very many edges out to
several tasks; nothing is collected but a count and a checksum by which the end is seen. Rounds are written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _support as S


def _star(edges: DataFrame, n: int) -> DataFrame:
    """One large star and one small star over ``n`` edges (u > v). Nodes of many edges are dealt out."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("m"), F.count_if(F.col("y") > F.col("x")).alias("n")).select("x", F.least("x", "m").alias("m"), "n")
    large = S.salted_join(both.filter("y > x"), least, ["x"], n, ["y"]).select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    small = S.salted_join(large, low, ["u"], n, ["v"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.select("u", F.col("m").alias("v")).unionAll(small).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (least node that links reach, itself included) of every node that an edge names.

    Loops, repeated edges and edges with a null end are ignored; no edge gives an empty table.
    """
    edges = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, mark = S.cut(edges, "edges"), None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if seen.n == 0 or (seen.n, seen.h) == mark:
            break
        mark, before = (seen.n, seen.h), now
        now = S.cut(_star(before, seen.n), "edges")
        S.discard(before)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
