"""Facts about the relations that decide what can be trusted: counts, extremes, order, unmatched rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Lines of a file within which one task judges their order.
STRETCH = 1 << 20


@dataclass(frozen=True)
class VertexSummary:
    node_count: int
    max_id: int
    sorted_by_name: bool
    sorted_by_id: bool

    @property
    def node_capacity(self) -> int:
        return self.max_id + 1


def order_breaks(df: DataFrame, columns: list[str]) -> DataFrame:
    """n_rows and for each column ``breaks_<column>``: rows that don't exceed the row before them along ``place``.

    Strings compare in byte order. Rows are judged within stretches of ``STRETCH`` lines at most, each of which
    reports its first and last value; then the stretches, a row each, are laid end to end.
    """
    stretch = [F.col("place.file_path").alias("file"), F.col("place.file_block_start").alias("block"), F.floor(F.col("place.line") / STRETCH).alias("part")]
    key = ["file", "block", "part"]
    rows = df.select(*stretch, F.col("place.line").alias("line"), *columns)
    along = Window.partitionBy(*key).orderBy("line")
    rows = rows.withColumns({f"breaks_{c}": (F.col(c) <= F.lag(c).over(along)).cast("bigint") for c in columns})
    ends = [f(c, "line").alias(f"{name}_{c}") for c in columns for name, f in (("first", F.min_by), ("last", F.max_by))]
    parts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"breaks_{c}").alias(f"breaks_{c}") for c in columns), *ends)
    over = Window.orderBy(*key)
    parts = parts.withColumns({f"gap_{c}": (F.col(f"first_{c}") <= F.lag(f"last_{c}").over(over)).cast("bigint") for c in columns})
    zero = F.lit(0).cast("bigint")
    found = [(F.coalesce(F.sum(f"breaks_{c}"), zero) + F.coalesce(F.sum(f"gap_{c}"), zero)).alias(f"breaks_{c}") for c in columns]
    return parts.agg(F.coalesce(F.sum("n"), zero).alias("n_rows"), *found)


def sortedness(df: DataFrame, columns: list[str]) -> dict[str, bool]:
    """For each column whether it strictly ascends along ``place``, in byte order for strings."""
    found = order_breaks(df, columns).first()
    return {c: found[f"breaks_{c}"] == 0 for c in columns}


def summarize_vertices(vertices: DataFrame) -> VertexSummary:
    facts = vertices.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m")).first()
    order = sortedness(vertices, ["rev", "id"])
    return VertexSummary(facts.n, -1 if facts.m is None else facts.m, order["rev"], order["id"])


def edge_summary(edges: DataFrame) -> DataFrame:
    """raw_edges, self_links, distinct_edges, max_from, max_to: exact, in one row."""
    grouped = edges.groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("raw_edges"),
        F.coalesce(F.sum(F.when(F.col("from_id") == F.col("to_id"), F.col("n"))), F.lit(0)).cast("bigint").alias("self_links"),
        F.count_if(F.col("from_id") != F.col("to_id")).alias("distinct_edges"),
        F.max("from_id").alias("max_from"), F.max("to_id").alias("max_to"),
    )


def rank_match(vertices: DataFrame, ranks: DataFrame) -> DataFrame:
    """rank_rows, matched_rows in one row; no match at all means the files are of different releases."""
    joined = ranks.select("rev").join(vertices.select("rev").distinct().withColumn("known", F.lit(True)), "rev", "left")
    return joined.agg(F.count(F.lit(1)).alias("rank_rows"), F.count("known").alias("matched_rows"))
