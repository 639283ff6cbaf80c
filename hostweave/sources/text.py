"""The graph's three text files as DataFrames: permissive, line by line, plain or gzip.

Lines end at ``\\n`` only and lose one ``\\r``. What can't be parsed is skipped, never an error. Gzip is one
partition to Spark; its rows are not dealt out here, as whoever sorts, groups or filters them does that better.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ID = 4294967295
_FLOAT = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
_INF = r"(?i)\A[+-]?inf(inity)?\z"

#: Names under which the header of a ranks file lists its columns.
RANK_COLUMNS = {
    "harmonicc_pos": "harmonic_position", "harmonic_pos": "harmonic_position",
    "harmonicc_val": "harmonic", "harmonic_val": "harmonic", "harmonic": "harmonic",
    "pr_pos": "pagerank_position", "pagerank_pos": "pagerank_position",
    "pr_val": "pagerank", "pagerank": "pagerank", "pr": "pagerank",
    "host_rev": "rev", "domain_rev": "rev", "rev_host": "rev", "rev_domain": "rev",
}


@dataclass(frozen=True)
class RankLayout:
    """Which tab field holds what; the defaults hold without a header."""

    harmonic_position: int = 0
    harmonic: int = 1
    pagerank_position: int = 2
    pagerank: int = 3
    rev: int = 4

    @classmethod
    def from_header(cls, line: str) -> RankLayout:
        found = {}
        for i, name in enumerate(line.lstrip("#").rstrip("\r").split("\t")):
            if key := RANK_COLUMNS.get(name.strip().lstrip("#").lower()):
                found[key] = i
        return cls(**found)

    @property
    def last(self) -> int:
        return max(self.harmonic_position, self.harmonic, self.pagerank_position, self.pagerank, self.rev)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value and place (the order of lines within the file) of every valid line that is no comment and not blank."""
    df = spark.read.option("lineSep", "\n").text(path)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("line"))
    df = df.filter(F.is_valid_utf8("value"))  # before any string function, which would mend the bytes
    return df.select(F.regexp_replace("value", "\r\\z", "").alias("value"), place.alias("place")).filter("value <> ''")


def u32(c: Column) -> Column:
    """An unsigned 32-bit number written in ASCII digits, else null."""
    n = F.when(c.rlike(r"\A[0-9]+\z"), c.try_cast("decimal(38,0)"))
    return F.when(n <= MAX_ID, n.cast("bigint"))


def f64(c: Column) -> Column:
    """A decimal float with or without exponent; infinities; NaN and anything else null."""
    return F.when(c.rlike(_FLOAT), c.try_cast("double")).when(c.rlike(_INF), F.when(c.startswith("-"), float("-inf")).otherwise(float("inf")))


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """id, rev of lines ``id <tab> name [<tab> more]``."""
    parts = F.split("value", "\t")
    df = lines(spark, path).filter(~F.col("value").startswith("#"))
    df = df.select(u32(parts[0]).alias("id"), F.try_element_at(parts, F.lit(2)).alias("rev"), "place")
    return df.filter("id is not null and rev is not null and rev <> ''")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """from_id, to_id of lines whose first field is a number and whose second begins with one."""
    pattern = r"\A([0-9]+)\t([0-9]+)"
    df = lines(spark, path).select(u32(F.regexp_extract("value", pattern, 1)).alias("from_id"), u32(F.regexp_extract("value", pattern, 2)).alias("to_id"))
    return df.filter("from_id is not null and to_id is not null")


def rank_layout(spark: SparkSession, path: str) -> RankLayout:
    """The layout that the first comment line names; it heads the file, so reading stops at the first one found."""
    first = lines(spark, path).filter(F.col("value").startswith("#")).select("value").head(1)
    return RankLayout.from_header(first[0].value) if first else RankLayout()


def read_ranks(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame:
    """rev, pagerank, harmonic (doubles), pagerank_position, harmonic_position; of repeated names the last line.

    ``only``: names (rev) beyond which no row is shuffled.
    """
    at = rank_layout(spark, path)
    parts = F.split("value", "\t")
    df = lines(spark, path).filter(~F.col("value").startswith("#")).filter(F.size(parts) > at.last)

    def value(i: int) -> Column:
        return F.coalesce(f64(parts[i]), F.lit(0.0))

    def position(i: int) -> Column:
        return F.coalesce(u32(parts[i]), F.lit(0)).cast("bigint")

    row = F.struct(value(at.pagerank).alias("pagerank"), value(at.harmonic).alias("harmonic"), position(at.pagerank_position).alias("pagerank_position"), position(at.harmonic_position).alias("harmonic_position"))
    df = df.select(parts[at.rev].alias("rev"), row.alias("row"), "place").filter("rev <> ''")
    if only is not None:
        df = df.join(only.select("rev"), "rev", "left_semi")
    return df.groupBy("rev").agg(F.max_by("row", "place").alias("row")).select("rev", "row.*")


def crawl_of(path: str) -> str | None:
    """The release's id in a file name ``cc-…-domain-…``."""
    import re

    name = re.split(r"[/\\]", path)[-1]
    found = re.match(r"(cc-.*?)-domain-", name)
    return found[1] if found else None
