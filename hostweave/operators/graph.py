"""Link operators over three relations: vertices(id, rev), edges(from_id, to_id), ranks by id or by name.

A batch of targets is answered at once: one pass finds both directions' neighbours, one join names them, one
ranks them. Rows stay flat, one a link, so a hub's millions of links are many rows and never one array.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostweave.functions import domains as D

#: Targets up to which their ids are broadcast (16 bytes each); beyond that joins shuffle.
BROADCAST_TARGETS = 500_000
DEFAULT_LIMIT = 20_000


class Metric(Enum):
    PAGERANK = "pagerank"
    HARMONIC = "harmonic"

    @classmethod
    def parse(cls, text: str) -> Metric:
        #: The accepted names of either metric.
        names = {"pagerank": cls.PAGERANK, "pr": cls.PAGERANK, "harmonic": cls.HARMONIC, "harmonicc": cls.HARMONIC}
        try:
            return names[text.strip().lower()]
        except KeyError:
            raise ValueError(f"unknown rank metric {text!r}: use pagerank or harmonic") from None

    @property
    def position(self) -> str:
        return f"{self.value}_position"


@dataclass(frozen=True)
class Options:
    metric: Metric = Metric.PAGERANK
    limit: int = DEFAULT_LIMIT
    inbound: bool = True
    outbound: bool = True


def clean_edges(edges: DataFrame) -> DataFrame:
    """Distinct links between different domains."""
    return edges.filter("from_id <> to_id").select("from_id", "to_id").distinct()


def node_ranks(vertices: DataFrame, ranks: DataFrame) -> DataFrame:
    """Ranks by id in single precision; zeros for a domain without a rank row."""
    joined = vertices.select("id", "rev").join(ranks, "rev", "left")
    value = [F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")).alias(c) for c in ("pagerank", "harmonic")]
    place = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("pagerank_position", "harmonic_position")]
    return joined.select("id", *value, *place)


def targets_of(names: DataFrame) -> DataFrame:
    """ord, domain, rev from (ord, name): cleaned, blanks and non-domains dropped, of equal domains the first."""
    t = names.filter(D.trim_unicode(F.col("name")) != "")
    t = t.select("ord", D.normalize_domain(F.col("name")).alias("domain"), D.to_reverse(F.col("name")).alias("rev")).filter("rev <> ''")
    return t.groupBy("rev").agg(F.min_by(F.struct("ord", "domain"), "ord").alias("t")).select("t.ord", "t.domain", "rev")


def maybe_broadcast(df: DataFrame, rows: int, most: int = BROADCAST_TARGETS) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def resolve(vertices: DataFrame, targets: DataFrame, rows: int) -> DataFrame:
    """Targets with node_id; null where the graph lacks the domain. Of repeated names the least id."""
    found = vertices.select("id", "rev").join(maybe_broadcast(targets.select("rev"), rows), "rev").groupBy("rev").agg(F.min("id").alias("node_id"))
    return targets.join(found, "rev", "left")


def missing(vertices: DataFrame, targets: DataFrame) -> DataFrame:
    return targets.join(vertices.select("rev"), "rev", "left_anti")


def neighbours(edges: DataFrame, found: DataFrame, rows: int, options: Options = Options(), inbound: DataFrame | None = None) -> DataFrame:
    """direction, node_id, id of every link of the found nodes, from clean edges (and their transpose, if stored)."""
    nodes = maybe_broadcast(found.select("node_id"), rows)
    none = edges.select(F.lit("").alias("direction"), F.col("from_id").alias("node_id"), F.col("to_id").alias("id")).limit(0)
    out = []
    if options.inbound:
        back = inbound if inbound is not None else edges
        out.append(back.join(nodes, back.to_id == nodes.node_id).select(F.lit("inbound").alias("direction"), "node_id", F.col("from_id").alias("id")))
    if options.outbound:
        out.append(edges.join(nodes, edges.from_id == nodes.node_id).select(F.lit("outbound").alias("direction"), "node_id", F.col("to_id").alias("id")))
    return out[0].unionAll(out[1]) if len(out) == 2 else out[0] if out else none


def raw_neighbours(edges: DataFrame, found: DataFrame, rows: int) -> DataFrame:
    """What ``neighbours`` gives in both directions, from raw edges in one scan: only links of targets are made distinct."""
    here, there = (maybe_broadcast(found.select(F.col("node_id").alias(c)), rows) for c in ("source", "goal"))
    e = edges.filter("from_id <> to_id").join(here, F.col("from_id") == F.col("source"), "left").join(there, F.col("to_id") == F.col("goal"), "left")
    link = [F.struct(F.lit(d).alias("direction"), F.col(n).alias("node_id"), F.col(o).alias("id")) for d, n, o in (("inbound", "goal", "from_id"), ("outbound", "source", "to_id"))]
    links = e.filter("source is not null or goal is not null").select(F.explode(F.array(*link)).alias("link")).select("link.*")
    return links.filter("node_id is not null").distinct()


def ranges(ids: list[int], most: int = 64) -> list[tuple[int, int]]:
    """At most ``most`` closed ranges that hold all ids, parted at the widest gaps."""
    ids = sorted(set(ids))
    if not ids:
        return []
    gaps = sorted(range(1, len(ids)), key=lambda i: ids[i - 1] - ids[i])[: most - 1]
    starts = [0, *sorted(gaps)]
    return [(ids[i], ids[j - 1]) for i, j in zip(starts, [*starts[1:], len(ids)], strict=True)]


def within(column: str, ids: list[int]) -> Column:
    """Whether a column lies in the ranges of ids: a condition of literals, which prunes row groups of sorted files."""
    parts = [F.col(column) == low if low == high else F.col(column).between(low, high) for low, high in ranges(ids)]
    return reduce(or_, parts) if parts else F.lit(False)


def capped(links: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` links of a node and direction by ascending neighbour id, before any ranking."""
    w = Window.partitionBy("direction", "node_id").orderBy("id")
    return links.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= limit).drop("nth")


def totals(links: DataFrame) -> DataFrame:
    return links.groupBy("node_id").agg(
        F.count_if(F.col("direction") == "inbound").alias("inbound_total"), F.count_if(F.col("direction") == "outbound").alias("outbound_total")
    )


def named_and_ranked(links: DataFrame, vertices: DataFrame, by_id: DataFrame | None, metric: Metric) -> DataFrame:
    """direction, node_id, domain, rank, position; neighbours without a name drop out, without a rank are 0."""
    out = links.join(vertices.select("id", "rev"), "id")
    if by_id is not None:
        out = out.join(by_id.select("id", F.col(metric.value).cast("double").alias("rank"), F.nullif(F.col(metric.position), F.lit(0)).alias("position")), "id", "left")
    else:
        out = out.withColumns({"rank": F.lit(0.0), "position": F.lit(None).cast("bigint")})
    return out.select("direction", "node_id", D.from_reverse(F.col("rev")).alias("domain"), F.coalesce("rank", F.lit(0.0)).alias("rank"), "position")


def with_order(rows: DataFrame, *keys: str) -> DataFrame:
    """Adds ord: strongest first, equal ranks by name in byte order."""
    w = Window.partitionBy(*keys).orderBy(F.desc("rank"), "domain")
    return rows.withColumn("ord", F.row_number().over(w).cast("bigint"))


def degrees(edges: DataFrame, end: str) -> DataFrame:
    """id, degree over clean edges: ``to_id`` for in-degrees, ``from_id`` for out-degrees."""
    return edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def top_by_degree(deg: DataFrame, n: int) -> DataFrame:
    return deg.orderBy(F.desc("degree"), "id").limit(n)


def scan_ranks(links: DataFrame, vertices: DataFrame, ranks: DataFrame, metric: Metric) -> DataFrame:
    """The index-free path: names first, then ranks by name in double precision; positions stay unknown."""
    out = links.join(vertices.select("id", "rev"), "id").join(ranks.select("rev", F.col(metric.value).cast("double").alias("rank")), "rev", "left")
    return out.select("direction", "node_id", D.from_reverse(F.col("rev")).alias("domain"), F.coalesce("rank", F.lit(0.0)).alias("rank"))


def contains_filter(domain: Column, needle: str) -> Column:
    return F.contains(domain, F.lit(needle.strip().lower()))
