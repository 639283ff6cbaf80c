"""The query engine over whichever tiers exist: one domain or many in one job."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostweave.operators import graph
from hostweave.plans import setup

log = logging.getLogger(__name__)

#: Targets that are looked up by literals in the sorted files, and neighbours that are looked up in ranges of ids.
POINT_TARGETS = 200
POINT_NEIGHBOURS = 10_000

LINK_COLUMNS = ("target", "direction", "ord", "domain", "rank", "position")


def one_of(column: str, values: list[str]) -> Column:
    """An IN of literals in short lists, as Parquet gets only the extremes of a long one."""
    values = sorted(set(values))
    return reduce(or_, [F.col(column).isin(values[i : i + 8]) for i in range(0, len(values), 8)])


@dataclass
class Report:
    """The answer for one domain."""

    domain: str
    reverse_domain: str
    found: bool
    metric: str
    node_id: int | None = None
    rank: float | None = None
    position: int | None = None
    inbound: list[dict] = field(default_factory=list)
    outbound: list[dict] = field(default_factory=list)
    inbound_total: int = 0
    outbound_total: int = 0
    outbound_degree: int = 0
    inbound_truncated: bool = False
    outbound_truncated: bool = False
    elapsed_ms: int = 0
    warnings: list[str] = field(default_factory=list)


class Engine:
    """Tiers: ``vertices`` and clean ``edges`` (lookup), ``ranks`` by id, ``inbound`` (the transpose).

    Without ``vertices`` nothing can be asked. Without ranks neighbours rank 0, without ``inbound`` who links to a
    domain is unknown unless ``transpose`` allows reading all edges for it.
    """

    def __init__(self, spark: SparkSession, vertices: DataFrame | None, edges: DataFrame | None = None, ranks: DataFrame | None = None, inbound: DataFrame | None = None, transpose: bool = True, notes: list[str] | None = None):
        self.spark, self.vertices, self.edges, self.ranks = spark, vertices, edges, ranks
        self.inbound = inbound if inbound is not None else edges if transpose else None
        self.notes = notes or []

    @property
    def capabilities(self) -> setup.Capabilities:
        return setup.Capabilities(lookup=self.vertices is not None, outbound=self.edges is not None, inbound=self.inbound is not None, ranks=self.ranks is not None)

    def node_count(self) -> int:
        return 0 if self.vertices is None else self.vertices.count()

    def resolve(self, domain: str) -> int | None:
        rows = self._found([domain])[0].collect()
        return rows[0].node_id if rows else None

    def _found(self, domains: list[str]) -> tuple[DataFrame, list[int] | None]:
        """ord, domain, rev, node_id of the targets; and their ids, if the targets are few.

        Few targets are looked up by literals, which reach the sorted files as pushed filters, and are a local
        table after that; many are joined.
        """
        if self.vertices is None:
            raise ValueError("tier lookup is not built: build it first")
        names = self.spark.createDataFrame(list(enumerate(domains)), "ord bigint, name string")
        targets = graph.targets_of(names)
        if len(domains) > POINT_TARGETS:
            return graph.resolve(self.vertices, targets, len(domains)), None
        wanted = targets.collect()
        ids: dict[str, int] = {}
        if wanted:
            rows = self.vertices.filter(one_of("rev", [t.rev for t in wanted])).select("id", "rev")
            ids = {r.rev: r.id for r in rows.groupBy("rev").agg(F.min("id").alias("id")).collect()}
        local = [(t.ord, t.domain, t.rev, ids.get(t.rev)) for t in wanted]
        return self.spark.createDataFrame(local, "ord bigint, domain string, rev string, node_id bigint"), sorted(ids.values())

    def links(self, domains: list[str], options: graph.Options = graph.Options()) -> DataFrame:
        """target, direction, ord, domain, rank, position: every link of every domain that the graph has."""
        found, ids = self._found(domains)
        return self._named(graph.capped(self._links(found, ids, len(domains), options), options.limit), found, ids, len(domains), options)

    def _links(self, found: DataFrame, ids: list[int] | None, rows: int, options: graph.Options) -> DataFrame:
        """direction, node_id, id of all links of the targets."""
        wanted = graph.Options(options.metric, options.limit, options.inbound and self.inbound is not None, options.outbound and self.edges is not None)
        edges, inbound = self.edges, self.inbound
        if ids is not None:
            edges = None if edges is None else edges.filter(graph.within("from_id", ids))
            inbound = None if inbound is None else inbound.filter(graph.within("to_id", ids))
        base = edges if edges is not None else inbound
        if base is None:
            base = self.spark.createDataFrame([], "from_id bigint, to_id bigint")
        return graph.neighbours(base, found.filter("node_id is not null"), rows, wanted, inbound)

    def _named(self, links: DataFrame, found: DataFrame, ids: list[int] | None, rows: int, options: graph.Options) -> DataFrame:
        """Links with names and ranks. Few neighbours are looked up in ranges of their ids, many are joined."""
        vertices, ranks = self.vertices, self.ranks
        if ids is not None:
            near = links.select("id").distinct().limit(POINT_NEIGHBOURS + 1).collect()
            if len(near) <= POINT_NEIGHBOURS:
                here = graph.within("id", [r.id for r in near])
                vertices, ranks = vertices.filter(here), None if ranks is None else ranks.filter(here)
        named = graph.named_and_ranked(links, vertices, ranks, options.metric)
        named = named.join(graph.maybe_broadcast(found.filter("node_id is not null").select("node_id", F.col("domain").alias("target")), rows), "node_id")
        return graph.with_order(named, "target", "direction").select(*LINK_COLUMNS)

    def headers(self, domains: list[str], options: graph.Options = graph.Options()) -> DataFrame:
        """A row a domain: found, id, own rank and position, totals and whether lists were cut."""
        found, ids = self._found(domains)
        return self._headers(self._links(found, ids, len(domains), options), found, ids, len(domains), options)

    def _headers(self, links: DataFrame, found: DataFrame, ids: list[int] | None, rows: int, options: graph.Options) -> DataFrame:
        out = found.join(graph.totals(links), "node_id", "left").fillna(0, ["inbound_total", "outbound_total"])
        if self.ranks is not None:
            ranks = self.ranks if ids is None else self.ranks.filter(graph.within("id", ids))
            own = ranks.select(F.col("id").alias("node_id"), F.col(options.metric.value).cast("double").alias("rank"), F.nullif(options.metric.position, F.lit(0)).alias("position"))
            own = own.join(graph.maybe_broadcast(found.select("node_id"), rows), "node_id", "left_semi")
            out = out.join(own, "node_id", "left").withColumn("rank", F.when(F.col("node_id").isNotNull(), F.coalesce("rank", F.lit(0.0))))
        else:
            out = out.withColumns({"rank": F.lit(None).cast("double"), "position": F.lit(None).cast("bigint")})
        limit = F.lit(options.limit)
        return out.select(
            "ord", "domain", F.col("rev").alias("reverse_domain"), F.col("node_id").isNotNull().alias("found"), "node_id", F.lit(options.metric.value).alias("metric"), "rank", "position",
            "inbound_total", F.least("outbound_total", limit).cast("bigint").alias("outbound_total"), F.col("outbound_total").alias("outbound_degree"),
            (F.col("inbound_total") > limit).alias("inbound_truncated"), (F.col("outbound_total") > limit).alias("outbound_truncated"),
        )

    def query_many(self, domains: list[str], options: graph.Options = graph.Options()) -> list[Report]:
        """Reports for a few domains, in the order given; each list is at most ``options.limit`` long."""
        started = time.monotonic()
        out = {}
        found, ids = self._found(domains)
        links = self._links(found, ids, len(domains), options)
        for h in self._headers(links, found, ids, len(domains), options).orderBy("ord").collect():
            d = h.asDict()
            d.pop("ord")
            out[d["domain"]] = Report(**d, warnings=setup.warnings(d["found"], self.capabilities, options.inbound, options.outbound, d["domain"]) + (self.notes if d["found"] else []))
        if any(r.found for r in out.values()):
            capped = graph.capped(links, options.limit).persist()  # named and counted, read once
            try:
                for row in self._named(capped, found, ids, len(domains), options).orderBy("target", "direction", "ord").toLocalIterator():
                    getattr(out[row.target], row.direction).append({"domain": row.domain, "rank": row.rank, "position": row.position})
                for r in capped.groupBy("node_id", "direction").agg(F.count(F.lit(1)).alias("n")).collect():
                    report = next(x for x in out.values() if x.node_id == r.node_id)
                    if lost := r.n - len(getattr(report, r.direction)):
                        report.warnings.append(f"{lost} {r.direction} neighbours of {report.domain} have no name in the vertices file")
            finally:
                capped.unpersist()
        for report in out.values():
            report.elapsed_ms = int(1000 * (time.monotonic() - started))
        return list(out.values())

    def query(self, domain: str, options: graph.Options = graph.Options()) -> Report:
        reports = self.query_many([domain], options)
        if not reports:
            raise ValueError(f"{domain!r} is not a domain name")
        return reports[0]
