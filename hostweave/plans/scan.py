"""The index-free answer for a batch of targets: the text files are read, joined and forgotten.

Names are resolved before ranks and counted as found, ranks stay in double precision, positions are unknown.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostweave.functions.domains import from_reverse
from hostweave.operators import graph
from hostweave.plans import report
from hostweave.plans.engine import Report
from hostweave.plans.progress import Progress
from hostweave.sources import text


def scan_links(spark: SparkSession, sources: dict[str, str], domains: list[str], metric: graph.Metric = graph.Metric.PAGERANK) -> tuple[DataFrame, DataFrame]:
    """Headers (ord, domain, rev, node_id, rank) and links (target, direction, ord, domain, rank)."""
    names = spark.createDataFrame(list(enumerate(domains)), "ord bigint, name string")
    vertices = text.read_vertices(spark, sources["vertices"]).select("id", "rev")
    found = graph.resolve(vertices, graph.targets_of(names), len(domains))
    known = found.filter("node_id is not null")
    links = graph.raw_neighbours(text.read_edges(spark, sources["edges"]), known, len(domains))
    return _ranked(spark, sources, found, links.join(vertices, "id"), len(domains), metric)


def _ranked(spark: SparkSession, sources: dict[str, str], found: DataFrame, named: DataFrame, rows: int, metric: graph.Metric) -> tuple[DataFrame, DataFrame]:
    """Headers and links from named links (direction, node_id, id, rev); only rank rows of their names are shuffled."""
    known = found.filter("node_id is not null")
    ranks = text.read_ranks(spark, sources["ranks"], named.select("rev").unionAll(known.select("rev")).distinct())
    ranks = ranks.select("rev", F.col(metric.value).alias("rank"))
    headers = found.join(ranks, "rev", "left").withColumn("rank", F.when(F.col("node_id").isNotNull(), F.coalesce("rank", F.lit(0.0))))
    links = named.join(ranks, "rev", "left").select("direction", "node_id", from_reverse(F.col("rev")).alias("domain"), F.coalesce("rank", F.lit(0.0)).alias("rank"))
    links = links.join(graph.maybe_broadcast(known.select("node_id", F.col("domain").alias("target")), rows), "node_id")
    return headers, graph.with_order(links, "target", "direction").select("target", "direction", "ord", "domain", "rank")


def run(spark: SparkSession, sources: dict[str, str], domains: list[str], folder: str, metric: graph.Metric = graph.Metric.PAGERANK, progress: Progress | None = None) -> list[str]:
    """Write a result file for each target, stubs for absent ones; returns the sorted paths.

    Each progress stage is a job of its own. Result files are written as their links arrive, so the driver holds
    no list of them.
    """
    progress = progress or Progress()
    with progress.jobs(spark):
        progress.stage("vertices_targets", "targets", 0.0, 0.1)
        names = spark.createDataFrame(list(enumerate(domains)), "ord bigint, name string")
        vertices = text.read_vertices(spark, sources["vertices"]).select("id", "rev")
        rows = graph.resolve(vertices, graph.targets_of(names), len(domains)).collect()  # a row a target
        found = spark.createDataFrame(rows, "rev string, ord bigint, domain string, node_id bigint") if rows else graph.targets_of(names).withColumn("node_id", F.lit(None).cast("bigint"))
        progress.finish_stage()
        progress.stage("edges", "links", 0.1, 0.4)
        links = graph.raw_neighbours(text.read_edges(spark, sources["edges"]), found.filter("node_id is not null"), len(domains)).persist()
        links.count()
        progress.finish_stage()
        progress.stage("vertices_neighbors", "names of neighbours", 0.5, 0.2)
        named = links.join(vertices, "id").persist()
        named.count()
        progress.finish_stage()
        progress.stage("ranks", "ranks", 0.7, 0.25)
        headers, ranked = _ranked(spark, sources, found, named, len(domains), metric)
        reports = {h.domain: Report(h.domain, h.rev, h.node_id is not None, metric.value, h.node_id, h.rank) for h in headers.collect()}
        progress.finish_stage()
        progress.stage("writing", "results", 0.95, 0.05, max(1, len(reports)))
        out = []
        for target, entries in groupby(_checked(ranked.orderBy("target", "direction", "ord").toLocalIterator(), progress), lambda r: r.target):
            out.append(report.save_stream(reports.pop(target), folder, ((r.direction, {"domain": r.domain, "rank": r.rank}) for r in entries), "scan"))
            progress.advance()
        for r in reports.values():  # without links, or not in the graph
            out.append(report.save_stream(r, folder, (), "scan"))
            progress.advance()
        links.unpersist()
        named.unpersist()
        progress.finish_stage()
    return sorted(out)


def _checked(rows: Iterator, progress: Progress) -> Iterator:
    for row in rows:
        progress.check()
        yield row
