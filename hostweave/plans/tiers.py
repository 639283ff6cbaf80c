"""Materialised tiers as sorted Parquet, a JSON manifest, freshness by source fingerprints.

``lookup`` holds vertices sorted by name and clean links sorted by source, ``ranks`` ranks by id, ``inbound``
links sorted by destination. Sorting is by range partitions, so row-group statistics let a filter on the key
read a few row groups. Every build of a tier has a folder of its own, which counts once the manifest names it;
the manifest is replaced in one step, and only then the folder before is deleted.
"""

from __future__ import annotations

import json
import logging
import os
import shutil
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostweave.operators import graph, quality
from hostweave.plans import setup
from hostweave.plans.engine import Engine
from hostweave.plans.progress import Progress
from hostweave.sources import text

log = logging.getLogger(__name__)

FORMAT = 1
#: The sources that a tier's answers depend on.
DEPENDS = {"lookup": ("vertices", "edges"), "ranks": ("vertices", "ranks"), "inbound": ("vertices", "edges")}
#: Rows of a Parquet row group, the unit that a point lookup reads.
ROW_GROUP_BYTES = 16 << 20


def fingerprint(path: str) -> dict:
    known = os.path.isfile(path)
    return {"path": path, "size": os.path.getsize(path) if known else 0, "modified": int(os.path.getmtime(path)) if known else None}


def parse_tiers(names: list[str]) -> list[str]:
    """Tier names in build order, without repeats; none or ``all`` means all."""
    wanted = [n.strip().lower() for n in names if n.strip()]
    if not wanted or "all" in wanted:
        return list(setup.TIERS)
    for n in wanted:
        if n not in setup.TIERS:
            raise ValueError(f"unknown tier {n!r}: use {', '.join(setup.TIERS)} or all")
    return [t for t in setup.TIERS if t in wanted]


@dataclass(frozen=True)
class TierStatus:
    key: str
    state: str
    bytes: int
    estimated_bytes: int
    estimated_temp_bytes: int
    built_at: str | None


@dataclass(frozen=True)
class Status:
    root: str
    node_count: int
    edge_count: int
    total_bytes: int
    free_bytes: int
    tiers: tuple[TierStatus, ...]
    sources: tuple[dict, ...]
    blockers: tuple[str, ...]
    crawl: str


class Store:
    """Tiers below ``root``, a folder that driver and executors share; sources by kind."""

    def __init__(self, spark: SparkSession, root: str, sources: dict[str, str]):
        self.spark, self.root, self.sources = spark, root, sources

    # ---- manifest

    @property
    def _manifest(self) -> str:
        return os.path.join(self.root, "index.json")

    def load(self) -> dict:
        """The manifest; one that is missing, broken or of another format counts as absent."""
        empty = {"format": FORMAT, "node_count": 0, "node_capacity": 0, "edge_count": 0, "quality": {}, "tiers": {}}
        try:
            with open(self._manifest, encoding="utf-8") as f:
                found = json.load(f)
            return empty | found if found.get("format") == FORMAT else empty
        except (OSError, ValueError, AttributeError):
            return empty

    def save(self, meta: dict) -> None:
        os.makedirs(self.root, exist_ok=True)
        part = f"{self._manifest}.part"
        with open(part, "w", encoding="utf-8") as f:
            json.dump(meta, f, indent=2, ensure_ascii=False)
        os.replace(part, self._manifest)

    # ---- state

    def _folder(self, tier: str, meta: dict | None = None) -> str:
        record = (meta or self.load())["tiers"].get(tier) or {}
        return os.path.join(self.root, record.get("folder", tier))

    def _fingerprints(self, tier: str) -> list[dict]:
        return [fingerprint(self.sources[k]) for k in DEPENDS[tier]]

    def state(self, tier: str, meta: dict | None = None) -> str:
        record = (meta or self.load())["tiers"].get(tier)
        if record is None or not os.path.isdir(self._folder(tier, meta)):
            return "missing"
        return "ready" if record["sources"] == self._fingerprints(tier) else "stale"

    def bytes(self, tier: str) -> int:
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(self._folder(tier)) for f in names)

    def free(self) -> int:
        """Free bytes below the nearest folder that exists; 0 if unknown."""
        probe = os.path.abspath(self.root)
        while not os.path.exists(probe):
            parent = os.path.dirname(probe)
            if parent == probe:
                return 0
            probe = parent
        try:
            return shutil.disk_usage(probe).free
        except OSError:
            return 0

    def sizes(self) -> setup.SourceSizes:
        return setup.SourceSizes.of(self.sources)

    def crawl(self) -> str:
        return next((c for c in map(text.crawl_of, self.sources.values()) if c), setup.DEFAULT_CRAWL)

    def blockers(self) -> list[str]:
        """Missing sources. Packed ones are read as they are, so they block nothing."""
        out = []
        for kind, path in self.sources.items():
            if not os.path.isfile(path):
                size = next(f[1] for f in setup.FILES if f[0] == kind)
                out.append(f"no file {kind}: download {setup.file_name(self.crawl(), kind)}.gz ({setup.human(size)}) to {os.path.dirname(path)}")
        return out

    def status(self) -> Status:
        meta, s = self.load(), self.sizes()
        tiers = tuple(TierStatus(t, self.state(t, meta), self.bytes(t), setup.stored_bytes(t, s), setup.stored_temp_bytes(t, s), meta["tiers"].get(t, {}).get("built_at")) for t in setup.TIERS)
        must = {f[0]: f[3] for f in setup.FILES}
        sources = tuple({"kind": k, "path": p, "size_bytes": fingerprint(p)["size"], "exists": os.path.isfile(p), "compressed": p.lower().endswith(".gz"), "must_be_unpacked": must[k]} for k, p in self.sources.items())
        return Status(self.root, meta["node_count"], meta["edge_count"], sum(t.bytes for t in tiers), self.free(), tiers, sources, tuple(self.blockers()), self.crawl())

    # ---- building

    def plan(self, tiers: list[str]) -> list[str]:
        """What to build, in order; lookup comes first if it isn't ready."""
        wanted = set(tiers)
        if wanted and self.state("lookup") != "ready":
            wanted.add("lookup")
        return [t for t in setup.TIERS if t in wanted]

    def check_space(self, tiers: list[str]) -> None:
        needed, free = setup.stored_needed(tiers, self.sizes()), self.free()
        if free == 0:
            log.warning("free space below %s is unknown", self.root)
        elif free < needed:
            raise OSError(f"not enough space for the index in {self.root}: needs about {setup.human(needed)}, {setup.human(free)} are free")

    def build(self, tiers: list[str], progress: Progress | None = None) -> list[str]:
        progress = progress or Progress()
        order = self.plan(tiers)
        for kind in dict.fromkeys(k for t in order for k in DEPENDS[t]):
            if not os.path.isfile(self.sources[kind]):
                raise FileNotFoundError("; ".join(self.blockers()))
        self.check_space(order)
        work = [setup.work_units(t, self.sizes()) for t in order]
        done = 0
        with progress.jobs(self.spark):
            for tier, units in zip(order, work, strict=True):
                getattr(self, f"_build_{tier}")(progress, done / sum(work), units / sum(work))
                done += units
        return order

    def _publish(self, tier: str, tables: dict[str, DataFrame], meta: dict, prints: list[dict]) -> None:
        folder = f"{tier}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(os.path.join(self.root, folder, name))
        meta["tiers"][tier] = {"built_at": datetime.now(UTC).isoformat(), "sources": prints, "folder": folder}
        if tier == "lookup":
            meta["edge_count"] = self.spark.read.parquet(os.path.join(self.root, folder, "outbound")).count()
        self.save(meta)
        self._sweep(meta)

    def _sweep(self, meta: dict) -> None:
        """Delete folders of builds that the manifest doesn't name: older ones, and what a failed build left."""
        named = {record.get("folder") for record in meta["tiers"].values()}
        for name in os.listdir(self.root):
            if name.rpartition("-")[0] in setup.TIERS and name not in named:
                shutil.rmtree(os.path.join(self.root, name), ignore_errors=True)

    def _sorted(self, df: DataFrame, *keys: str) -> DataFrame:
        return df.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def _build_lookup(self, progress: Progress, base: float, weight: float) -> None:
        prints = self._fingerprints("lookup")
        progress.stage("vertices_index", "vertices", base, weight / 2)
        vertices = text.read_vertices(self.spark, self.sources["vertices"])
        facts = quality.summarize_vertices(vertices)
        progress.finish_stage()
        progress.stage("edges_index", "edges", base + weight / 2, weight / 2)
        links = graph.clean_edges(text.read_edges(self.spark, self.sources["edges"]))
        meta = self.load()
        meta |= {"node_count": facts.node_count, "node_capacity": facts.node_capacity, "quality": {"sorted_by_name": facts.sorted_by_name, "sorted_by_id": facts.sorted_by_id}}
        self._publish("lookup", {"vertices": self._sorted(vertices.select("id", "rev"), "rev"), "outbound": self._sorted(links, "from_id", "to_id")}, meta, prints)
        progress.finish_stage()

    def _tier(self, tier: str, table: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self._folder(tier), table))

    def _build_ranks(self, progress: Progress, base: float, weight: float) -> None:
        prints = self._fingerprints("ranks")
        progress.stage("ranks_partition", "ranks", base, weight / 2)
        vertices, ranks = self._tier("lookup", "vertices"), text.read_ranks(self.spark, self.sources["ranks"])
        match = quality.rank_match(vertices, ranks).first()
        if match.rank_rows and not match.matched_rows:
            raise ValueError("no rank row matches a vertex: the files are of different releases")
        progress.finish_stage()
        progress.stage("ranks_merge", "ranks by id", base + weight / 2, weight / 2)
        self._publish("ranks", {"by_id": self._sorted(graph.node_ranks(vertices, ranks), "id")}, self.load(), prints)
        progress.finish_stage()

    def _build_inbound(self, progress: Progress, base: float, weight: float) -> None:
        prints = self._fingerprints("inbound")
        progress.stage("inbound_partition", "links by destination", base, weight / 2)
        links = self._tier("lookup", "outbound").filter(F.col("to_id") < F.lit(self.load()["node_capacity"]))
        progress.finish_stage()
        progress.stage("inbound_merge", "links by destination", base + weight / 2, weight / 2)
        self._publish("inbound", {"links": self._sorted(links.select("to_id", "from_id"), "to_id", "from_id")}, self.load(), prints)
        progress.finish_stage()

    def drop(self, tiers: list[str]) -> None:
        meta = self.load()
        for tier in tiers:
            meta["tiers"].pop(tier, None)
        if os.path.isdir(self.root):
            self.save(meta)
            self._sweep(meta)

    # ---- opening

    def _open(self, tier: str, table: str, meta: dict) -> DataFrame | None:
        """A tier's table; one that is missing, stale or unreadable counts as absent."""
        state = self.state(tier, meta)
        if state != "ready":
            log.info("tier %s is %s", tier, state)
            return None
        try:
            return self._tier(tier, table)
        except Exception as error:
            log.warning("tier %s can't be read: %s", tier, error)
            return None

    def engine(self, strict: bool = False) -> Engine:
        """``strict`` refuses names when the vertices file wasn't sorted, as lookups by binary search would have to."""
        meta = self.load()
        notes = []
        if meta["quality"] and not meta["quality"].get("sorted_by_name", True):
            if strict:
                raise ValueError("the vertices file is not sorted by name")
            notes.append("the vertices file is not sorted by name or repeats names")
        inbound = self._open("inbound", "links", meta)
        return Engine(self.spark, self._open("lookup", "vertices", meta), self._open("lookup", "outbound", meta), self._open("ranks", "by_id", meta), inbound, transpose=False, notes=notes)
