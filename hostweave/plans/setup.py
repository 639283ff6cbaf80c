"""The graph's source files, what they need, and what tiers cost: small static tables and arithmetic."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CRAWL = "cc-main-2026-apr-may-jun"
BASE_URL = "https://data.commoncrawl.org/projects/hyperlinkgraph"
CRAWL_LIST_URL = "https://commoncrawl.org/web-graphs"
#: Kind, download and unpacked bytes of the three files, whether they had to be unpacked, purpose.
FILES = (
    ("vertices", 838 * 1024 * 1024, 3_430_160_421, True, "Domains: number and name of each"),
    ("edges", 13_600 * 1024 * 1024, 67_065_528_122, True, "All links between domains"),
    ("ranks", 2_252 * 1024 * 1024, 8_331_642_513, False, "PageRank and harmonic centrality of each domain"),
)
#: Fixed values of the estimates: bytes of a vertex line and an edge line, of a block entry and its domains, …
VERTEX_LINE, EDGE_LINE = 28, 18
BLOCK_LINES, BLOCK_ENTRY, EDGE_BLOCK, EDGE_SAMPLE = 256, 40, 4 << 20, 16
RANK_ROW, HEADER, RANK_TEMP, EDGE_TEMP, EDGE_FINAL, OFFSET = 16, 64, 35, 8, 4, 8
TIERS = ("lookup", "ranks", "inbound")


def file_name(crawl: str, kind: str) -> str:
    return f"{crawl}-domain-{kind}.txt"


def guide(spark: SparkSession, crawl: str) -> DataFrame:
    """A row a file: names, address, sizes, whether it had to be unpacked, bytes kept on disk after setup."""
    rows = [(k, p, file_name(crawl, k), file_name(crawl, k) + ".gz", f"{BASE_URL}/{crawl}/domain/{file_name(crawl, k)}.gz", down, un, must, un if must else down) for k, down, un, must, p in FILES]
    return spark.createDataFrame(rows, "kind string, purpose string, file_name string, archive_name string, url string, download_bytes bigint, unpacked_bytes bigint, must_be_unpacked boolean, resident_bytes bigint")


def guide_totals(files: DataFrame) -> DataFrame:
    return files.agg(F.sum("download_bytes").alias("total_download_bytes"), F.sum("resident_bytes").alias("total_resident_bytes"))


ORACLE = " union all ".join(
    f"select '{k}' as kind, '{p}' as purpose, '{file_name(DEFAULT_CRAWL, k)}' as file_name, '{file_name(DEFAULT_CRAWL, k)}' || '.gz' as archive_name, "
    f"'{BASE_URL}/{DEFAULT_CRAWL}/domain/{file_name(DEFAULT_CRAWL, k)}.gz' as url, {down}::bigint as download_bytes, {un}::bigint as unpacked_bytes, {must} as must_be_unpacked, "
    f"(case when {must} then {un} else {down} end)::bigint as resident_bytes"
    for k, down, un, must, p in FILES
)


def human(n: int) -> str:
    """Base 1024, one decimal from GB on."""
    value, unit = float(n), 0
    while value >= 1024 and unit < 4:
        value, unit = value / 1024, unit + 1
    return f"{value:.{1 if unit >= 3 else 0}f} {('B', 'KB', 'MB', 'GB', 'TB')[unit]}"


def instructions(crawl: str, folder: str) -> str:
    out = [f"How to get the data ({crawl}):", "", f"1. Download three files (about {human(sum(f[1] for f in FILES))} together):"]
    for kind, down, _, _, purpose in FILES:
        out += [f"     {BASE_URL}/{crawl}/domain/{file_name(crawl, kind)}.gz", f"       {human(down)}: {purpose}"]
    total = sum(f[2] if f[3] else f[1] for f in FILES)
    return "\n".join([*out, "", f"2. Put them into {folder} (plain text or gzip).", "3. Build the tiers: index build", "", f"On disk after that: about {human(total)}. Releases: {CRAWL_LIST_URL}", ""])


@dataclass(frozen=True)
class SourceSizes:
    """Bytes of the source files as they lie; 0 for a missing one. A missing or packed file counts as unpacked."""

    vertices: int = 0
    edges: int = 0
    ranks: int = 0
    packed: frozenset[str] = frozenset()

    @classmethod
    def of(cls, paths: dict[str, str]) -> SourceSizes:
        sizes = {k: os.path.getsize(p) if os.path.isfile(p) else 0 for k, p in paths.items()}
        return cls(**sizes, packed=frozenset(k for k, p in paths.items() if p.lower().endswith(".gz")))

    def text(self, kind: str) -> int:
        size = getattr(self, kind)
        return next(f[2] for f in FILES if f[0] == kind) if size == 0 or kind in self.packed else size

    @property
    def nodes(self) -> int:
        return max(1, self.text("vertices") // VERTEX_LINE)

    @property
    def links(self) -> int:
        return max(1, self.text("edges") // EDGE_LINE)


def estimated_bytes(tier: str, s: SourceSizes) -> int:
    if tier == "lookup":
        return s.nodes // BLOCK_LINES * BLOCK_ENTRY + s.edges // EDGE_BLOCK * EDGE_SAMPLE
    if tier == "ranks":
        return s.nodes * RANK_ROW + HEADER
    return s.links * EDGE_FINAL + (s.nodes + 1) * OFFSET + HEADER


def estimated_temp_bytes(tier: str, s: SourceSizes) -> int:
    return {"lookup": 0, "ranks": s.nodes * RANK_TEMP, "inbound": s.links * EDGE_TEMP}[tier]


def work_units(tier: str, s: SourceSizes) -> int:
    temp = 2 * estimated_temp_bytes(tier, s)
    return max(1, {"lookup": s.vertices + s.edges // 512, "ranks": s.ranks + s.vertices + temp, "inbound": s.edges + temp}[tier])


def needed_bytes(tiers: list[str], s: SourceSizes) -> int:
    return sum(estimated_bytes(t, s) for t in tiers) + max((estimated_temp_bytes(t, s) for t in tiers), default=0)


#: What the Parquet tiers take, above what was measured: bytes a domain's name and id, a rank row, a link; and of
#: shuffled rows while building.
NAME_STORED, RANK_STORED, LINK_STORED, LINK_SHUFFLED, NAME_SHUFFLED = 32, 24, 8, 24, 64


def _stored_rows(s: SourceSizes) -> tuple[int, int]:
    """Domains and links, of packed files by the ratio at which the published ones are packed."""

    def size(kind: str) -> int:
        _, down, unpacked, *_ = next(f for f in FILES if f[0] == kind)
        known = getattr(s, kind)
        return known * unpacked // down if known and kind in s.packed else known or unpacked

    return size("vertices") // VERTEX_LINE + 1, size("edges") // EDGE_LINE + 1


def stored_bytes(tier: str, s: SourceSizes) -> int:
    """Bytes of a tier of this store, which holds names and links itself; an upper estimate."""
    nodes, links = _stored_rows(s)
    return {"lookup": nodes * NAME_STORED + links * LINK_STORED, "ranks": nodes * RANK_STORED, "inbound": links * LINK_STORED}[tier]


def stored_temp_bytes(tier: str, s: SourceSizes) -> int:
    """Bytes that are shuffled while a tier is built; links twice for lookup, to be made distinct and sorted."""
    nodes, links = _stored_rows(s)
    return {"lookup": 2 * links * LINK_SHUFFLED + nodes * NAME_SHUFFLED, "ranks": 2 * nodes * NAME_SHUFFLED, "inbound": links * LINK_SHUFFLED}[tier]


def stored_needed(tiers: list[str], s: SourceSizes) -> int:
    return sum(stored_bytes(t, s) for t in tiers) + max((stored_temp_bytes(t, s) for t in tiers), default=0)


def estimates(spark: SparkSession, s: SourceSizes) -> DataFrame:
    return spark.createDataFrame([(t, estimated_bytes(t, s), estimated_temp_bytes(t, s), work_units(t, s)) for t in TIERS], "tier string, estimated_bytes bigint, estimated_temp_bytes bigint, work_units bigint")


ESTIMATES_ORACLE = """
with n as (select 3430160421 // 28 as nodes, 67065528122 // 18 as links)
select 'lookup' as tier, (nodes // 256 * 40)::bigint as estimated_bytes, 0::bigint as estimated_temp_bytes, 1::bigint as work_units from n
union all select 'ranks', nodes * 16 + 64, nodes * 35, nodes * 70 from n
union all select 'inbound', links * 4 + (nodes + 1) * 8 + 64, links * 8, links * 16 from n
"""


@dataclass(frozen=True)
class Capabilities:
    lookup: bool
    outbound: bool
    inbound: bool
    ranks: bool

    @property
    def can_query(self) -> bool:
        return self.lookup


def capabilities(tiers: set[str]) -> Capabilities:
    return Capabilities(lookup="lookup" in tiers, outbound="lookup" in tiers, inbound="inbound" in tiers, ranks="ranks" in tiers)


def warnings(found: bool, caps: Capabilities, want_inbound: bool = True, want_outbound: bool = True, domain: str = "") -> list[str]:
    if not found:
        return [f"domain {domain} is not in this release of the graph"]
    out = [] if caps.ranks else ["tier ranks is not built: ranks show as 0"]
    if want_inbound and not caps.inbound:
        out.append("tier inbound is not built: who links to the domain is unknown")
    if want_outbound and not caps.outbound:
        out.append("outbound links are not available")
    return out


def _subsets() -> list[set[str]]:
    return [{t for i, t in enumerate(TIERS) if k >> i & 1} for k in range(8)]


def capability_matrix(spark: SparkSession) -> DataFrame:
    rows = []
    for tiers in _subsets():
        c = capabilities(tiers)
        rows.append(("lookup" in tiers, "ranks" in tiers, "inbound" in tiers, c.lookup, c.outbound, c.inbound, c.ranks, c.can_query))
    return spark.createDataFrame(rows, "has_lookup boolean, has_ranks boolean, has_inbound boolean, can_lookup boolean, can_outbound boolean, can_inbound boolean, can_rank boolean, can_query boolean")


CAPABILITY_ORACLE = """
with b as (select unnest([true, false]) as v)
select l.v as has_lookup, r.v as has_ranks, i.v as has_inbound, l.v as can_lookup, l.v as can_outbound, i.v as can_inbound, r.v as can_rank, l.v as can_query
from b as l, b as r, b as i
"""


def warnings_by_tier(spark: SparkSession) -> DataFrame:
    rows = [("lookup" in t, "ranks" in t, "inbound" in t, len(warnings(True, capabilities(t)))) for t in _subsets()]
    return spark.createDataFrame(rows, "has_lookup boolean, has_ranks boolean, has_inbound boolean, n_warnings bigint")


WARNINGS_ORACLE = """
with b as (select unnest([true, false]) as v)
select l.v as has_lookup, r.v as has_ranks, i.v as has_inbound, ((not l.v)::int + (not r.v)::int + (not i.v)::int)::bigint as n_warnings
from b as l, b as r, b as i
"""
