"""Site-relative line dedup in DataFrame operations only.

A line is boilerplate on a host when more than ``ratio`` of the host's pages have it, and at least
``min_pages``. Pages are counted once for a line however often they repeat it. Lines travel as 128-bit
digests; counts are summed on the map side before they are shuffled, so a host with a third of all pages is
no heavier for a task than others.

A host has at most (lines per page / ratio) boilerplate lines, so they fit one array for each host. The table
of hosts is broadcast when its counted entries are few; beyond that documents meet it by a salted equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _support as S

#: A line on more than this share of a host's pages is boilerplate, if on so many pages at least.
RATIO = 0.1
MIN_PAGES = 3
#: Digests up to which the hosts' table is broadcast (some 50 bytes each), and the parts of a host beyond that.
BROADCAST_ENTRIES = 100_000
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(line: Column) -> Column:
    """What equal lines share: 128 bits of the line without spaces, tabs and returns at its ends."""
    return F.md5(F.btrim(line, F.lit(" \t\r")).cast("binary"))


_BLANK = "d41d8cd98f00b204e9800998ecf8427e"  # the digest of an empty line


def boilerplate(docs: DataFrame, host: str = "host", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, digests: the boilerplate lines of every host that has any. A null host is the empty one."""
    pages = docs.select(F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(text).alias("text"))
    total = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    digests = F.array_distinct(F.transform(_lines(F.col("text")), _digest))
    lines = pages.filter("text is not null").select("host", F.explode(digests).alias("digest")).filter(F.col("digest") != _BLANK)
    counted = lines.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    over = counted.join(total, "host").filter(F.col("n") > F.lit(ratio) * F.col("total"))
    return over.groupBy("host").agg(F.collect_set("digest").alias("digests"))


def drop_boilerplate(docs: DataFrame, host: str = "host", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """All columns of ``docs`` with ``text`` less its host's boilerplate lines, and line_count, dropped_count.

    Blank lines are never dropped. A null text stays null and has no lines; an empty text is one blank line. A
    document of nothing but boilerplate keeps its row with an empty text. Repeated rows count as pages of their
    own and all stay. Columns line_count and dropped_count of the input are replaced, all others stay as they
    are whatever their names. An empty table gives no rows.
    """
    found = S.cut(boilerplate(docs, host, text, ratio, min_pages), "boilerplate")
    entries = found.agg(F.sum(F.size("digests")).alias("n")).first().n or 0
    names = [c for c in docs.columns if c not in ("line_count", "dropped_count")]
    row = F.struct(*[F.col(f"`{c}`") for c in names])  # so that no name of the input can clash with ours
    pages = docs.select(row.alias("row"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(text).alias("text"))
    if entries <= broadcast_entries:
        joined = pages.join(F.broadcast(found), "host", "left")
    else:
        pages = pages.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
        found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = pages.join(found, ["host", "salt"], "left")
    lines = _lines(F.col("text"))
    hits = F.array_intersect(F.transform(lines, _digest), F.col("digests"))
    joined = joined.withColumn("hits", F.when(F.col("digests").isNotNull(), hits))
    kept = F.when(F.size("hits") > 0, F.filter(lines, lambda x: ~F.array_contains(F.col("hits"), _digest(x)))).otherwise(lines)
    out = joined.withColumn("kept", kept)
    known = F.col("text").isNotNull()
    n, left = F.when(known, F.size(lines)).otherwise(0), F.when(known, F.size("kept")).otherwise(0)
    cleaned = F.when(known, F.array_join("kept", "\n"))
    columns = [cleaned.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names]
    return out.select(*columns, n.cast("bigint").alias("line_count"), (n - left).cast("bigint").alias("dropped_count"))


#: The same result in DuckDB SQL over ``documents`` with the source as host.
ORACLE = f"""
with pages as (select row_number() over () as rid, doc_id, coalesce(source, '') as host, text from documents),
total as (select host, count(*) as total from pages group by host),
lines as (
  select rid, doc_id, host, u.line, u.pos, trim(u.line, chr(32) || chr(9) || chr(13)) as body
  from pages, unnest(string_split(text, chr(10))) with ordinality as u(line, pos)
  where text is not null),
bad as (
  select host, body from (select host, body, count(distinct rid) as n from lines where body <> '' group by host, body)
  join total using (host) where n >= {MIN_PAGES} and n > {RATIO} * total),
kept as (
  select rid, count(*) as n, count(*) filter (where bad.body is not null) as dropped,
    coalesce(string_agg(line, chr(10) order by pos) filter (where bad.body is null), '') as text
  from lines left join bad using (host, body) group by rid)
select doc_id, coalesce(n, 0) as line_count, coalesce(dropped, 0) as dropped_count, kept.text as text
from pages left join kept using (rid)
"""
