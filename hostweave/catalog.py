"""All queries by name over a folder of tables, with the SQL that an independent engine runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, update_wrapper

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostweave.functions import domains as D
from hostweave.functions import formats
from hostweave.operators import audit, discovery, graph, history, quality
from hostweave.plans import sample_files as F_
from hostweave.plans import sample_graph as G
from hostweave.plans import scan, setup
from hostweave.plans.sample_graph import table as _table
from hostweave.sources import text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Targets of the batch queries: every tenth customer's domain as typed, and two that the graph lacks.
_TARGETS = """
tg as (select id as node_id, rev from vx where id % 10 = 0),
"""
_LIMIT = 25


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.clean_edges(G.raw_edges(spark, d))


def _targets(spark: SparkSession, d: str, every: int = 10) -> DataFrame:
    """Every tenth domain, or each if ``every`` is 1, written as a person would, with two that don't exist."""
    known = G.vertices(spark, d).filter(F.col("id") % every == 0).select(F.col("id").alias("ord"), F.concat(F.lit("https://www."), F.upper(D.from_reverse(F.col("rev"))), F.lit("/page?x=1")).alias("name"))
    return graph.targets_of(known.unionAll(_rows(spark, [(-1, "nowhere.example"), (-2, "Absent.Example."), (-3, " absent.example/x")], "ord bigint, name string")))


def _links(spark: SparkSession, d: str, options: graph.Options, every: int = 10) -> DataFrame:
    rows = 1 << 60  # the sample graph's targets grow with the tables, so they are never broadcast by hand
    found = graph.resolve(G.vertices(spark, d), _targets(spark, d, every), rows).filter("node_id is not null")
    return graph.neighbours(_edges(spark, d), found, rows, options)


def _report(spark: SparkSession, d: str, options: graph.Options, every: int = 10) -> DataFrame:
    v = G.vertices(spark, d)
    links = graph.capped(_links(spark, d, options, every), options.limit)
    named = graph.named_and_ranked(links, v, graph.node_ranks(v, G.ranks(spark, d)), options.metric)
    return graph.with_order(named, "direction", "node_id")


_DOMAIN = "array_to_string(list_reverse(string_split({}, '.')), '.')"


def _links_sql(direction: str, limit: int | None = None, metric: str = "pagerank") -> str:
    mine, other = ("to_id", "from_id") if direction == "inbound" else ("from_id", "to_id")
    cap = f"where nth <= {limit}" if limit else ""
    return f"""
lk_{direction} as (
  select '{direction}' as direction, node_id, id from (
    select node_id, {other} as id, row_number() over (partition by node_id order by {other}) as nth
    from ed join tg on {mine} = node_id) {cap}),
nm_{direction} as (
  select direction, node_id, {_DOMAIN.format("rev")} as domain, coalesce(cast({metric} as double), 0) as rank, nullif({metric}_position, 0) as position
  from lk_{direction} join vx using (id) left join nr using (id)),
out_{direction} as (
  select direction, node_id, domain, rank, position, row_number() over (partition by node_id order by rank desc, domain) as ord from nm_{direction})
"""


def _sql(*parts: str) -> str:
    """The sample graph's relations, more of them, and a final select."""
    *more, final = parts
    return G.SQL.rstrip() + "".join("," + p.strip().rstrip(",") for p in more) + "\n" + final


# ---- relations -------------------------------------------------------------------------------------------


@query(_sql("select id, rev from vx"))
def vertices_view(spark, d):
    return G.vertices(spark, d)


@query(_sql("select from_id, to_id from ed"))
def edges_clean(spark, d):
    return _edges(spark, d)


@query(_sql("select id, cast(pagerank as double) as pagerank, cast(harmonic as double) as harmonic, pagerank_position, harmonic_position from nr"))
def ranks_by_id(spark, d):
    r = graph.node_ranks(G.vertices(spark, d), G.ranks(spark, d))
    return r.select("id", F.col("pagerank").cast("double").alias("pagerank"), F.col("harmonic").cast("double").alias("harmonic"), "pagerank_position", "harmonic_position")


@query(_sql("""select (select count(*) from vx) as node_count, (select max(id) + 1 from vx) as node_capacity,
  (select count(*) from raw) as raw_edges, (select count(*) from raw where from_id = to_id) as self_links,
  (select count(*) from ed) as distinct_edges, (select max(from_id) from raw) as max_from, (select max(to_id) from raw) as max_to,
  (select count(*) from rk) as rank_rows, (select count(*) from rk semi join vx using (rev)) as matched_rows,
  (select count(*) from (select from_id from ed union select to_id from ed) anti join vx on id = from_id) as nameless_ids"""))
def graph_summary(spark, d):
    v, raw = G.vertices(spark, d), G.raw_edges(spark, d)
    ends = _edges(spark, d).select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    nodes = v.agg(F.count(F.lit(1)).alias("node_count"), (F.max("id") + 1).alias("node_capacity"))
    nameless = ends.join(v, "id", "left_anti").agg(F.count(F.lit(1)).alias("nameless_ids"))
    one = [nodes, quality.edge_summary(raw), quality.rank_match(v, G.ranks(spark, d)), nameless]
    out = one[0].withColumn("k", F.lit(1))
    for facts in one[1:]:  # one row each
        out = out.join(facts.withColumn("k", F.lit(1)), "k")
    return out.drop("k")


@query(_sql("""select name, count(*) as n_rows, count(*) filter (where rev <= before) as name_violations, count(*) filter (where id <= id_before) as id_violations
  from (select 'by_id' as name, rev, id, lag(rev) over (order by id) as before, lag(id) over (order by id) as id_before from vx) group by name"""))
def sortedness_flags(spark, d):
    place = F.struct(F.lit("by_id").alias("file_path"), F.lit(0).alias("file_block_start"), F.col("id").alias("line"))
    found = quality.order_breaks(G.vertices(spark, d).withColumn("place", place), ["rev", "id"])
    return found.select(F.lit("by_id").alias("name"), "n_rows", F.col("breaks_rev").alias("name_violations"), F.col("breaks_id").alias("id_violations"))


# ---- targets ---------------------------------------------------------------------------------------------

_NAMES = "nm as (select " + _DOMAIN.format("rev") + " as domain, rev, node_id from tg union all select 'nowhere.example', 'example.nowhere', null union all select 'absent.example', 'example.absent', null)"


@query(_sql(_TARGETS, _NAMES, "select domain, rev, node_id from nm"))
def resolve_targets(spark, d, every=10):
    return graph.resolve(G.vertices(spark, d), _targets(spark, d, every), 1 << 60).select("domain", "rev", "node_id")


@query("select 'nowhere.example' as domain, 'example.nowhere' as rev union all select 'absent.example', 'example.absent'")
def missing_targets(spark, d):
    return graph.missing(G.vertices(spark, d), _targets(spark, d, 1)).select("domain", "rev")


@query("select 'example.nowhere.json' as file, false as found, 'nowhere.example' as domain union all select 'example.absent.json', false, 'absent.example'")
def not_found_stubs(spark, d):
    t = graph.missing(G.vertices(spark, d), _targets(spark, d, 1))
    return t.select(F.concat(D.safe_file_name(F.col("rev")), F.lit(".json")).alias("file"), F.lit(False).alias("found"), "domain")


# ---- links -----------------------------------------------------------------------------------------------

_COLUMNS = "direction, node_id, domain, rank, position, ord"


@query(_sql(_TARGETS, _links_sql("inbound"), f"select {_COLUMNS} from out_inbound"))
def inbound_links(spark, d, every=10):
    return _report(spark, d, graph.Options(limit=1 << 40, outbound=False), every).select(*_COLUMNS.split(", "))


@query(_sql(_TARGETS, _links_sql("outbound"), f"select {_COLUMNS} from out_outbound"))
def outbound_links(spark, d, every=10):
    return _report(spark, d, graph.Options(limit=1 << 40, inbound=False), every).select(*_COLUMNS.split(", "))


def _capped(spark, d, options, every):
    links = _links(spark, d, options, every)
    side = "inbound" if options.inbound else "outbound"
    total = links.groupBy("node_id").agg(F.count(F.lit(1)).alias("total"))
    v = G.vertices(spark, d)
    named = graph.named_and_ranked(graph.capped(links, options.limit), v, graph.node_ranks(v, G.ranks(spark, d)), options.metric)
    out = graph.with_order(named, "direction", "node_id").join(total, "node_id")
    return out.filter(F.col("direction") == side).select(*_COLUMNS.split(", "), "total", (F.col("total") > options.limit).alias("truncated"))


def _capped_sql(side: str) -> str:
    mine = "to_id" if side == "inbound" else "from_id"
    total = f"tt as (select {mine} as node_id, count(*) as total from ed group by 1)"
    return _sql(_TARGETS, _links_sql(side, _LIMIT), total, f"select {_COLUMNS}, total, total > {_LIMIT} as truncated from out_{side} join tt using (node_id)")


@query(_capped_sql("inbound"))
def inbound_capped(spark, d, every=10):
    return _capped(spark, d, graph.Options(limit=_LIMIT, outbound=False), every)


@query(_capped_sql("outbound"))
def outbound_capped(spark, d, every=10):
    return _capped(spark, d, graph.Options(limit=_LIMIT, inbound=False), every)


def _both_sql(metric: str, columns: str = _COLUMNS) -> str:
    return _sql(_TARGETS, _links_sql("inbound", 20000, metric), _links_sql("outbound", 20000, metric), f"select {columns} from (select * from out_inbound union all select * from out_outbound)")


@query(_both_sql("pagerank"))
def link_report_pagerank(spark, d, every=10):
    return _report(spark, d, graph.Options(), every).select(*_COLUMNS.split(", "))


@query(_both_sql("harmonic"))
def link_report_harmonic(spark, d, every=10):
    return _report(spark, d, graph.Options(metric=graph.Metric.HARMONIC), every).select(*_COLUMNS.split(", "))


@query(_both_sql("harmonic", "node_id, direction, domain, cast(position as varchar) as position, ord"))
def csv_rows(spark, d, every=10):
    r = _report(spark, d, graph.Options(metric=graph.Metric.HARMONIC), every)
    return r.select("node_id", "direction", "domain", F.col("position").cast("string").alias("position"), "ord")


@query(_sql(_TARGETS, """hd as (
  select node_id, pagerank, nullif(pagerank_position, 0) as position,
    (select count(*) from ed where to_id = node_id) as inbound_total, (select count(*) from ed where from_id = node_id) as outbound_total
  from tg join nr on id = node_id)""", f"""select node_id, cast(pagerank as double) as rank, position, inbound_total, least(outbound_total, {_LIMIT}) as outbound_total,
  outbound_total as outbound_degree, inbound_total > {_LIMIT} as inbound_truncated, outbound_total > {_LIMIT} as outbound_truncated from hd"""))
def report_headers(spark, d, every=10):
    v = G.vertices(spark, d)
    found = graph.resolve(v, _targets(spark, d, every), 1 << 60).filter("node_id is not null")
    total = graph.totals(_links(spark, d, graph.Options(), every))
    own = graph.node_ranks(v, G.ranks(spark, d)).select(F.col("id").alias("node_id"), F.col("pagerank").cast("double").alias("rank"), F.nullif("pagerank_position", F.lit(0)).alias("position"))
    out = found.select("node_id").join(own, "node_id", "left").join(total, "node_id", "left").fillna(0, ["inbound_total", "outbound_total"])
    return out.select("node_id", "rank", "position", "inbound_total", F.least("outbound_total", F.lit(_LIMIT)).cast("bigint").alias("outbound_total"), F.col("outbound_total").alias("outbound_degree"), (F.col("inbound_total") > _LIMIT).alias("inbound_truncated"), (F.col("outbound_total") > _LIMIT).alias("outbound_truncated"))


def _scan_sql() -> str:
    side = "select '{0}' as direction, node_id, {1} as id from ed join tg on {2} = node_id"
    links = "lk as (" + side.format("inbound", "from_id", "to_id") + " union all " + side.format("outbound", "to_id", "from_id") + ")"
    named = "nm as (select direction, node_id, " + _DOMAIN.format("rev") + " as domain, coalesce(pagerank, 0) as rank from lk join vx using (id) left join rk using (rev))"
    return _sql(_TARGETS, links, named, "select *, row_number() over (partition by direction, node_id order by rank desc, domain) as ord, count(*) over (partition by direction, node_id) as total from nm")


@query(_scan_sql())
def scan_report(spark, d, every=10):
    from pyspark.sql import Window

    named = graph.scan_ranks(_links(spark, d, graph.Options(), every), G.vertices(spark, d), G.ranks(spark, d), graph.Metric.PAGERANK)
    return graph.with_order(named, "direction", "node_id").withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("direction", "node_id")))


# ---- the same for all domains ----------------------------------------------------------------------------

#: These are registered as ``<name>_of_all`` alone, with all vertices as targets; the functions take ``every`` tenth
#: domain, which serves benchmarks.
BATCH = (resolve_targets, inbound_links, outbound_links, inbound_capped, outbound_capped, link_report_pagerank, link_report_harmonic, csv_rows, report_headers, scan_report)

for _f in BATCH:
    _all = update_wrapper(partial(_f, every=1), _f)
    _all.__name__ = f"{_f.__name__}_of_all"
    query(ORACLE.pop(_f.__name__).replace("from vx where id % 10 = 0", "from vx"))(_all)
    del QUERIES[_f.__name__]


# ---- the graph as text files, read back, scanned, and indexed ---------------------------------------------

_ALL = _TARGETS.replace("where id % 10 = 0", "")
_NAMED = "nt as (select node_id, " + _DOMAIN.format("rev") + " as target from tg)"


@query(_sql("select id, rev from vx"))
def text_vertices(spark, d):
    return text.read_vertices(spark, F_.sources(spark, d, packed=True)["vertices"]).select("id", "rev")


@query(_sql("select from_id, to_id, count(*) as n from raw group by all"))
def text_edges(spark, d):
    return text.read_edges(spark, F_.sources(spark, d)["edges"]).groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("n"))


@query(_sql("select rev, cast(pagerank as double) as pagerank, cast(harmonic as double) as harmonic, pagerank_position, harmonic_position from rk"))
def text_ranks(spark, d):
    return text.read_ranks(spark, F_.sources(spark, d, packed=True)["ranks"])


@query(_sql("select true as by_name, true as by_id, count(*) as node_count, max(id) + 1 as node_capacity from vx"))
def text_vertices_summary(spark, d):
    facts = quality.summarize_vertices(text.read_vertices(spark, F_.sources(spark, d, packed=True)["vertices"]))
    return _rows(spark, [(facts.sorted_by_name, facts.sorted_by_id, facts.node_count, facts.node_capacity)], "by_name boolean, by_id boolean, node_count bigint, node_capacity bigint")


def _names(spark, d):
    return [r.name for r in G.vertices(spark, d).select(D.from_reverse(F.col("rev")).alias("name")).collect()]


@query(_sql(_ALL, _NAMED, _links_sql("inbound", 20000), _links_sql("outbound", 20000), "select target, direction, ord, domain, rank, position from (select * from out_inbound union all select * from out_outbound) join nt using (node_id)"))
def store_links(spark, d):
    return F_.store(spark, d).engine().links(_names(spark, d))


@query(_sql(_ALL, _NAMED, """tt as (
  select node_id, (select count(*) from ed where to_id = node_id) as inbound_total, (select count(*) from ed where from_id = node_id) as outbound_degree from tg)""",
"select target as domain, node_id, cast(pagerank as double) as rank, nullif(pagerank_position, 0) as position, inbound_total, outbound_degree from nt join tt using (node_id) join nr on id = node_id"))
def store_headers(spark, d):
    return F_.store(spark, d).engine().headers(_names(spark, d)).select("domain", "node_id", "rank", "position", "inbound_total", "outbound_degree")


_SCANNED = _scan_sql().replace("where id % 10 = 0", "").replace("select *, row_number()", "select direction, target, domain, cast(rank as double) as rank, row_number()").replace(", count(*) over (partition by direction, node_id) as total from nm", " from nm join nt using (node_id)")
_SCANNED = _SCANNED.replace("lk as (", _NAMED + ",\nlk as (", 1)


@query(_SCANNED)
def scan_file_links(spark, d):
    return scan.scan_links(spark, F_.sources(spark, d), _names(spark, d))[1]


# ---- degrees ---------------------------------------------------------------------------------------------


@query(_sql("select to_id as id, count(*) as degree from ed group by to_id"))
def in_degree(spark, d):
    return graph.degrees(_edges(spark, d), "to_id")


@query(_sql("select from_id as id, count(*) as degree from ed group by from_id"))
def out_degree(spark, d):
    return graph.degrees(_edges(spark, d), "from_id")


@query(_sql("select to_id as id, count(*) as degree from ed group by to_id order by degree desc, id limit 25"))
def degree_top_k(spark, d):
    return graph.top_by_degree(graph.degrees(_edges(spark, d), "to_id"), 25)


@query(_sql("select to_id, from_id, row_number() over (partition by to_id order by from_id) as nth from ed"))
def inbound_transposed(spark, d):
    from pyspark.sql import Window

    return _edges(spark, d).select("to_id", "from_id", F.row_number().over(Window.partitionBy("to_id").orderBy("from_id")).cast("bigint").alias("nth"))


@query(_sql("select id, " + _DOMAIN.format("rev") + " as domain from vx where contains(" + _DOMAIN.format("rev") + ", 'nation-1.')"))
def domain_filter(spark, d):
    v = G.vertices(spark, d).select("id", D.from_reverse(F.col("rev")).alias("domain"))
    return v.filter(graph.contains_filter(F.col("domain"), " Nation-1. "))


@query(_sql("select * from (select " + _DOMAIN.format("rev") + " as domain, id from vx) order by domain limit 100 offset 100"))
def domain_sort_page(spark, d):
    return G.vertices(spark, d).select(D.from_reverse(F.col("rev")).alias("domain"), "id").orderBy("domain").offset(100).limit(100)


# ---- domains and URLs ------------------------------------------------------------------------------------

_HOST = "regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), '^www[.]', '')"


@query(f"select page_id, {_HOST} as domain, {_DOMAIN.format(_HOST)} as rev from pages")
def normalize_urls(spark, d):
    return _table(spark, d, "pages").select("page_id", D.normalize_domain(F.col("url")).alias("domain"), D.to_reverse(F.col("url")).alias("rev"))


@query(f"select page_id, {_HOST} as domain, true as same from pages")
def reverse_roundtrip(spark, d):
    p = _table(spark, d, "pages").select("page_id", D.normalize_domain(F.col("url")).alias("domain"))
    return p.withColumn("same", D.from_reverse(D.to_reverse(F.col("domain"))) == F.col("domain"))


@query("select page_id, translate(url, '/\\:*?\"<>|', '_________') as file from pages")
def safe_filename(spark, d):
    return _table(spark, d, "pages").select("page_id", D.safe_file_name(F.col("url")).alias("file"))


@query(f"select {_HOST} as source_domain, count(*) as n from pages group by 1")
def source_host_counts(spark, d):
    return _table(spark, d, "pages").groupBy(D.url_host(F.col("url")).alias("source_domain")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select page_id, ({_HOST} = 'example.com' or {_HOST} like '%.example.com') as own from pages")
def own_vs_external(spark, d):
    return audit.own_and_external(_table(spark, d, "pages"), "example.com").select("page_id", "own")


@query("""with t as (select page_id, text || ' ' || url || ', again ' || url || '.' as text from pages join documents on doc_id = page_id),
  u as (select page_id, regexp_replace(unnest(regexp_extract_all(text, 'https?://[^\\s<>"''\\])}]+')), '[.,;:]+$', '') as url from t)
  select distinct page_id, url from u""")
def extract_urls(spark, d):
    p = _table(spark, d, "pages").join(_table(spark, d, "documents").select("doc_id", F.col("text").alias("body")), F.col("doc_id") == F.col("page_id"))
    text = F.concat("body", F.lit(" "), "url", F.lit(", again "), "url", F.lit("."))
    return p.select("page_id", F.explode(D.urls_in_text(text)).alias("url"))


@query("select c_custkey, 'Customer ' || lpad(cast(c_custkey as varchar), 9, '0') as brand from customer")
def brands(spark, d):
    c = _table(spark, d, "customer")
    name = F.concat(F.lit("https://www.customer-"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit(".com.ua/"))
    return c.select("c_custkey", D.brand(name).alias("brand"))


# ---- discovery -------------------------------------------------------------------------------------------


def _query_rows_sql() -> str:
    rows = []
    for i, (kind, template, purpose) in enumerate(discovery.QUERY_TEMPLATES):
        rows.append(f"select host as target, cast({i} as bigint) as query_ord, '{kind}' as kind, replace(replace('{template}', '{{d}}', host), '{{b}}', upper(host[1]) || split_part(host, '.', 1)[2:]) as query, '{purpose}' as purpose from h")
    return f"with h as (select distinct {_HOST} as host from pages where not contains({_HOST}, '-') and not contains({_HOST}, '_')) " + " union all ".join(rows)


@query(_query_rows_sql())
def seo_queries(spark, d):
    hosts = _table(spark, d, "pages").select(D.url_host(F.col("url")).alias("target"), F.lit("").alias("brand")).distinct()
    return discovery.search_queries(hosts.filter(~F.col("target").rlike("[-_]")))


def _hits(spark, d):
    """Every page is a hit of the search page_id % 6 for example.com."""
    kinds = F.array(*[F.lit(k) for k, _, _ in discovery.QUERY_TEMPLATES])
    p = _table(spark, d, "pages")
    kind = F.pmod("page_id", F.lit(6)).cast("int")
    return p.select(F.lit("example.com").alias("target"), kinds[kind].alias("query_kind"), F.lit("q").alias("query"), kind.alias("query_ord"), F.col("page_id").alias("hit_ord"), F.lit("").alias("title"), "url", F.lit("").alias("snippet"))


_KINDS = "['potential_backlink','brand_mention','url_mention','inpage_domain','reputation','documents']"
_EVIDENCE = f"""ev as (
  select query_kind, query_ord, page_id as hit_ord, url, source_domain,
    case when query_kind in ('potential_backlink','url_mention','inpage_domain') then 'potential_backlink' when query_kind = 'reputation' then 'reputation_mention'
      when query_kind = 'documents' then 'document_citation' else 'brand_mention' end as evidence_type,
    case when query_kind = 'brand_mention' then 'low' else 'medium' end as confidence
  from (select *, row_number() over (partition by rtrim(url, '/') order by query_ord, page_id) as nth from (
    select page_id, url, {_HOST} as source_domain, cast(page_id % 6 as integer) as query_ord, {_KINDS}[page_id % 6 + 1] as query_kind from pages))
  where nth = 1 and source_domain <> '' and source_domain <> 'example.com' and source_domain not like '%.example.com')"""
_SUMMARY = """sm as (
  select count(distinct source_domain) as unique_source_domains, count(*) filter (where evidence_type = 'potential_backlink') as potential_backlinks,
    count(*) filter (where evidence_type = 'brand_mention') as brand_mentions, count(*) filter (where evidence_type = 'reputation_mention') as reputation_mentions,
    (select source_domain from ev group by 1 order by count(*) desc, source_domain desc limit 1) as strongest,
    (select count(*) from ev group by source_domain order by 1 desc limit 1) as strongest_count
  from ev)"""


@query(f"with {_EVIDENCE} select * from ev")
def evidence(spark, d):
    e = discovery.evidence(_hits(spark, d))
    return e.select("query_kind", "query_ord", "hit_ord", "url", "source_domain", "evidence_type", "confidence")


@query(f"with {_EVIDENCE}, {_SUMMARY} select * from sm")
def evidence_summary(spark, d):
    return discovery.summary(discovery.evidence(_hits(spark, d)))


@query(f"""with {_EVIDENCE}, {_SUMMARY}
  select 0::bigint as ord, 'info' as level, 'Discovery, not link verification' as title, 'Search results prove index visibility or a mention. Open the source page before treating it as a confirmed live backlink.' as detail
  union all select 1, 'positive', 'Backlink prospects found', potential_backlinks || ' external pages are candidates for manual or automated link verification.' from sm where potential_backlinks > 0
  union all select 2, 'warning', 'Reputation results need review', reputation_mentions || ' review/complaint-oriented results were found; sentiment is not inferred from snippets alone.' from sm where reputation_mentions > 0
  union all select 3, 'info', 'Most visible source', 'The most frequently discovered external domain is ' || strongest || ' (' || strongest_count || ').' from sm where strongest is not null""")
def insights(spark, d):
    return discovery.insights(discovery.summary(discovery.evidence(_hits(spark, d))))


# ---- audit -----------------------------------------------------------------------------------------------


def _pages(spark, d):
    """Pages as fetched: some blocked, failed, private, disallowed or of the target's own site."""
    p = _table(spark, d, "pages")
    code = F.expr("case page_id % 10 when 1 then 403 when 2 then 429 when 3 then 404 when 4 then cast(null as int) else 200 end")
    url = F.expr("case when page_id % 10 = 5 then 'http://192.168.1.' || (page_id % 200) || '/x' when page_id % 10 = 6 then 'ftp://files.example.org/a' else url end")
    robots = F.expr("case when page_id % 10 = 7 then 'User-agent: *\\nDisallow: /en # part\\nUser-agent: other\\nDisallow: /fr' end")
    return p.select(F.col("page_id").alias("ord"), url.alias("url"), code.alias("http_status"), "html", robots.alias("robots"))


_AUDIT = f"""pg as (
  select page_id as ord, html, case when page_id % 10 = 5 then 'http://192.168.1.' || (page_id % 200) || '/x' when page_id % 10 = 6 then 'ftp://files.example.org/a' else url end as url,
    case page_id % 10 when 1 then 403 when 2 then 429 when 3 then 404 when 4 then null else 200 end as code from pages),
st as (
  select ord, url, html, code, {_HOST} as host, case when ord % 10 in (5, 6) then 'skipped' when {_HOST} = 'example.com' or {_HOST} like '%.example.com' then 'skipped'
    when ord % 10 = 7 and regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) like '/en%' then 'robots_blocked'
    when code is null then 'request_failed' when code in (403, 429) then 'blocked' when code not between 200 and 299 then 'http_error' else 'audited' end as status
  from pg)"""


@query(f"with {_AUDIT} select ord, url, status, case when status in ('blocked', 'http_error', 'audited') then cast(code as bigint) end as http_status, case when status in ('blocked', 'http_error', 'audited') then host else '' end as source_domain from st")
def audit_status(spark, d):
    out = audit.status_of(_pages(spark, d), "example.com")
    return out.select("ord", "url", "status", F.col("http_status").cast("bigint").alias("http_status"), "source_domain")


@query(f"""with {_AUDIT}, m as (select *, status = 'audited' and contains(lower(regexp_replace(html, '<[^>]*>', ' ', 'g')), 'track(') as mention from st)
  select count(*) as audited, cast(0 as bigint) as confirmed_backlinks, count(*) filter (where mention) as mentions_without_link, count(*) filter (where status <> 'audited') as blocked_or_skipped from m""")
def audit_summary(spark, d):
    return audit.audit_summary(audit.audit(_pages(spark, d), "https://www.example.com/", brand="Track("))


@query("select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)) as title from pages")
def page_titles(spark, d):
    return _table(spark, d, "pages").select("page_id", D.html_title(F.col("html")).alias("title"))


@query("""with t as (select page_id, lower(regexp_replace(html, '<!--(?s:.*?)-->|<[^>]*>', ' ', 'g')) as t from pages)
  select page_id, contains(t, 'track(') as has_brand_mention, contains(t, 'example.com') as has_domain_mention from t""")
def page_mentions(spark, d):
    t = F.lower(D.html_text(F.col("html")))
    return _table(spark, d, "pages").select("page_id", F.contains(t, F.lit("track(")).alias("has_brand_mention"), F.contains(t, F.lit("example.com")).alias("has_domain_mention"))


@query("select page_id, cast(len(regexp_extract_all(regexp_replace(html, '<!--(?s:.*?)-->', '', 'g'), '<a href=\"')) as bigint) as backlink_count from pages")
def page_links(spark, d):
    """Links of a page to its own site, where all its links lead."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            n = [audit.page_facts(h, u, t)["backlink_count"] for u, h, t in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["page_id", "backlink_count"])

    return _table(spark, d, "pages").select("page_id", "url", "html", D.url_host(F.col("url")).alias("host")).mapInArrow(run, "page_id bigint, backlink_count bigint")


@query("""select * from (values ('/private/a', false), ('/public', true), ('/tmp', true), ('/privateer', false), ('/', true)) as v(path, allowed)""")
def robots_eval(spark, d):
    body = "User-agent: *\r\nDisallow: /private # no\nDisallow:\nbroken line\nUser-Agent: bot\nDisallow: /tmp\n"
    rows = _rows(spark, [(p,) for p in ("/private/a", "/public", "/tmp", "/privateer", "/")], "path string")
    return rows.select("path", D.robots_allows(F.lit(body), F.col("path")).alias("allowed"))


@query("""select * from (values ('127.0.0.1', true), ('192.168.1.1', true), ('10.1.2.3', true), ('172.16.0.1', true), ('172.32.0.1', false), ('169.254.9.9', true),
  ('255.255.255.255', true), ('0.0.0.0', true), ('1.1.1.1', false), ('::1', true), ('fd00::1', true), ('fe80::1', true), ('2606:4700::1111', false)) as v(ip, private)""")
def private_addresses(spark, d):
    ips = ["127.0.0.1", "192.168.1.1", "10.1.2.3", "172.16.0.1", "172.32.0.1", "169.254.9.9", "255.255.255.255", "0.0.0.0", "1.1.1.1", "::1", "fd00::1", "fe80::1", "2606:4700::1111"]
    return _rows(spark, [(i,) for i in ips], "ip string").select("ip", D.private_ip(F.col("ip")).alias("private"))


# ---- history, setup, formats -----------------------------------------------------------------------------


def _events(spark, d):
    """Runs from the event stream: every event starts a run; clicks fail, errors cancel, views still run."""
    e = _table(spark, d, "events")
    base = [F.col("event_id").alias("id"), F.when(F.col("event_type") == "signup", F.lit(None)).otherwise("query").cast("string").alias("kind"), F.lit("t").alias("started_at")]
    start = e.select(*base, F.lit(None).cast("string").alias("finished_at"), F.lit(None).cast("string").alias("error"), F.lit("pagerank").alias("rank_metric"), F.col("props").alias("targets_json"), F.lit("r").alias("results_dir"), F.lit(0).cast("bigint").alias("seq"), F.lit(False).alias("finished"))
    error = F.expr("case event_type when 'click' then 'disk full' when 'error' then 'scan cancelled by user' end")
    null = F.lit(None).cast("string")
    end = e.filter("event_type <> 'view'").select(F.col("event_id").alias("id"), null.alias("kind"), null.alias("started_at"), F.lit("u").alias("finished_at"), error.alias("error"), null.alias("rank_metric"), null.alias("targets_json"), null.alias("results_dir"), F.lit(1).cast("bigint").alias("seq"), F.lit(True).alias("finished"))
    return start.unionAll(end)


_STATUS = "case event_type when 'view' then 'running' when 'click' then 'failed' when 'error' then 'cancelled' else 'completed' end"


@query(f"select event_id as id, case when event_type = 'signup' then 'scan' else 'query' end as kind, {_STATUS} as status, props as targets_json from events order by id desc limit 100")
def run_history(spark, d):
    return history.run_history(_events(spark, d)).select("id", "kind", "status", "targets_json")


@query(f"select {_STATUS} as status, count(*) as n from events group by 1")
def run_status_counts(spark, d):
    return history.run_history(_events(spark, d), 1 << 30).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("select event_id as id, case when event_id % 3 = 0 then 2 when event_id % 3 = 1 then 0 else 0 end::bigint as evidence_count from events order by id desc limit 50")
def report_evidence_count(spark, d):
    body = F.expr("""case event_id % 3 when 0 then '{"evidence":[{"url":"a"},{"url":"b"}]}' when 1 then '{"evidence":[]}' else '{"other":1}' end""")
    e = _table(spark, d, "events").select(F.col("event_id").alias("id"), F.lit("t").alias("generated_at"), F.lit("brave").alias("provider"), body.alias("report_json"))
    return history.report_list(e).select("id", "evidence_count")


@query(setup.ORACLE)
def setup_guide(spark, d):
    return setup.guide(spark, setup.DEFAULT_CRAWL)


@query(setup.ESTIMATES_ORACLE)
def tier_estimates(spark, d):
    return setup.estimates(spark, setup.SourceSizes())


@query(setup.CAPABILITY_ORACLE)
def capability_matrix(spark, d):
    return setup.capability_matrix(spark)


@query(setup.WARNINGS_ORACLE)
def warnings_by_tier(spark, d):
    return setup.warnings_by_tier(spark)


@query("select * from (values (0::bigint, '0 B'), (1023, '1023 B'), (1024, '1 KB'), (1048576, '1 MB'), (17179869184, '16.0 GB'), (1649267441664, '1.5 TB')) as v(n, text)")
def human_bytes(spark, d):
    return _rows(spark, [(n,) for n in (0, 1023, 1024, 1 << 20, 16 << 30, 3 << 39)], "n bigint").select("n", formats.human_bytes(F.col("n")).alias("text"))


@query("select * from (values (45::bigint, '45 s'), (600, '10 min'), (7800, '2 h 10 min')) as v(n, text)")
def durations(spark, d):
    return _rows(spark, [(n,) for n in (45, 600, 7800)], "n bigint").select("n", formats.duration(F.col("n")).alias("text"))


@query("select n, case when n % 100 between 11 and 14 then 'many' when n % 10 = 1 then 'one' when n % 10 between 2 and 4 then 'few' else 'many' end as form from (select cast(unnest(range(0, 130)) as bigint) as n)")
def plurals(spark, d):
    return spark.range(130).select(F.col("id").alias("n"), formats.plural(F.col("id"), "one", "few", "many").alias("form"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backlinks of one domain with its neighbours' ranks and positions."""
    from hostweave.plans.engine import Engine

    v = G.vertices(spark, sf_dir)
    engine = Engine(spark, vertices=v, edges=_edges(spark, sf_dir), ranks=graph.node_ranks(v, G.ranks(spark, sf_dir)))
    target = v.filter("id = 3").select(D.from_reverse(F.col("rev")).alias("domain")).first().domain
    return engine.links([target])
