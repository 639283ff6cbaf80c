"""Web-mention discovery over search hits: query templates, evidence, counts and insights.

Fetching hits is the caller's business; they arrive as rows (target, query_kind, query, query_ord, hit_ord,
title, url, snippet). Several targets may share one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostweave.functions import domains as D

#: Kind, template and purpose of the six queries; {d} is the domain, {b} the brand.
QUERY_TEMPLATES = (
    ("potential_backlink", '"{d}" -site:{d}', "Pages mentioning the exact domain outside the target site"),
    ("brand_mention", '"{b}" -site:{d}', "Unlinked and linked brand mentions"),
    ("url_mention", '"https://{d}" -site:{d}', "Pages containing the canonical URL"),
    ("inpage_domain", 'inpage:"{d}" NOT site:{d}', "Domain text found in page content"),
    ("reputation", '"{b}" (review OR reviews OR відгуки OR скарги OR scam) -site:{d}', "Reviews, complaints and reputation signals"),
    ("documents", '"{d}" (filetype:pdf OR filetype:doc OR filetype:xls) -site:{d}', "Documents and citations mentioning the domain"),
)
#: Searches to be made by hand, and where.
MANUAL_TEMPLATES = (
    '"{b}" -site:{d}', '"{d}" -site:{d}', '"https://{d}" -site:{d}', 'intext:"{d}" -site:{d}', "link:{d}",
    '"{b}" (review OR reviews OR відгуки OR скарги) -site:{d}',
)
ENGINES = {
    "Google": "https://www.google.com/search?q=",
    "Brave": "https://search.brave.com/search?q=",
    "Bing": "https://www.bing.com/search?q=",
    "DuckDuckGo": "https://duckduckgo.com/?q=",
}


def _filled(template: Column, domain: Column, brand: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{d}"), domain), F.lit("{b}"), brand)


def search_queries(targets: DataFrame) -> DataFrame:
    """target, query_ord, kind, query, purpose: six rows for each (target, brand); an empty brand is derived."""
    domain = D.search_target(F.col("target"), lower=True)
    brand = F.when(F.coalesce(F.trim("brand"), F.lit("")) == "", D.brand(domain)).otherwise(F.trim("brand"))
    rows = F.array(*[F.struct(F.lit(i).cast("bigint").alias("query_ord"), F.lit(k).alias("kind"), F.lit(q).alias("template"), F.lit(p).alias("purpose")) for i, (k, q, p) in enumerate(QUERY_TEMPLATES)])
    out = targets.select("target", domain.alias("d"), brand.alias("b"), F.explode(rows).alias("q"))
    return out.select("target", "q.query_ord", "q.kind", _filled(F.col("q.template"), F.col("d"), F.col("b")).alias("query"), "q.purpose")


def manual_searches(targets: DataFrame) -> DataFrame:
    """target, ord, engine, query, url: the searches that a person opens in a browser."""
    d = D.regexp_host(F.col("target"))
    out = targets.select("target", d.alias("d"), F.coalesce(F.col("brand"), D.brand(d)).alias("b"), F.posexplode(F.array(*map(F.lit, MANUAL_TEMPLATES))).alias("ord", "template"))
    out = out.withColumn("query", _filled(F.col("template"), F.col("d"), F.col("b")))
    out = out.select("target", F.col("ord").cast("bigint").alias("ord"), "query", F.explode(F.create_map(*[F.lit(x) for pair in ENGINES.items() for x in pair])).alias("engine", "base"))
    return out.select("target", "ord", "engine", "query", F.concat("base", F.replace(F.url_encode("query"), F.lit("+"), F.lit("%20"))).alias("url"))


def evidence(hits: DataFrame) -> DataFrame:
    """Hits outside the target's own site, of equal addresses the first found; with kind and confidence."""
    host, target = D.url_host(F.col("url")), D.search_target(F.col("target"), lower=False)
    rows = hits.select("*", host.alias("source_domain"), target.alias("target_domain"))
    rows = rows.filter((F.col("source_domain") != "") & ~D.host_within(F.col("source_domain"), F.col("target_domain")))
    key = F.regexp_replace("url", r"/+\z", "")
    first = F.row_number().over(Window.partitionBy("target_domain", key).orderBy("query_ord", "hit_ord"))
    rows = rows.withColumn("nth", first).filter("nth = 1")
    return rows.select(
        "target_domain", "query_kind", "query", "query_ord", "hit_ord", "title", "url", "source_domain", "snippet",
        D.evidence_type(F.col("query_kind")).alias("evidence_type"), D.evidence_confidence(F.col("query_kind")).alias("confidence"),
    )


def summary(found: DataFrame) -> DataFrame:
    """One row of counts, and the most visible source: of equals the greatest name."""
    counts = found.groupBy("source_domain", "evidence_type").agg(F.count(F.lit(1)).alias("n"))
    by_source = counts.groupBy("source_domain").agg(
        F.sum("n").alias("n"), *[F.coalesce(F.sum(F.when(F.col("evidence_type") == t, F.col("n"))), F.lit(0)).alias(c) for t, c in (("potential_backlink", "potential_backlinks"), ("brand_mention", "brand_mentions"), ("reputation_mention", "reputation_mentions"))]
    )
    total = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("potential_backlinks", "brand_mentions", "reputation_mentions")]
    top = F.max_by("source_domain", F.struct("n", "source_domain"))
    return by_source.agg(F.count(F.lit(1)).alias("unique_source_domains"), *total, top.alias("strongest"), F.max("n").cast("bigint").alias("strongest_count"))


def insights(facts: DataFrame) -> DataFrame:
    """ord, level, title, detail derived from the summary row."""
    def row(i: int, level: str, title: str, detail: Column) -> Column:
        return F.struct(F.lit(i).cast("bigint").alias("ord"), F.lit(level).alias("level"), F.lit(title).alias("title"), detail.alias("detail"))

    # The wording of the insights
    rows = F.array(
        row(0, "info", "Discovery, not link verification", F.lit("Search results prove index visibility or a mention. Open the source page before treating it as a confirmed live backlink.")),
        F.when(F.col("potential_backlinks") > 0, row(1, "positive", "Backlink prospects found", F.concat(F.col("potential_backlinks").cast("string"), F.lit(" external pages are candidates for manual or automated link verification.")))),
        F.when(F.col("reputation_mentions") > 0, row(2, "warning", "Reputation results need review", F.concat(F.col("reputation_mentions").cast("string"), F.lit(" review/complaint-oriented results were found; sentiment is not inferred from snippets alone.")))),
        F.when(F.col("strongest").isNotNull(), row(3, "info", "Most visible source", F.concat(F.lit("The most frequently discovered external domain is "), F.col("strongest"), F.lit(" ("), F.col("strongest_count").cast("string"), F.lit(").")))),
    )
    return facts.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.*")


def check_request(api_key: str, targets: list[str], provider: str, google_cx: str = "", results_per_query: int = 10) -> int:
    """Raises ValueError for a request that can't be served; returns the results per query in 1 to 20 (10 for Google)."""
    if not api_key.strip():
        raise ValueError("API key is required")
    if not targets:
        raise ValueError("At least one target is required")
    if provider == "google" and not google_cx.strip():
        raise ValueError("Google Search Engine ID (cx) is required")
    if provider not in ("brave", "google"):
        raise ValueError(f"Unsupported provider: {provider}")
    limit = min(20, max(1, results_per_query))
    return min(limit, 10) if provider == "google" else limit


def hits_from_json(envelopes: DataFrame, provider: str) -> DataFrame:
    """Hits from (target, query_kind, query, query_ord, body): one search answer in JSON a row."""
    path, link, text = ("web.results", "url", "description") if provider == "brave" else ("items", "link", "snippet")
    item = f"array<struct<title:string,{link}:string,{text}:string>>"
    schema = f"struct<web:struct<results:{item}>>" if provider == "brave" else f"struct<items:{item}>"
    rows = envelopes.select("target", "query_kind", "query", "query_ord", F.posexplode(F.from_json("body", schema)[path.split(".")[0]] if provider == "google" else F.from_json("body", schema)["web"]["results"]).alias("hit_ord", "h"))
    return rows.select("target", "query_kind", "query", "query_ord", F.col("hit_ord").cast("bigint"), *[F.coalesce(F.col(f"h.{a}"), F.lit("")).alias(b) for a, b in (("title", "title"), (link, "url"), (text, "snippet"))])
