"""Backlink audit of fetched pages: status, links to the target, mentions.

Fetching is the caller's business; pages arrive as rows (ord, url, http_status, html, robots). Links are found
by an HTML parser in Arrow batches, as attributes can't be told apart reliably by patterns; everything else is
column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.functions import domains as D

MAX_PAGES = 50
MAX_BODY_BYTES = 2 * 1024 * 1024
MAX_ANCHORS = 8


class _Links(HTMLParser):
    """Targets, texts and rel values of ``a[href]``, the first title, and all text."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links: list[list] = []
        self.open: list | None = None
        self.title: list[str] | None = None
        self.in_title = False
        self.text: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            named = dict(reversed(attrs))
            self.open = None
            if named.get("href") is not None:
                self.open = [named["href"], [], named.get("rel")]
                self.links.append(self.open)
        elif tag == "title" and self.title is None:
            self.title, self.in_title = [], True

    def handle_endtag(self, tag):
        if tag == "a":
            self.open = None
        elif tag == "title":
            self.in_title = False

    def handle_data(self, data):
        self.text.append(data)
        if self.open is not None:
            self.open[1].append(data)
        if self.in_title:
            self.title.append(data)


def page_facts(html: str, url: str, target: str) -> dict:
    """What the audit needs of one page."""
    page = _Links()
    page.feed(html)
    page.close()
    anchors, rels, count = [], [], 0
    for href, text, rel in page.links:
        try:
            host = urlsplit(urljoin(url, href.strip())).hostname or ""
        except ValueError:
            continue
        while host.startswith("www."):
            host = host[4:]
        if host == target or host.endswith("." + target):
            count += 1
            anchor = " ".join(text).strip()
            if anchor and len(anchors) < MAX_ANCHORS:
                anchors.append(anchor)
            if rel is not None and rel not in rels:
                rels.append(rel)
    return {"title": " ".join(page.title or []).strip(), "backlink_count": count, "anchors": anchors, "rel_values": rels, "text": " ".join(page.text).lower()}


def first_urls(urls: DataFrame, most: int = MAX_PAGES) -> DataFrame:
    """ord, url of the first ``most`` different addresses; spaces around and slashes at the end don't differ."""
    key = F.regexp_replace(D.trim_unicode(F.col("url")), r"/+\z", "")
    first = urls.groupBy(key.alias("key")).agg(F.min_by(F.struct("ord", "url"), "ord").alias("u")).select("u.*")
    return first.orderBy("ord").limit(most)


def status_of(pages: DataFrame, target: str) -> DataFrame:
    """Adds source_domain (known), status and note; the rules apply in this order."""
    host = F.regexp_replace(F.lower(F.try_parse_url("url", F.lit("HOST"))), r"^(www\.)+", "")
    path = F.coalesce(F.nullif(F.try_parse_url("url", F.lit("PATH")), F.lit("")), F.lit("/"))
    code = F.col("http_status")
    status = (
        F.when(host.isNull(), "invalid")
        .when(~D.public_url(F.col("url")), "skipped")
        .when(D.host_within(host, target), "skipped")
        .when(F.col("robots").isNotNull() & ~D.robots_allows(F.col("robots"), path), "robots_blocked")
        .when(code.isNull(), "request_failed")
        .when(code.isin(403, 429), "blocked")
        .when(~code.between(200, 299), "http_error")
        .when(F.octet_length("html") > MAX_BODY_BYTES, "too_large")
        .otherwise("audited")
    )
    known = F.col("status").isin("blocked", "http_error", "audited")
    out = pages.withColumn("status", status)
    return out.withColumns({"source_domain": F.when(known, host).otherwise(""), "http_status": F.when(known, code)})


def audit(pages: DataFrame, target: str, brand: str = "") -> DataFrame:
    """One row a page: ord, url, source_domain, status, http_status, title, backlinks, anchors, rel values, mentions."""
    target = clean_target(target)
    brand = brand.strip().lower()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["title", "backlink_count", "anchors", "rel_values", "has_brand_mention", "has_domain_mention"]
            rows = []
            at = {n: i for i, n in enumerate(batch.schema.names)}
            for url, status, html in zip(*(batch.column(at[n]).to_pylist() for n in ("url", "status", "html")), strict=True):
                if status != "audited":
                    rows.append(("", 0, [], [], False, False))
                    continue
                f = page_facts(html or "", url, target)
                rows.append((f["title"], f["backlink_count"], f["anchors"], f["rel_values"], bool(brand) and brand in f["text"], target in f["text"]))
            kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_(), pa.bool_()]
            kept = [n for n in batch.schema.names if n != "html"]
            yield pa.RecordBatch.from_arrays([*(batch.column(at[n]) for n in kept), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [*kept, *names])

    rows = status_of(pages, target).select(F.col("ord").cast("bigint"), "url", "source_domain", "status", F.col("http_status").cast("bigint"), "html")
    schema = "ord bigint, url string, source_domain string, status string, http_status bigint, title string, backlink_count bigint, anchors array<string>, rel_values array<string>, has_brand_mention boolean, has_domain_mention boolean"
    return rows.mapInArrow(run, schema).withColumn("has_backlink", F.col("backlink_count") > 0)


def clean_target(target: str) -> str:
    """The target as the audit compares it; ValueError unless it looks like a domain."""
    x = target.strip()
    for prefix in ("https://", "http://", "www."):
        while x.startswith(prefix):
            x = x[len(prefix) :]
    x = x.rstrip("/").lower()
    if not x or "." not in x:
        raise ValueError("A valid target domain is required")
    return x


def audit_summary(audited: DataFrame) -> DataFrame:
    mention = F.col("has_brand_mention") | F.col("has_domain_mention")
    return audited.agg(
        F.count(F.lit(1)).alias("audited"), F.count_if("has_backlink").alias("confirmed_backlinks"),
        F.count_if(~F.col("has_backlink") & mention).alias("mentions_without_link"), F.count_if(F.col("status") != "audited").alias("blocked_or_skipped"),
    )


def own_and_external(urls: DataFrame, domain: str) -> DataFrame:
    """Adds own: whether the address lies on the domain's site."""
    host = F.regexp_replace(F.lower(F.try_parse_url("url", F.lit("HOST"))), r"^www\.", "")
    return urls.withColumn("own", F.coalesce(D.host_within(host, domain), F.lit(False)))


