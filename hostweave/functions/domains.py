"""Domain, URL and text rules as column expressions; every step runs inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def trim_unicode(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def normalize_domain(c: Column) -> Column:
    """Host of a URL or domain as typed: lower case, without quotes, scheme, path, user, port, dots, one www."""
    # each step reads its input once: a column used twice in every step would make the plan grow exponentially
    x = ascii_lower(trim_unicode(c))
    x = trim_unicode(F.regexp_replace(x, r"(?s)\A([\"'])(.*)\1\z", "$2"))
    x = F.regexp_replace(x, r"(?s)\A(?:.*?://|//)", "")
    x = F.regexp_replace(x, r"(?s)[/?#\\].*\z", "")
    x = F.regexp_replace(x, r"(?s)\A.*@", "")
    x = F.regexp_replace(x, r"(?s)\A([^:]*):[^:]*\z", "$1")
    x = F.regexp_replace(x, r"\.+\z", "")
    return F.regexp_replace(x, r"\Awww\.", "")


def _labels_reversed(c: Column) -> Column:
    return F.array_join(F.reverse(F.filter(F.split(c, "[.]"), lambda x: x != "")), ".")


def to_reverse(c: Column) -> Column:
    """``example.com`` -> ``com.example``, normalised first; empty where there is no label."""
    return _labels_reversed(normalize_domain(c))


def from_reverse(c: Column) -> Column:
    return _labels_reversed(F.regexp_replace(trim_unicode(c), r"\.+\z", ""))


def safe_file_name(c: Column) -> Column:
    return F.translate(c, '/\\:*?"<>|', "_" * 9)


def host_within(host: Column, target: Column | str) -> Column:
    """The host is the target domain or lies under it."""
    t = F.lit(target) if isinstance(target, str) else target
    return (host == t) | host.endswith(F.concat(F.lit("."), t))


def url_host(c: Column) -> Column:
    """Host of an absolute URL in lower case, all leading ``www.`` removed; empty if there is none."""
    host = F.try_parse_url(c, F.lit("HOST"))
    return F.coalesce(F.lower(F.regexp_replace(host, r"^(www\.)+", "")), F.lit(""))


def audit_target(c: Column) -> Column:
    """The audit's rule: repeated schemes, then ``www.``, then trailing slashes go; a path stays."""
    x = F.regexp_replace(trim_unicode(c), r"^(https://)+", "")
    x = F.regexp_replace(F.regexp_replace(x, r"^(http://)+", ""), r"^(www\.)+", "")
    return F.lower(F.regexp_replace(x, r"/+\z", ""))


def search_target(c: Column, lower: bool) -> Column:
    """The search's rule: schemes and trailing slashes go; the query text is lower-cased, the host is not but loses ``www.``."""
    x = F.regexp_replace(F.regexp_replace(trim_unicode(c), r"^(https://)+", ""), r"^(http://)+", "")
    x = F.regexp_replace(x, r"/+\z", "")
    return F.lower(x) if lower else F.regexp_replace(x, r"^(www\.)+", "")


def typed_domain(c: Column) -> Column:
    """The input field's rule, whose order differs from ``normalize_domain``."""
    x = F.lower(trim_unicode(c))
    for pattern in (r"^[a-z]+://", r"^www\.", r"[/?#].*\z", r":[0-9]+\z", r"\.+\z"):
        x = F.regexp_replace(x, pattern, "")
    return x


def _brand(label: Column) -> Column:
    words = F.filter(F.split(label, "[-_]"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), " ")


def brand(c: Column) -> Column:
    """``my-transfer.com.ua`` -> ``My Transfer``."""
    x = F.regexp_replace(F.regexp_replace(trim_unicode(c), r"^(https://)+", ""), r"^(http://)+", "")
    x = F.regexp_replace(F.substring_index(x, "/", 1), r"^(www\.)+", "")
    return _brand(F.substring_index(x, ".", 1))


def urls_in_text(c: Column) -> Column:
    """Distinct URLs of a text in order, without punctuation at their ends."""
    found = F.regexp_extract_all(c, F.lit(r"(https?://[^\s<>\"'\])}]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:]+\z", "")))


def evidence_type(kind: Column) -> Column:
    return (
        F.when(kind.isin("potential_backlink", "url_mention", "inpage_domain"), "potential_backlink")
        .when(kind == "reputation", "reputation_mention")
        .when(kind == "documents", "document_citation")
        .otherwise("brand_mention")
    )


def evidence_confidence(kind: Column) -> Column:
    return F.when(kind.isin("potential_backlink", "url_mention", "inpage_domain", "reputation", "documents"), "medium").otherwise("low")


def private_ip(c: Column) -> Column:
    """Addresses that must not be fetched: private, loopback, link-local, broadcast, unspecified (v4 and v6 text)."""
    v4 = F.regexp_extract_all(c, F.lit(r"([0-9]+)"), F.lit(1))
    is_v4 = c.rlike(r"\A[0-9]{1,3}(\.[0-9]{1,3}){3}\z")
    a, b = (F.try_element_at(v4, F.lit(i)).try_cast("int") for i in (1, 2))
    bad4 = (a == 10) | (a == 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | c.isin("255.255.255.255", "0.0.0.0")
    x = F.lower(c)
    bad6 = x.isin("::1", "::", "0:0:0:0:0:0:0:1", "0:0:0:0:0:0:0:0") | x.rlike(r"\Af[cd][0-9a-f]{2}:") | x.rlike(r"\Afe[89ab][0-9a-f]:")
    return F.when(is_v4, bad4).otherwise(bad6)


def public_url(c: Column) -> Column:
    """http(s), with a host that is neither ``localhost`` nor a private address; names are not resolved here."""
    scheme, host = F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))), F.try_parse_url(c, F.lit("HOST"))
    bare = F.regexp_replace(host, r"^\[|\]\z", "")
    return F.coalesce(scheme.isin("http", "https") & (F.length(host) > 0) & (F.lower(host) != "localhost") & ~private_ip(bare), F.lit(False))


def robots_allows(body: Column, path: Column) -> Column:
    """Prefix ``Disallow`` rules of ``*`` groups; the latest ``User-agent`` line decides the group."""
    lines = F.transform(F.split(body, r"\r?\n"), lambda raw: F.trim(F.substring_index(raw, "#", 1)))
    lines = F.filter(lines, lambda s: F.instr(s, ":") > 0)
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("rules"))

    def fold(acc: Column, line: Column) -> Column:
        name = F.lower(F.trim(F.substring_index(line, ":", 1)))
        value = F.trim(F.substr(line, F.instr(line, ":") + 1))
        on = F.when(name == "user-agent", value == "*").otherwise(acc["on"])
        rules = F.when((name == "disallow") & acc["on"] & (value != ""), F.concat(acc["rules"], F.array(value))).otherwise(acc["rules"])
        return F.struct(on.alias("on"), rules.alias("rules"))

    rules = F.aggregate(lines, start, fold)["rules"]
    return ~F.exists(rules, lambda r: path.startswith(r))


def html_title(html: Column) -> Column:
    """Text of the first title element; entities stay as written."""
    return trim_unicode(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1))


def html_text(html: Column) -> Column:
    """All text between tags, script and style included, tags and comments as spaces."""
    return F.regexp_replace(html, r"(?s)<!--.*?-->|<[^>]*>", " ")


def regexp_host(c: Column) -> Column:
    """The manual search form's rule: scheme, one ``www.`` and the path go; case stays."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^https?://", ""), r"^www\.", ""), r"(?s)/.*\z", "")
