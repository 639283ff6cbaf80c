"""Reports as JSON, CSV and text."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.functions.domains import safe_file_name
from hostweave.functions.formats import plain_decimal
from hostweave.plans.engine import Report

_UNSAFE = str.maketrans('/\\:*?"<>|', "_" * 9)


def to_json(report: Report, full: bool = True) -> dict:
    """camelCase; keys without a value are left out, but ``rank`` is always there. Unfound domains are stubs."""
    def entry(e: dict) -> dict:
        return {k: v for k, v in e.items() if v is not None or k == "rank"}

    out = {"domain": report.domain, "found": report.found, "rank": report.rank, "inbound": [entry(e) for e in report.inbound], "outbound": [entry(e) for e in report.outbound]}
    if report.found and full:
        more = {"metric": report.metric, "nodeId": report.node_id, "position": report.position, "inboundTotal": report.inbound_total, "outboundTotal": report.outbound_total, "source": "index"}
        out |= {k: v for k, v in more.items() if v is not None}
    return out


def from_json(body: dict) -> Report:
    """A stored result, of old files too, which lack what was added since."""
    return Report(body["domain"], ".".join(reversed(body["domain"].split("."))), body["found"], body.get("metric", "pagerank"), body.get("nodeId"), body.get("rank"), body.get("position"),
                  [{"position": None} | e for e in body.get("inbound", [])], [{"position": None} | e for e in body.get("outbound", [])], body.get("inboundTotal", 0), body.get("outboundTotal", 0))


def file_for(reverse_domain: str) -> str:
    return reverse_domain.translate(_UNSAFE) + ".json"


def save(report: Report, folder: str, body: dict | None = None) -> str:
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, file_for(report.reverse_domain))
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        f.write(json.dumps(body or to_json(report), indent=2, ensure_ascii=False) + "\n")
    os.replace(f"{path}.part", path)
    return path


def save_stream(report: Report, folder: str, entries: Iterable[tuple[str, dict]], source: str) -> str:
    """Write a result whose links (direction, entry), inbound ones first, are never held together."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, file_for(report.reverse_domain))
    count = {"inbound": 0, "outbound": 0}

    def line(key: str, value) -> str:
        return f"  {json.dumps(key)}: {json.dumps(value, ensure_ascii=False)}"

    with open(f"{path}.part", "w", encoding="utf-8") as f:
        f.write("{\n" + ",\n".join([line("domain", report.domain), line("found", report.found), line("rank", report.rank)]))
        now = None
        for direction, entry in entries:
            for key in ("inbound", "outbound")[(-1 if now is None else ("inbound", "outbound").index(now)) + 1 : ("inbound", "outbound").index(direction) + 1]:
                f.write(("" if now is None else "\n  ]") + f',\n  "{key}": [')
                now = key
            f.write((",\n    " if count[direction] else "\n    ") + json.dumps(entry, ensure_ascii=False))
            count[direction] += 1
        for key in ("inbound", "outbound")[(-1 if now is None else ("inbound", "outbound").index(now)) + 1 :]:
            f.write(("" if now is None else "\n  ]") + f',\n  "{key}": [')
            now = key
        f.write("\n  ]")
        if report.found:
            more = {"metric": report.metric, "nodeId": report.node_id, "position": report.position, "inboundTotal": count["inbound"], "outboundTotal": count["outbound"], "source": source}
            f.write("".join(",\n" + line(k, v) for k, v in more.items() if v is not None))
        f.write("\n}\n")
    os.replace(f"{path}.part", path)
    return path


def to_csv(report: Report) -> str:
    """A row a link, inbound first; numbers in plain decimals."""
    rows = ["domain,direction,rank,position"]
    for direction in ("inbound", "outbound"):
        rows += [f"{e['domain']},{direction},{plain_decimal(e['rank'])},{'' if e['position'] is None else e['position']}" for e in getattr(report, direction)]
    return "\n".join(rows) + "\n"


def as_text(report: Report, top: int = 25) -> str:
    out = ["", report.domain]
    if not report.found:
        out.append("  not found in this release of the graph")
    else:
        rank = "—" if report.rank is None else f"{report.rank:.6e}"
        out.append(f"  {report.metric}: {rank}" + (f" (#{report.position})" if report.position is not None else ""))
        out.append(f"  inbound: {report.inbound_total}   outbound: {report.outbound_total}   in {report.elapsed_ms} ms")
    for title, entries, total in (("Who links here", report.inbound, report.inbound_total), ("Where it links", report.outbound, report.outbound_total)):
        if entries:
            out += ["", f"{title} ({total}):", *(f"  {e['domain']:<44} {e['rank']:.4e}" for e in entries[:top])]
            if total > top:
                out.append(f"  … {total - top} more")
    return "\n".join([*out, *(f"\n! {w}" for w in report.warnings)]) + "\n"


def bulk_json(headers: DataFrame, links: DataFrame, path: str) -> None:
    """Flat results of a large batch: JSON lines of headers and of links, written by the executors."""
    headers.withColumn("file", F.concat(safe_file_name(F.col("reverse_domain")), F.lit(".json"))).write.json(f"{path}/headers")
    links.write.json(f"{path}/links")
