"""History of runs and stored discovery reports as append-only tables; the latest event of an id is its state."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostweave.functions.formats import run_status

RUN_EVENTS = "id bigint, kind string, started_at string, finished_at string, error string, rank_metric string, targets_json string, results_dir string, seq bigint, finished boolean"
REPORTS = "id bigint, generated_at string, provider string, report_json string"
CANCELLED = "cancelled"


def _now() -> str:
    return datetime.now(UTC).isoformat()


class History:
    """Tables below ``root``, which may be any path that Spark writes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _append(self, name: str, schema: str, row: tuple) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return with_kind(self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{name}"), schema)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def start_run(self, metric: str, targets: list[str], results_dir: str, kind: str = "scan") -> int:
        number = uuid.uuid4().int >> 80 | int(datetime.now(UTC).timestamp() * 1000) << 20  # ascends with time
        number &= (1 << 63) - 1
        self._append("runs", RUN_EVENTS, (number, kind, _now(), None, None, metric, json.dumps(targets), results_dir, 0, False))
        return number

    def finish_run(self, run: int, error: str | None = None) -> None:
        self._append("runs", RUN_EVENTS, (run, None, None, _now(), error, None, None, None, 1, True))

    def runs(self, limit: int = 100) -> DataFrame:
        return run_history(self._read("runs", RUN_EVENTS), limit)

    def save_report(self, provider: str, report: dict) -> int:
        number = int(datetime.now(UTC).timestamp() * 1_000_000)
        self._append("reports", REPORTS, (number, _now(), provider, json.dumps(report, ensure_ascii=False)))
        return number

    def reports(self, limit: int = 50) -> DataFrame:
        return report_list(self._read("reports", REPORTS), limit)


def with_kind(rows: DataFrame, schema: str) -> DataFrame:
    """Tables written before ``kind`` existed read as scans."""
    if "kind string" in schema and "kind" not in rows.columns:
        rows = rows.withColumn("kind", F.lit("scan"))
    return rows


def run_history(events: DataFrame, limit: int = 100) -> DataFrame:
    """Latest state of every run, newest first."""
    fields = ["kind", "started_at", "finished_at", "error", "rank_metric", "targets_json", "results_dir"]
    latest = events.groupBy("id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields], F.max("finished").alias("finished"))
    status = F.when(~F.col("finished"), "running").otherwise(run_status(F.col("error"), CANCELLED))
    out = latest.withColumn("kind", F.coalesce("kind", F.lit("scan"))).withColumn("status", status).drop("finished")
    return out.orderBy(F.desc("id")).limit(limit)


def report_list(reports: DataFrame, limit: int = 50) -> DataFrame:
    """id, generated_at, provider, evidence_count, newest first."""
    count = F.coalesce(F.json_array_length(F.get_json_object("report_json", "$.evidence")), F.lit(0)).cast("bigint")
    return reports.select("id", "generated_at", "provider", count.alias("evidence_count")).orderBy(F.desc("id")).limit(limit)
