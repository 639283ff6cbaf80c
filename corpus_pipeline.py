"""The corpus pipeline: STAGES over documents, each stage's result written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostweave.llm import _support as S
from hostweave.llm import decontaminate, lines, packing, simhash
from hostweave.llm import toxicity as toxic
from hostweave.llm.queries import BYTE_BPE

def _aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of these names under others, so that an operator's own can't clash; and how to undo it."""
    moved = {f"_kept_{c}": c for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed({c: k for k, c in moved.items()}), moved


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from ``labels`` of the stage's own documents.

    Null and empty texts stay. Repeated rows go or stay together. All columns stay as they are.
    """
    model = toxic.learn(docs, S.table(spark, sf_dir, "labels"))
    rows, moved = _aside(docs, ("score", "predicted"))
    return toxic.score(rows, model).filter("predicted = 0").drop("score", "predicted").withColumnsRenamed(moved)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from texts; all documents stay, a text of nothing else as an empty one.

    ``n_chars`` follows the text where there is such a column; a null text stays null, as does its length.
    """
    rows, moved = _aside(docs, ("line_count", "dropped_count"))
    cleaned = lines.drop_boilerplate(rows, host="source").drop("line_count", "dropped_count").withColumnsRenamed(moved)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return cleaned.select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of the least doc_id.

    Groups are of rows, not of doc_ids: of rows that share a doc_id each is judged by its own text, and of equal
    rows one stays. A null doc_id comes after all others. Texts without words are one group.
    """
    row = "_row" + "_" * max(len(c) for c in docs.columns)
    rows = S.cut(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = simhash.simhash_groups(rows, doc_id=row).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row))
    least = groups.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(F.min_by(row, order).alias(row))
    return rows.join(least.select(row), row, "left_semi").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside a benchmark window go. Null and empty texts stay, and so do all columns."""
    rows, moved = _aside(docs, ("n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
    found = decontaminate.contamination(rows, S.table(spark, sf_dir, "benchmark"), keep=rows.columns)
    return found.filter("not contaminated").select(*rows.columns).withColumnsRenamed(moved)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents that are left; a null or empty text is one piece of the end id."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Classifier training, fingerprints and packing have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = S.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = S.cut(docs, name)
    return docs
