"""The corpus operators as queries over a folder of tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _support as S
from . import decontaminate, embeddings, language, lines, packing, simhash, substrings, tokenfile, tokens, toxicity

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def _held_out(folds: int, fold: int) -> Column:
    return F.coalesce(S.doc_fold(F.col("doc_id"), folds) == fold, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a model that learns outside fold 0 of 5. A null doc_id has no fold: it teaches nothing and is not held out."""
    docs = S.table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, S.table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", _held_out(5, 0).alias("held_out"), "score", "predicted")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by profiles that learn outside fold 2 of 4. A null doc_id has no fold: it teaches nothing and is not held out."""
    docs = S.table(spark, sf_dir, "documents")
    found = language.identify(docs, learn_from=S.doc_fold(F.col("doc_id"), 4) != 2)
    return found.select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document by the 32k piece model."""
    return tokens.count_tokens(S.table(spark, sf_dir, "documents"), PIECE_BPE)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less the boilerplate lines of its source."""
    docs = lines.drop_boilerplate(S.table(spark, sf_dir, "documents"), host="source")
    return docs.select("doc_id", "line_count", "dropped_count", "text")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: shingles of four words, links at four bits or fewer."""
    return simhash.simhash_groups(S.table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every document with windows of ten words of the benchmark."""
    return decontaminate.contamination(S.table(spark, sf_dir, "documents"), S.table(spark, sf_dir, "benchmark"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2048 tokens."""
    return packing.pack(S.table(spark, sf_dir, "documents"), BYTE_BPE)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every vector at a cosine of 0.98 or more, within labels."""
    return embeddings.near_vectors(S.table(spark, sf_dir, "embeddings"))


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    path = S.scratch_path(spark, "token-files")
    tokenfile.write_token_files(S.table(spark, sf_dir, "documents"), path, BYTE_BPE)
    return tokenfile.read_token_files(spark, path, ids=False)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less the words of 50-word windows that a document of smaller id has."""
    return substrings.remove_repeats(S.table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_language_id, op3_token_counts, op4_line_dedup, op5_simhash, op6_decontamination, op7_best_fit_packing, op8_embedding_near_dedup, op9_token_binary, op10_substring_dedup)}
ORACLE: dict[str, str] = {"op4_line_dedup": lines.ORACLE}
