"""Token counts of whole texts by a two-tier lookup on the map side.

A broadcast table holds the counts of the most frequent pre-tokens, so most lookups end there; what it lacks
is encoded once and kept in a bounded cache of the worker. No pre-token is shuffled. All texts are read in one
scan; the table is chosen before it, from the ids alone and then the texts of the rows drawn. The table is
only an accelerator: any table, or none, gives the same counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _support as S
from .pretokens import CACHE_ENTRIES, piece_chunks, piece_count, piece_counts

#: Entries of the broadcast table, and rows of the texts from which its pre-tokens are chosen.
FREQUENT = 40_000
SAMPLE_ROWS = 1_000


def frequent_pretokens(docs: DataFrame, model: str, entries: int = FREQUENT, rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> dict[str, int]:
    """The table's pre-tokens and their counts, at most ``entries``, from a bounded sample of the texts.

    The sample is whole texts of the rows whose ids have the least hashes, which are found without reading a
    text, and again at most ``rows`` where rows share an id; a single task counts it, the driver gets
    ``entries`` rows at most.
    """

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.begin("pieces")
        seen: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                seen.update(piece_chunks(value) if value else ())
        count = piece_count(model)
        best = [(w, count(w)) for w, n in seen.most_common(entries) if n > 1 and len(w) <= 40]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.string()), pa.array([n for _, n in best], pa.int32())], ["chunk", "n"])

    order = F.xxhash64(F.col(doc_id))
    last = docs.select(order.alias("o")).orderBy("o").limit(rows).agg(F.max("o").alias("o")).first().o  # of bare hashes
    sample = docs.filter(order <= F.lit(last)).filter(F.col(text).isNotNull()).select(F.col(text).alias("t")).limit(rows).coalesce(1)
    return {r.chunk: r.n for r in sample.mapInArrow(top, "chunk string, n int").collect()}


def count_tokens(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", limit: int = 4096, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text, by the sentencepiece model at ``model``.

    Null and empty texts have no bytes and no tokens. Repeated rows give repeated results; columns besides
    the two named are not read. A text of any length is counted whole: it is cut at its spaces, never short.
    """
    spark = docs.sparkSession
    S.bounded_batches(spark)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    table = spark.sparkContext.broadcast(frequent_pretokens(docs, model))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.begin("pieces")
        cache = piece_counts(model, cache_entries)
        cache.fixed = table.value
        look = cache.__getitem__
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column(1).to_pylist():
                cache.age()
                n_bytes.append(len(value.encode("utf-8", "replace")) if value else 0)
                n_tokens.append(sum(map(look, piece_chunks(value))) if value else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(counted, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
