"""The sample graph as the three text files of a release, and a store of all tiers over them.

The files have what real ones have: a header, comments, blank and broken lines, carriage returns, repeated links
and links to oneself. They lie in the folder that driver and executors share, and are written once a session.
"""

from __future__ import annotations

import atexit
import gzip
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostweave.plans import sample_graph as G
from hostweave.plans.tiers import Store

_HEADER = "#harmonicc_pos\t#harmonicc_val\t#pr_pos\t#pr_val\t#host_rev"
_NOISE = {"vertices": ["# vertices", "", "x\tcom.none", "7", "4294967296\tcom.none"], "edges": ["# edges", "1", "a\t2", "-1\t2", "3\t4294967296"], "ranks": ["", "short\t1"]}
_made: dict[tuple[str, bool], dict[str, str]] = {}
_stores: dict[str, Store] = {}


def _root(spark: SparkSession) -> str:
    """A folder of this session below spark.checkpoint.dir; a private one where that is unset, on local masters only."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return os.path.join(shared.removeprefix("file://").removeprefix("file:"), "hostweave", f"sample-{uuid.uuid4().hex[:12]}")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="hostweave-sample-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def _lines(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    def tabbed(df: DataFrame, *columns: str) -> DataFrame:
        return df.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in columns)).alias("value"))

    return {
        "vertices": tabbed(G.vertices(spark, d).orderBy("id"), "id", "rev"),
        "edges": tabbed(G.raw_edges(spark, d), "from_id", "to_id"),
        "ranks": tabbed(G.ranks(spark, d), "harmonic_position", "harmonic", "pagerank_position", "pagerank", "rev"),
    }


def sources(spark: SparkSession, d: str, packed: bool = False) -> dict[str, str]:
    """Paths of the three files, written line by line as they arrive."""
    if (d, packed) not in _made:
        root = _root(spark)
        os.makedirs(root, exist_ok=True)
        paths = {}
        for kind, rows in _lines(spark, d).items():
            paths[kind] = os.path.join(root, f"{kind}.txt" + (".gz" if packed else ""))
            with (gzip.open if packed else open)(paths[kind], "wt", encoding="utf-8", newline="") as f:
                f.write("".join(line + "\n" for line in ([_HEADER] if kind == "ranks" else []) + _NOISE[kind]))
                for i, r in enumerate(rows.toLocalIterator()):
                    f.write(r.value + ("\r\n" if i % 5 == 0 else "\n"))
        _made[(d, packed)] = paths
    return _made[(d, packed)]


def store(spark: SparkSession, d: str) -> Store:
    """All tiers over the files, built once a session."""
    if d not in _stores:
        files = sources(spark, d)
        _stores[d] = Store(spark, os.path.join(os.path.dirname(files["edges"]), "index"), files)
        _stores[d].build(["lookup", "ranks", "inbound"])
    return _stores[d]
