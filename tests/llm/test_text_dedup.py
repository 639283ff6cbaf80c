"""Line dedup, SimHash, decontamination and substring dedup against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hostweave.llm import _support as S
from hostweave.llm import components, decontaminate, lines, queries, simhash, substrings

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    passage, base = prose(rng, 70), prose(rng, 300)
    texts = [prose(rng, int(n)) for n in rng.integers(0, 200, 40)]
    texts += [base] * 5 + [re.sub(r"w7\b", f"x{i}", base) for i in range(6)]  # copies and near copies
    texts += [f"{prose(rng, int(n))} {passage} {prose(rng, 20)}" for n in rng.integers(0, 60, 8)]  # a shared passage
    texts += [f"{passage}\n\t{passage}", passage, passage[:-4], None, "", " \n\t", "one", "Two  words", "É é À", prose(rng, 6000), base.upper()]
    order = rng.permutation(len(texts))
    return [(int(i) * 3 + 1, texts[k]) for i, k in enumerate(order)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "key", 5) for i, t in corpus], "doc_id bigint, text string, h string, place int").repartition(5)


# ---- components ------------------------------------------------------------------------------------------


def roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = np.random.default_rng(1)
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(99, i) for i in range(50)], "random": [tuple(map(int, e)) for e in rng.integers(0, 120, (80, 2))], "none": []}[kind]
    df = spark.createDataFrame([*edges, (7, 7), (7, None)], "a bigint, b bigint")
    got = {r.node: r.component for r in components.components(df).collect()}
    assert got == roots([e for e in edges if e[0] != e[1]])


# ---- SimHash ---------------------------------------------------------------------------------------------


def brute_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_hash_is_the_engines_own(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d")).alias("h")).first().h & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_simhash(docs, corpus):
    got = {r.doc_id: r for r in simhash.simhash_groups(docs).collect()}
    prints = {i: brute_fingerprint(t) for i, t in corpus}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    ids = sorted(prints)
    group = roots([(a, b) for a in ids for b in ids if a <= b and (prints[a] ^ prints[b]).bit_count() <= 4])
    assert {i: r.component_id for i, r in got.items()} == group
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [6, 40, 2048])
def test_links_of_dense_and_hot_keys(spark, most):
    """Crowded neighbourhoods: small limits send keys through the blocked way, with the same components."""
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 2**63, 4)
    prints = {int(c) for c in rng.integers(0, 2**63, 100)}
    for c in centres:
        for _ in range(60):
            flips = rng.choice(63, rng.integers(0, 6), replace=False)
            prints.add(int(c) ^ sum(1 << int(b) for b in flips))
    prints = sorted(prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint").repartition(3)
    links = [(r.a, r.b) for r in simhash.link_fingerprints(df, most).collect()]
    want = roots([(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 4])
    got = roots(links)
    assert {k: v for k, v in got.items()} == want


# ---- decontamination -------------------------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(text, items):
    words, hit, names = plain_words(text), set(), set()
    for name, item in items:
        test = plain_words(item)
        n = min(10, len(test))
        grams = {tuple(test[i : i + n]) for i in range(len(test) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                names |= {str(name)} if name is not None else set()
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_contamination(spark, docs, corpus, block_bytes):
    some = [t for _, t in corpus if t and len(t) > 300]
    items = [(1, some[0][20:200].upper()), (2, " ".join(some[1].split()[5:15])), (2, "w1 w2 w3"), (3, "w5, W9!"), (4, None), (5, "…"), (6, " ".join(some[2].split()[:9])), (None, " ".join(some[3].split()[10:30])), (7, "not here at all, ever")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, hit int")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination(docs, bench, block_bytes=block_bytes).collect()}
    assert got == {i: brute_contamination(t, items) for i, t in corpus}
    assert sum(r[-1] for r in got.values()) > 3


def test_contamination_of_nothing(spark, docs):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(docs, bench).filter("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


# ---- substrings ------------------------------------------------------------------------------------------


def brute_repeats(corpus, window):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in corpus}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("batches,window,gram", [(1, 50, 18), (2, 50, 18), (3, 50, 18), (4, 12, 5)])
def test_substrings(docs, corpus, batches, window, gram):
    got = {r.doc_id: tuple(r)[1:] for r in substrings.remove_repeats(docs, batches=batches, window=window, gram=gram).collect()}
    want = brute_repeats(corpus, window)
    assert got == want and sum(1 for r in want.values() if r[1]) > 10


def test_substrings_edge_cases(spark, docs):
    assert substrings.remove_repeats(docs.limit(0)).count() == 0
    text = " ".join(WORDS[:60])
    rows = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in substrings.remove_repeats(rows).collect())
    assert got == [("1", 0), ("1", 0), ("2", 60), ("None", 0)]


# ---- lines -----------------------------------------------------------------------------------------------


def test_lines_equal_sql(spark, sf, duck):
    got = queries.op4_line_dedup(spark, sf).orderBy("doc_id").collect()
    want = duck.execute(f"select doc_id, line_count, dropped_count, text from ({lines.ORACLE}) order by doc_id").fetchall()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


@pytest.mark.parametrize("broadcast_entries", [100_000, -1])
def test_lines(spark, broadcast_entries):
    foot = "all rights reserved"
    rows = [(i, f"own line {i}\n {foot}\t\n\nown line {i}", "a.com", 1) for i in range(6)]
    rows += [(10 + i, f"page {i}\n{foot}" if i < 2 else f"page {i}", "b.com", 1) for i in range(6)]
    rows += [(20, foot, "a.com", 1), (21, None, "a.com", 1), (22, "", "a.com", 1), (23, "x", None, 1), (23, "x", None, 1), (24, "x", None, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, host string, line_count int").withColumns({"kept": F.lit(1), "hits": F.lit(2), "digests": F.lit(3), "row": F.lit(4)})
    out = lines.drop_boilerplate(df, ratio=0.5, broadcast_entries=broadcast_entries)
    assert out.columns == ["doc_id", "text", "host", "kept", "hits", "digests", "row", "line_count", "dropped_count"] and out.first().row == 4
    got = {(r.doc_id, r.text): (r.line_count, r.dropped_count) for r in lines.drop_boilerplate(df, ratio=0.5, broadcast_entries=broadcast_entries).collect()}
    assert got[(0, "own line 0\n\nown line 0")] == (4, 1) and got[(20, "")] == (1, 1) and got[(21, None)] == (0, 0) and got[(22, "")] == (1, 0)
    assert got[(10, f"page 0\n{foot}")] == (2, 0) and got[(23, "")] == (1, 1) and got[(24, "")] == (1, 1)
    assert lines.drop_boilerplate(df, broadcast_entries=broadcast_entries).count() == len(rows)
    assert lines.drop_boilerplate(df.limit(0)).count() == 0


@pytest.mark.parametrize("batches", [5, 6])
def test_substrings_in_many_batches(docs, corpus, batches):
    got = {r.doc_id: tuple(r)[1:] for r in substrings.remove_repeats(docs, batches=batches, window=12, gram=5).collect()}
    assert got == brute_repeats(corpus, 12)


def test_rows_that_share_a_doc_id_take_nothing_from_each_other(spark):
    t, u = " ".join(WORDS[:60]), " ".join(WORDS[100:170])
    rows = spark.createDataFrame([(1, t), (2, t), (2, u), (2, u), (3, f"{u} tail"), (2, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(rows, batches=1).collect())
    assert got == [(1, 60, 0), (2, 0, 0), (2, 60, 60), (2, 70, 0), (2, 70, 0), (3, 71, 70)]


def test_doubly_repetitive_words_are_told_apart(spark):
    """Patterns on which polynomials modulo a power of two collide, whatever their base."""
    def thue_morse(n):
        return [bin(i).count("1") % 2 for i in range(n)]

    a, b = (" ".join("xy"[k ^ flip] for k in thue_morse(2048)) for flip in (0, 1))
    rows = [(1, a), (2, b), (3, f"{a} z")]
    got = {r.doc_id: tuple(r)[1:] for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), batches=2).collect()}
    assert got == brute_repeats(rows, 50)


def test_runs_meet_without_a_shuffle_and_are_merged_by_size(spark, docs, corpus):
    with substrings.FingerprintIndex(spark, 12, 5) as index:
        ids = sorted(i for i, _ in corpus)
        parts = [docs.filter(F.col("doc_id").between(ids[k], ids[min(k + 15, len(ids)) - 1])) for k in range(0, 60, 15)]
        for part in parts[:3]:
            index.ingest(part, compact=False)
        assert len(index.runs) == 3
        own = index.runs.pop()
        with S.settings(spark, substrings._MERGE):
            flagged, theirs = index.merge_join(own)
            for df in (flagged, theirs):
                plan = df._jdf.queryExecution().executedPlan().toString()
                assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan and "Sort [" not in plan
        index.runs.append(own)
        entries = sum(run._entries for run in index.runs)
        index.compact()
        assert len(index.runs) < 3 and sum(run.agg(F.sum("n")).first()[0] for run in index.runs) >= entries
        for run in index.runs:
            assert run.groupBy("h", "r", "q").count().filter("count > 1").count() == 0
        names = [run._name for run in index.runs]
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_salted_join_deals_hot_keys_out(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_LEAST", 10)
    rows = spark.range(500).selectExpr("if(id < 300, 0, id) as k", "id as v")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    got = S.salted_join(rows, table, ["k"], 500, ["v"])
    assert sorted(tuple(r) for r in got.collect()) == sorted((0, v, 299) if v < 300 else (v, v, v) for v in range(500))
