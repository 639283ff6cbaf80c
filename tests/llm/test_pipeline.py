"""Each stage of the pipeline on its predecessor's rows."""

import numpy as np
import pytest

import corpus_pipeline
from hostweave.llm import _support as S
from hostweave.llm import decontaminate, lines, simhash


@pytest.fixture(scope="module")
def stages(spark, sf):
    out = [S.table(spark, sf, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(S.cut(stage(spark, out[-1], sf), name))
    return out


def test_stage_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    for df in stages[1:5]:
        assert df.dtypes == stages[0].dtypes


def test_toxicity_keeps_most_and_drops_flagged(spark, sf, stages):
    before, after = {r.doc_id for r in stages[0].collect()}, {r.doc_id for r in stages[1].collect()}
    assert after < before and len(after) > 0.7 * len(before)


def test_lines_go_and_documents_stay(spark, stages):
    before = {r.doc_id: r.text for r in stages[1].collect()}
    want = {r.doc_id: r.text for r in lines.drop_boilerplate(stages[1], host="source").collect()}
    got = {r.doc_id: (r.text, r.n_chars) for r in stages[2].collect()}
    assert got.keys() == before.keys() and all(t == want[i] and n == len(t) for i, (t, n) in got.items())


def test_one_document_of_each_group_stays(stages):
    rows = stages[2].collect()
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in rows}
    kept = {r.doc_id for r in stages[3].collect()}
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    label = np.arange(len(ids))
    while True:
        best = np.array([label[row].min() for row in near])
        if (best == label).all():
            break
        label = best
    assert kept == {ids[k] for k in set(label.tolist())}


def test_contaminated_documents_go(spark, sf, stages):
    found = decontaminate.contamination(stages[3], S.table(spark, sf, "benchmark")).collect()
    assert {r.doc_id for r in stages[4].collect()} == {r.doc_id for r in found if not r.contaminated}
    assert any(r.contaminated for r in found)


def test_packing_places_all_that_is_left(stages):
    placed = stages[5].collect()
    assert {r.doc_id for r in placed} == {r.doc_id for r in stages[4].collect()}
    by_sequence = {}
    for r in placed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_entry_works_without_the_corpus_part():
    import subprocess
    import sys

    code = "import sys; sys.modules['hostweave.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rpartition("/")[0])


def odd_rows(spark):
    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in ("ab", "cd"))
    rows = [(3, a), (7, a), (7, b), (9, "see"), (9, "see"), (None, a), (None, "lone words of its own"), (4, None), (5, ""), (8, " \n")]
    docs = spark.createDataFrame([(i, t, None if i == 9 else "en", "s", len(t or ""), 1, "x", True, 0.5) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, line_count int, score string, contaminated boolean, n_words double")
    return rows, docs


def test_survivors_are_rows(spark, sf):
    rows, docs = odd_rows(spark)
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, sf)
    assert kept.dtypes == docs.dtypes
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([rows[0], rows[2], (9, "see"), (None, "lone words of its own"), (4, None)], key=str)


def test_stages_on_odd_rows_and_extra_columns(spark, sf):
    rows, docs = odd_rows(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes, name
        got = out.collect()
        if name == "line_dedup":  # a text on three of ten pages of the source is boilerplate; its rows stay
            assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
        elif name != "simhash_near_dedup":  # clean documents stay
            assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(rows, key=str), name
        assert all((r.line_count, r.score, r.contaminated, r.n_words) == (1, "x", True, 0.5) for r in got), name
    assert corpus_pipeline.best_fit_packing(spark, docs, sf).count() == len(rows)
