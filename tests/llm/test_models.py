"""Toxicity, language identification and vector near-duplicates on small planted data."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostweave.llm import _support as S
from hostweave.llm import embeddings, language, toxicity

# ---- toxicity --------------------------------------------------------------------------------------------

BAD = {"en": ["vilefoo", "grumbar"], "xx": ["zorkla", "zorkli", "zorklust", "zorkleck"]}


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(900):
        lang = "en" if i % 3 else "xx"
        words = [("en" if lang == "en" else "ux") + w for w in map(str.lower, rng.choice([a + b for a in "abcdefgh" for b in "klmnop"], rng.integers(5, 60)))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words.insert(int(rng.integers(0, len(words))), rng.choice(BAD[lang]))
        rows.append((i, " ".join(words).capitalize() + ".", lang, toxic))
    return rows


def test_classifier_finds_planted_words_and_stems(labelled):
    model = toxicity.fit([(t, y, g) for _, t, g, y in labelled[:700]], 1.0)
    scorer = toxicity.Scorer(model, entries=40, stretch=16)  # tables are reset and texts cut all the time
    whole = toxicity.Scorer(model)
    scores = np.array([scorer.score(t) for _, t, _, _ in labelled[700:]])
    assert np.allclose(scores, [whole.score(t) for _, t, _, _ in labelled[700:]], atol=1e-4)
    want = np.array([y for _, _, _, y in labelled[700:]])
    assert ((scores >= 0.5) == want).mean() > 0.95
    assert scorer.score("uxak zorklong uxbk") > scorer.score("uxak uxcl uxbk")  # a form never seen, of a known stem
    assert scorer.score("word " * 3000 + " vilefoo") == pytest.approx(scorer.score("word word vilefoo"), abs=0.2)


def test_classifier_operator(spark, labelled):
    docs = spark.createDataFrame([(i, t, g) for i, t, g, _ in labelled] + [(5000, None, "en"), (5001, "", None), (5002, "?!", "xx"), (5002, "?!", "xx")], "doc_id bigint, text string, lang string").withColumn("score", F.lit("old"))
    labels = spark.createDataFrame([(i, y) for i, _, _, y in labelled] + [(0, None), (None, 1), (7777, 1)], "doc_id bigint, toxic int")
    model = toxicity.learn(docs, labels, sample_toxic=200, sample_clean=300)
    out = toxicity.score(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "score", "predicted"]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 903 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = {r.doc_id for r in docs.filter(S.doc_fold(F.col("doc_id"), 5) == 0).select("doc_id").collect()}
    right = [got[i].predicted == y for i, _, _, y in labelled if i in held]
    assert np.mean(right) > 0.95
    assert got[5000].score == got[5001].score == got[5002].score and got[5000].predicted == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_classifier_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", "en")], "doc_id bigint, text string, lang string")
    model = toxicity.learn(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert 0 <= toxicity.score(docs, model).first().score <= 1


def test_threshold_lies_between_classes():
    z, y = np.array([3.0, 2.0, -1.0, -2.0]), np.array([1.0, 1.0, 0.0, 0.0])
    assert toxicity.threshold(z, y, np.ones(4)) == 0.5


def test_every_labelled_row_teaches(spark):
    """The toxic word of most rows is in none of those that come first by hash; a model of a sample never sees it."""
    rng = np.random.default_rng(6)
    ids = [r.id for r in spark.range(2000).filter(S.doc_fold(F.col("id"), 5) != 0).orderBy(F.xxhash64("id")).collect()]
    rows = []
    for k, i in enumerate(ids):
        words, toxic = [a + b for a, b in zip(rng.choice(list("abcdefgh"), 20), rng.choice(["lo", "mi", "na"], 20), strict=True)], int(k % 3 == 0)
        if toxic:
            words.insert(int(rng.integers(0, 20)), "grumbar" if k < 150 else "zorkla")
        rows.append((i, " ".join(words), "en", toxic))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string")
    model = toxicity.learn(docs, spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id bigint, toxic int"), sample_toxic=40, sample_clean=60)
    scorer = toxicity.Scorer(model)
    assert np.mean([(scorer.score(t) >= 0.5) == y for _, t, _, y in rows]) > 0.97
    assert scorer.score("alo bmi zorkla cna") >= 0.5 > scorer.score("alo bmi cna")


def test_labelled_rows_are_all_there_once(spark):
    docs = spark.createDataFrame([(i, f"text {i % 50}", None) for i in range(400)] * 2 + [(1, "other", "en"), (None, "x", "en"), (3, None, "en")], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 0) for i in range(300)] + [(7, 1), (None, 1), (8, None)], "doc_id bigint, toxic int")
    found = toxicity.labelled(docs, labels).collect()
    ids = [r.id for r in spark.range(300).filter(S.doc_fold(F.col("id"), 5) != 0).collect()]
    assert sorted(r.text for r in found) == sorted([f"text {i % 50}" for i in ids] + ["other"] * (1 in ids))
    assert sum(r.toxic for r in found) == (7 in ids)
    assert len({(r.text, r.held) for r in found}) == len({r.text for r in found})  # copies on one side


def test_copies_of_the_model_are_averaged(spark, labelled):
    rows = spark.createDataFrame([(t, y) for _, t, _, y in labelled], "text string, toxic int").repartition(3).cache()
    trainer = toxicity.untrained(np.random.default_rng(1), 0.3)
    for turn in range(6):
        toxicity._train_everywhere(rows, trainer, turn)
    scorer = toxicity.Scorer(trainer.model)
    trainer.model.thresholds = np.zeros(1)
    assert np.mean([(scorer.score(t) >= 0.5) == y for _, t, _, y in labelled]) > 0.95


def test_language_evidence_counts_all_rows(spark, labelled):
    texts = [(g if i % 7 else None, t) for i, t, g, _ in labelled] + [("rare", "a b c")] * 9
    names, evidence = toxicity._evidence(spark.createDataFrame(texts, "lang string, text string").repartition(3))
    want, numbers = toxicity.language_evidence([t for _, t in texts], [g for g, _ in texts])
    assert names == want == ["en", "xx"] and np.allclose(evidence, numbers)


def test_cuts_over_a_table_are_the_thresholds(spark):
    rng = np.random.default_rng(9)
    rows = [(int(g), float(np.round(rng.normal(2 * y, 1 + g), 1 if g == 1 else 6)), int(y)) for g, y in zip(rng.integers(-1, 3, 1200), rng.random(1200) < 0.2, strict=True)] + [(5, 0.5, 1), (6, 0.5, 0), (6, 90.0, 0), (6, -300.0, 1)]
    found = toxicity.cuts(spark.createDataFrame(rows, "language int, z double, toxic int").repartition(3))
    assert sorted(found) == [-1, 0, 1, 2, 5, 6]
    for g, (at, toxic, clean) in found.items():
        z, y = (np.array([r[k] for r in rows if g in (-1, r[0])], float) for k in (1, 2))
        assert (toxic, clean) == (y.sum(), (1 - y).sum())
        assert at == pytest.approx(toxicity.threshold(z, y, np.ones(len(z))))


def test_a_stretch_of_words_is_enough(monkeypatch):
    trainer = toxicity.untrained(np.random.default_rng(3), 0.5)
    docs = [trainer.buckets_of(" ".join(np.random.default_rng(k).choice(list("abcdefghijklmnop"), n))) for k, n in enumerate((1, 2, 40, 7))]
    best, won = trainer.pool(docs)
    for k, rows in enumerate(docs):
        r = toxicity.responses(trainer.model.embeddings[rows].sum(axis=1) @ trainer.model.filters)
        assert np.allclose(best[k], r.max(axis=0)) and np.allclose(r[won[k], range(r.shape[1])], best[k])
    monkeypatch.setattr(toxicity, "STRETCH", 5)
    assert np.allclose(trainer.pool(docs)[0], best)


@pytest.mark.parametrize("piece,steps", [(1 << 18, 48), (1, 20), (7, 21)])
def test_words_of_many_texts_at_once(monkeypatch, piece, steps):
    """The buckets of ``words_of``, whatever the script, however long the word."""
    monkeypatch.setattr(toxicity, "PIECE", piece)
    monkeypatch.setattr(toxicity, "STEPS", steps)
    texts = ["Plain words, plain!", None, "", "?! 12", "ΣΊΣΥΦΟΣ ΌΔΟΣ. İstanbul Straße", "a" * 300 + " " + "é" * 99 + "b 中文字字字字字", "x_y 12a3b ½²x ٣ب ㊀", "𝔘𝔫𝔦 𐐀𐐁𐐂𐐃𐐄𐐅x 😀y", "Жж", " lead  and trail "]
    for text, rows in zip(texts, toxicity.buckets_of(texts), strict=True):
        assert rows.tolist() == toxicity.buckets(toxicity.words_of(text)).tolist()
    assert toxicity.buckets_of([]) == []


def test_words_of_many_texts_are_cheap():
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(300)) for _ in range(100)]

    def seconds(work):
        begun = time.process_time()
        work()
        return time.process_time() - begun

    scorer = toxicity.Scorer(toxicity.untrained(rng, 0.5).model)
    plain = min(seconds(lambda: [toxicity.buckets(toxicity.words_of(t)) for t in texts]) for _ in range(3))
    assert min(seconds(lambda: toxicity.buckets_of(texts)) for _ in range(3)) < 0.7 * plain
    assert min(seconds(lambda: scorer.score_of(texts)) for _ in range(3)) < 1.5 * plain
    assert np.allclose(scorer.score_of(texts), [scorer.score(t) for t in texts])


# ---- language --------------------------------------------------------------------------------------------

SYLLABLES = {"en": "the and ing tion her ent for", "de": "der sch ein ung und ich cht", "el": "και του την που ειν στη μα", "zh": "的是 不了 在人 有我 他这 中大 来上"}


def text_in(lang, rng, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split(), 2)) for _ in range(n)).capitalize() + "! 12"


def test_language(spark):
    rng = np.random.default_rng(4)
    rows = [(i, text_in(lang, rng, int(rng.integers(3, 80))), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 + 3 = 15 !", "de"), (1003, text_in("de", rng, 9), None), (1003, text_in("de", rng, 9), None), (1004, text_in("en", rng, 20_000), "en"), (1005, "Жж", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows + odd], "doc_id bigint, text string, lang string, score int")
    found = {r.doc_id: r for r in language.identify(docs, S.doc_fold(F.col("doc_id"), 4) != 2, sample_rows=30).collect()}
    assert np.mean([found[i].lang_pred == g for i, _, g in rows]) > 0.98
    assert [(found[i].lang_pred, found[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert found[1003].lang_pred == "de" and found[1004].lang_pred == "en" and found[1005].lang_pred in SYLLABLES
    assert all(0 <= r.score <= 1 for r in found.values())
    assert language.identify(docs.limit(0), F.lit(True)).count() == 0
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect()} == {"und"}


def test_no_letter_is_folded_away(spark):
    def word(first, rng):  # words of one length, so that only letters tell scripts apart
        return "".join(chr(first + int(k)) for k in rng.integers(0, 24, 5))

    rng = np.random.default_rng(3)
    scripts = {"ka": 0x10D0, "am": 0x1200, "hangul": 0xAC00, "han": 0x4E00, "kana": 0x3041, "arab": 0x0620}
    rows = [(" ".join(word(first, rng) for _ in range(30)), lang) for lang, first in scripts.items() for _ in range(12)]
    profiles = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert all(profiles.predict(text)[0] == lang for text, lang in rows)
    assert len(profiles.alphabet) > 90 and len(language.ranked("\u0436\u0449", "ab")[0]) == 2 + 3 + 2


def test_ranking_by_both_ways_of_counting():
    text = text_in("en", np.random.default_rng(1), 4000)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    base = len(alphabet) + 2
    grams = language._grams(language._codes(text, alphabet), base)
    known, counts = np.unique(grams, return_counts=True)
    order = np.lexsort((known, -counts))[: language.PROFILE]
    assert language.ranked(text, alphabet)[0].tolist() == known[order].tolist()


# ---- vectors ---------------------------------------------------------------------------------------------


def brute(rows, least=0.98):
    ids = [r[0] for r in rows]
    unit = {}
    for i, (_, v, label) in enumerate(rows):
        if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v):
            v = np.array(v, float) / np.abs(v).max()
            unit[i] = v / np.linalg.norm(v)
    links, parent = {i: 0 for i in range(len(rows))}, {x: x for x in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in unit:
        for j in unit:
            if i != j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                a, b = find(ids[i]), find(ids[j])
                parent[max(a, b)] = min(a, b)
    return sorted((ids[i], links[i], find(ids[i]), find(ids[i]) == ids[i]) for i in range(len(rows)))


@pytest.mark.parametrize("per_pivot,block", [(20_000, 2048), (20, 2048), (25, 16), (5, 7)])
def test_vectors(spark, per_pivot, block):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(12):
        centre = rng.normal(size=16)
        spread = rng.choice([0.02, 0.05, 0.12])
        rows += [((centre + spread * rng.normal(size=16)) * rng.choice([1.0, 7.0])).tolist() for _ in range(14)]
    rows += rng.normal(size=(60, 16)).tolist() + [rows[0]] * 9
    rows = [(int(i), v, int(i) % 2 if k < 160 else 0) for k, (i, v) in enumerate(zip(rng.permutation(len(rows)) * 2, rows, strict=True))]
    rows += [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 16, 1), (9004, [float("nan")] * 16, 1), (9005, [float("inf")] + [1.0] * 15, 1), (9006, [None] + [1.0] * 15, 1), (9007, rows[0][1], None), (9008, rows[0][1][:8], rows[0][2]), (9009, [1e-200] * 16, 5), (9010, [1e200] * 16, 5)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, vec string").repartition(3)
    got = sorted(tuple(r) for r in embeddings.near_vectors(df, per_pivot=per_pivot, block=block).collect())
    assert got == brute(rows)
    assert sum(r[1] > 0 for r in got) > 100


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert embeddings.near_vectors(df).count() == 0


# ---- learning from whole texts and bounded rows ----------------------------------------------------------


def test_toxic_words_late_in_a_long_text_are_learnt(spark):
    rng = np.random.default_rng(6)
    plain = [a + b + c for a in "abcdefgh" for b in "klmnop" for c in "uvw"]
    rows = []
    for i in range(160):
        words = list(rng.choice(plain, 9000 if i % 8 == 0 else 30))
        toxic = i % 4 == 0
        rows.append((i, " ".join([*words, "vilefoo"] if toxic else words), "en", int(toxic)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string")
    model = toxicity.learn(docs, spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id bigint, toxic int"))
    scorer = toxicity.Scorer(model)
    assert np.mean([(scorer.score(t) >= 0.5) == bool(y) for _, t, _, y in rows]) > 0.97


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda sample, weight: seen.append(sample))
    text = "same words"
    docs = spark.range(40).selectExpr("id % 2 as doc_id", f"'{text}' as text", "'en' as lang").unionAll(spark.createDataFrame([(4, "x" * 500, "en"), (None, "y", "en"), (5, None, "en")], "doc_id bigint, text string, lang string"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1)], "doc_id bigint, toxic int")
    toxicity.learn(docs, labels, folds=10**6, sample_bytes=100)
    toxicity.learn(docs, labels, folds=10**6)
    assert sorted(t for t, _, _ in seen[0]) == [text] * 2 and sorted(len(t) for t, _, _ in seen[1]) == [10, 10, 500]


def naive_logit(model, text):
    """The classifier's formula place by place."""
    words = toxicity.words_of(text)
    vectors = [model.embeddings[toxicity.buckets([w])[0]].sum(axis=0) for w in words]
    pooled, column = [], 0
    for span in toxicity.SPANS:
        best = np.zeros(toxicity.FILTERS)
        for at in range(len(words)):
            total = model.bias[len(pooled) : len(pooled) + toxicity.FILTERS].copy()
            for j in range(span):
                if at + j < len(words):
                    total += vectors[at + j] @ model.filters[:, column + j * toxicity.FILTERS : column + (j + 1) * toxicity.FILTERS]
            best = np.maximum(best, total)
        pooled += best.tolist()
        column += span * toxicity.FILTERS
    return float(np.array(pooled) @ model.weights + model.offset)


def test_scores_equal_the_plain_forward_pass(labelled):
    model = toxicity.fit([(t, y, g) for _, t, g, y in labelled[:300]], 1.0)
    for text in [labelled[400][1], labelled[401][1] + " vilefoo", "one", "", None]:
        assert toxicity.Scorer(model, stretch=7).raw(text)[0] == pytest.approx(naive_logit(model, text), abs=1e-4)


def test_training_follows_the_gradient():
    """A step along the numerical gradient's sign: loss falls with training and words of one label part."""
    texts, labels = ["aa bb cc", "aa bb dd", "ee bb cc", "ee dd"] * 8, np.array([1.0, 1.0, 0.0, 0.0] * 8)

    def loss(epochs):
        m = toxicity.train(texts, labels, epochs=epochs)
        z = np.array([naive_logit(m, t) for t in texts[:4]])
        return float(np.mean(np.log1p(np.exp(-z * (2 * labels[:4] - 1)))))

    assert loss(40) < loss(10) < loss(0)


@pytest.mark.parametrize("few", [0, 20_000])
def test_language_sample_by_either_join(spark, monkeypatch, few):
    monkeypatch.setattr(language, "BROADCAST_LANGUAGES", few)
    data = [(f"l{i % 3}", f"text {i}", (i * 7919) % 1009) for i in range(900)]
    rows = spark.createDataFrame(data, "lang string, text string, o bigint").repartition(11)
    got = language._sample(rows, 20).collect()
    want = [(g, t) for g in ("l0", "l1", "l2") for _, t in sorted((o, t) for x, t, o in data if x == g)[:20]]
    assert sorted((r.lang, r.text) for r in got) == sorted(want)
    assert language._sample(rows.limit(0), 20).count() == 0


def test_language_sample_is_exact_and_bounded(spark):
    rows = spark.range(500).selectExpr("'en' as lang", "'one text' as text", "1L as o").unionAll(spark.range(90).selectExpr("'de' as lang", "cast(id as string) as text", "id as o")).repartition(7)
    got = language._sample(rows, 20).collect()
    assert sum(r.lang == "en" for r in got) == 20 and sorted(int(r.text) for r in got if r.lang == "de") == list(range(20))


@pytest.mark.parametrize("stretch", [5, 64, 1 << 20])
def test_counting_by_stretches(stretch, monkeypatch):
    text = text_in("el", np.random.default_rng(2), 60)
    alphabet = "".join(sorted({c for c in text.lower() if c.isalpha()}))
    want = np.unique(language._grams(language._codes(text, alphabet), len(alphabet) + 2), return_counts=True)
    monkeypatch.setattr(language, "STRETCH", stretch)
    used, n = language._counted(text, alphabet)
    assert used[n > 0].tolist() == want[0].tolist() and n[n > 0].tolist() == want[1].tolist()


def naive_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    joined = " " + " ".join(words) + " "
    return [c for w in words for c in w] + [joined[i : i + 2] for i in range(len(joined) - 1)] + [joined[i : i + 3] for i in range(len(joined) - 2)]


def test_distance_is_out_of_place(spark):
    """Scores against a plain out-of-place distance; ties of rank are broken as the operator breaks them."""
    rng = np.random.default_rng(12)
    rows = [(text_in(g, rng, 40), g) for g in SYLLABLES for _ in range(5)]
    profiles = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    base = len(profiles.alphabet) + 2
    number = {" ": 0} | {c: i + 2 for i, c in enumerate(profiles.alphabet)}

    def code(gram):
        v = [number[c] for c in gram]
        return v[0] if len(v) == 1 else base + v[0] * base + v[1] if len(v) == 2 else base + base * base + (v[0] * base + v[1]) * base + v[2]

    def top(texts):
        counts = {}
        for t in texts:
            for g in naive_grams(t):
                counts[g] = counts.get(g, 0) + 1
        return sorted(counts, key=lambda g: (-counts[g], code(g)))[: language.PROFILE]

    learnt = {g: {x: i for i, x in enumerate(top([t for t, h in rows if h == g]))} for g in SYLLABLES}
    for g in SYLLABLES:
        text = rows[0][0] + " " + text_in(g, np.random.default_rng(5), 12)
        mine = top([text])
        if any(c not in number for c in text.lower() if c.isalpha()):
            continue
        distance = {k: sum(min(abs(p.get(x, 10**9) - i), language.PROFILE) for i, x in enumerate(mine)) for k, p in learnt.items()}
        best = min(sorted(distance), key=distance.get)
        lang, score = profiles.predict(text)
        assert lang == best and score == pytest.approx(1 - distance[best] / (language.PROFILE * len(mine)))


def test_vectors_that_share_an_id_are_told_apart(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a, 0), (1, b, 0), (2, [0.999, 0.01, 0.0], 0), (3, [0.01, 0.999, 0.0], 0), (None, a, 0), (5, a, 1), (6, None, 0), (None, None, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = sorted(map(str, (tuple(r) for r in embeddings.near_vectors(df, per_pivot=2).collect())))
    want = [(1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (3, 1, 1, False), (None, 2, 1, False), (5, 0, 5, True), (6, 0, 6, True), (None, 0, None, False)]
    assert got == sorted(map(str, want))


def test_cells_save_comparisons(spark):
    """At the default cell size a few thousand vectors lie in many cells, and fewer pairs meet than there are."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24))
    rows = [(int(i), (centres[i % 40] + 0.3 * rng.normal(size=24)).tolist(), int(i % 2)) for i in range(4000)]
    units = embeddings.unit_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    found = embeddings.cells(embeddings.distinct_vectors(units), 0.98).groupBy("label", "cell").agg(F.count_if("home").alias("h"), F.count(F.lit(1)).alias("n")).collect()
    assert len(found) == 2 * 4 and sum(r.h for r in found) == 4000
    met, pairs = sum(r.h * (r.h - 1) // 2 + r.h * (r.n - r.h) for r in found), 2 * 2000 * 1999 // 2
    assert met < 0.75 * pairs


def test_string_labels_and_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_LEAST", 3)
    rows = [(i, [1.0, 2.0], "x") for i in range(40)] + [(50 + i, [float(i), 1.0], "y") for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")
    assert sorted(tuple(r) for r in embeddings.near_vectors(df, per_pivot=3).collect()) == brute(rows)
