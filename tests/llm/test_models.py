"""Trained operators: held-out accuracy on the given tables, and defined results for awkward rows."""

import os
import random
import re
import zlib

import numpy as np
import pytest
from fixtures import awkward, clashing, empty, rows_of
from pyspark.sql import functions as F

from tallymark.llm import language, quality, queries, toxicity
from tallymark.llm.fitting import fold, sample_per_label, trimmed, weighted_quantile

FOLDER = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.01")


def documents(spark):
    return queries.table(spark, FOLDER, "documents")


def test_language_held_out(spark):
    found = queries.QUERIES["op4_subword_language"](spark, FOLDER).join(documents(spark).select("doc_id", "lang"), "doc_id")
    rows = found.filter("held_out").collect()
    assert len(rows) > 200 and found.count() == documents(spark).count()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.accepted for r in rows) >= 0.98 * len(rows)


def test_quality_held_out(spark):
    labels = queries.table(spark, FOLDER, "labels")
    found = queries.QUERIES["op7_bradley_terry_quality"](spark, FOLDER)
    assert found.count() == documents(spark).count()
    rows = found.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) >= 0.98


def test_toxicity_leaves_clean_documents_alone(spark):
    """On the larger table: the smaller one labels 45 toxic documents to learn from."""
    folder = "/root/testdata/sf0.1"
    labels = queries.table(spark, folder, "labels").withColumnRenamed("toxic", "label")
    found = queries.QUERIES["op1_ordinal_toxicity"](spark, folder)
    assert found.count() == queries.table(spark, folder, "documents").count()
    for part in ("held_out", "not held_out"):
        rows = found.join(labels, "doc_id").filter(part).collect()
        assert sum(r.toxic for r in rows if not r.label) <= 0.01 * len(rows)
        assert sum(r.toxic for r in rows if r.label) >= 0.9 * sum(r.label for r in rows)


def test_grades_are_ordered(spark):
    """Four grades that share one direction: severity rises with the grade."""
    rng = np.random.default_rng(3)
    x = (rng.random((3000, 30)) < 0.3).astype(np.float32)
    raw = x[:, :10].sum(1) - x[:, 10:20].sum(1) + rng.normal(0, 0.3, 3000)
    y = np.digitize(raw, [-2, 0, 2])
    weights, thresholds = toxicity.fit(x, y, 4, 1e-4, 800)
    assert (np.diff(thresholds) > 0).all()
    assert (weights[:10] > 0.3).all() and (weights[10:20] < -0.3).all() and np.abs(weights[20:]).max() < 0.3
    model = toxicity.ToxicityModel(np.arange(30), weights, thresholds, np.arange(4.0))
    severity = model.above(x @ weights).sum(1)
    assert all(severity[y == g].mean() + 0.4 < severity[y == g + 1].mean() for g in range(3))
    assert np.corrcoef(severity, y)[0, 1] > 0.9


def models(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 1), (7, 0, 1), (9, 0, 0), (11, 1, 0), (99, 0, 1), (4, None, None), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    return docs, [
        language.train(docs).predict,
        quality.train(docs, labels).score,
        toxicity.train(docs, labels, label="toxic", least_rows=1).grade,
    ]


def test_awkward_rows(spark):
    docs, found = models(spark)
    ids = sorted(repr(r.doc_id) for r in docs.collect())
    for score in found:
        plain = score(docs).collect()
        assert sorted(repr(r.doc_id) for r in plain) == ids
        assert all(v is not None for r in plain for v in tuple(r)[1:])
        assert rows_of(score(clashing(docs))) == rows_of(score(docs))
        assert score(empty(spark)).collect() == []


def test_texts_without_letters_are_unknown(spark):
    docs, (predict, _, _) = models(spark)
    found = {r.doc_id: r for r in predict(docs.filter("doc_id is not null")).collect()}
    for key in (4, 5, 6, 13):
        assert (found[key].lang_pred, found[key].score, found[key].accepted) == ("und", 0.0, False)
    assert all(found[k].lang_pred in ("en", "fr") for k in (1, 7, 12))


def test_nothing_to_learn_from(spark):
    docs, none = awkward(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    n = docs.count()
    assert [tuple(r)[1:] for r in language.train(empty(spark)).predict(docs).distinct().collect()].count(("und", 0.0, False)) > 0
    scored = quality.train(docs, none)
    assert {(round(r.score, 9), r.kept) for r in scored.score(docs).collect()} == {(0.3, True)}
    assert scored.filter(docs).count() == n
    assert {(r.grade, r.toxic) for r in toxicity.train(docs, none, label="toxic").grade(docs).collect()} == {(0, False)}


def test_filters_keep_all_columns(spark):
    docs = documents(spark)
    model = language.train(docs)
    kept = model.filter(docs)
    assert kept.columns == docs.columns
    accepted = model.predict(docs).filter("accepted").select("doc_id")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in accepted.collect())


def test_samples_are_bounded(spark):
    rows = spark.range(30_000).selectExpr("id as doc_id", "if(id % 100 = 0, 'rare', 'often') as label")
    counts = dict(sample_per_label(rows, "label", 500).groupBy("label").count().collect())
    assert counts == {"often": 500, "rare": 300}
    assert rows_of(sample_per_label(rows, "label", 50)) == rows_of(sample_per_label(rows.repartition(7), "label", 50))


def test_folds_follow_the_checksum_of_the_id(spark):
    rows = spark.range(50).select("id", fold("id", 5).alias("fold")).collect()
    assert all(r.fold == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


@pytest.mark.parametrize("word, core", [(b"'word,", "word"), ("«été»".encode(), "été"), (b"12-3", ""), (b"a1b2", "a1b"), (b"", "")])
def test_words_lose_what_surrounds_their_letters(word, core):
    assert trimmed(word) == core


def test_gaps_between_grades(spark):
    """With grades 0 and 3 alone, what is toxic has severity near 3 and grade 3."""
    docs = spark.createDataFrame([(i, f"plain words number {i} " + ("awful vile slur" if i % 2 else "kind mild phrase")) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 3 * (i % 2)) for i in range(200)], "doc_id long, grade int")
    found = toxicity.train(docs, labels).grade(docs).collect()
    assert {(r.doc_id % 2, r.grade, r.toxic) for r in found} == {(0, 0, False), (1, 3, True)}
    assert all(r.severity > 2 if r.doc_id % 2 else r.severity < 1 for r in found)


def plain_words(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


def core(word):
    letters = [i for i, c in enumerate(word) if c.isalpha()]
    return word[letters[0] : letters[-1] + 1] if letters else ""


def test_language_scores_equal_plain_loops(spark):
    docs = documents(spark).select("doc_id", "text").union(awkward(spark).select("doc_id", "text"))
    model = language.train(documents(spark))
    buckets = len(model.scores)

    def score(text):
        total, n = np.zeros(len(model.languages)), 0
        for word in map(core, plain_words((text or "").lower())):
            if word:
                word = f"<{word}>"
                for gram in [word[i : i + k] for k in (2, 3, 4) for i in range(len(word) - k + 1)] + [word]:
                    total += model.scores[zlib.crc32(gram.encode()) % buckets]
                    n += 1
        if not n:
            return "und", 0.0
        logits = (total / n + model.bias) / model.temperature
        chance = np.exp(logits - logits.max())
        return model.languages[int(chance.argmax())], float(chance.max() / chance.sum())

    expected = sorted(((r.doc_id, *score(r.text)) for r in docs.collect()), key=repr)
    found = sorted((tuple(r)[:3] for r in model.predict(docs).collect()), key=repr)
    assert [r[:2] for r in found] == [r[:2] for r in expected]
    assert np.allclose(sorted(r[2] for r in found), sorted(r[2] for r in expected), atol=1e-4)


def test_toxicity_equals_plain_loops(spark):
    folder = "/root/testdata/sf0.001"
    docs = queries.table(spark, FOLDER, "documents")
    model = toxicity.train(docs, queries.table(spark, FOLDER, "labels"), label="toxic")
    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    some = queries.table(spark, folder, "documents").select("doc_id", "text").union(awkward(spark).select("doc_id", "text"))

    def severity(text):
        total = 0.0
        for word in set(plain_words((text or "").lower())):
            part = core(word).lower()
            features = {part + "$", *(part[:k] for k in range(3, 8) if k < len(part))} if part else set()
            total += sum(weight.get(zlib.crc32(f.encode()) % 2**31, 0.0) for f in features)
        return sum(1 / (1 + np.exp(t - total)) for t in model.thresholds)

    expected = sorted((repr(r.doc_id), severity(r.text)) for r in some.collect())
    found = sorted((repr(r.doc_id), r.severity) for r in model.grade(some).collect())
    assert [r[0] for r in found] == [r[0] for r in expected]
    assert np.allclose([r[1] for r in found], [r[1] for r in expected], atol=1e-4)


def test_quality_learns_from_every_labelled_document(spark):
    """More documents of a label than a sample of 6,000 would hold: centre, spread and threshold are those of all."""
    chance = random.Random(6)
    rows = [(i, " ".join(["word", "Other,", "x1"][chance.randrange(1 + i % 3)] for _ in range(chance.randrange(1, 12)))) for i in range(15_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(chance.random() < 0.3 + 0.2 * (i % 3))) for i, _ in rows], "doc_id long, quality int")
    model = quality.train(docs, labels)
    x = np.array([quality.describe(t) for _, t in rows])
    assert np.allclose(model.middle, x.mean(0), atol=1e-9) and np.allclose(model.spread[x.std(0) > 0], x.std(0)[x.std(0) > 0])
    raw = np.sort(model.bent(x) @ model.weight)
    bad = labels.filter("quality = 0").count()
    assert np.isclose(model.threshold, raw[bad - 1], atol=1e-9)


def test_quality_weights_have_least_loss_over_all_pairs(spark):
    chance = random.Random(3)
    rows = [(i, " ".join(["word", "Other,", "x1", "!"][chance.randrange(2 + i % 3)] for _ in range(chance.randrange(1, 9)))) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    y = np.array([int(chance.random() < 0.2 + 0.3 * (i % 3)) for i, _ in rows])
    model = quality.train(docs, spark.createDataFrame(list(enumerate(y.tolist())), "doc_id long, quality int"))
    x = model.bent(np.array([quality.describe(t) for _, t in rows]))
    pairs = (x[y == 1][:, None] - x[y == 0][None]).reshape(-1, x.shape[1])
    loss = lambda w: np.logaddexp(0, -pairs @ w).mean() + 0.0005 * w @ w
    weight = np.zeros(x.shape[1])
    for _ in range(30):
        missed = 1 / (1 + np.exp(pairs @ weight))
        slope = pairs.T @ missed / len(pairs) - 0.001 * weight
        weight += np.linalg.solve((pairs * (missed * (1 - missed))[:, None]).T @ pairs / len(pairs) + 0.001 * np.eye(len(weight)), slope)
    assert loss(weight) <= loss(model.weight) <= loss(weight) + 1e-4


def test_weighted_quantiles_are_exact(spark):
    chance = random.Random(4)
    rows = [(chance.choice([-1e300, -2.5, -0.0, 0.0, 1e-310, 3.0, chance.gauss(0, 1)]), chance.choice([1.0, 2.5])) for _ in range(400)]
    table = spark.createDataFrame(rows, "value double, weight double")
    rows.sort()
    upto = np.cumsum([w for _, w in rows])
    for share in (0.0, 0.1, 0.33, 0.5, 0.9, 1.0):
        wanted = rows[min(int(np.searchsorted(upto, share * upto[-1] * (1 - 1e-12))), 399)][0]
        assert weighted_quantile(table, "value", F.col("weight"), share) == wanted


def test_quality_equals_plain_loops(spark):
    docs = queries.table(spark, FOLDER, "documents")
    model = queries.quality_model(docs, queries.labels(spark, FOLDER))
    some = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").union(awkward(spark).select("doc_id", "text"))

    def score(text):
        total = 0.0
        for i, value in enumerate(quality.describe(text)):
            x = min(max((value - model.middle[i]) / model.spread[i], -8), 8)
            total += model.weight[i] * x
            for j, knots in enumerate(model.knots):
                total += model.weight[(j + 1) * quality.FEATURES + i] * max(x - knots[i], 0)
        odds = np.exp(min(max(model.scale * (total - model.threshold), -500), 500)) * model.place / (1 - model.place)
        return odds / (1 + odds)

    expected = sorted((repr(r.doc_id), score(r.text)) for r in some.collect())
    found = sorted((repr(r.doc_id), r.score) for r in model.score(some).collect())
    assert [r[0] for r in found] == [r[0] for r in expected]
    assert np.allclose([r[1] for r in found], [r[1] for r in expected], atol=1e-9)


def test_texts_of_no_learned_language_are_rejected(spark):
    """The threshold is the calibrated one: clean held-out documents stay, and strings of random letters go."""
    model = queries.language_model(documents(spark))
    chance = random.Random(4)
    noise = [("".join(chance.choice("bcdfghjklmnpqrstvwxz") + (" " if chance.random() < 0.15 else "") for _ in range(400)),) for _ in range(60)]
    noise = spark.createDataFrame([(i, t) for i, (t,) in enumerate(noise)], "doc_id long, text string")
    clean = documents(spark).filter(fold("doc_id", 3) == 1).filter("lang is not null")
    gone = noise.count() - model.filter(noise).count()
    assert model.filter(clean).count() >= 0.98 * clean.count()
    assert gone >= 55
