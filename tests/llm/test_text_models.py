"""Toxicity (op1) and quality (op8): held-out accuracy and edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, quality_crf, toxicity

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string"
LABELS = "doc_id long, quality int, toxic int"
ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "plain words here"), (4, "word " * 60000), (5, "\n\n\n"), (6, "x" * 300000)]


def odd(spark):
    return spark.createDataFrame([(i, t, None, "s", None, "clash", "clash") for i, t in ODD], DOCS)


def held_out_accuracy(got, column, label):
    return np.mean([r[column] == r[label] for r in got])


@pytest.mark.parametrize("operator, column, label", [(quality_crf, "predicted", "quality"), (toxicity, "toxic", "is_toxic")])
def test_held_out_accuracy(spark, operator, column, label):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    out = operator.predictions(docs, labels)
    assert out.count() == docs.count()
    got = out.join(labels.withColumnRenamed("toxic", "is_toxic"), "doc_id").where(quality_crf.held_out(F.col("doc_id"))).collect()
    assert len(got) > 50 and held_out_accuracy(got, column, label) > 0.95


def test_held_out_fold(spark):
    rows = spark.range(50).select("id", quality_crf.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


@pytest.mark.parametrize("operator, keep, column", [(quality_crf, quality_crf.good_documents, "score"), (toxicity, toxicity.clean_documents, "toxic_probability")])
def test_edges(spark, operator, keep, column):
    labels = common.table(spark, SF, "labels")
    docs = common.table(spark, SF, "documents").withColumns({"score": F.lit("x"), "predicted": F.lit("x")}).unionByName(odd(spark))
    out = operator.predictions(docs, labels)
    got = out.where("doc_id is null or doc_id < 7").collect()
    assert len([r for r in got if r["doc_id"] == 3]) == 3
    assert all(r[column] is not None and 0 <= r[column] <= 1 for r in got)
    assert keep(docs, labels).columns == docs.columns
    none = labels.where("false")
    assert {r[column] for r in operator.predictions(odd(spark), none).collect()} == {0.5 if operator is quality_crf else 0.0}
    assert operator.predictions(odd(spark).where("false"), labels).count() == 0
    nulls = spark.createDataFrame([(None, 1, 1), (1, None, None), (1, 1, 0), (1, 1, 0)], LABELS)
    assert operator.predictions(odd(spark), nulls).count() == len(ODD)


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    lines, trans = np.array([4, 1, 0, 3]), rng.normal(size=(2, 2))
    emit = rng.normal(size=lines.sum())
    p, _ = quality_crf.marginals(emit, lines, trans)
    at = 0
    for n in lines:
        if n:
            total, bad = 0.0, np.zeros(n)
            for code in range(2**n):
                y = [(code >> k) & 1 for k in range(n)]
                w = np.exp(sum(emit[at + k] * y[k] for k in range(n)) + sum(trans[y[k], y[k + 1]] for k in range(n - 1)))
                total += w
                bad += w * np.array(y)
            assert np.allclose(p[at : at + n], bad / total)
        at += n


def test_chain_sees_earlier_probabilities():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)).astype(np.float32)
    first = (x[:, 0] > 0).astype(float)
    chain = toxicity.fit_chain(x, [("a", first), ("b", first)])
    assert [len(w) for _, w in chain] == [4, 5]
    assert ((toxicity.run_chain(chain, x)[:, 1] > 0.5) == first).mean() > 0.95


def test_word_hashes_by_segments(monkeypatch):
    texts = [b"Ab cd\tef " * 50, b"", b"x" * 700, b"one\ntwo"]
    whole = common.word_hashes(texts)
    monkeypatch.setattr(common, "CHUNK_BYTES", 64)
    parts = common.word_hashes(texts)
    assert all((a == b).all() for a, b in zip(whole, parts))
    assert len(set(whole[1][:3].tolist())) == 3 and (whole[1][0] == common.word_hashes([b"aB"])[1][0])


def random_documents(seed=3, n=240):
    """Features of documents, a quarter of them toxic by one of four groups of features, and near copies."""
    rng = np.random.default_rng(seed)
    feats, toxic = [], np.zeros(n, int)
    for k in range(n):
        f = rng.integers(1000, 3000, 60)
        if k % 4 == 0:
            toxic[k], f[:4] = 1, 10 * (k // 4 % 4) + np.arange(4)
        feats.append(np.unique(f).astype(np.int32))
    feats += [np.append(f, 5000 + k).astype(np.int32) for k, f in enumerate(feats[:40])]
    return feats, [np.ones(len(f), np.int32) for f in feats], np.append(toxic, toxic[:40])


def test_folds_keep_near_copies_together():
    feats, _, _ = random_documents()
    fold = toxicity.folds_of(feats)
    assert (fold[:40] == fold[240:]).mean() > 0.95 and len(np.unique(fold)) == toxicity.FOLDS


def test_out_of_fold_probabilities_do_not_know_their_labels():
    """Other labels in a fold change nothing in what that fold gets from the others."""
    feats, times, toxic = random_documents()
    fold = toxicity.folds_of(feats)
    views = []
    for labels in (toxic, np.where(fold == 2, 1 - toxic, toxic)):
        _, x, group = toxicity._view(feats, times, labels, np.flatnonzero(fold != 2))
        goals = [y for _, y in toxicity._targets(group, labels)]
        views.append(toxicity.out_of_fold(0, np.zeros((len(x), 0), np.float32), fold, {2: (x, goals)})[fold == 2])
    assert (views[0] == views[1]).all() and views[0].max() > 0


def test_chain_brute_force():
    """Scores by plain loops over words, markers and links equal those of the operator."""
    feats, times, toxic = random_documents()
    model = toxicity.fit(feats, times, toxic)
    x = toxicity._matrix(feats, times, model["markers"])
    p = toxicity.run_chain(model["chain"], x)
    for k in range(0, len(feats), 17):
        seen = [float(np.log1p(dict(zip(feats[k].tolist(), times[k].tolist())).get(m, 0))) for m in model["markers"].tolist()]
        for j, (_, w) in enumerate(model["chain"]):
            z = sum(a * b for a, b in zip(seen, w[:-1].tolist())) + float(w[-1])
            seen.append(1 / (1 + np.exp(-z)))
            assert abs(seen[-1] - p[k, j]) < 1e-4
    assert ((p[:, -1] >= toxicity.THRESHOLD) == (toxic == 1)).mean() > 0.97


def test_sample_of_lines():
    assert quality_crf.sampled_lines(100).tolist() == list(range(100))
    long = quality_crf.sampled_lines(100_000)
    assert len(long) <= quality_crf.WINDOW * quality_crf.TRAIN_WINDOWS and long[-1] > 90_000
