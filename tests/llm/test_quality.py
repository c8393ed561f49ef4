import random

import numpy as np
import pytest

from refrain.llm import quality as Q
from tests.llm.tables import documents, empty, mixed_texts, prose

LABELS = "doc_id long, quality int, toxic int"


def corpus(seed, n=600):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        junk = rng.random() < 0.3
        text = prose(rng, rng.randrange(20, 200))
        texts.append((i, " ".join(w + rng.choice(["###", "!!", " |"]) for w in text.split()) if junk else text))
        labels.append((i, int(not junk), 0))
    return texts, labels


def test_held_out_accuracy(spark):
    texts, labels = corpus(1)
    known = spark.createDataFrame(labels[:300], LABELS)
    df = Q.classify_quality(documents(spark, texts), known)
    assert df.columns == ["doc_id", "p_document", "site_posterior", "section_posterior", "p_quality", "kept"]
    rows = {r.doc_id: r for r in df.collect()}
    right = [rows[i].kept == bool(good) for i, good, _ in labels[300:]]
    assert np.mean(right) > 0.98


def test_sites_shift_uncertain_documents(spark):
    """Two sites, one nearly all junk: the same middling text gets less on the junk site; a site of one document stays at the prior."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        site = "bad" if i % 2 else "good"
        junk = rng.random() < (0.9 if site == "bad" else 0.05)
        text = prose(rng, 60)
        rows.append((i, " ".join(w + "###" for w in text.split()) if junk else text, "en", site))
        if i < 200:
            labels.append((i, int(not junk), 0))
    middling = " ".join(w + "###" if k % 2 else w for k, w in enumerate(prose(rng, 60).split()))
    rows += [(1000, middling, "en", "bad"), (1001, middling, "en", "good"), (1002, middling, "en", "single")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in Q.classify_quality(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert got[1000].p_document == pytest.approx(got[1001].p_document)
    assert got[1000].p_quality < got[1002].p_quality < got[1001].p_quality
    assert got[1000].site_posterior < 0.3 < 0.8 < got[1001].site_posterior


def test_posteriors_by_hand(spark):
    """The site posterior is the shrunk mean of document probabilities with the strength estimated from the sites."""
    texts, labels = corpus(5, 200)
    rows = Q.classify_quality(documents(spark, texts), spark.createDataFrame(labels, LABELS)).collect()
    site = {i: f"s{i % 3}" if i != 4 else None for i, _ in texts}
    p = {r.doc_id: r.p_document for r in rows}
    prior = np.mean(list(p.values()))
    groups = {s: [p[i] for i in p if site[i] == s] for s in set(site.values())}
    noise = prior * (1 - prior)
    weight = sum(len(g) for g in groups.values())
    excess = sum(len(g) * (np.mean(g) - prior) ** 2 - noise for g in groups.values())
    between = max(excess / max(weight - len(groups), 1), 1e-12)
    strength = min(max(noise / between - 1, 1), 1e6)
    for r in rows:
        g = groups[site[r.doc_id]]
        assert r.site_posterior == pytest.approx((sum(g) + strength * prior) / (len(g) + strength), rel=1e-6)


def test_logistic_matches_gradient():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3)) * [1, 10, 0.1]
    y = (rng.random(500) < 1 / (1 + np.exp(-(x[:, 0] - 0.2 * x[:, 1])))).astype(float)
    m = Q.fit_logistic(x, y, ridge=0.0)
    p = 1 / (1 + np.exp(-(m.intercept + x @ np.array(m.weights))))
    assert np.abs(x.T @ (y - p)).max() < 1e-3 and abs((y - p).sum()) < 1e-4


def test_edge_tables(spark):
    texts = mixed_texts()
    none = spark.createDataFrame([], LABELS)
    rows = Q.classify_quality(documents(spark, texts), none).collect()
    assert len(rows) == len(texts) and all(r.p_quality == pytest.approx(0.5) for r in rows)
    one = spark.createDataFrame([(5, 1, 0), (6, None, 0), (None, 0, 0)], LABELS)
    assert all(r.kept for r in Q.classify_quality(documents(spark, texts), one).collect())
    assert Q.classify_quality(empty(spark), one).count() == 0


def test_features():
    assert Q.text_features(None) == Q.text_features(" \n") == [0.0] * len(Q.FEATURES)
    f = dict(zip(Q.FEATURES, Q.text_features("AB ab ab. 1# |"), strict=True))
    assert f["adjacent"] == 0 and f["upper"] == 2 / 10 and f["digit"] == 1 / 10 and f["bare_mark"] == 1 / 5 and f["marked_end"] == 2 / 5
