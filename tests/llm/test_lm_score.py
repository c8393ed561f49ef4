import random
from collections import Counter
from math import log

import pytest

from refrain.llm.lm_score import score_documents
from tests.llm.tables import documents, empty, mixed_texts, prose


def brute(texts, order, backoff=0.4):
    docs = [(i, (t or "").encode().lower().split()) for i, t in texts]
    grams = lambda w, n: [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
    whole = [Counter(g for _, w in docs for g in grams(w, n)) for n in range(1, order + 1)]
    size = sum(len(w) for _, w in docs)
    out = []
    for i, w in docs:
        own = [Counter(grams(w, n)) for n in range(1, order + 1)]
        count = lambda g: whole[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: B023, E731
        total, full = 0.0, 0
        for k in range(len(w)):
            score = 0.0
            for n in range(min(order, k + 1), 0, -1):
                g = tuple(w[k - n + 1 : k + 1])
                if n == 1:
                    c = count(g)
                    score += log(max(c, 1) / max(size - len(w), 1)) + (0 if c else log(backoff))
                elif count(g):
                    score += log(count(g) / count(g[:-1]))
                else:
                    score += log(backoff)
                    continue
                full += n == order and (n > 1 or count(g) > 0)
                break
            total += score
        out.append((i, len(w), full, round(total, 6), round(total / len(w), 9) if w else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_counters(spark, order):
    rng = random.Random(order)
    texts = [t for t in mixed_texts() if t[0] not in (31, 32)] + [(100 + i, prose(rng, 50, 60)) for i in range(40)] + [(None, prose(rng, 9, 60))]
    df = score_documents(documents(spark, texts).repartition(4), order=order)
    assert df.columns == ["doc_id", "n_words", "n_full_order", "log_score", "mean_log_score"]
    got = sorted(((r.doc_id, r.n_words, r.n_full_order, round(r.log_score, 6), None if r.mean_log_score is None else round(r.mean_log_score, 9)) for r in df.collect()), key=str)
    want = brute(texts, order)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[3] == pytest.approx(w[3], abs=1e-5) and (g[4] is None) == (w[4] is None)


def test_single_document_and_empty(spark):
    row = score_documents(documents(spark, {1: "a b a"})).first()
    assert row.log_score == pytest.approx(3 * log(0.4) + 2 * log(0.4)) and row.n_full_order == 0
    assert score_documents(empty(spark)).count() == 0
