import itertools
import random

import pytest
from pyspark.sql import functions as F

from refrain.llm import mixing as M
from tests.llm.tables import documents, empty

CELLS = "source string, lang string, topic string, tokens long"


def test_rake_holds_the_marginals_and_the_interaction(spark):
    values = {"source": ["a", "b", "c"], "lang": ["x", "y"], "topic": ["0", "1"]}
    rows = [(*k, 1000 + 137 * n % 911) for n, k in enumerate(itertools.product(*values.values()))]
    shares = {"source": [0.5, 0.3, 0.2], "lang": [0.4, 0.6], "topic": [0.45, 0.55]}
    targets = {d: spark.createDataFrame(list(zip(values[d], shares[d], strict=True)), "value string, share double") for d in values}
    got = {r[:3]: (r.tokens, r.weight, r.probability) for r in M.rake(spark.createDataFrame(rows, CELLS), targets, 0.3).collect()}
    wanted = 0.3 * sum(r[3] for r in rows)
    for axis, d in enumerate(values):
        for v, share in zip(values[d], shares[d], strict=True):
            assert sum(w for k, (_, w, _) in got.items() if k[axis] == v) == pytest.approx(share * wanted, rel=1e-5)
    assert all(p == pytest.approx(w / t) and 0 < p < 1 for t, w, p in got.values())
    # raking keeps odds ratios of the seed
    odds = lambda f: f(("a", "x", "0")) * f(("b", "y", "0")) / f(("a", "y", "0")) / f(("b", "x", "0"))
    assert odds(lambda k: got[k][1]) == pytest.approx(odds(lambda k: got[k][0]), rel=1e-6)


def test_rake_never_asks_for_more_than_there_is(spark):
    rows = [("a", "x", "0", 10), ("b", "x", "0", 1000), ("c", "x", "0", 0)]
    targets = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "value string, share double")}
    got = {r.source: r for r in M.rake(spark.createDataFrame(rows, CELLS), targets, 0.5).collect()}
    assert got["a"].probability == 1.0 and got["b"].weight == pytest.approx(252.5) and got["c"].probability == 0.0


def test_documents(spark):
    texts = [(i, f"word{i % 13} longerword{i % 7} " * (1 + i % 9)) for i in range(600)] + [(900, None), (901, "")]
    df = M.mix(documents(spark, texts))
    assert df.columns == ["doc_id", "source", "lang", "topic", "n_tokens", "probability", "sampled"]
    rows = df.collect()
    assert len(rows) == len(texts)
    words = {i: len((t or "").encode().split()) for i, t in texts}
    for r in rows:
        assert r.n_tokens == words[r.doc_id] and 0 <= r.probability <= 1 and (r.probability < 1 or r.sampled)
    assert sum(r.n_tokens * r.probability for r in rows) == pytest.approx(sum(words.values()) * M.BUDGET, rel=0.05)
    spread = sum(r.probability * (1 - r.probability) for r in rows) ** 0.5
    assert abs(sum(r.sampled for r in rows) - sum(r.probability for r in rows)) < 4 * spread
    assert sorted(r.doc_id for r in M.mix(documents(spark, texts)).where("sampled").collect()) == sorted(r.doc_id for r in rows if r.sampled)


def test_nulls_and_empty(spark):
    rows = M.mix(documents(spark, [(3, "a b"), (4, "c d"), (None, None), (None, "")])).collect()
    assert {(r.source, r.lang) for r in rows} >= {("s0", "<null>"), ("<null>", "en")} and len(rows) == 4
    assert M.mix(empty(spark)).count() == 0
    nothing = M.mix(documents(spark, [(1, None), (2, " ")])).collect()
    assert [(r.n_tokens, r.probability, r.sampled) for r in nothing] == [(0, 0.0, False)] * 2


def test_topic():
    assert M.token_count_and_topic(None) == (0, 0) and M.token_count_and_topic("a b c") == (3, 0)
    assert M.token_count_and_topic("Longword longword other1") == M.token_count_and_topic("longword LONGWORD other1")


def test_unit_hash(spark):
    row = spark.range(20_000).select(M.unit_hash(F.col("id"), 1).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert row[0] >= 0 and row[1] < 1 and abs(row[2] - 0.5) < 0.01


def test_rake_goes_on_past_a_source_that_is_too_small(spark):
    """A source that can't reach its share is always off by the same; the other marginals are met all the same."""
    rng = random.Random(4)
    cells = {(s, x): rng.randrange(1000, 5000) * (1 if (s, x) in {("a", "x"), ("b", "y"), ("c", "z")} else 0.02) for s in "abc" for x in "xyz"}
    rows = [(s, x, "0", int(t)) for (s, x), t in cells.items()] + [("small", x, "0", 1) for x in "xyz"]
    shares = {"source": {"a": 0.6, "b": 0.2, "c": 0.15, "small": 0.05}, "lang": {"x": 0.3, "y": 0.4, "z": 0.3}}
    targets = {d: spark.createDataFrame(list(v.items()), "value string, share double") for d, v in shares.items()}
    wanted, weight = 0.2 * sum(r[3] for r in rows), {r[:2]: 0.2 * r[3] for r in rows}
    for _ in range(M.MOST_CYCLES):
        for axis, d in enumerate(shares):
            had = {v: sum(w for k, w in weight.items() if k[axis] == v) for v in shares[d]}
            weight = {k: w * shares[d][k[axis]] * wanted / had[k[axis]] for k, w in weight.items()}
        weight = {r[:2]: min(weight[r[:2]], r[3]) for r in rows}
    got = {(r.source, r.lang): r.weight for r in M.rake(spark.createDataFrame(rows, CELLS), targets, 0.2).collect()}
    assert got == pytest.approx(weight, rel=1e-4)
