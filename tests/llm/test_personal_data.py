import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from refrain.llm import personal_data as pd_
from refrain.llm.personal_data import KINDS, LABELERS, luhn, op12_personal_data, personal_data, reliabilities, span_classifier
from tests.llm.tables import documents, empty, mixed_texts

#: The patterns of the contract, as they are given.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in match.split("."))
    if kind == "card":
        d = [int(c) for c in digits][::-1]
        return 16 <= len(d) <= 19 and sum(d[::2] + [2 * x - 9 * (x > 4) for x in d[1::2]]) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(BASE[k], text or "") if passes(k, m.group())]


def noise(rng, n):
    pieces = ["a@b", ".c", "_", "@", "+1", " ", "-", "4111", "1111", "1.2", ".3.4", "255", "(0", ")", "é", "😀", "x", ".", "%", "00", "7", "+49 30 1234567", "\n", "4111 1111-1111 1111"]
    return "".join(rng.choice(pieces) for _ in range(n))


def hostile():
    rng = random.Random(4)
    texts = [noise(rng, rng.randrange(1, 60)) for _ in range(300)]
    texts += ["a@b.c_d@e.f", "a@b.c+d@e.f x", "x@y.z@w.v", "1.2.3.400.5.6.7", "0001.2.3.0255", "1.2.3.4.5.6.7.8.9", "+1+2 345 6789+49(30)12345", "4111-1111-1111-1111 2", "😀a@b.c 😀 1.1.1.1"]
    return texts


def test_base_spans_equal_the_given_patterns(spark):
    texts = dict(enumerate([*hostile(), None, "", *[t for _, t in mixed_texts()]]))
    rows, spans = personal_data(documents(spark, texts).select("doc_id", "text"))
    got = {}
    for r in spans.where("base").join(rows, "row").collect():
        assert (texts[r.doc_id] or "")[r.start : r.end] == r.value
        got.setdefault(r.doc_id, set()).add((r.kind, r.start, r.end))
    for i, text in texts.items():
        assert got.get(i, set()) == set(base_spans(text)), text


def test_long_runs_take_linear_time(spark):
    n = 400_000
    runs = ["a" * n, "1" * n, "1-" * n, "1." * n, "+1" + " " * n, "a@" * n, "a@b" + ".c" * n, "+1" * n, "@" * n, "(at)" * n, "1:" * n, "9" * 18 + " " + "4111111111111111 " * 3000]
    rows, spans = personal_data(documents(spark, dict(enumerate(runs))).select("doc_id", "text"))
    counts = {r.doc_id: r["count"] for r in spans.where("base").join(rows, "row").groupBy("doc_id").count().collect()}
    assert counts[6] == 1 and counts.get(0) is None and counts.get(1) is None
    assert counts[3] == n // 4


def test_query_columns_and_digest(spark, tmp_path):
    texts = [(1, "mail a.b@c.org or +49 30 1234567, 10.0.0.1 and 4111 1111 1111 1111"), (2, None), (3, "mail a.b@c.org"), (3, "nothing"), (None, "x@y.de")]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_personal_data(spark, str(tmp_path)).collect()
    assert len(got) == 5
    for r in got:
        options = [base_spans(t) for i, t in texts if i == r.doc_id]
        names = [",".join(f"{k}:{s}:{e}" for k, s, e in spans) for spans in options]
        assert r.base_sha256 in {hashlib.sha256(x.encode()).hexdigest() for x in names}
        assert r.spans in names
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] in [[sum(s[0] == k for s in spans) for k in KINDS] for spans in options]


def test_added_spans(spark):
    """Spelt-out, bare and short forms are added; numbers that fail their check, or stand in identifiers, are not."""
    texts = {i: f"text {i} mail me{i}@host.example.com, call +49 30 12345{i:02d}, 20.1.{i}.7, 4111111111111111" for i in range(60)}
    wanted = {
        100: ("email", "john.doe (at) mail (dot) org"), 101: ("phone", "(443) 555-2671"), 102: ("card", "3782 822463 10005"),
        103: ("ip", "2001:0db8:0000:0000:0000:ff00:0042:8329"), 104: ("ip", "20[.]7[.]8[.]9"), 105: ("phone", "+1 (443) 555-2671 20.7.8.9"),
    }
    texts |= {i: f"Please use {v} for it" for i, (_, v) in wanted.items()}
    texts |= {200: "order 9999999999999999 shipped", 201: "token 4f3782822463100059ab", 202: "version 1.2.3.999", 203: "timestamp 1700000000000", 204: "(at) home (dot) end"}
    rows, spans = personal_data(documents(spark, texts).select("doc_id", "text"))
    added = {(r.doc_id, r.kind): texts[r.doc_id][r.start : r.end] for r in spans.where("not base").join(rows, "row").collect()}
    wanted[105] = ("phone", "(443) 555-2671")
    assert added == {(i, k): v for i, (k, v) in wanted.items()}


def test_reliabilities_equal_plain_em(spark):
    rng = random.Random(9)
    truth = [rng.random() < 0.4 for _ in range(600)]
    sharp = [0.95, 0.9, 0.75, 0.6, 0.85]
    rows = [("card", t and rng.random() < 0.3, *[rng.choice([0, v, v]) for v in (1 if (rng.random() < s) == t else -1 for s in sharp)]) for t in truth]
    got = reliabilities(spark.createDataFrame(rows, f"kind string, base boolean, {', '.join(f'{v} int' for v in LABELERS)}")).first()
    prior, right, wrong = 0.5, [0.8] * 5, [0.2] * 5
    for _ in range(pd_.ROUNDS):
        p = []
        for _, base, *votes in rows:
            odds = math.log(prior / (1 - prior)) + sum(math.log(a / b) if v == 1 else math.log((1 - a) / (1 - b)) for v, a, b in zip(votes, right, wrong, strict=True) if v)
            p.append(1.0 if base else 1 / (1 + math.exp(-odds)))
        prior = (sum(p) + 1) / (len(p) + 2)
        mass = lambda j, v, w: sum(x for x, r in zip(w, rows, strict=True) if r[2 + j] == v)  # noqa: B023, E731
        q = [1 - x for x in p]
        right = [(mass(j, 1, p) + 8) / (mass(j, 1, p) + mass(j, -1, p) + 10) for j in range(5)]
        wrong = [(mass(j, 1, q) + 2) / (mass(j, 1, q) + mass(j, -1, q) + 10) for j in range(5)]
    assert got.prior == pytest.approx(prior, abs=1e-6) and got.right == pytest.approx(right, abs=1e-6) and got.wrong == pytest.approx(wrong, abs=1e-6)

    def found(q):
        return sum((x > 0.5) == t for x, t in zip(q, truth, strict=True))

    known = [1.0 if base else 1 / (1 + math.exp(-math.log(0.4 / 0.6) - sum(v * math.log(s / (1 - s)) for v, s in zip(votes, sharp, strict=True)))) for _, base, *votes in rows]
    assert found(p) >= found(known) - 12  # at most 2 % behind a judge who knows how reliable each labeler is


def test_classifier_weights(spark):
    rows = [("ip", ["a=1", "b=1"], 1.0), ("ip", ["a=1", "b=2"], 0.25), ("ip", ["a=2", "b=1"], 0.0)]
    got = span_classifier(spark.createDataFrame(rows, "kind string, features array<string>, posterior double")).first()
    assert got.bias == pytest.approx(math.log(2.25 / 2.75))
    assert got.weights["a=1"] == pytest.approx(math.log((1.25 + 8 * 2 / 3) / 9.25) - math.log((0.75 + 8 * 2 / 3) / 9.75))
    assert got.weights["b=2"] == pytest.approx(math.log((0.25 + 8 / 3) / 9.25) - math.log((0.75 + 8 / 3) / 9.75))


def test_luhn(spark):
    values = ["4111111111111111", "378282246310005", "4111111111111112", "0", "6304000000000000000"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(luhn(F.col("v"))).collect()]
    assert got == [True, True, False, True, True]


def test_empty(spark):
    rows, spans = personal_data(empty(spark).select("doc_id", "text"))
    assert rows.count() == 0 and spans.count() == 0


def test_runs_without_python_workers(spark):
    rows, spans = personal_data(documents(spark, {1: "a@b.org"}).select("doc_id", "text"))
    plan = spans._jdf.queryExecution().executedPlan().toString() + rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
