import random
import re

from refrain.llm.line_dedup import LONG_WORDS, WINDOW, repeated_lines
from tests.llm.tables import documents, empty, mixed_texts, prose


def brute(texts, width=WINDOW):
    def windows(text):
        lines = [re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ") for x in (text or "").split("\n")]
        for i in range(len(lines) - width + 1):
            if any(lines[i : i + width]):
                yield i, width, "\n".join(lines[i : i + width])
        for i, x in enumerate(lines):
            if len(x.split(" ")) >= LONG_WORDS:
                yield i, 1, x

    first = {}
    for i, text in texts:
        for k, n, content in windows(text):
            first[n, content] = min(first.get((n, content), (i, k)), (i, k))
    out = {}
    for i, text in texts:
        gone = set()
        for k, n, content in windows(text):
            if first[n, content] != (i, k):
                gone |= set(range(k, k + n))
        lines = (text or "").split("\n")
        runs = sum(1 for k in gone if k - 1 not in gone)
        out[i] = (len(lines), len(gone), runs, "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def got(df):
    assert df.columns == ["doc_id", "n_lines", "n_removed", "n_runs", "kept_text"]
    return {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.kept_text) for r in df.collect()}


def lined(seed, n):
    rng = random.Random(seed)
    pool = [prose(rng, rng.randrange(1, 9)).replace("\n", " ") for _ in range(12)] + ["", " ", "long " * 60]
    return [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own {rng.random()}" for _ in range(rng.randrange(12)))) for i in range(n)]


def test_random_lines(spark):
    texts = lined(1, 80)
    want = brute(texts)
    assert sum(w[1] for w in want.values()) > 50
    assert got(repeated_lines(documents(spark, texts).repartition(3))) == want


def test_wider_windows(spark):
    texts = lined(2, 60)
    assert got(repeated_lines(documents(spark, texts), width=3)) == brute(texts, 3)


def test_mixed(spark):
    texts = [t for t in mixed_texts() if t[0] not in (40, 41)]
    assert got(repeated_lines(documents(spark, texts))) == brute(texts)


def test_nulls_repeats_and_empty(spark):
    two = "first line\nsecond line"
    rows = repeated_lines(documents(spark, [(None, two), (1, two), (1, two), (2, None), (2, "")])).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.kept_text) for r in rows) == [("1", 2, ""), ("1", 2, ""), ("2", 0, ""), ("2", 0, ""), ("None", 0, two)]
    assert repeated_lines(empty(spark)).count() == 0


def test_no_python_in_the_plan(spark, capsys, tmp_path):
    documents(spark, lined(3, 5)).write.parquet(str(tmp_path / "docs"))
    repeated_lines(spark.read.parquet(str(tmp_path / "docs"))).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
