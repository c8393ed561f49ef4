import hashlib
import re

from refrain.llm import exact_dedup
from tests.llm.tables import documents, empty, mixed_texts


def expected(texts):
    groups = {}
    for i, t in texts:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return {i: (min(g), len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for i in g}


def found(df):
    rows = df.collect()
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    for keep in {r.keep_id for r in rows}:
        assert sum(r.kept for r in rows if r.keep_id == keep) == 1
    return len(rows), {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in rows}


def test_mixed(spark):
    texts = mixed_texts()
    assert found(exact_dedup.exact_duplicates(documents(spark, texts))) == (len(texts), expected(texts))


def test_hot_text_is_split_and_merged(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_HOT_LEAST", 8)
    texts = [(1000 - i, "hot  text" if i % 3 else f"own {i % 7}") for i in range(400)]
    assert found(exact_dedup.exact_duplicates(documents(spark, texts)))[1] == expected(texts)


def test_null_ids_come_last(spark):
    rows = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_duplicates(documents(spark, [(None, "a"), (5, "a"), (None, "b")])).collect()}
    assert rows == {(None, 5, False), (5, 5, True), (None, None, True)}


def test_empty(spark):
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0


def test_no_python_in_the_plan(spark, capsys, tmp_path):
    documents(spark, mixed_texts()).write.parquet(str(tmp_path / "docs"))
    exact_dedup.exact_duplicates(spark.read.parquet(str(tmp_path / "docs"))).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
