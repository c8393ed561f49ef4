"""The stages keep the documents' columns, act on all their predecessor kept, and agree with plain code."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from refrain.llm.token_output import public_tokenizer
from tests.llm.tables import prose
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_similar import plain_bag, plain_similarity
from tests.llm.test_simhash import components

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(8)
    items = [(k, prose(rng, 30, 5000)) for k in range(10)]
    rows, labels = [], []
    for i in range(240):
        text = prose(rng, rng.randrange(30, 120), 5000)
        kind = i % 8
        if kind == 1:
            text = " ".join(w + "###" for w in text.split())
        elif kind == 2:
            text = rows[-2][1] if rng.random() < 0.5 else rows[-2][1].upper()
        elif kind == 3:
            text += " " + items[i % 10][1]
        rows.append((i, text, rng.choice(["en", "de"]), f"s{i % 3}"))
        if i < 160:
            labels.append((i, int(kind != 1), 0))
    rows += [(None, None, None, None), (500, "", "en", "s1"), (501, None, "en", "s2")]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCUMENTS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    seen = [sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=str))
        assert (None, None) in seen[-1]
    start, quality, near, clean, mixed = seen
    # junk goes, clean documents stay
    assert [x for x in start if x not in quality] == [x for x in start if "###" in (x[1] or "")]
    # one document of each group stays, the smallest id
    named = [(i, t) for i, t in quality if i is not None]
    bags = [plain_bag(t) for _, t in named]
    groups = components([i for i, _ in named], [(named[x][0], named[y][0]) for x in range(len(named)) for y in range(x + 1, len(named)) if plain_similarity(bags[x], bags[y]) >= 0.8])
    assert [i for i, _ in near if i is not None] == sorted({g for g in groups.values()}, key=str)
    # contaminated documents go
    assert {i for i, _ in near} - {i for i, _ in clean} == {i for i, _ in leaks([x for x in near if x[0] is not None], items)}
    assert 0 < len(mixed) < len(clean)

    plain, want, at = Tokenizer.from_file(public_tokenizer("word_bpe_49k.json")), [], 0
    for i, text in sorted(mixed, key=lambda x: (x[0] is None, x[0])):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert sorted(map(tuple, last.collect()), key=str) == sorted(want, key=str)


def test_run_equals_its_stages(spark, sf_dir):
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
