import hashlib
import random

import numpy as np
import pytest

from refrain.llm import suffix_dedup as S
from tests.llm.tables import documents, empty, mixed_texts, prose


def brute(texts, length=S.LENGTH):
    places = {}
    ordered = sorted(texts, key=lambda x: (S._NULL_ID if x[0] is None else x[0]))
    for i, t in ordered:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            key = (S._NULL_ID if i is None else i, p)
            string = raw[p : p + length]
            places[string] = min(places.get(string, key), key)
    out = []
    for i, t in ordered:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            if places[raw[p : p + length]] != (S._NULL_ID if i is None else i, p):
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        runs = int(np.sum(np.diff(gone.astype(int)) == 1)) + int(gone[0])
        out.append((i, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in df.collect()), key=str)


def test_mixed(spark):
    texts = mixed_texts()
    assert got(S.repeated_strings(documents(spark, texts).repartition(3))) == brute(texts)


def test_periodic_and_overlapping(spark):
    rng = random.Random(5)
    text = prose(rng, 60)
    texts = [(1, "ab" * 200), (2, "ba" * 90), (3, text + text), (4, text[7:150]), (5, text[:99]), (6, text[:100]), (None, text[3:120]), (9, "\x00" * 130 + "a")]
    assert got(S.repeated_strings(documents(spark, texts))) == brute(texts)


@pytest.mark.parametrize("cold", [0, 3, 200])
def test_hot_grams_take_the_other_way(spark, cold):
    """A line and a passage shared by many documents, with different surroundings: sorted or through buckets, the result is the same."""
    rng = random.Random(cold)
    line, passage = prose(rng, 17, 9000)[:85], prose(rng, 40, 9000)
    texts = [(i, prose(rng, rng.randrange(5, 30)) + (line if i % 2 else passage[: rng.randrange(90, 160)]) + prose(rng, 12)) for i in range(60)]
    assert got(S.repeated_strings(documents(spark, texts).repartition(4), cold=cold)) == brute(texts)


def test_spans_and_kept_text(spark):
    rng = random.Random(1)
    text = "".join(chr(97 + rng.randrange(26)) for _ in range(150))
    rows = {r.doc_id: r for r in S.repeated_strings(documents(spark, {1: text, 2: "xx" + text + "yy"}), with_text=True).collect()}
    assert [(s.start, s.stop) for s in rows[2].spans] == [(2, 152)] and bytes(rows[2].kept) == b"xxyy" and rows[1].spans == []


def test_empty(spark):
    assert S.repeated_strings(empty(spark)).count() == 0


def test_samples_in_slices(monkeypatch):
    """Long texts are winnowed in slices with the same result."""
    rng = random.Random(2)
    raw = prose(rng, 3000).encode()
    row = {"page": 0, "ids": [1, 2], "lengths": [len(raw) - 500, 500], "text": raw}
    whole = S._Page(row).samples()
    monkeypatch.setattr(S, "_SLICE", 333)
    parts = S._Page(row).samples()
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_repeated_ids_with_null_texts(spark):
    """Rows of one id, or without one, in one batch, some of them without a text."""
    text = prose(random.Random(2), 40, 9000)
    texts = [(1, None), (1, text), (1, None), (None, text), (None, None), (None, ""), (2, text)]
    assert got(S.repeated_strings(documents(spark, texts).coalesce(1))) == brute(texts)


@pytest.mark.parametrize("cold", [0, 200])
def test_copies_with_two_letters_changed_in_case(spark, cold):
    """Two case changes at equal places of their 8-byte words: no pair of places hides the change."""
    rng = random.Random(7)
    gram = "".join(chr(97 + rng.randrange(26)) for _ in range(S.GRAM))
    text = "".join(chr(97 + rng.randrange(26)) for _ in range(S.LEFT)) + gram + "".join(chr(97 + rng.randrange(26)) for _ in range(S.LEFT))
    outside = [p for p in range(len(text)) if not S.LEFT <= p < S.LEFT + S.GRAM]
    texts = [(0, text)]
    for p in outside:
        for q in outside:
            if p < q and (q - p) % 8 == 0:
                texts.append((len(texts), "".join(c.upper() if k in (p, q) else c for k, c in enumerate(text))))
    assert got(S.repeated_strings(documents(spark, texts), cold=cold)) == brute(texts)


def test_digests_tell_case_changes_at_all_places_apart():
    rows = [bytearray(b"a" * S.LENGTH)]
    for p in range(S.LENGTH):
        for q in range(p + 1, S.LENGTH):
            rows.append(bytearray(rows[0]))
            rows[-1][p] ^= 0x20
            rows[-1][q] ^= 0x20
    first, second = S._digests(np.array([list(r) for r in rows], np.uint8))
    assert len({*zip(first.tolist(), second.tolist(), strict=True)}) == len(rows)


def test_pages_are_read_a_few_at_a_time(spark):
    """Spark's reader decodes a batch of rows inside one row group; pages of megabytes in one group filled the heap."""
    import pyarrow.parquet as pq

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    most = spark.conf.get(key)
    spark.conf.set(key, "1")  # a batch gives a page at least
    try:
        pages = S._settle_pages(spark.createDataFrame([(i, "word " * 50) for i in range(40)], "id long, text string").coalesce(1))
    finally:
        spark.conf.set(key, most)
    files = [pq.ParquetFile(f.removeprefix("file:").removeprefix("//")).metadata for f in pages.inputFiles()]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(groups) == 40 and max(groups) == S.GROUP_PAGES
