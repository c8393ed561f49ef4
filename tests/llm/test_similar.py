import itertools
import random
import re
from collections import Counter

import numpy as np
import xxhash

import corpus_pipeline
from refrain.llm import similar
from refrain.llm.similar import bag, similar_groups, similarity
from tests.llm.tables import documents, empty, mixed_texts, prose
from tests.llm.test_simhash import components


def plain_bag(text, shingle=5):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return Counter(tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))) if words else Counter()


def plain_similarity(a, b):
    whole = (a | b).total()
    return (a & b).total() / whole if whole else 1.0


def groups_of(texts):
    bags = [plain_bag(t) for t in texts]
    return components(range(len(bags)), [(i, j) for i in range(len(bags)) for j in range(i) if plain_similarity(bags[i], bags[j]) >= 0.8])


def edited(rng, text, edits):
    words = text.split()
    for p in rng.sample(range(len(words)), edits):
        words[p] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def near_copies():
    """Copies at similarities on both sides of 0.8, copies of copies, and a large group of copies of one text."""
    rng = random.Random(6)
    texts = []
    for edits in range(7):
        for _ in range(6):
            base = prose(rng, rng.randrange(150, 260), 9000)
            texts += [base, edited(rng, base, edits), edited(rng, edited(rng, base, edits), edits)]
    base = prose(rng, 200, 9000)
    return texts + [edited(rng, base, rng.randrange(4)) for _ in range(60)]


def test_bags():
    texts = [t for _, t in mixed_texts()]
    for a in texts[:20]:
        assert len(bag(a)) == plain_bag(a).total()
        for b in texts[:20]:
            assert similarity(bag(a), bag(b)) == plain_similarity(plain_bag(a), plain_bag(b))


def test_groups_against_all_pairs(spark):
    texts = near_copies() + [t for _, t in mixed_texts()]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    assert {r.row: r.group for r in similar_groups(rows).collect()} == groups_of(texts)
    assert similar_groups(rows.where("false")).count() == 0


def templates():
    """Crowds around 0.8: copies of templates with one to six of about 120 words changed, some sharing edits, some of a copy."""
    rng = random.Random(11)
    texts = []
    for _ in range(3):
        base = prose(rng, 120, 9000)
        other = " ".join(base.split()[:80]) + " " + prose(rng, 40, 9000)  # a template of its own that shares a passage
        for edits in range(1, 7):
            texts += [edited(rng, base, edits) for _ in range(25)]
            texts += [edited(rng, texts[-1], 1), edited(rng, texts[-2], 2), edited(rng, other, edits), edited(rng, other, edits)]
    rng.shuffle(texts)
    return texts


def test_crowds_below_the_threshold(spark):
    texts = templates()
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(5)
    want = groups_of(texts)
    assert {r.row: r.group for r in similar_groups(rows).collect()} == want
    assert len(set(want.values())) > 20 and max(Counter(want.values()).values()) > 20


def test_crowd_that_never_links_meets_in_few_pairs(spark, monkeypatch):
    """300 copies with six of 120 words changed: 44,850 pairs, hardly any of which is looked at."""
    rng = random.Random(2)
    base = prose(rng, 120, 9000)
    texts = [edited(rng, base, 6) for _ in range(300)]
    written = []
    plain = similar.settle
    monkeypatch.setattr(similar, "settle", lambda df: written.append(plain(df)) or written[-1])
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    assert {r.row: r.group for r in similar.similar_groups(rows).collect()} == groups_of(texts)
    pairs = [df.count() for df in written if df.columns == ["node_a", "node_b"]]
    assert len(pairs) == 1 and pairs[0] < 300


def test_stage_keeps_columns_of_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 777, 5), (2, "a b c d e f", 778, 6), (3, "else", 779, 7)], "doc_id long, text string, Row long, group long")
    out = corpus_pipeline.near_dedup_stage(spark, df, "")
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [(1, "a b c d e f", 777, 5), (3, "else", 779, 7)]


def test_stage_keeps_one_of_each_group(spark):
    """Also of rows that repeat an id and a text; rows without an id stay."""
    texts = near_copies()
    group = groups_of(texts)
    pairs = [(1000 - i, t) for i, t in enumerate(texts)]
    smallest = {}
    for i, _ in enumerate(texts):
        smallest[group[i]] = min(smallest.get(group[i], 10**9), 1000 - i)
    lone = "a text of its own that nothing else in here is like"
    df = documents(spark, pairs + pairs[:5] + [(5000, lone), (5000, lone), (None, lone), (None, lone)])
    out = corpus_pipeline.near_dedup_stage(spark, df, "")
    want = sorted([*map(str, smallest.values()), "5000", "None", "None"])
    assert sorted(str(r.doc_id) for r in out.collect()) == want and out.columns == df.columns
    assert corpus_pipeline.near_dedup_stage(spark, empty(spark), "").count() == 0


def test_near_fingerprints_link_without_minhash(spark, monkeypatch):
    """Copies whose fingerprints the pigeonring chains join are compared though they share no MinHash key."""

    def apart(bags):
        return np.array([[xxhash.xxh64_intdigest(x.tobytes(), band) for band in range(similar.BANDS)] for x in bags], np.uint64)

    rng = random.Random(8)
    bases = [prose(rng, 3000, 9000) for _ in range(4)]
    texts = [t for base in bases for t in (base, edited(rng, base, 1), base.upper())]
    prints = [similar.fingerprint_of(bag(t)) for t in texts]
    assert all((prints[i] ^ prints[i + 1]).bit_count() <= similar.RADIUS and bag(texts[i]).tolist() != bag(texts[i + 1]).tolist() for i in range(0, 12, 3))
    monkeypatch.setattr(similar, "band_keys", apart)
    out = similar_groups(spark.createDataFrame(list(enumerate(texts)), "row long, text string"))
    assert dict(map(tuple, out.select("row", "group").collect())) == {i: i // 3 * 3 for i in range(12)}


def test_exploded_rows_are_not_broadcast(spark, monkeypatch):
    """Spark sizes exploded rows as if they were not; a broadcast of them ran the driver out of memory."""
    plans, settle = [], similar.settle
    monkeypatch.setattr(similar, "settle", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settle(df))
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:k], f"edit{k}", *words[k + 1 :]]) for k in range(2, 58, 4)] * 2
    similar.similar_groups(spark.createDataFrame([*enumerate(texts)], "row long, text string")).collect()
    for plan in plans:
        lines = plan.splitlines()
        depth = [len(re.match(r"[\s:+*()\d-]*", x)[0]) for x in lines]
        for at, line in enumerate(lines):
            if "BroadcastExchange" in line:
                below = list(itertools.takewhile(lambda k: depth[k] > depth[at], range(at + 1, len(lines))))  # noqa: B023
                made = list(itertools.takewhile(lambda k: "Aggregate" not in lines[k], below))
                assert not any("Generate" in lines[k] for k in made), plan
    assert sum("Generate" in x and "SortMergeJoin" in x for x in plans) >= 3
