import random
from collections import Counter

from refrain.llm import decontaminate as D
from tests.llm.tables import documents, empty, mixed_texts, prose

ITEMS = "item_id long, text string, id long, similarity string"


def words(text):
    return (text or "").encode().lower().split()


def bag(w, width=5):
    return Counter(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else Counter()


def brute(texts, items, similarity=0.8):
    out = {}
    for i, text in texts:
        w = words(text)
        for key, item in items:
            b = bag(words(item))
            size = min(len(words(item)), len(w))
            best = 0.0
            for at in range(len(w) - size + 1):
                own = bag(w[at : at + size])
                total = sum((own | b).values())
                best = max(best, sum((own & b).values()) / total if total else 0.0)
            if best >= similarity:
                out[i, key] = round(best, 9)
    return out


def scan(spark, texts, items):
    df = D.contaminated(documents(spark, texts), spark.createDataFrame([(k, t, 1, "x") for k, t in items], ITEMS))
    assert df.columns == ["doc_id", "item_id", "similarity", "first_word", "n_words"]
    return df.collect()


def planted(seed):
    rng = random.Random(seed)
    items = [(k, prose(rng, rng.randrange(1, 60), 200)) for k in range(25)] + [(90, None), (91, " "), (92, "a b c"), (93, "a a a a a a a a a a a a a")]
    texts = [t for t in mixed_texts() if t[0] is not None and t[0] not in (32, 40, 41)]
    for n in range(60):
        _, item = rng.choice(items[:25])
        w = item.split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "changed"
        texts.append((500 + n, prose(rng, rng.randrange(20)) + " " + " ".join(w).upper() + "\t" + prose(rng, rng.randrange(20))))
    texts += [(600, "a b c"), (601, "a " * 40), (602, items[3][1])]
    return texts, items


def test_against_all_windows(spark):
    texts, items = planted(1)
    want = brute(texts, items)
    rows = scan(spark, texts, items)
    assert len(want) > 20 and {(r.doc_id, r.item_id): round(r.similarity, 9) for r in rows} == want


def test_parts_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(D, "PART_ITEMS", 10)
    texts, items = planted(2)
    assert {(r.doc_id, r.item_id) for r in scan(spark, texts, items)} == set(brute(texts, items))


def test_index_finds_every_fingerprint_within_the_radius():
    rng = random.Random(3)
    index = D.ItemIndex([(k, prose(rng, 30, 100)) for k in range(50)], 5, 0.8)
    bits = index.prints.view("u1")
    for k in range(50):
        flipped = bits[k].copy()
        for b in rng.sample(range(128), D.RADIUS):
            flipped[b // 8] ^= 1 << b % 8
        assert k in index.within_radius(flipped.view("u2"))


def test_repeats_nulls_and_empty(spark):
    item = "one two three four five six"
    rows = scan(spark, [(None, item), (2, item), (2, item), (3, None)], [(1, item), (1, item)])
    assert sorted(str(r.doc_id) for r in rows) == ["2"] * 4 + ["None"] * 2
    items = spark.createDataFrame([(1, item, 1, "x")], ITEMS)
    assert D.contaminated(empty(spark), items).count() == 0
    assert D.contaminated(documents(spark, {1: item}), items.limit(0)).count() == 0
