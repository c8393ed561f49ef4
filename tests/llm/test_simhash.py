import random
import re

import numpy as np
import xxhash

from refrain.llm.components import component_labels
from refrain.llm.simhash import fingerprint, linked_fingerprints, near_duplicates
from refrain.operators.settle import settle
from tests.llm.tables import documents, empty, mixed_texts


def plain_fingerprint(text, shingle=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    for _, text in mixed_texts():
        assert fingerprint(text) == plain_fingerprint(text)


def test_documents_against_all_pairs(spark):
    texts = [t for t in mixed_texts() if t[0] is not None]
    prints = {i: plain_fingerprint(t) for i, t in texts}
    edges = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = components(prints, edges)
    df = near_duplicates(documents(spark, texts))
    rows = df.collect()
    assert df.columns == ["doc_id", "fingerprint", "component_id"] and len(rows) == len(texts)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{f:016x}", want[i]) for i, f in prints.items()}


def test_links_against_all_pairs(spark):
    """Clusters around random centres, at 0 to 6 flipped bits, for several radii."""
    rng = random.Random(9)
    prints = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(6):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))))
    signed = np.array(sorted(prints), np.uint64).view(np.int64)
    for radius in (2, 3, 5):
        want = {(min(a, b), max(a, b)) for a in signed.tolist() for b in signed.tolist() if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= radius}
        table = spark.createDataFrame([(x,) for x in signed.tolist()], "fp long")
        assert {(r.a, r.b) for r in linked_fingerprints(table, radius).collect()} == want


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    got = {r.node: r.label for r in component_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == components(nodes, [e for e in edges if e[0] != e[1]])


def test_null_ids_and_empty(spark):
    rows = near_duplicates(documents(spark, [(None, "a b c d"), (7, "a b c d"), (None, "other words here now")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("7", "7"), ("None", "7"), ("None", "None")]
    assert near_duplicates(empty(spark)).count() == 0


def test_flips_are_not_broadcast(spark):
    """Spark sizes the exploded sides like the fingerprints; a broadcast of them ran the driver out of memory."""
    few = settle(spark.createDataFrame([(k << 20,) for k in range(50)], "fp long"))
    assert "Broadcast" not in linked_fingerprints(few)._jdf.queryExecution().executedPlan().toString()
