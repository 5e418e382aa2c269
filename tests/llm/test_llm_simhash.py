import random

import numpy as np
import pytest
import xxhash

from llm_data import frame, rows, sample
from vitrine.llm import simhash as S


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    if not words:
        return 0
    shingles = [words] if len(words) < 3 else [words[i:i + 3] for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64(" ".join(s).encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(pairs, radius=3):
    """doc_id -> smallest id reachable over links of at most ``radius`` bits."""
    ids, fps = [p[0] for p in pairs], [p[1] for p in pairs]
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return {ids[i]: least.get(find(i)) for i in range(len(ids))}


def test_masks_cover_every_pair_within_the_radius():
    masks = S.covering_masks(3)
    rng = random.Random(1)
    for _ in range(2000):
        apart = 0
        for b in rng.sample(range(64), 3):
            apart |= 1 << b
        assert any(not m & apart for m in masks)
    free = masks[0] ^ ((1 << 64) - 1)
    assert all(m & ~free == ~free & ((1 << 64) - 1) for m in S.covering_masks(3, free))
    again = [m for m in S.covering_masks(3, free)]
    positions = [b for b in range(64) if free >> b & 1]
    for _ in range(500):
        apart = sum(1 << b for b in rng.sample(positions, 3))
        assert any(not m & apart for m in again)


def test_documents_equal_brute_force(spark):
    data = [(d["doc_id"], d["text"]) for d in sample()]
    from llm_data import SF
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in S.query(spark, SF).collect()}
    fps = {i: plain_fingerprint(t) for i, t in data}
    assert {i: f for i, (f, _) in got.items()} == fps
    assert {i: c for i, (_, c) in got.items()} == brute(sorted(fps.items()))


def test_edge_rows(spark):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(frame(spark)).collect()]
    pairs = [(r[0], plain_fingerprint(r[1])) for r in rows()]
    want = brute(pairs)
    assert sorted(got, key=str) == sorted([(i, f"{f:016x}", want[i]) for i, f in pairs], key=str)
    assert S.near_duplicates(frame(spark, [])).count() == 0


def test_links_through_rows_without_id(spark):
    """Only the middle text is near both others, and its rows have no id."""
    rng = random.Random(2)
    apart = lambda a, b: (plain_fingerprint(a) ^ plain_fingerprint(b)).bit_count()
    while True:
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        middle = " ".join(words)
        sides = [" ".join([*words[:i], "other", *words[i + 1:]]) for i in range(0, 200, 5)]
        near = [t for t in sides if apart(middle, t) <= 3]
        found = next(((a, b) for a in near for b in near if apart(a, b) > 3), None)
        if found:
            break
    data = [(5, found[0]), (None, middle), (None, middle), (9, found[1])]
    got = S.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == [(5, 5), (9, 5), (None, 5), (None, 5)]


@pytest.mark.parametrize("limit", [128, 2048])
def test_large_buckets_are_refined_without_loss(spark, limit):
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 600:      # a dense ball: most of its buckets exceed the limit of 128
        f = centre
        for b in rng.sample(range(64), rng.randint(1, 3)):
            f ^= 1 << b
        fps.add(f)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    pairs = list(enumerate(sorted(fps)))
    nodes = spark.createDataFrame([(S._signed(f), i) for i, f in pairs], "fp long, node long")
    label = {r.node: r.component for r in S.components(S.links(nodes, 3, limit)).collect()}
    assert {i: label.get(i, i) for i, _ in pairs} == brute(pairs)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 99), (99, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in S.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 99}


def test_stars_span_each_linked_set():
    nodes = np.array([5, 3, 9])
    assert S.linked_stars(np.array([0, 7, (1 << 40) - 1], np.uint64), nodes, 3) == [(5, 3)]
