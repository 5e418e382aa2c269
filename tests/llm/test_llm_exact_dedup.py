import hashlib
import random

import pytest

from llm_data import frame, rows
from vitrine.llm.exact_dedup import PatriciaTrie, exact_dedup


def brute(data, pick):
    groups = {}
    for doc_id, text, *_ in data:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = pick(known) if known else None
        for i in ids:
            out.append((i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_groups_equal_brute_force(spark, keep):
    got = sorted((tuple(r) for r in exact_dedup(frame(spark), keep).collect()), key=str)
    assert got == brute(rows(), {"min": min, "max": max}[keep])


def test_small_limits_flush_and_spill_without_change(spark):
    got = sorted((tuple(r) for r in exact_dedup(frame(spark), "max", flush_bytes=1000, most_bytes=1000).collect()), key=str)
    assert got == brute(rows(), max)


def test_empty_table(spark):
    assert exact_dedup(frame(spark, [])).count() == 0


def test_trie_with_spilled_subtrees_equals_a_dict():
    rng = random.Random(3)
    keys = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    trie, want = PatriciaTrie(max, most_bytes=20_000), {}
    for i, key in enumerate(keys):
        trie.insert(key, i)
        want[key] = (i, want.get(key, (0, 0))[1] + 1)
    assert trie.spills == 3      # the three subtrees of the root
    assert {k: (o, n) for k, o, n in trie.items()} == want


def test_trie_shares_prefixes():
    trie = PatriciaTrie()
    for i in range(100):
        trie.insert(b"x" * 10_000 + str(i).encode(), i)
    assert trie.held < 10_000 + 100 * 700
