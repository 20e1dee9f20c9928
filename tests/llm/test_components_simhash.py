from __future__ import annotations

import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from statelens.llm import simhash
from statelens.llm.components import components, forest


def brute(pairs):
    low = {}

    def find(x):
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for a, b in pairs:
        if a is None or b is None or a == b:
            continue
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(low)}


def test_components_chain_star_and_random(spark):
    rnd = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rnd.randrange(5000, 5400), rnd.randrange(5000, 5400)) for _ in range(200)]
    pairs += [(7, 7), (None, 8), (9, None)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()))
    assert got == brute(pairs)


def test_components_of_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=30))
@settings(max_examples=60, deadline=None)
def test_forest_keeps_components(pairs):
    a, b = forest(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    want = {k: v for k, v in brute(pairs).items() if k != v}
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == want


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", low) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


@given(st.text(alphabet="aBcÄé \t\n\x0b\x1f  .", max_size=80))
@settings(max_examples=150, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_masks_cover_every_four_bits():
    m = simhash.masks(4)
    assert len(m) == 31
    rnd = random.Random(1)
    for _ in range(3000):
        bits = sum(1 << b for b in rnd.sample(range(64), 4))
        assert any(x & bits == 0 for x in m)


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rnd.choices(words, k=60)) for _ in range(40)]
    texts = list(base)
    for b in base[:25]:
        for _ in range(3):
            w = b.split()
            w[rnd.randrange(60)] = "other"
            texts.append(" ".join(w))
    texts += [base[0], base[0].upper(), "", None, "  \n", "one two", "One  Two"]
    rows = [(100 + 7 * i, t) for i, t in enumerate(texts)]
    rows.append(rows[0])
    got = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    fp = {d: slow_fingerprint(t) for d, t in rows}
    want = brute([(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    assert {d: v[1] for d, v in got.items()} == {d: want.get(d, d) for d in fp}
    assert {d: v[0] & (1 << 64) - 1 for d, v in got.items()} == fp


def test_large_key_groups_are_split_without_loss(spark):
    """Fingerprints of one table's key beyond the block size are compared in pairs of blocks."""
    rnd = random.Random(9)
    mask = simhash.masks(4)[0]
    fps = list({mask & 0x5555555555555555 | (rnd.getrandbits(64) & ~mask) for _ in range(60)})
    fps += [f ^ 1 << next(i for i in range(64) if not mask >> i & 1) for f in fps[:20]]
    fps = sorted(set(fps))
    rows = [(simhash.signed(f), i) for i, f in enumerate(fps)]
    links = simhash.near_links(spark.createDataFrame(rows, "fp long, node long"), 4, group=8)
    got = dict(map(tuple, components(links).collect()))
    assert got == brute([(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])


def test_first_of_groups(spark):
    rows = [(5, "a b c d e f", "x"), (3, "a b c d e f", "y"), (3, "a b c d e f", "z"), (9, "other words stand in this text", "x"), (None, "a b c d e f", "n"), (None, None, "n")]
    got = simhash.first_of_groups(spark.createDataFrame(rows, "doc_id long, text string, component_id string"))
    assert sorted((r[0] is None, r[0] or 0) for r in got.collect()) == [(False, 3), (False, 9), (True, 0), (True, 0)]
    assert got.columns == ["doc_id", "text", "component_id"]


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
