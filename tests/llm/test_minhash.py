import random

import numpy as np
import pytest

from tablewright.llm import minhash as H


def shingle_set(text):
    parts = (text or "").encode().lower().split()
    return {b" ".join(parts[i : i + 2]) for i in range(max(1, len(parts) - 1))} if parts else set()


def plain(rows):
    """All pairs, in a union of sets; a repeated id is one node."""
    rows = [(i, shingle_set(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    linked = {i for i, s in rows if s}
    return sorted((i, len(s), find(i) if i in linked and s else i, (find(i) if i in linked and s else i) == i) for i, s in rows)


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(w if r.random() > share else f"new{r.randint(0, 10**6)}" for w in text.split())


def found(docs, **options):
    return sorted(tuple(r) for r in H.minhash_components(docs, **options).select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_like_brute_force(spark, make_docs, odd, prose):
    rows = list(odd)
    for group in range(12):
        base = prose(80, group)
        rows += [(1000 * group + 50 + k, edited(base, 0.01 * k, 100 * group + k)) for k in range(9)]
    rows += [(20_000, prose(60, 1)), (20_001, prose(60, 1)), (20_002, prose(60, 1).upper()), (20_003, "two words"), (20_004, "Two\n words"), (20_005, "two")]
    assert found(make_docs(rows)) == plain(rows)


def test_large_buckets_lose_no_link(spark, make_docs, prose):
    """A shared passage, and members that are only like some others."""
    rows, shared = [], prose(60, 7)
    for group in range(8):
        own = f"{shared} {prose(12, 50 + group)}"
        rows += [(100 * group + k, edited(own, 0.02 * (k % 5), 31 * group + k)) for k in range(9)]
    want = plain(rows)
    assert len({r[2] for r in want}) > 4
    assert found(make_docs(rows), bucket=2) == want
    # Groups in several chunks, members outside the largest component in several blocks.
    assert found(make_docs(rows), bucket=2, chunk_bytes=6_000, block_bytes=4_000) == want


def test_chains(spark, make_docs, prose):
    """Each text is like the next one; the ends are not alike."""
    words = prose(400, 3).split()
    rows = [(10 + i, " ".join(words[5 * i : 5 * i + 100])) for i in range(20)]
    for chunk_bytes in (1_000_000, 5_000):
        assert found(make_docs(rows), bucket=2, chunk_bytes=chunk_bytes, block_bytes=3_000) == plain(rows)
    assert len({r[2] for r in plain(rows)}) == 1


def test_repeated_and_null_ids(spark, make_docs, prose):
    a, b, c = prose(50, 1), prose(50, 2), prose(50, 3)
    rows = [(5, a), (5, b), (7, b), (7, b), (2, a), (None, c), (9, c), (5, ""), (9, None)]
    assert found(make_docs(rows)) == [(2, 49, 2, True), (5, 0, 5, True), (5, 49, 2, False), (5, 49, 2, False), (7, 49, 2, False), (7, 49, 2, False), (9, 0, 9, True), (9, 49, 9, True)]


def test_empty_table(spark, make_docs):
    assert found(make_docs([]).limit(0)) == []


def test_one_very_long_text_and_its_copy(spark, make_docs, prose):
    text = prose(120_000, 5)
    got = found(make_docs([(1, text), (2, text + " end"), (3, prose(30, 1))]))
    assert [(r[0], r[2]) for r in got] == [(1, 1), (2, 1), (3, 3)]


def test_share_of_equal_minima_is_the_similarity():
    r = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        both, a, b = r.integers(0, 1 << 64, (3, 4000), np.uint64)
        only = int(4000 * (1 - share) / (2 * share))
        one, other = H.signatures([np.r_[both, a[:only]], np.r_[both, b[:only]]], 2000)
        assert np.mean(one == other) == pytest.approx(share, abs=0.04)


def test_pairs_at_the_threshold_meet():
    r = np.random.default_rng(2)
    for _ in range(300):
        both, a, b = r.integers(0, 1 << 64, (3, 80), np.uint64)
        sigs = H.signatures([np.r_[both, a[:10]], np.r_[both, b[:10]]])
        keys = H.band_keys(sigs)
        assert (keys[0] == keys[1]).any() and (sigs[0] == sigs[1]).sum() >= H.AGREE
