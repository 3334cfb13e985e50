import random

import numpy as np
import pytest
import xxhash

from tablewright.llm.components import smallest_reachable
from tablewright.llm.near_copies import near_copies, without_near_copies
from tablewright.llm.simhash import covering_masks, fingerprint, fingerprint_links, simhash_components


def plain_fingerprint(text, n=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints(prose):
    for text in ["", "one", "One  TWO\tthree", "É à b c d", prose(100, 1), prose(5000, 2), "same same same same same same"]:
        assert fingerprint(text.encode()) & (1 << 64) - 1 == plain_fingerprint(text)


@pytest.mark.parametrize("radius, blocks", [(1, 1), (2, 1), (4, 1), (9, 2)])
def test_masks_cover(radius, blocks):
    masks = covering_masks(list(range(64)), radius, blocks)
    r = random.Random(0)
    for _ in range(2000):
        differ = sum(1 << p for p in r.sample(range(64), radius))
        assert any(not (m & differ) for m in masks)


def test_links_connect_what_is_near(spark):
    r = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(30):
        base = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            fps.add(base)
            for p in r.sample(range(64), r.randint(1, 5)):
                base ^= 1 << p
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    near = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for bucket_rows in (2, 20_000):
        got = [(r["a"], r["b"]) for r in fingerprint_links(df, 4, bucket_rows).collect()]
        assert set(map(tuple, map(sorted, got))) <= set(near)
        assert roots(got, fps) == roots(near, fps)


def test_components_equal_brute_force(spark, make_docs, prose, odd):
    r = random.Random(7)
    rows = [(i, prose(60, i % 9)) for i in range(40)]
    for i in range(40, 90):
        words = prose(300, i % 6).split()
        for _ in range(i % 4):
            words[r.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += odd + [(3, "another text with the id of an earlier one"), (60, rows[60][1])]
    got = simhash_components(make_docs(rows))
    known = [(i, t) for i, t in rows if i is not None]
    fps = [(i, plain_fingerprint(t)) for i, t in known]
    pairs = [(a, b) for a, x in fps for b, y in fps if a < b and (x ^ y).bit_count() <= 4]
    want = roots(pairs, {i for i, _ in known})
    assert sorted((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got.collect()) == sorted((i, f, want[i]) for i, f in fps)
    assert simhash_components(make_docs([]).select("doc_id", "text")).count() == 0


def test_reachable_over_long_paths(spark):
    r = random.Random(1)
    order = list(range(200))
    r.shuffle(order)
    pairs = list(zip(order, order[1:])) + [(300, 301), (302, 301), (None, 5), (7, 7)]
    got = smallest_reachable(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()
    want = roots([p for p in pairs if None not in p], set(order) | {300, 301, 302})
    assert {(r["node"], r["root"]) for r in got} == set(want.items()) and len(got) == len(want)
    assert smallest_reachable(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def shingle_set(text, n=5):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def test_near_copies_keep_one(spark, make_docs, prose, odd):
    r = random.Random(2)
    rows = [(i, prose(40, 1000 + i)) for i in range(30)]  # nothing in common
    base = prose(400, 77)
    for i in range(100, 160):  # one large group of near copies
        words = base.split()
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(200, rows[0][1]), (201, rows[0][1].upper())] + odd
    sets = {i: shingle_set(t) for i, t in rows if i is not None}

    def share(a, b):
        return len(sets[a] & sets[b]) / len(sets[a] | sets[b])

    for group_rows in (1000, 8):
        got = {r["doc_id"]: r["kept_id"] for r in near_copies(make_docs(rows), group_rows=group_rows).collect()}
        assert got.keys() == sets.keys()
        kept = [i for i, k in got.items() if i == k]
        assert all(got[k] == k and k <= i for i, k in got.items())
        assert all(share(i, k) >= 0.8 for i, k in got.items() if i != k and i < 900)
        assert set(range(30)) <= set(kept) and got[200] == got[201] == 0
        assert got[901] == got[902] == got[903] == 901
        group = [i for i in kept if 100 <= i < 160]
        assert len(group) < 12
    assert near_copies(make_docs([])).count() == 0


def test_near_copies_beyond_the_radius(spark, make_docs, prose):
    r = random.Random(5)

    def edited(text, least):
        """As many words changed as the similarity allows."""
        words, best = text.split(), text
        while True:
            words[r.randrange(len(words))] = f"new{r.random()}"
            changed = " ".join(words)
            a, b = shingle_set(text), shingle_set(changed)
            if len(a & b) < least * len(a | b):
                return best
            best = changed

    passage = prose(60, 9)  # in a third of the documents and more, which are no copies for that
    rows = []
    for i in range(60):
        base = prose((12, 60, 300)[i % 3], 5000 + i)
        base = f"{base} {passage}" if i % 2 else base
        rows += [(2 * i, base), (2 * i + 1, edited(base, 0.8 + 0.1 * (i % 5) / 4))]
    base = prose(200, 8)
    rows += [(1000 + i, edited(base, 0.8)) for i in range(30)]  # more texts than one key compares
    far = sum((fingerprint(a.encode(), 5) ^ fingerprint(b.encode(), 5)).bit_count() > 9 for (_, a), (_, b) in zip(rows[:120:2], rows[1:120:2]))
    assert far >= 5
    want, kept = {}, []
    for i, t in rows:
        own = shingle_set(t)
        want[i] = next((k for k, o in kept if len(own & o) >= 0.8 * len(own | o)), i)
        if want[i] == i:
            kept.append((i, own))
    assert {r["doc_id"]: r["kept_id"] for r in near_copies(make_docs(rows)).collect()} == want


def test_rows_of_one_id_are_decided_by_their_own_texts(spark, make_docs, prose):
    copied, clean, other = prose(60, 1), prose(60, 2), prose(60, 3)
    rows = [(1, copied), (5, copied + " end"), (5, clean), (7, other), (7, other), (8, clean), (None, copied), (None, copied)]
    left = without_near_copies(make_docs(rows))
    got = sorted((str(r["doc_id"]), r["text"]) for r in left.collect())
    assert got == sorted([("1", copied), ("5", clean), ("7", other), ("None", copied), ("None", copied)])
    assert left.columns == make_docs(rows).columns


def test_large_components_by_rows_and_bytes(spark, make_docs, prose):
    r, base, rows = random.Random(4), prose(150, 6).split(), []
    for i in range(60):
        words = list(base)
        for _ in range(r.randint(0, 6)):
            words[r.randrange(150)] = f"new{r.random()}"
        rows.append((i, " ".join(words)))
    one = {r["doc_id"]: r["stays"] for r in near_copies(make_docs(rows)).collect()}
    for options in ({"group_rows": 7}, {"group_bytes": 5_000}, {"bucket": 2, "chunk_bytes": 8_000}):
        got = {r["doc_id"]: (r["kept_id"], r["stays"]) for r in near_copies(make_docs(rows), **options).collect()}
        kept = [i for i, (_, stays) in got.items() if stays]
        sets = {i: shingle_set(t) for i, t in rows}
        assert all((k == i) == stays for i, (k, stays) in got.items())
        assert all(k in kept and 100 * len(sets[i] & sets[k]) >= 80 * len(sets[i] | sets[k]) for i, (k, _) in got.items())
        assert not any(100 * len(sets[i] & sets[k]) >= 80 * len(sets[i] | sets[k]) for i in kept for k in kept if i < k)
    assert sum(one.values()) < 40


def test_forest_of_hot_bucket():
    from tablewright.llm.simhash import _forest

    base = 0x0123456789ABCDEF
    fps = np.array([base ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)] * 2, dtype=np.int64)
    edges = _forest(fps, 4)
    assert len(edges) == len(set(fps.tolist())) - 1
    signed = np.array([base, base ^ 1, (base | 1 << 63) - (1 << 64)], dtype=np.int64)
    assert len(_forest(signed, 1)) == 2
