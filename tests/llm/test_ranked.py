import math
import re
from collections import Counter

import numpy as np
import pytest

from tablewright.llm import ranked as R


def words(text):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode().lower())


def plain(docs, items, k):
    bags = [(i, Counter(words(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(words(text))
    out = []
    for item, own in asked.items():
        scored = []
        for (doc, bag), n in zip(bags, sizes, strict=True):
            if doc is None or not n:
                continue
            m = 50 + (50 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in own if bag[t])
            if score > 0:
                scored.append((-score, doc))
        out += [(item, r + 1, doc, -s) for r, (s, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def asked(spark, items):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, rank int, bag string")


def found(docs, items, k, **options):
    return sorted(tuple(r) for r in R.ranked_search(docs, items, k, **options).select("item_id", "rank", "doc_id", "score").collect())


ITEMS = [(1, "ba ke Li mo zzz"), (2, "The fa, the ge!"), (3, None), (4, ""), (None, "ba"), (5, "nothing-like-it"), (1, "ra se"), (6, "漢字 É x1")]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_like_brute_force(spark, make_docs, odd, prose, k):
    docs = [*odd, *[(i, prose(30, i)) for i in range(80)]]
    docs += [(100 + i, "ba ke ba unheard") for i in range(30)] + [(200 + i, f"ba ke ba other{i}") for i in range(30)] + [(7, "ba li"), (7, "ba li"), (7, "ra mo")]
    assert found(make_docs(docs), asked(spark, ITEMS), k) == plain(docs, ITEMS, k)


def test_portions_of_items_change_nothing(spark, make_docs, prose):
    docs, items = [(i, prose(30, i)) for i in range(40)], [(i, prose(8, 500 + i)) for i in range(9)]
    assert found(make_docs(docs), asked(spark, items), 5, item_bytes=600) == plain(docs, items, 5)


def test_equal_bags_are_one_class(spark, make_docs, monkeypatch):
    docs = [(i, f"ba ke strange{i}") for i in range(200)] + [(500, "ba ke")]
    rows = R.bags(make_docs(docs), {b"ba": 0, b"ke": 1})
    assert rows.select("bag").distinct().count() == 1 and rows.where("n = 3").count() == 200
    assert found(make_docs(docs), asked(spark, [(1, "ba")]), 50) == plain(docs, [(1, "ba")], 50)


def test_empty_tables(spark, make_docs):
    assert found(make_docs([]).limit(0), asked(spark, ITEMS), 5) == []
    assert found(make_docs([(1, "ba")]), asked(spark, ITEMS).limit(0), 5) == []


def test_terms_across_blocks(monkeypatch):
    text = ("Ab-c9 漢字x " * 50 + "z" * 70).encode()
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(R, "BLOCK_BYTES", size)
        assert [t for block in R.terms(text) for t in block] == words(text.decode())


def test_sums_beyond_double_precision_stay_whole():
    weights = np.full(40, 3 * 10**8, np.int64)
    block = R.ItemBlock([(1, np.arange(40))], weights)
    assert not block.exact
    row, term = np.zeros(40, np.int64), np.arange(40)
    tf = np.arange(1, 41)
    want = sum(3 * 10**8 * ((10**9 * t) // (1000 * t + 20 * 77)) for t in range(1, 41))
    assert block.scores(1, row, term, tf, np.array([77]))[0, 0] == want


def test_small_blocks_and_small_buffers_agree(spark, make_docs, prose, monkeypatch):
    docs, items = [(i, prose(20, i)) for i in range(60)], [(i, prose(6, 900 + i)) for i in range(7)]
    want = plain(docs, items, 4)
    monkeypatch.setattr(R, "_CELLS", 20)
    assert len(R.item_blocks([(i, np.arange(6)) for i in range(7)], np.ones(6))) > 1
    assert found(make_docs(docs), asked(spark, items), 4) == want
