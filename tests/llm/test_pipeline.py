"""Every stage of the pipeline against a plain version of it, on the rows its predecessor kept."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tablewright.llm.quality import fit_quality, score_quality
from tablewright.llm.tokens import default_vocabulary

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
SECRET = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(8)
    words = [a + b for a in "ba ke li mo nu ra se ti".split() for b in "lo mi na pe ru sa".split()]

    def prose(n):
        return " ".join(r.choice(words) for _ in range(n))

    items = [(k, prose(30)) for k in range(3)]
    rows = {i: prose(r.randint(30, 90)) for i in range(150)}
    for i in range(0, 150, 5):
        rows[i] = rows[i].upper().replace(" ", "!! ")  # junk
    for i in (11, 22, 33):
        rows[i] = f"{prose(20)} {items[i % 3][1]} {prose(20)}"
    for i in (41, 42):
        rows[i] = f"{prose(10)} {SECRET} {prose(10)} AKIA{'Q' * 16}"
    base = prose(300)
    for i in range(61, 65):
        parts = base.split()
        parts[50 * (i - 60)] = "changed"
        rows[i] = " ".join(parts)
    rows[71] = rows[72] = rows[73] = prose(40)
    docs = [(i, t, "en", "s", len(t)) for i, t in rows.items()] + [(200, None, None, None, None), (201, "", "en", "s", 0), (None, prose(30), "en", "s", 1)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 5 != 0), 0) for i in range(150)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def plain_dedup(rows):
    kept = []
    for i, t in sorted((i, t) for i, t in rows.items() if i is not None):
        own = shingles(t)
        if all(len(own & o) < 0.8 * len(own | o) for o in kept):
            kept.append(own)
            yield i


def masked(text):
    spans = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        spans += [m.span()] if len(m[2]) >= 8 else []
    spans += [m.span() for m in re.finditer(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", text)]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_stages(spark, tables):
    path, items = tables
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "simhash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing",
    ]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    model = fit_quality(docs, spark.read.parquet(f"{path}/labels.parquet"))
    want = {r["doc_id"] for r in score_quality(docs, model).where("score >= 0.7").collect()}
    docs = stages["quality classifier"](spark, docs, path).cache()
    kept = {r["doc_id"] for r in docs.collect()}
    assert kept == want and docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    assert not any(i in kept for i in range(0, 150, 5)) and sum(i in kept for i in range(150) if i % 5) > 110

    want = set(plain_dedup({i: texts[i] for i in kept})) | ({None} & kept)
    docs = stages["simhash near-dedup"](spark, docs, path).cache()
    kept = {r["doc_id"] for r in docs.collect()}
    assert kept == want and len(kept & {61, 62, 63, 64}) == 1 and len(kept & {71, 72, 73}) == 1

    want = {i for i in kept if not any(item in (texts[i] or "") for _, item in items)}
    docs = stages["benchmark decontamination"](spark, docs, path).cache()
    assert {r["doc_id"] for r in docs.collect()} == want and {11, 22, 33} & kept and not {11, 22, 33} & want

    before = {r["doc_id"]: r for r in docs.collect()}
    docs = stages["secret scans"](spark, docs, path).cache()
    after = {r["doc_id"]: r for r in docs.collect()}
    assert after.keys() == before.keys()
    for i, r in after.items():
        assert (r["text"] or "") == masked(before[i]["text"] or "") and r["lang"] == before[i]["lang"]
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))

    packed = stages["best-fit packing"](spark, docs, path).collect()
    tokenizer = Tokenizer.from_file(default_vocabulary())
    ids, places = defaultdict(list), defaultdict(list)
    for r in sorted(packed, key=lambda r: r["piece"]):
        ids[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {i: v for i, v in ids.items()} == {i: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0] for i, r in after.items()}
    for spans in places.values():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at <= 2048

    whole = corpus_pipeline.run(spark, path).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["piece"])
    assert [(r["doc_id"], r["piece"], r["ids"]) for r in sorted(whole, key=key)] == [(r["doc_id"], r["piece"], r["ids"]) for r in sorted(packed, key=key)]
