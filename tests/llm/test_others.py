import itertools
import math
import random

import numpy as np
import pytest

from tablewright.llm.chat import ROLES, RoleModel, blocks, fit_roles, format_chats, marker, path, transfer
from tablewright.llm.decontaminate import align, find_leaks
from tablewright.llm.personal import Blocks, KINDS, SemiMarkov, field_spans, find_personal, fit_field, lattice, luhn, pattern_spans, stretches
from tablewright.llm.pivots import PivotIndex, top_products, whole_vectors
from tablewright.llm.suffixes import Anchors, _shared_anchors, multikey_sort, remove_repeats


# --- suffix array


def plain_repeats(rows, window):
    first, out = {}, {}
    known = [(i, (t or "").encode()) for i, t in rows if i is not None]
    for i, b in known:
        for p in range(len(b) - window + 1):
            w = b[p : p + window]
            first[w] = min(first.get(w, i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if i is not None and first[b[p : p + window]] < i:
                gone[p : p + window] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.setdefault(i, []).append((len(b), int(gone.sum()), runs, kept))
    return {i: sorted(v) for i, v in out.items()}


def repeat_rows(prose, odd):
    r = random.Random(4)
    shared = [prose(20, 50 + k) for k in range(4)]
    rows = [(i, prose(60, i)) for i in range(25)]
    for i in range(30, 70):
        parts = [prose(r.randint(0, 15), 200 + i + k) for k in range(3)]
        rows.append((i, f" {r.choice(shared)} ".join(parts)))
    rows += [(80, "ab" * 300), (81, "xx" + "ab" * 200), (82, "the the " * 100), (83, "the the " * 100), (84, "\x00" * 120), (85, "\x00" * 70 + "a")]
    rows += [(90, rows[3][1]), (3, rows[3][1]), (3, rows[40][1]), (91, "short"), (92, "short"), (93, "é" * 25), (94, "é" * 26)]
    return rows + odd + [(None, rows[0][1])]


def test_repeats_equal_brute_force(make_docs, prose, odd):
    rows = repeat_rows(prose, odd)
    got = {}
    for r in remove_repeats(make_docs(rows), bucket_bytes=500).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])))
    assert {i: sorted(v) for i, v in got.items()} == plain_repeats(rows, 50)
    assert remove_repeats(make_docs([])).count() == 0


def test_a_passage_in_a_third_of_the_documents_under_random_contexts(make_docs, prose, odd, monkeypatch):
    passage = prose(30, 999)
    rows = [(i, f"{prose(12, i)} {passage} {prose(12, 5000 + i)}" if i % 3 == 0 else prose(30, 9000 + i)) for i in range(300)]
    rows += [(400 + i, prose(3, i % 4) + passage) for i in range(40)] + [(3, passage + "!"), (None, passage)] + odd
    rows += [(500 + i, "ab" * (200 + i)) for i in range(20)]
    want = plain_repeats(rows, 50)
    for hot, ranges in ((0, 100), (5, 3), (40, 100)):
        monkeypatch.setattr("tablewright.llm.suffixes.RANGES", ranges)
        got = {}
        for r in remove_repeats(make_docs(rows), bucket_bytes=2000, hot_pieces=hot).collect():
            got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])))
        assert {i: sorted(v) for i, v in got.items()} == want


def test_a_hot_anchor_is_spread_over_the_buckets(spark, make_docs, prose):
    passage = prose(30, 999)
    docs = make_docs([(i, f"{prose(12, i)} {passage} {prose(12, 5000 + i)}") for i in range(300)])
    texts = docs.selectExpr("doc_id as doc", "xxhash64(text) as tid", "cast(text as binary) as text")
    spots = _shared_anchors(texts, 8, 50, 20, 100)
    hot = spots.where("spot < 0").collect()
    # Inside the passage all surroundings are equal, so only anchors near its two borders are hot.
    assert 0 < len(hot) < 12 and spots.where("spot >= 0").count() > 300 * 5


def test_hashes_of_strings_are_those_of_anchors(prose):
    text = prose(400, 3).encode()
    h, pos, _, _ = Anchors().of(text)
    strings = np.array([text[p : p + 20] for p in pos.tolist()], "S20").view(np.uint8).reshape(len(pos), 20)
    assert (Anchors().hashes(strings) == h).all()


def test_anchors_of_long_texts(prose):
    text = (prose(60_000, 1) + " ").encode() * 3
    h, pos, left, count = Anchors().of(text)
    assert count.sum() == len(text) - 49 and (np.diff(pos) > 0).all() and left.max() <= 30
    assert (pos - left == np.cumsum(count) - count).all()
    _, again, _, _ = Anchors().of(text[1000:5000])
    assert set((again[2:-2] + 1000).tolist()) <= set(pos.tolist())
    assert len(Anchors().of(b"x" * 49)[0]) == 0


def test_multikey_sort():
    r = np.random.default_rng(0)
    for high in (2, 4, 1000):
        words = r.integers(0, high, (300, 4)).astype(np.uint64)
        order, new = multikey_sort(words)
        rows = [tuple(w) for w in words[order].tolist()]
        assert rows == sorted(rows) and sorted(order.tolist()) == list(range(300))
        assert new.tolist() == [i == 0 or rows[i] != rows[i - 1] for i in range(300)]
    assert len(multikey_sort(np.zeros((0, 3), np.uint64))[0]) == 0


# --- personal data

SPANS = [
    ("mail a.b+c@x-y.example.com, a@b, @c.d, p@q.r_s@t.u", {"email"}),
    ("at 10.0.0.255 and 10.0.0.256 and 1.2.3 and 1.2.3.4.5.6.7.8", {"ip"}),
    ("card 4111 1111 1111 1111 or 4111-1111-1111-1112 or 4111111111111111", {"card"}),
    ("call +1 (704) 555-7114 or +12 or +49 30 123456789012345", {"phone"}),
]


def plain_personal(text):
    import re

    found = []
    tests = [
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
    ]
    for k, pattern in enumerate(tests):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (True, k != 1 or all(int(p) <= 255 for p in m[0].split(".")), 13 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15)[k]
            if ok:
                found.append((k, m.start(), m.end()))
    return found


def test_patterns_equal_plain_search():
    r = random.Random(0)
    texts = [t for t, _ in SPANS] + ["".join(r.choice("ab1.@+ ()-9_%é") for _ in range(60)) for _ in range(3000)]
    for text in texts:
        assert pattern_spans(text) == plain_personal(text), text
    for text, kinds in SPANS:
        assert {KINDS[k] for k, _, _ in pattern_spans(text)} == kinds
    assert len(pattern_spans("1" * 200_000 + "@" * 1000)) == 0
    assert pattern_spans("9" * 5000 + ".1.1.1") == []
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def number(r):
    kind = r.randrange(5)
    if kind == 0:
        return f"{r.choice('abcd')}{r.choice('xyz')}.{r.randint(10, 99)}@mail{r.randint(1, 9)}.example.com"
    if kind == 1:
        return ".".join(str(r.randint(1, 255)) for _ in range(4))
    if kind == 2:
        body = "".join(str(r.randint(0, 9)) for _ in range(15))
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))
    if kind == 3:
        return f"+1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}"
    return r.choice(["Version 2.0.", "in 1999", "no. 17", "chapter 3"])


def test_field_finds_unseen_spans_and_base_stays(spark, make_docs, prose, odd):
    r = random.Random(9)
    rows = [(i, f"{prose(8, i)} {number(r)} {prose(8, 1000 + i)} {number(r)} {prose(5, 2000 + i)}") for i in range(220)]
    model = fit_field(make_docs(rows[:160] + odd))
    hit = miss = extra = 0
    for _, text in rows[160:]:
        want, got = set(pattern_spans(text)), set(field_spans(text, model, {}))
        hit, miss, extra = hit + len(want & got), miss + len(want - got), extra + len(got - want)
    assert hit > 60 and hit / (hit + miss) > 0.9 and hit / (hit + extra) > 0.9
    more = rows[160:] + odd + [(5, None), (6, "1 " * 30_000)]
    for row in find_personal(make_docs(more), model).collect():
        base = [(s["kind"], s["start"], s["stop"]) for s in row["personal"] if s["base"]]
        assert base == pattern_spans(row["text"] or "")
        assert [(s["kind"], s["start"]) for s in row["personal"]] == sorted((s["kind"], s["start"]) for s in row["personal"])
    assert fit_field(make_docs([])) is None and find_personal(make_docs([]), None).count() == 0


def test_dynamic_program_finds_the_best_segmentation():
    r = np.random.default_rng(0)
    model = SemiMarkov()
    model.weights[:] = r.normal(size=model.weights.shape) * 0.3
    model.steps[:] = r.normal(size=model.steps.shape)
    lat = lattice("ab 12.3 x")
    ends = [[(i, f) for i, f in row] for row in lat.segments]

    def all_ways(at, before):
        if at == len(lat.tokens):
            yield 0.0, ()
            return
        for j in range(at + 1, len(ends)):
            for i, f in ends[j]:
                if i == at:
                    for y in range(len(KINDS) + 1):
                        if y or j == at + 1:
                            own = model.weights[f].sum(axis=0)[y] + model.steps[before, y]
                            for rest, way in all_ways(j, y):
                                yield own + rest, ((at, j, y), *way)

    ways = list(all_ways(0, 0))
    best = max(ways)
    got = [(lat.tokens[i][0], lat.tokens[j - 1][1], y - 1) for i, j, y in best[1] if y]
    assert [(a, b, k) for k, a, b in model.decode(lat)] == got
    total = math.log(sum(math.exp(w[0]) for w in ways))
    want = {}
    for score, way in ways:
        for part in way:
            want[part] = want.get(part, 0.0) + math.exp(score - total)
    for i, j, _, p, _ in model.posteriors(lat):
        for y in range(len(p)):
            if y or j == i + 1:
                assert abs(p[y] - want.get((i, j, y), 0.0)) < 1e-9


def test_blocks_decide_like_one_stretch():
    """Segmentation and probabilities do not depend on where blocks end, also where an entity lies across a border."""
    r = random.Random(4)
    rng = np.random.default_rng(1)
    model = SemiMarkov()
    # A cost for each segment, so that long ones win.
    model.weights[:] = rng.normal(size=model.weights.shape) * 0.4 - 0.15
    model.steps[:] = rng.normal(size=model.steps.shape) * 0.5
    text = " ".join(r.choice([number(r), "word", "at 12:30", "7,8\n9", "x@y"]) for _ in range(60))
    lat = lattice(text)
    starts, stops = {a: k for k, (a, _) in enumerate(lat.tokens)}, {b: k + 1 for k, (_, b) in enumerate(lat.tokens)}
    p = {(i, j): probs for i, j, _, probs, _ in model.posteriors(lat)}
    want = [(k, a, b, p[starts[a], stops[b]][k + 1]) for k, a, b in model.decode(lat)]
    assert len(want) > 20 and max(stops[b] - starts[a] for _, a, b, _ in want) > 4
    for size in (1, 2, 5, 17, 40, len(lat.tokens), 9999):
        got = model.decode_blocks(Blocks(text, size))
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-9)
    assert field_spans(text, model, {}, 0.5, 8) == field_spans(text, model, {}, 0.5)


def test_stretches_hold_every_trigger():
    for text in ["a1" * 500, "x " * 200 + "7" + " y" * 200, "@", "no trigger", "1 " + "word " * 300 + "2"]:
        ranges = stretches(text)
        assert all(any(a <= i < b for a, b in ranges) for i, c in enumerate(text) if c in "0123456789@")
        assert all(x[1] < y[0] for x, y in zip(ranges, ranges[1:]))


# --- benchmark passages


def smith_waterman(a, b, penalty=0.5):
    best, h = 0.0, [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0.0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -penalty), h[i - 1][j] - penalty, h[i][j - 1] - penalty)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_plain_program():
    r = random.Random(1)
    for _ in range(200):
        a = [r.randint(0, 5) for _ in range(r.randint(1, 12))]
        others = [[r.randint(0, 5) for _ in range(r.randint(1, 15))] for _ in range(3)]
        for b, (score, agree, first, last) in zip(others, align(np.array(a, np.uint64), [np.array(b, np.uint64) for b in others]), strict=True):
            assert abs(score - smith_waterman(a, b)) < 1e-9
            assert score == 0 or abs(smith_waterman(a, b[first:last]) - score) < 1e-9 and agree >= score
    assert align(np.zeros(0, np.uint64), [np.zeros(0, np.uint64)]) == [(0.0, 0, 0, 0)]


def test_leaks_whole_edited_and_none(spark, make_docs, prose, odd):
    items = [(k, prose(40, 500 + k)) for k in range(6)]
    edited = items[1][1].split()
    for k in (3, 11, 19, 27, 35):
        edited[k] = "paraphrased"
    del edited[22]
    rows = [(i, prose(200, i)) for i in range(20)]
    rows += [(30, f"{prose(50, 31)} {items[0][1].upper()}. {prose(9, 32)}"), (31, f"{prose(50, 33)} {' '.join(edited)} {prose(50, 34)}")]
    rows += [(i, f"{prose(20, i)} {items[2][1]} {prose(20, 2 * i)}") for i in range(40, 80)]  # a passage that many share
    rows += [(90, " ".join(items[3][1].split()[:6])), (91, f"{items[4][1]} {items[5][1]}"), (91, items[4][1])] + odd
    benchmark = spark.createDataFrame(items + [(None, items[0][1]), (7, None), (8, ""), (9, "tiny")], "item_id long, text string")
    for part_words in (1_000_000, 60):
        got = find_leaks(make_docs(rows), benchmark, part_words).collect()
        assert len(got) == len(rows)
        found = sorted((r["doc_id"] or -1, x["item_id"]) for r in got for x in r["leaks"])
        assert found == sorted([(30, 0), (31, 1), (91, 4), (91, 4), (91, 5)] + [(i, 2) for i in range(40, 80)])
    one = next(r for r in got if r["doc_id"] == 31)["leaks"][0]
    assert 0.6 < one["score"] < 1 and one["first"] >= 45 and one["agree"] == 34
    assert find_leaks(make_docs([]), benchmark).count() == 0
    assert all(r["leaks"] == [] for r in find_leaks(make_docs(rows[:3]), benchmark.limit(0)).collect())


def test_leaks_equal_brute_force(spark, make_docs, prose):
    """Against the plain alignment of every item with every whole document that shares four words in a row with it."""
    r = random.Random(8)
    items = [(k, prose(r.randint(12, 30), 700 + k)) for k in range(8)]
    rows = []
    for i in range(80):
        words = items[i % 8][1].split()
        for _ in range(r.randint(0, 14)):
            at = r.randrange(len(words))
            words[at : at + 1] = r.choice([[], ["other"], [words[at], "more"]])
            words = words or ["none"]
        rows.append((i, f"{prose(40, 3000 + i)} {' '.join(words)} {prose(40, 4000 + i)}"))
    want = {}
    for i, text in rows:
        doc = text.split()
        for k, item in items:
            own = item.split()
            seeds = {tuple(own[x : x + 4]) for x in range(len(own) - 3)}
            if seeds & {tuple(doc[x : x + 4]) for x in range(len(doc) - 3)}:
                score = smith_waterman(own, doc)
                if score >= 0.5 * len(own):
                    want[i, k] = score / len(own)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for part_words in (1_000_000, 50):
        got = {(r["doc_id"], x["item_id"]): x["score"] for r in find_leaks(make_docs(rows), benchmark, part_words).collect() for x in r["leaks"]}
        assert got.keys() == want.keys() and 20 < len(got) < 80
        assert all(abs(got[x] - want[x]) < 1e-9 for x in want)


# --- exact search


@pytest.mark.parametrize("sizes", [{}, {"pivots": 3, "rings": 2, "block_rows": 7}])
def test_search_equals_brute_force(spark, sizes):
    r = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in r.normal(size=8)]) for i in range(230)]
    vectors += [(i, vectors[0][1]) for i in range(230, 300)]  # a large group of equal vectors: ties
    odd = [(None, vectors[1][1]), (301, None), (302, []), (303, [float("nan")] * 8), (304, [float("inf")] + [0.0] * 7), (305, [None] + [1.0] * 7), (306, [1.0])]
    repeated = [(5, vectors[5][1]), (6, [9.0] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors + odd + repeated], "vec_id long, embedding array<float>, rank string")
    index = PivotIndex(whole_vectors(df), **sizes)
    got = top_products(index, df.where("vec_id % 50 = 0"), 4).collect()
    whole = {}
    for i, v in vectors + repeated:
        x = [math.floor(1024 * float(np.float32(c))) for c in v]
        whole[i] = min(whole.get(i, x), x)
    want = []
    for q in sorted(whole):
        if q % 50 == 0:
            rest = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(rest[:4])]
    assert sorted(tuple(r) for r in got) == want


def test_search_on_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.0])], "vec_id long, embedding array<float>")
    index = PivotIndex(whole_vectors(few))
    assert [tuple(r) for r in top_products(index, few.where("vec_id = 0"), 10).collect()] == [(0, 1, 1, 524288)]
    none = few.limit(0)
    assert top_products(PivotIndex(whole_vectors(none)), none, 10).count() == 0


# --- chats


def test_markers():
    assert marker("User: hello") == ("user", 6) and marker("### Assistant:\n")[0] == "assistant" and marker("<|system|> be kind")[0] == "system"
    assert marker("**Human:** hi")[0] == "user" and marker("[AI] ok")[0] == "assistant" and marker("Question the premise")[0] == ""
    assert marker("a dog") == ("", 0) and marker("") == ("", 0) and marker("Users: all")[0] == ""
    assert blocks("User: a\nb\nAssistant: c") == [("user", "a\nb"), ("assistant", "c")] and blocks("") == [("", "")]


def chats(prose, marked):
    rows = []
    for c in range(40):
        t = 0
        if c % 5 == 0:
            rows.append((c, t, "system", "You are a careful helper."))
            t += 1
        for k in range(3):
            rows.append((c, t, "user", ("Human: " if marked else "") + prose(8, 10 * c + k) + "?"))
            rows.append((c, t + 1, "assistant", ("Assistant: " if marked else "") + prose(70, 10 * c + k) + "\n" + prose(40, c)))
            t += 2
    return rows


@pytest.mark.parametrize("marked", [False, True])
def test_roles_come_back(spark, prose, marked):
    rows = chats(prose, marked)
    kind = "conv_id long, turn long, role string, text string"
    seen = spark.createDataFrame([r for r in rows if r[0] % 4], kind)
    unseen = [r for r in rows if r[0] % 4 == 0]
    got = format_chats(spark.createDataFrame(unseen + unseen[:2], kind), fit_roles(seen)).collect()
    truth = {(r[0], r[1]): r[2] for r in unseen}
    assert len(got) == len(unseen)
    assert np.mean([truth[r["conv_id"], r["turn"]] == r["role"] for r in got]) > 0.95
    assert all(r["rendered"].startswith(f"<|{r['role']}|>\n") and r["rendered"].endswith("\n<|end|>\n") and "Human:" not in r["rendered"] for r in got)


def test_odd_transcripts(spark, prose):
    kind = "conv_id long, turn long, role string, text string, part int"
    rows = [(1, None, "user", None, 0), (1, 0, None, "User: <|x|> a\nBot: b", 0), (1, 0, "tool", "c", 0), (None, 0, "user", "lost", 0), (2, 5, "user", "", 0)]
    df = spark.createDataFrame(rows, kind)
    got = sorted((r["conv_id"], r["turn"] is not None, r["part"], r["role"], r["rendered"]) for r in format_chats(df, fit_roles(df)).collect())
    assert [(g[0], g[1], g[2]) for g in got] == [(1, False, 0), (1, True, 0), (1, True, 1), (1, True, 2), (2, True, 0)]
    assert got[1][3:] == ("user", "<|user|>\n< |x|> a\n<|end|>\n") and got[2][3] == "assistant"
    assert format_chats(df.limit(0), fit_roles(df.limit(0))).count() == 0


def test_steps_over_borders_of_chunks_are_counted(spark):
    """One step from user to assistant in 2,048 turns, at the border of two chunks, and none the other way."""
    rows = [(1, t, "user" if t < 1024 else "assistant", f"text {t}") for t in range(2048)]
    model = fit_roles(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    user, assistant = ROLES.index("user"), ROLES.index("assistant")
    n = 1023 + 1 + 0.1 * len(ROLES)
    assert abs(model.steps[user, assistant] - math.log(1.1 / n)) < 1e-9
    assert abs(model.steps[assistant, user] - math.log(0.1 / (n - 1))) < 1e-9


def test_path_equals_enumeration():
    """Against every sequence of roles, with and without a fixed last role."""
    r = np.random.default_rng(2)
    for size in (1, 2, 5, 7):
        evidence, steps, before = r.normal(size=(size, 3)), r.normal(size=(3, 3)), r.normal(size=3)
        scores = {}
        for roles in itertools.product(range(3), repeat=size):
            rest = sum(evidence[k, y] + (steps[roles[k - 1], y] if k else 0.0) for k, y in enumerate(roles))
            scores[roles] = rest + max(before + steps[:, roles[0]])
        assert tuple(path(evidence, steps, before)) == max(scores, key=scores.get)
        for last in range(3):
            ending = {w: v for w, v in scores.items() if w[-1] == last}
            assert tuple(path(evidence, steps, before, last)) == max(ending, key=ending.get)
            assert abs((before[:, None] + transfer(evidence, steps)).max(axis=0)[last] - max(ending.values())) < 1e-9


def test_chunks_decide_like_one_path(spark):
    r = np.random.default_rng(0)
    evidence, steps, before = r.normal(size=(50, 3)), r.normal(size=(3, 3)), r.normal(size=3)
    whole = path(evidence, steps, before)
    ends, best = [], before
    for k in range(0, 50, 10):
        arrive = best[:, None] + transfer(evidence[k : k + 10], steps)
        ends.append(arrive.argmax(axis=0))
        best = arrive.max(axis=0)
    last, pieces = int(best.argmax()), []
    for k in range(40, -1, -10):
        enters = int(ends[k // 10][last])
        pieces = path(evidence[k : k + 10], steps, np.where(np.arange(3) == enters, 0.0, -np.inf) if k else before, last) + pieces
        last = enters
    assert pieces == whole
    long = [(1, t, None, f"User: q{t}" if t % 2 else f"Assistant: a{t}") for t in range(3000)]
    df = spark.createDataFrame(long, "conv_id long, turn long, role string, text string")
    model = RoleModel(np.zeros(3), np.zeros((3, 3)), {f"marker:{x}": np.where(np.array(ROLES) == x, 0.0, -9.0) for x in ROLES}, dict.fromkeys(("marker", "chars", "lines", "questions"), np.zeros(3)))
    got = {r["turn"]: r["role"] for r in format_chats(df, model).collect()}
    assert all(got[t] == ("user" if t % 2 else "assistant") for t in range(3000))

