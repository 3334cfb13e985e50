import hashlib
import re

import pytest

from tablewright.llm.middles import Arranged, FramedText, _pieces, fill_in_middle, frame_store, marker_places, plan, restored


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"(?s)[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    hexes = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexes[i : i + 8], 16) for i in (0, 8, 16, 24))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        form, out = "plain", text
    elif h4 % 100 < 20:
        form, out = "spm", f"<S>{suf}<P>{pre}<M>{mid}"
    else:
        form, out = "psm", f"<P>{pre}<S>{suf}<M>{mid}"
    sizes = (None, None) if form == "plain" else (len(pre), len(mid))
    return (doc_id, n, form, *sizes, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), out)


@pytest.mark.parametrize("frame_bytes", [5, 7, 1 << 17])
def test_like_a_plain_version_at_every_frame_size(spark, make_docs, odd, prose, frame_bytes):
    rows = [*odd, *[(i, prose(40, i)) for i in range(60)], (70, "a" * 5000), (71, "漢é" * 900), (72, "x < P> <P y"), (73, "one <M> two"), (74, "<S<P<M")]
    rows += [(75, "same row"), (75, "same row"), (75, "other row"), (76, "\U0001f600" * 40 + "end"), (77, "<")]
    got = fill_in_middle(frame_store(make_docs(rows), frame_bytes)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(plain(*r)) for r in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_a_very_long_text(spark, make_docs, prose):
    text = (prose(2000) + " é\n") * 300
    for doc in (1, 2):
        (got,) = fill_in_middle(frame_store(make_docs([(doc, text)]))).collect()
        assert tuple(got) == plain(doc, text)


def test_empty_table(spark, make_docs):
    assert fill_in_middle(frame_store(make_docs([]).limit(0))).collect() == []


def test_without_texts_the_digests_are_the_same(spark, make_docs, prose):
    store = frame_store(make_docs([(i, prose(30, i)) for i in range(20)]), 16)
    full = fill_in_middle(store).drop("output")
    assert sorted(full.collect()) == sorted(fill_in_middle(store, texts=False).collect())


def test_markers_are_found_across_pieces():
    for size in range(1, 9):
        stream = _pieces(b"<P>ab<<S>c<<M<M>x", size)
        assert marker_places(stream, [b"<P>", b"<S>", b"<M>"]) == ([0, 6, 13], 17)
    with pytest.raises(ValueError):
        marker_places(iter([b"<P>ab"]), [b"<P>", b"<S>"])


def test_restoring_reads_the_output_alone():
    from zstandard import ZstdCompressor

    data = b"abcdef"
    text = FramedText([{"units": 0, "chars": 0, "bytes": 0, "joined": False, "data": ZstdCompressor().compress(data)}], 1, 6, 6)
    output = Arranged(text, [b"<S>", (4, 6), b"<P>", (0, 1), b"<M>", (1, 4)])
    assert b"".join(output.read()) == b"<S>ef<P>a<M>bcd"
    assert b"".join(restored(output, "spm")) == data


def test_plan_needs_units():
    assert plan(5, 0, False)[0] == "plain" and plan(5, 10, True)[0] == "plain"
