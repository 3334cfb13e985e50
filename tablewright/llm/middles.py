"""Fill-in-the-middle transformation over texts that are stored as seekable compressed frames.

A text is cut into units (``[A-Za-z]+|[^A-Za-z]``, left to right). ``frame_store`` keeps it as independent zstandard frames of at most
``FRAME_BYTES`` bytes of UTF-8, each with the units, code points and bytes before it. Two hash-chosen unit numbers cut a text into prefix, middle and
suffix; ``fill_in_middle`` finds a cut by bisecting the unit counts and decompresses that frame alone. The output is never put together for its
digest: its parts are streamed from the frames in output order. For the second digest the markers are looked up in that stream, and the original
order is streamed between them.

Defined results: null and empty texts have no frames, no units and are plain; a null id hashes as empty; every row is treated by
itself, so rows with one id get the same cuts for the same text, each in a row of its own; other columns are left out, whatever they are
called; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import map_batches, text_bytes

FRAME_BYTES = 1 << 17
#: Bytes of text that a task turns into frames, or into outputs, at a time.
PORTION = 8_000_000
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Shares of 100: from this on a text stays plain, and below this its suffix comes first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_FRAME = "struct<units:long,chars:long,bytes:long,joined:boolean,data:binary>"
STORE = f"doc_id long, n long, n_chars long, n_bytes long, marked boolean, frames array<{_FRAME}>"


def unit_starts(data: bytes, joined: bool) -> np.ndarray:
    """Places in whole UTF-8 characters where units start; ``joined`` tells that a letter stands before them."""
    raw = np.frombuffer(data, np.uint8)
    letter = _LETTER[raw]
    follows = np.empty(len(raw), bool)
    follows[:1] = joined
    follows[1:] = letter[:-1]
    return np.flatnonzero(np.where(letter, ~follows, (raw & 0xC0) != 0x80))


def characters(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def _pieces(text: bytes, size: int) -> Iterator[bytes]:
    """The text in pieces of at most ``size`` bytes that end between characters."""
    at = 0
    while at < len(text):
        stop = min(len(text), at + size)
        while stop < len(text) and (text[stop] & 0xC0) == 0x80:
            stop -= 1
        yield text[at:stop]
        at = stop


def frame_store(docs: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """One row for each document: its counts and its frames in order."""

    def frames(batch: pa.RecordBatch) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=3).compress
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), strict=True):
            units = chars = size = 0
            joined, kept = False, []
            for piece in _pieces(text, frame_bytes):
                kept.append({"units": units, "chars": chars, "bytes": size, "joined": joined, "data": pack(piece)})
                units += len(unit_starts(piece, joined))
                chars += characters(piece)
                size += len(piece)
                joined = bool(_LETTER[piece[-1]])
            marked = any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
            rows.append({"doc_id": doc, "n": units, "n_chars": chars, "n_bytes": size, "marked": marked, "frames": kept})
        return pa.RecordBatch.from_pylist(rows, schema=_STORE_SCHEMA)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(rows, frames, STORE, PORTION)


_STORE_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n", pa.int64()),
        ("n_chars", pa.int64()),
        ("n_bytes", pa.int64()),
        ("marked", pa.bool_()),
        (
            "frames",
            pa.list_(
                pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()), ("joined", pa.bool_()), ("data", pa.binary())])
            ),
        ),
    ]
)


class FramedText:
    """Reads byte ranges and unit places of a text from its frames; one frame is open at a time."""

    def __init__(self, frames: list[dict], n_units: int, n_chars: int, n_bytes: int):
        self.frames, self.ends = frames, (n_bytes, n_chars)
        self.units, self.bytes = [f["units"] for f in frames], [f["bytes"] for f in frames]
        self.n_units, self._open = n_units, (-1, b"")

    def frame(self, k: int) -> bytes:
        if self._open[0] != k:
            self._open = k, zstandard.ZstdDecompressor().decompress(self.frames[k]["data"])
        return self._open[1]

    def place(self, unit: int) -> tuple[int, int]:
        """Bytes and code points before a unit."""
        if unit >= self.n_units:
            return self.ends
        k = bisect_right(self.units, unit) - 1
        data, head = self.frame(k), self.frames[k]
        at = int(unit_starts(data, head["joined"])[unit - head["units"]])
        return head["bytes"] + at, head["chars"] + characters(data[:at])

    def read(self, start: int, stop: int) -> Iterator[bytes]:
        k = bisect_right(self.bytes, start) - 1
        while start < stop:
            data = self.frame(k)
            shift = self.bytes[k]
            piece = data[start - shift : stop - shift]
            yield piece
            start, k = start + len(piece), k + 1


class Arranged:
    """Markers and byte ranges of a text in output order."""

    def __init__(self, text: FramedText, parts: list[bytes | tuple[int, int]]):
        self.text, self.parts = text, parts

    def read(self, start: int = 0, stop: int | None = None) -> Iterator[bytes]:
        """Bytes ``start`` to ``stop`` of the output, piece by piece."""
        at = 0
        for part in self.parts:
            size = len(part) if isinstance(part, bytes) else part[1] - part[0]
            low, high = max(start - at, 0), size if stop is None else min(stop - at, size)
            if low < high:
                if isinstance(part, bytes):
                    yield part[low:high]
                else:
                    yield from self.text.read(part[0] + low, part[0] + high)
            at += size


def marker_places(stream: Iterator[bytes], markers: list[bytes]) -> tuple[list[int], int]:
    """Where each of the markers first stands in a stream, one after the other, and the length of the stream."""
    found, tail, at = [], b"", 0
    for piece in stream:
        window, shift = tail + piece, at - len(tail)
        low = 0
        while len(found) < len(markers) and (place := window.find(markers[len(found)], low)) >= 0:
            found.append(shift + place)
            low = place + len(markers[len(found) - 1])
        at += len(piece)
        tail = window[max(low, len(window) - 2) :]
    if len(found) != len(markers):
        raise ValueError("the output lacks a marker")
    return found, at


def restored(output: Arranged, form: str) -> Iterator[bytes]:
    """The original text, from the output and its form alone."""
    if form == "plain":
        yield from output.read()
        return
    order = [PREFIX, SUFFIX, MIDDLE] if form == "psm" else [SUFFIX, PREFIX, MIDDLE]
    places, size = marker_places(output.read(), order)
    spans = {m: (place + len(m), stop) for m, place, stop in zip(order, places, [*places[1:], size], strict=True)}
    for marker in (PREFIX, MIDDLE, SUFFIX):
        yield from output.read(*spans[marker])


def plan(doc_id: int | None, n: int, marked: bool) -> tuple[str, int, int]:
    """Form and the two cuts of a text with ``n`` units, from the hash of its id."""
    digest = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or marked or h[2] % 100 >= PLAIN_FROM:
        return "plain", low, high
    return ("spm" if h[3] % 100 < SUFFIX_FIRST else "psm"), low, high


def _digest(stream: Iterator[bytes]) -> str:
    out = sha256()
    for piece in stream:
        out.update(piece)
    return out.hexdigest()


def fill_in_middle(store: DataFrame, texts: bool = True) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)`` and, with ``texts``, the output itself.

    Without ``texts`` a task holds one frame of a text at a time besides the compressed ones.
    """
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *(["output"] if texts else [])]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.large_string()]

    def arrange(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [[] for _ in names]
        columns = (batch.column(c) for c in ("doc_id", "n", "n_chars", "n_bytes", "marked", "frames"))
        for row in zip(*columns, strict=True):
            doc, n, n_chars, n_bytes, marked, frames = (x.as_py() for x in row)
            text = FramedText(frames, n, n_chars, n_bytes)
            form, low, high = plan(doc, n, marked)
            prefix = middle = None
            whole = (0, n_bytes)
            if form == "plain":
                output = Arranged(text, [whole])
            else:
                (b1, c1), (b2, c2) = text.place(low), text.place(high)
                prefix, middle = c1, c2 - c1
                first, last, mid = (0, b1), (b2, n_bytes), (b1, b2)
                parts = [PREFIX, first, SUFFIX, last] if form == "psm" else [SUFFIX, last, PREFIX, first]
                output = Arranged(text, [*parts, MIDDLE, mid])
            values = [doc, n, form, prefix, middle, _digest(output.read()), _digest(restored(output, form))]
            if texts:
                values.append(b"".join(output.read()).decode())
            for column, value in zip(out, values, strict=True):
                column.append(value)
        arrays = [pa.array(c, t) for c, t in zip(out, types, strict=False)]
        if texts:
            arrays[-1] = arrays[-1].cast(pa.string())
        return pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    sized = store.select("doc_id", "n", "n_chars", "n_bytes", "marked", "frames")
    return map_batches(sized, arrange, schema + (", output string" if texts else ""), PORTION if texts else None, "frames")
