"""Suffix-array deduplication: remove every byte that a repeated string of ``WINDOW`` bytes covers, if the string also starts in a document
with a smaller id.

A suffix matters here by its first ``WINDOW`` bytes only. Sorting one suffix for each byte of the corpus would move many times
its size, so the array is a sparse one: among the ``KEY``-byte strings that start in a window, the one with the smallest hash is
the window's anchor. Equal windows have equal anchors at the same place, hence only windows can be equal whose anchors begin with
the same bytes. The steps:

1. Copies of whole texts: only the one with the smallest id goes on; the others are covered from end to end.
2. Hashes of anchors are brought together; an anchor that no other document has leaves the race, with all its windows.
3. The remaining anchors, with the bytes of their windows around them, are range-partitioned by their leading bytes, between splitters
   sampled from the corpus. A splitter is as long as the key, so that equal keys are never on both sides of one, and no window needs
   comparing across a boundary. Each bucket expands its suffixes, sorts them by multikey quicksort (eight bytes at a time, equal
   ones only) and takes the smallest id of each run of equal neighbours.
4. Covered windows are joined to the texts, which are cut.

Within a batch of documents, of equal anchors or equal windows only the first document's travel on: the others' fate is known. So the inside of a
passage that a third of all documents share brings one row for each batch to its bucket. At the borders of such a passage every document has
a context of its own: anchors with more than ``HOT_PIECES`` different surroundings are counted when anchors meet, and their windows
are dealt out one by one, by a hash of all their bytes, over all buckets.

Defined results: null texts are empty; texts shorter than a window lose nothing; rows with a null id lose nothing and cover nothing;
rows with the same id never cover each other; an empty table gives no rows. Other columns pass through, unless they bear the name of a
result column, which then replaces them.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import extended, forget, map_batches, portions, release, small_or_plain, text_bytes, written

WINDOW = 50
KEY = 20
#: Bytes of text for one bucket.
BUCKET_BYTES = 6_000_000
#: Documents that splitters are sampled from, and the most ranges between splitters; beyond it a range is cut by a hash of the key.
SPLITTER_DOCS = 2000
RANGES = 100_000
#: Different surroundings of one anchor from which its windows are spread over all buckets, and the most anchors that are treated so:
#: on a corpus of more bytes than their product the first number rises.
HOT_PIECES = 20_000
HOT_KEYS = 4_000_000
#: Bytes that are hashed at a time.
_BLOCK = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


class Anchors:
    """Anchors of texts: position, windows before it, and number of windows."""

    def __init__(self, window: int = WINDOW, key: int = KEY):
        self.window, self.key = window, key
        steps = np.full(_BLOCK + window + 1, _MULTIPLIER, np.uint64)
        steps[0] = 1
        self.powers = np.multiply.accumulate(steps)
        steps[1:] = pow(_MULTIPLIER, -1, 1 << 64)
        self.inverse = np.multiply.accumulate(steps)

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(hashes, positions, left, windows)``: the windows start at ``position - left`` and follow each other."""
        windows = len(text) - self.window + 1
        at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for low in range(0, windows, _BLOCK):
            high = min(windows, low + _BLOCK)
            a, h = self._block(np.frombuffer(text, np.uint8, high - low + self.window - 1, low))
            at.append(a + low)
            hashes.append(h)
        at, hashes = np.concatenate(at), np.concatenate(hashes)
        if not len(at):
            return hashes, at, at, at
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        count = np.diff(np.append(first, len(at)))
        return hashes[first], at[first], at[first] - first, count

    def _block(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each window, the place of its anchor and the anchor's hash."""
        n, key = len(data), self.key
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=sums[1:])
        h = self._mixed((sums[key:] - sums[: n - key + 1]) * self.inverse[: n - key + 1])
        order = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        reach, least = 1, order
        span = self.window - key + 1
        while 2 * reach <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < span:
            least = np.minimum(least[: len(order) - span + 1], least[span - reach :])
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return at, self._dealt(h[at])

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h

    @staticmethod
    def _dealt(h: np.ndarray) -> np.ndarray:
        """Anchors have small hashes in their upper half; the key that is dealt out by must not."""
        return (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)

    def hashes(self, strings: np.ndarray) -> np.ndarray:
        """The hashes that ``of`` gives for these strings (a row of bytes each), of any length."""
        return self._dealt(self._mixed((strings.astype(np.uint64) + np.uint64(1)) @ self.powers[: strings.shape[1]]))


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``words``, and which rows of that order differ from the one before.

    Ternary quicksort on eight-byte characters: rows are split by one character, and only equal ones go on to the next.
    """
    n = len(words)
    order, new = np.arange(n), np.zeros(n, bool)
    if n:
        new[0] = True
    open_rows = np.arange(n)  # places in the order that are not alone in their group yet
    for k in range(words.shape[1]):
        if not len(open_rows):
            break
        group = np.cumsum(new)[open_rows]
        word = words[order[open_rows], k]
        inner = np.lexsort((word, group))
        order[open_rows] = order[open_rows][inner]
        word, group = word[inner], group  # groups keep their places
        new[open_rows[1:]] |= (word[1:] != word[:-1]) | (group[1:] != group[:-1])
        alone = new & np.append(new[1:], True)
        open_rows = open_rows[~alone[open_rows]]
    return order, new


_ANCHOR = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("tid", "<i8"), ("pos", "<i8"), ("left", "u1"), ("windows", "u1"), ("many", "<u2")])


def _pack_anchors(rows: np.ndarray) -> bytes:
    """Column by column, which compresses better."""
    return b"".join(np.ascontiguousarray(rows[n]).tobytes() for n in _ANCHOR.names)


def _unpack_anchors(data: bytes) -> np.ndarray:
    n = len(data) // _ANCHOR.itemsize
    rows, at = np.zeros(n, _ANCHOR), 0
    for name in _ANCHOR.names:
        kind = _ANCHOR[name]
        rows[name] = np.frombuffer(data, kind, n, at)
        at += n * kind.itemsize
    return rows


def _surroundings(texts: list[bytes], rows: np.ndarray, text_of: np.ndarray, window: int) -> np.ndarray:
    """A hash for each row of the bytes at both ends of its windows, and where the anchor lies in them."""
    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    start = rows["pos"] - rows["left"] + (np.cumsum(size) - size)[text_of]
    stop = start + rows["windows"] + window - 1
    out = rows["left"].astype(np.uint64) << np.uint64(8) | rows["windows"].astype(np.uint64)
    for i in range(8):
        for place in (start + i, stop - 1 - i):
            out = (out ^ data[place]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def _shared_anchors(texts: DataFrame, buckets: int, window: int, key: int, hot_pieces: int) -> DataFrame:
    """``(doc, tid, spot)``: places of anchors that more than one document has, packed as in ``_spot``.

    A row with the spot -1 says that the anchor with the hash ``doc`` has more than ``hot_pieces`` different surroundings.
    """

    def gather(batches):
        anchors = Anchors(window, key)
        for batch in portions(batches):
            parts, texts = [], text_bytes(batch.column("text"))
            for doc, tid, text in zip(batch.column("doc").to_pylist(), batch.column("tid").to_pylist(), texts, strict=True):
                h, pos, left, count = anchors.of(text)
                rows = np.zeros(len(h), _ANCHOR)
                rows["hash"], rows["doc"], rows["tid"], rows["pos"], rows["left"], rows["windows"] = h, doc, tid, pos, left, count
                parts.append(rows)
            rows = np.concatenate(parts)
            if not len(rows):
                continue
            # The first document of each hash asks for it; the batch's others know that they are not alone.
            rank = np.lexsort((rows["doc"], rows["hash"]))
            sorted_hash, sorted_doc = rows["hash"][rank], rows["doc"][rank]
            first = np.append(True, sorted_hash[1:] != sorted_hash[:-1])
            run = np.cumsum(first) - 1
            starts = np.flatnonzero(first)
            asks = sorted_doc == sorted_doc[starts][run]
            several = (np.maximum.reduceat(sorted_doc, starts) != sorted_doc[starts])[run]
            asking = np.zeros(len(rows), bool)
            asking[rank] = asks
            known = np.zeros(len(rows), bool)
            known[rank] = several
            # How many different surroundings the batch has of an anchor is told by one of its rows.
            rows["many"][rank[starts]] = 1
            among = rank[several]
            if len(among):
                text_of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                around = _surroundings(texts, rows[among], text_of[among], window)
                pair = np.lexsort((around, run[several]))
                r, a = run[several][pair], around[pair]
                different = np.append(True, (r[1:] != r[:-1]) | (a[1:] != a[:-1]))
                n = np.bincount(r[different], minlength=len(starts))
                rows["many"][rank[starts]] = np.clip(n, 1, 65535)
            bucket = ((rows["hash"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            # Known ones pass through a bucket by document.
            bucket[known & ~asking] = rows["tid"][known & ~asking] % buckets
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
            out = ([], [], [])
            for low, high in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
                part = order[low:high]
                out[0].append(int(bucket[part[0]]))
                out[1].append(_pack_anchors(rows[part[~known[part] | asking[part]]]))
                out[2].append(_pack_anchors(rows[part[known[part]]]))
            types = [pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["bucket", "asking", "known"])

    def answer(batch: pa.RecordBatch) -> pa.RecordBatch:
        got, told = ([[np.zeros(0, np.int64)] for _ in range(3)] for _ in range(2))
        for asking, known in zip(batch.column("asking").to_pylist(), batch.column("known").to_pylist(), strict=True):
            rows = np.concatenate([_unpack_anchors(b) for b in asking])
            rank = np.argsort(rows["hash"], kind="stable")
            rows = rows[rank]
            parts = [_unpack_anchors(b) for b in known]
            if len(rows):
                starts = np.flatnonzero(np.append(True, rows["hash"][1:] != rows["hash"][:-1]))
                low, high = np.minimum.reduceat(rows["doc"], starts), np.maximum.reduceat(rows["doc"], starts)
                parts.append(rows[np.repeat(low != high, np.diff(np.append(starts, len(rows))))])
                hot = rows["hash"][starts][np.add.reduceat(rows["many"].astype(np.int64), starts) > hot_pieces].astype(np.int64)
                for column, values in zip(told, (hot, np.zeros_like(hot), np.full_like(hot, -1)), strict=True):
                    column.append(values)
            held = np.concatenate(parts) if parts else rows
            got[0].append(held["doc"])
            got[1].append(held["tid"])
            got[2].append(_spot(held["pos"], held["left"], held["windows"]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c + t), pa.int64()) for c, t in zip(got, told, strict=True)], ["doc", "tid", "spot"])

    packed = texts.mapInArrow(gather, "bucket int, asking binary, known binary")
    lists = packed.groupBy("bucket").agg(F.collect_list("asking").alias("asking"), F.collect_list("known").alias("known"))
    return written(map_batches(lists, answer, "doc long, tid long, spot long"), "anchors")


def _spot(pos: np.ndarray, left: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return (pos.astype(np.int64) << 16) | (left.astype(np.int64) << 8) | windows.astype(np.int64)


def _splitters(texts: DataFrame, buckets: int, window: int, key: int) -> np.ndarray:
    """Keys of sampled suffixes that cut the corpus into parts of about equal size."""
    chosen = texts.select("doc", "tid").orderBy(F.xxhash64("doc", "tid"), "doc", "tid").limit(SPLITTER_DOCS)

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        anchors, out = Anchors(window, key), []
        for text in text_bytes(batch.column("text")):
            _, pos, _, _ = anchors.of(text)
            some = pos[:: max(1, len(pos) // 64)]
            out.extend(text[p : p + key] for p in some.tolist())
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["key"])

    sample = map_batches(texts.join(F.broadcast(chosen), ["doc", "tid"], "left_semi"), keys, "key binary")
    got = sorted({bytes(r["key"]) for r in sample.collect()})  # at most 128 keys for each sampled document
    cut = [got[len(got) * i // buckets] for i in range(1, buckets)] if got else []
    return np.array(sorted(set(cut)), dtype=f"S{key}")


def _covered(texts: DataFrame, spots: DataFrame, buckets: int, window: int, key: int) -> DataFrame:
    """``(doc, tid, covers)``: runs of windows, as ``_spot`` of first position and bits (see ``_unfold``), that start in an earlier document."""
    release(texts.sparkSession)  # the shuffle files of the anchors, whose plan has just gone
    # At most HOT_KEYS hashes of 8 bytes, by the choice of hot_pieces.
    hot = np.array([r["doc"] for r in spots.where("spot < 0").select("doc").collect()], np.int64).view(np.uint64)
    ranges = min(buckets, RANGES)
    finer = -(-buckets // ranges)
    buckets = ranges * finer
    shared = texts.sparkSession.sparkContext.broadcast((_splitters(texts, ranges, window, key), np.sort(hot)))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        splitters, hot = shared.value
        hasher = Anchors(window, key)
        first: dict[tuple[bytes, int], tuple[int, list[tuple[int, int]]]] = {}
        done: list[tuple[int, int, int, int]] = []
        rows = zip(*(batch.column(c).to_pylist() for c in ("doc", "tid")), text_bytes(batch.column("text")), batch.column("spots").to_pylist(), strict=True)
        for doc, tid, text, spots in sorted(rows, key=lambda r: r[:2]):
            for spot in sorted(spots):
                pos, left, windows = spot >> 16, spot >> 8 & 255, spot & 255
                start = pos - left
                piece = text[start : start + windows + window - 1]
                known = first.get((piece, left))
                if known is None:
                    first[piece, left] = (doc, [(tid, start)])
                elif known[0] < doc:
                    done.append((doc, tid, start, (1 << windows) - 1))
                else:  # the same document again
                    known[1].append((tid, start))
        out = [[] for _ in range(6)]
        heads = np.array([p[left : left + key] for p, left in first], dtype=f"S{key}")
        hashes = hasher.hashes(heads.view(np.uint8).reshape(len(heads), key))
        bucket = np.searchsorted(splitters, heads, side="right") * finer + (hashes % np.uint64(finer)).astype(np.int64) if len(heads) else heads
        spread = np.isin(hashes, hot)
        # Windows of hot anchors, with the first document of the batch that has them; pieces come by document.
        windows: dict[bytes, int] = {}
        for (piece, left), known, b, is_hot in zip(first, first.values(), bucket, spread, strict=True):
            if is_hot:
                doc, bits = known[0], 0
                for i in range(len(piece) - window + 1):
                    one = piece[i : i + window]
                    if windows.setdefault(one, doc) < doc:
                        bits |= 1 << i
                        continue
                    for tid, start in known[1]:
                        for column, value in zip(out, (crc32(one) % buckets, one, left - i, doc, tid, start + i), strict=True):
                            column.append(value)
                if bits:
                    done.extend((doc, tid, start, bits) for tid, start in known[1])
                continue
            for tid, start in known[1]:
                for column, value in zip(out, (int(b), piece, left, known[0], tid, start), strict=True):
                    column.append(value)
        for i, (doc, tid, start, bits) in enumerate(done):
            for column, value in zip(out, (i % buckets, None, bits, doc, tid, start), strict=True):
                column.append(value)
        types = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["bucket", "piece", "left", "doc", "tid", "start"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    def compare(batches):
        """Rows come sorted by bucket; one bucket is compared at a time."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = 0
            buckets_here = batch.column("bucket").to_numpy()
            for stop in [*(np.flatnonzero(np.diff(buckets_here)) + 1).tolist(), batch.num_rows]:
                part = batch.slice(at, stop - at)
                if held and held[0].column("bucket")[0].as_py() != part.column("bucket")[0].as_py():
                    yield _compare_bucket(held, window, key)
                    held = []
                if part.num_rows:
                    held.append(part)
                at = stop
        if held:
            yield _compare_bucket(held, window, key)

    joined = texts.join(spots.where("spot >= 0").groupBy("doc", "tid").agg(F.collect_set("spot").alias("spots")), ["doc", "tid"])
    pieces = joined.mapInArrow(lambda bs: map(cut, portions(bs)), "bucket int, piece binary, left long, doc long, tid long, start long")
    sorted_rows = pieces.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    covers = written(sorted_rows.mapInArrow(compare, "doc long, tid long, start long, bits long"), "covers")
    forget(spots)
    return covers.groupBy("doc", "tid").agg(F.collect_list(F.struct("start", "bits")).alias("covers"))


#: Windows of one bucket that are sorted at a time; anchors with the same key stay together.
_SORT_WINDOWS = 400_000


def _compare_bucket(parts: list[pa.RecordBatch], window: int, key: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(parts).combine_chunks()
    column = {n: table.column(n) for n in ("left", "doc", "tid", "start")}
    left, doc, tid, start = (column[n].to_numpy() for n in ("left", "doc", "tid", "start"))
    pieces = table.column("piece").to_pylist()
    real = np.array([p is not None for p in pieces])
    bits = np.where(real, 0, left)
    rows = np.flatnonzero(real)
    heads = np.array([pieces[i][left[i] : left[i] + key] for i in rows], dtype=f"S{key}")
    rank = np.argsort(heads, kind="stable")
    rows, heads = rows[rank], heads[rank]
    size = np.array([len(pieces[i]) - window + 1 for i in rows], np.int64)
    low = 0
    while low < len(rows):
        high, total = low, 0
        while high < len(rows) and (total < _SORT_WINDOWS or heads[high] == heads[high - 1]):
            total += size[high]
            high += 1
        own, n = rows[low:high], size[low:high]
        data = np.frombuffer(b"".join(pieces[i] for i in own), np.uint8)
        begin = np.cumsum(n + window - 1) - (n + window - 1)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        places = np.repeat(begin, n) + inner
        wide = np.lib.stride_tricks.sliding_window_view(data, window)[places]
        words = np.zeros((len(places), -(-window // 8) * 8), np.uint8)
        words[:, :window] = wide
        words = words.view(">u8")
        order, new = multikey_sort(words.astype(np.uint64))
        starts = np.flatnonzero(new)
        smallest = np.minimum.reduceat(np.repeat(doc[own], n)[order], starts)
        earlier = np.zeros(len(places), bool)
        earlier[order] = np.repeat(smallest, np.diff(np.append(starts, len(order)))) < np.repeat(doc[own], n)[order]
        bits[own] = np.add.reduceat(np.where(earlier, np.int64(1) << inner, 0), np.cumsum(n) - n)
        low = high
    keep = bits != 0
    return pa.RecordBatch.from_arrays([pa.array(c[keep], pa.int64()) for c in (doc, tid, start, bits)], ["doc", "tid", "start", "bits"])


def _keep(text: bytes, covers: list[dict], window: int) -> tuple[bytes, int]:
    """What is left of the text, and the number of runs that went."""
    starts = np.zeros(len(text) + 1, np.int64)
    for c in covers:
        offsets = np.flatnonzero(c["bits"] >> np.arange(window) & 1) + c["start"]
        np.add.at(starts, offsets, 1)
        np.add.at(starts, offsets + window, -1)
    gone = np.cumsum(starts[:-1]) > 0
    if not gone.any():
        return text, 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone[0]) + int((np.diff(gone.astype(np.int8)) == 1).sum())


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, key: int = KEY, bucket_bytes: int = BUCKET_BYTES, hot_pieces: int = HOT_PIECES
) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``: the bytes that remain (they need not be valid UTF-8)."""
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    doc = F.col("doc_id").cast("long")
    hashed = docs.select(doc.alias("doc"), text.alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    copies = written(
        hashed.where(F.col("doc").isNotNull() & (F.octet_length("text") >= window)).groupBy("sha").agg(
            F.min("doc").alias("first"), F.count("*").alias("n"), F.first(F.octet_length("text")).alias("bytes")
        ),
        "copies",
    )
    total = copies.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(8, -(-total // bucket_bytes))
    repeated = copies.where("n > 1").select("sha", "first")
    repeated = small_or_plain(repeated, repeated.count(), 64)
    tid = F.xxhash64("text").alias("tid")
    alone = (
        hashed.where(F.col("doc").isNotNull() & (F.octet_length("text") >= window))
        .join(repeated, "sha", "left")
        .where("first is null or first = doc")
        .select("doc", tid, "text")
    )
    # There are fewer anchors than bytes.
    spots = _shared_anchors(alone, buckets, window, key, max(hot_pieces, total // HOT_KEYS))
    covers = _covered(alone, spots, buckets, window, key)
    tagged = docs.withColumns({"__doc": doc, "__text": text}).withColumn("__tid", F.xxhash64("__text")).withColumn("__sha", F.unhex(F.sha2("__text", 256)))
    tagged = tagged.join(repeated.select(F.col("sha").alias("__sha"), F.col("first").alias("__first")), "__sha", "left")
    covers = covers.select(F.col("doc").alias("__doc"), F.col("tid").alias("__tid"), F.col("covers").alias("__covers"))
    tagged = tagged.join(covers, ["__doc", "__tid"], "left").drop("__tid", "__sha")

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [[] for _ in range(4)]
        rows = zip(*(batch.column(c).to_pylist() for c in ("__doc", "__text", "__first", "__covers")), strict=True)
        for doc, text, first, covers in rows:
            if doc is not None and first is not None and first < doc:
                kept, spans = b"", 1
            else:
                kept, spans = _keep(text, covers or [], window)
            for column, value in zip(out, (len(text), len(text) - len(kept), spans, kept), strict=True):
                column.append(value)
        names = [n for n in batch.schema.names if not n.startswith("__")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        columns = [batch.column(n) for n in names] + [pa.array(c, t) for c, t in zip(out, types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, [*names, "n_bytes", "n_removed", "n_spans", "kept"])

    schema = extended(docs, "n_bytes long, n_removed long, n_spans long, kept binary")
    return tagged.select(*docs.columns, "__doc", "__text", "__first", "__covers").mapInArrow(lambda bs: map(finish, portions(bs, column="__text")), schema)

