"""Best-fit packing of token sequences.

Best-fit decreasing looks at lengths only, so it runs over the count of pieces of each length: a table of as many rows as a
sequence has tokens, whatever the size of the corpus. A segment tree over remaining capacities finds the tightest open
sequences that still take a length in logarithmic time; all pieces of that length that go to sequences of that capacity are placed
together, exactly as one after the other would be. The plan is a list of runs (length, first piece, first sequence, offset);
each piece then looks up its own place by its number among the pieces of its length.

Defined results: null and empty texts are the closing id alone; rows with a null id are packed like others; repeated rows are
packed each; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import extended, small_or_plain, written
from tablewright.llm.tokens import Encoder, default_vocabulary

LENGTH = 2048
#: Characters that a task encodes at a time.
ENCODE_CHARS = 2_000_000

_PIECES = "doc_id long, piece int, start long, length long, ids binary, block int, rank long"


def token_pieces(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """Documents as pieces of at most ``length`` ids, each document closed by ``end_id``; only the first piece may be shorter.

    ``block`` is the task that made the piece and ``rank`` its number among the task's pieces of its length.
    """
    vocabulary = vocabulary or default_vocabulary()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encoder = Encoder.shared(vocabulary)
        block = TaskContext.get().partitionId()
        counts = np.zeros(length + 1, np.int64)
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for low, high in _portions(texts):
                encoded = encoder.encode([t or "" for t in texts[low:high]])
                rows = []
                for doc_id, ids in zip(doc_ids[low:high], encoded, strict=True):
                    ids += end
                    total = len(ids) // 4
                    at, piece = 0, 0
                    while at < total:
                        size = (total % length or length) if piece == 0 else length
                        rows.append((doc_id, piece, at, size, ids[4 * at : 4 * (at + size)], block, int(counts[size])))
                        counts[size] += 1
                        at, piece = at + size, piece + 1
                columns = zip(*rows, strict=True)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _names(_PIECES))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _PIECES)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _portions(texts: list):
    """Ranges of texts of about ``ENCODE_CHARS`` characters together."""
    low, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= ENCODE_CHARS:
            yield low, i + 1
            low, size = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


class CapacityTree:
    """Segment tree over capacities 0..size; a node tells how many open sequences lie under it."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += n
            at //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that an open sequence has."""
        at = least + self.leaves
        if not self.count[at]:
            # Up until a right neighbour has some, then down to its leftmost.
            while at > 1 and (at % 2 or not self.count[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_runs(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing as runs ``(length, first piece, first sequence, offset, pieces for each sequence)``."""
    tree = CapacityTree(length)
    open_runs: dict[int, list[tuple[int, int]]] = {}  # capacity: runs (first sequence, sequences)
    plan, sequences = [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            open_runs.setdefault(capacity, []).append((first, n))
            tree.add(capacity, n)

    for size in sorted((s for s, c in counts.items() if c), reverse=True):
        placed, wanted = 0, counts[size]
        while placed < wanted:
            capacity = tree.tightest(size)
            if capacity is None:
                capacity = length
                n = -(-(wanted - placed) // (capacity // size))
                first, sequences = sequences, sequences + n
            else:
                first, n = open_runs[capacity].pop()
                tree.add(capacity, -n)
            # A sequence takes pieces of one length until they no longer fit: what is left in it is the tightest place.
            each = capacity // size
            full = min(n, (wanted - placed) // each)
            if full:
                plan.append((size, placed, first, length - capacity, each))
                placed += full * each
                put(capacity - each * size, first, full)
            if full < n:
                rest = wanted - placed
                if rest:
                    plan.append((size, placed, first + full, length - capacity, rest))
                    put(capacity - rest * size, first + full, 1)
                    placed, full = wanted, full + 1
                put(capacity, first + full, n - full)
    return plan


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces`` (as ``token_pieces`` made them, written before) with ``sequence_id`` and ``offset``."""
    blocks = pieces.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = written(blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "blocks")
    totals = blocks.groupBy("length").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).collect()  # at most `length` rows
    plan = best_fit_runs({r["length"]: r["n"] for r in totals}, length)
    # Runs of one length follow each other in the order of their first piece.
    plan.sort(key=lambda run: (run[0], run[1]))
    starts = {}
    for i, run in enumerate(plan):
        starts.setdefault(run[0], ([], i))[0].append(run[1])
    shared = pieces.sparkSession.sparkContext.broadcast((starts, plan))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        starts, plan = shared.value
        sequence, offset = [], []
        sizes, ranks = batch.column("length").to_pylist(), batch.column("number").to_pylist()
        for size, number in zip(sizes, ranks, strict=True):
            firsts, at = starts[size]
            _, first_piece, first_sequence, base, each = plan[at + bisect_right(firsts, number) - 1]
            sequence.append(first_sequence + (number - first_piece) // each)
            offset.append(base + (number - first_piece) % each * size)
        columns = [*batch.columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "sequence_id", "offset"])

    rows = sum(r["blocks"] for r in totals)
    numbered = pieces.join(small_or_plain(blocks.select("length", "block", "before"), rows), ["length", "block"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids", (F.col("before") + F.col("rank")).alias("number"))
    return numbered.mapInArrow(lambda bs: map(place, bs), extended(numbered, "sequence_id long, offset long")).drop("number")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """``(doc_id, piece, start, length, ids, sequence_id, offset)``: every piece of every document and its place."""
    return pack(written(token_pieces(docs, vocabulary, length, end_id), "pieces"), length)
