"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has 64 bits: bit b is set when it is set in over half of the hashes of the text's word shingles, repeats
counted. Texts are linked when their fingerprints differ in at most ``radius`` bits, and linked texts form components.

Search: every bit position gets a vector of ``radius + 1`` bits (none is zero); for each non-zero vector v one table keeps the
bits whose vector has an odd product with v. Any ``radius`` positions leave some v orthogonal to all of them, so a pair within
the radius agrees on all bits which that table keeps: no pair is lost. Equal fingerprints are one row from the start. A bucket
of up to ``BUCKET_ROWS`` fingerprints is compared in one task, which hands on a spanning forest, never all pairs; buckets are counted
first, and a larger one is cut further by the same masks over the bits that its table has left out, as often as it takes.

Defined results: null and empty texts have fingerprint zero and are linked like others; rows with a null id take no part;
repeated ids are told apart by their fingerprints and share their smallest component; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import forget, map_batches, text_bytes, written
from tablewright.llm.components import smallest_reachable

#: Fingerprints of one bucket that a task compares with each other.
BUCKET_ROWS = 20_000
#: Rows that a task makes of fingerprints by tables.
TASK_ROWS = 500_000
#: With so few bits left to differ in, a bucket holds at most 4,096 fingerprints whatever the table.
_FEW_BITS = 12
RADIUS = 4


def shingles(text: bytes, words: int) -> list[bytes]:
    """Word n-grams of the text with A-Z in lower case, joined by spaces; all words if there are fewer."""
    parts = text.lower().split()
    if len(parts) <= words:
        return [b" ".join(parts)] if parts else []
    return list(map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False)))


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """A 64-bit hash of each shingle, repeats included."""
    grams, digest = shingles(text, words), xxhash.xxh64_intdigest
    return np.fromiter((digest(g, seed) for g in grams), np.uint64, len(grams))


def hash_bits(hashes: np.ndarray) -> int:
    """The 64 majority bits of hashes as a signed number; 0 without hashes."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 15):
        part = hashes[start : start + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The 64 majority bits as a signed number; 0 for a text without words."""
    return hash_bits(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``(doc_id, fp)`` of every row with an id."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t, words) for t in text_bytes(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    return map_batches(rows, of, "doc_id long, fp long")


def covering_masks(positions: list[int], radius: int, blocks: int = 1) -> list[int]:
    """One mask over ``positions`` for each table, as signed 64-bit numbers.

    With several blocks the positions are dealt out to them, and each block has tables for its share of the radius: of the bits
    that differ, some block has no more than that.
    """
    if blocks > 1:
        return [m for b in range(blocks) for m in covering_masks(positions[b::blocks], radius // blocks)]
    # A basis comes first, so that every table keeps something even of a few positions.
    vectors = sorted(range(1, 1 << (radius + 1)), key=lambda v: (v.bit_count() > 1, v))
    vector = {p: vectors[i % len(vectors)] for i, p in enumerate(positions)}
    masks = []
    for v in vectors:
        kept = sum(1 << p for p in positions if (vector[p] & v).bit_count() % 2)
        masks.append(kept - (1 << 64) if kept >> 63 else kept)
    return masks


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what links within the radius connect: a breadth-first search, one row of distances at a time."""
    fps = np.unique(fps)
    bits = fps.view(np.uint64)  # of a signed number numpy counts the bits of its absolute value
    left = np.ones(len(fps), bool)
    edges = []
    for root in range(len(fps)):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front:
            at = front.pop()
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count(bits[rest] ^ bits[at]) <= radius]
            left[near] = False
            front.extend(near.tolist())
            edges.extend((int(fps[at]), int(fps[j])) for j in near)
    return edges


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS, blocks: int = 1) -> DataFrame:
    """``(a, b)``: links between different fingerprints that connect all pairs within the radius.

    ``fps`` has one row for each distinct fingerprint, in the column ``fp``.
    """
    links, steps = [], []
    # "done" names the tables that a bucket came through; "kept" has the bits that its members share.
    level = fps.select("fp", F.lit("").alias("done"), F.lit(0).cast("long").alias("kept"), F.lit(0).cast("long").alias("common"))
    free = {"": list(range(64))}
    small = (F.col("n") <= bucket_rows) | (F.bit_count("kept") >= 64 - _FEW_BITS)
    while True:
        rows = []
        for done, positions in free.items():
            for t, mask in enumerate(covering_masks(positions, radius, blocks)):
                rows.append((done, f"{done}{t:x}.", mask))
        masks = F.broadcast(fps.sparkSession.createDataFrame(rows, "done string, table string, mask long"))
        # Few bytes of fingerprints become very many rows, so their number of tasks follows what they become.
        tasks = max(fps.sparkSession.sparkContext.defaultParallelism, level.count() * len(rows) // len(free) // TASK_ROWS)
        keyed = (
            level.repartition(tasks)
            .join(masks, "done")
            .select("fp", "table", (F.col("kept").bitwiseOR(F.col("mask"))).alias("kept"))
            .withColumn("common", F.col("fp").bitwiseAND(F.col("kept")))
        )
        sizes = keyed.groupBy("table", "kept", "common").agg(F.count("*").alias("n"))
        large = written(sizes.where(~small).select("table", "kept", "common"), "large_buckets")
        steps.append(large)
        many = not large.isEmpty()
        rest = keyed.join(large, ["table", "kept", "common"], "left_anti") if many else keyed
        lists = rest.groupBy("table", "kept", "common").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1").select("fps")

        def forest(batch: pa.RecordBatch) -> pa.RecordBatch:
            pairs = [e for row in batch.column("fps") for e in _forest(row.values.to_numpy(), radius)]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        links.append(map_batches(lists, forest, "a long, b long"))
        if not many:
            break
        level = written(
            keyed.join(large, ["table", "kept", "common"]).select("fp", F.col("table").alias("done"), "kept", "common"), "level"
        )
        steps.append(level)
        kept = {r["table"]: r["kept"] for r in large.select("table", "kept").distinct().collect()}  # at most the tables so far
        free = {t: [p for p in range(64) if not (k >> p) & 1] for t, k in kept.items()}
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    out = written(out.distinct(), "links")
    forget(*steps)
    return out


def simhash_components(docs: DataFrame, words: int = 4, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest id that links lead to."""
    fps = written(fingerprints(docs, words), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    links = fingerprint_links(classes.select("fp"), radius, bucket_rows)
    # From here on a class goes by its smallest id.
    first = classes.select(F.col("fp").alias("a"), F.col("first").alias("x"))
    ends = links.join(first, "a").join(first.toDF("b", "y"), "b").select("x", "y")
    # A repeated id joins all classes it occurs in.
    shared = fps.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("doc_id")
    same = fps.join(shared, "doc_id").join(classes, "fp").select(F.col("doc_id").alias("x"), F.col("first").alias("y"))
    roots = smallest_reachable(ends.unionByName(same.where("x <> y")), "x", "y")
    placed = classes.join(roots, classes["first"] == roots["node"], "left").select(
        "fp", F.least("first", F.coalesce("root", "first")).alias("component_id")
    )
    return fps.join(placed, "fp").select("doc_id", "fp", "component_id")
