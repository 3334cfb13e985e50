"""Near copies by SimHash, MinHash bands and exact similarity: which document of a group stays.

Two texts are near copies if the Jaccard similarity of their word shingles is at least ``PERCENT`` of 100. Texts with the same set of shingles are one class from the start.
Classes whose SimHash fingerprints differ in at most ``RADIUS`` bits are found with covering masks (see ``simhash``). At a
similarity of 0.8 fingerprints differ in about 10 of 64 bits, so classes that meet in a MinHash band are candidates as well (see
``minhash``, with the chance to miss a pair). What candidates tie together is a group, and links are confirmed on full sets inside groups. Confirmed links form components. Inside a component,
documents are taken by id: one that is similar to a document kept before it goes, any other is kept. So every document that goes has a kept near copy with a smaller id, and no two
kept documents are near copies.

Components of up to ``GROUP_ROWS`` classes and ``GROUP_BYTES`` of sets are decided in one task each. In a larger one, some documents at a time are decided among
themselves, then all others are compared with those that were kept, in as many tasks as they fill.

Defined results: null and empty texts have no words and are copies of each other; texts shorter than a shingle are one shingle; rows with a null id are left
out (``without_near_copies`` keeps them); every row of a repeated id is decided by its own text, and of equal rows one stays; an empty table gives no rows; other columns are
never read, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import forget, map_batches, text_bytes, written
from tablewright.llm.components import smallest_reachable
from tablewright.llm.minhash import BUCKET, band_keys, band_ties, full_sets, group_links, grouped, linked, signatures
from tablewright.llm.minhash import BLOCK_BYTES as STRAY_BYTES
from tablewright.llm.minhash import CHUNK_BYTES
from tablewright.llm.simhash import RADIUS, fingerprint_links, hash_bits, shingle_hashes

WORDS = 5
PERCENT = 80
#: Classes of a component that one task decides, and bytes of their sets.
GROUP_ROWS, GROUP_BYTES = 512, 8_000_000
#: Bytes of text that are hashed at a time.
PORTION = 1_000_000


def _prints(rows: DataFrame, words: int) -> DataFrame:
    """``(doc_id, h, same, fp, keys, sig)`` of each row; ``same`` is the digest of its set."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, sets = [], []
        for text in text_bytes(batch.column("text")):
            hashes = shingle_hashes(text, words)
            fps.append(hash_bits(hashes))
            sets.append(np.unique(hashes))
        minima = signatures([s for s in sets if len(s)])
        keys, sigs = iter(band_keys(minima)), iter(minima.astype(np.uint8))
        columns = [
            batch.column("doc_id"),
            batch.column("h"),
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
            pa.array(fps, pa.int64()),
            pa.array([next(keys).tobytes() if len(s) else b"" for s in sets], pa.binary()),
            pa.array([next(sigs).tobytes() if len(s) else b"" for s in sets], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "same", "fp", "keys", "sig"])

    return map_batches(rows, of, "doc_id long, h long, same binary, fp long, keys binary, sig binary", PORTION)


def _fingerprint_ties(classes: DataFrame, radius: int) -> DataFrame:
    """``(a, b)``: ties between classes with fingerprints within the radius."""
    heads = written(classes.groupBy("fp").agg(F.min("c").alias("head")), "heads")
    links = fingerprint_links(heads.select("fp"), radius)
    one, other = (heads.select(F.col("fp").alias(x), F.col("head").alias(f"head_{x}")) for x in "ab")
    across = links.join(one, "a").join(other, "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    equal = classes.join(heads, "fp").where("c <> head").select(F.col("c").alias("a"), F.col("head").alias("b"))
    return across.unionByName(equal)


def near_copies(
    docs: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
    radius: int = RADIUS,
    group_rows: int = GROUP_ROWS,
    group_bytes: int = GROUP_BYTES,
    bucket: int = BUCKET,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``(doc_id, text_hash, kept_id, stays)`` of every row with an id: the document that stays for it, and whether that is itself."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).where("doc_id is not null")
    prints = written(_prints(rows, words), "prints")
    facts = [F.any_value(x).alias(x) for x in ("fp", "keys", "sig")]
    classes = prints.groupBy("same").agg(F.min(F.struct("doc_id", "h")).alias("head"), *facts)
    classes = classes.select("same", F.col("head.doc_id").alias("first"), F.col("head.h").alias("first_h"), "fp", "keys", "sig")
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    held = classes.where("octet_length(keys) > 0")
    ties, weights = band_ties(held, bucket)
    groups = grouped(ties.unionByName(_fingerprint_ties(held, radius)), weights)
    links = group_links(rows.select("doc_id", "text"), held, groups, words, percent, chunk_bytes, STRAY_BYTES)
    comps = smallest_reachable(links, "a", "b").select(F.col("node").alias("c"), F.col("root").alias("comp"))
    members = written(classes.select("c", "first", "same").join(comps, "c"), "members")
    decided = _decided(rows.select("doc_id", "text"), members, words, percent, group_rows, group_bytes)
    placed = classes.select("same", "first", "first_h", "c").join(decided, "c", "left")
    own = F.coalesce("keeper", "c") == F.col("c")
    placed = placed.select("same", "first", "first_h", own.alias("kept"), F.coalesce("kept_id", "first").alias("kept_id"))
    stays = F.col("kept") & (F.col("doc_id") == F.col("first")) & (F.col("h") == F.col("first_h"))
    out = prints.select("doc_id", "h", "same").join(placed, "same").select("doc_id", F.col("h").alias("text_hash"), "kept_id", stays.alias("stays"))
    forget(ties, weights, groups)
    return out


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay; those without an id cannot be compared and stay."""
    decided = written(near_copies(docs), "near_copies")
    hashed = docs.withColumn("__h", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    gone = decided.where("not stays").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__gone")).distinct()
    same_id = F.col("doc_id").cast("long") == F.col("__id")
    left = hashed.join(gone, same_id & (F.col("__h") == F.col("__gone")), "left_anti")
    twice = decided.where("stays").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    twice = written(twice.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__gone")), "equal_rows")
    if twice.isEmpty():
        return left.select(*docs.columns)
    met = same_id & (F.col("__h") == F.col("__gone"))
    equal = left.join(twice, met).groupBy("__id", "__gone").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return left.join(twice, met, "left_anti").select(*docs.columns).unionByName(equal.select(*docs.columns))


def _decide(rows: list[dict], percent: int) -> list[dict]:
    """For each class, in order of its first id, the kept one it goes for (itself if it is kept)."""
    kept, out = [], []
    for r in sorted(rows, key=lambda r: (r["first"], r["c"])):
        own = np.frombuffer(r["grams"], np.uint64)
        keeper = next((k for k, other in kept if linked(own, other, percent)), None)
        if keeper is None:
            keeper = r
            kept.append((r, own))
        out.append({**r, "keeper": keeper["c"], "kept_id": keeper["first"]})
    return out


_DECIDED = pa.schema([("comp", pa.int64()), ("c", pa.int64()), ("first", pa.int64()), ("keeper", pa.int64()), ("kept_id", pa.int64()), ("grams", pa.binary())])


def _decided(rows: DataFrame, members: DataFrame, words: int, percent: int, group_rows: int, group_bytes: int) -> DataFrame:
    """``(c, keeper, kept_id)`` of the members ``(c, first, same, comp)`` of components."""
    kind = "comp long, c long, first long, keeper long, kept_id long, grams binary"
    sets = full_sets(rows, members, words)
    open_rows = written(members.select("comp", "c", "first").join(sets, "c").select("comp", "c", "first", "grams"), "open")

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for comp, group in zip(batch.column("comp").to_pylist(), batch.column("rows"), strict=True):
            out += [{"comp": comp, **r} for r in _decide(group.as_py(), percent)]
        return pa.RecordBatch.from_pylist(out, _DECIDED)

    def follow(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Blocks of members against the classes of their component that were kept in this round; null where none is similar."""
        out = []
        for comp, group, leaders in zip(batch.column("comp").to_pylist(), batch.column("rows"), batch.column("leaders"), strict=True):
            kept = [(r, np.frombuffer(r["grams"], np.uint64)) for r in sorted(leaders.as_py(), key=lambda r: (r["first"], r["c"]))]
            for r in group.as_py():
                own = np.frombuffer(r["grams"], np.uint64)
                keeper = next((k for k, other in kept if linked(own, other, percent)), {"c": None, "first": None})
                out.append({"comp": comp, **r, "keeper": keeper["c"], "kept_id": keeper["first"]})
        return pa.RecordBatch.from_pylist(out, _DECIDED)

    collected = F.collect_list(F.struct("c", "first", "grams"))
    done, steps = [], [open_rows]
    while True:
        sizes = open_rows.groupBy("comp").agg(F.count("*").alias("n"), F.sum(F.octet_length("grams")).alias("size"))
        # As many parts as keep both the rows and the bytes of one within their bounds.
        parts = F.greatest(F.ceil(F.col("n") / group_rows), F.ceil(F.col("size") / group_bytes))
        large = written(sizes.withColumn("parts", parts).where("parts > 1"), "large")
        steps.append(large)
        small = open_rows.join(large.select("comp"), "comp", "left_anti").groupBy("comp").agg(collected.alias("rows"))
        done.append(map_batches(small, settle, kind, group_bytes, "rows").select("c", "keeper", "kept_id"))
        if large.isEmpty():
            break
        rest = open_rows.join(large, "comp")
        # Some small ids of each large component, as many as one task decides.
        salts = F.greatest(F.lit(1), F.floor(F.col("n") / F.col("parts")))
        smallest = rest.groupBy("comp", F.pmod(F.xxhash64("c"), salts).alias("salt")).agg(F.min(F.struct("first", "c")).alias("head"))
        heads = rest.join(smallest.select("comp", F.col("head.c").alias("c")), ["comp", "c"])
        batch = written(map_batches(heads.groupBy("comp").agg(collected.alias("rows")), settle, kind, group_bytes, "rows"), "leaders")
        done.append(batch.select("c", "keeper", "kept_id"))
        leaders = batch.where("c = keeper").groupBy("comp").agg(collected.alias("leaders"))
        others = rest.join(batch.select("comp", "c"), ["comp", "c"], "left_anti")
        # In blocks, so that the kept ones travel with a block and not with every member.
        blocks = others.groupBy("comp", F.pmod(F.xxhash64("c"), F.col("parts")).alias("block")).agg(collected.alias("rows"))
        met = blocks.join(leaders, "comp").select("comp", "rows", "leaders")
        followed = written(map_batches(met, follow, kind, group_bytes, "rows"), "followed")
        steps += [batch, followed]
        done.append(followed.where("keeper is not null").select("c", "keeper", "kept_id"))
        open_rows = followed.where("keeper is null").select("comp", "c", "first", "grams")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = written(out, "decided")
    forget(*steps)
    return out
