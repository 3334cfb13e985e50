"""MinHash near-duplicates: universal hash minima, banding, verification of signatures, confirmation on full sets, components.

A document's set holds its distinct word shingles, as 64-bit hashes. Documents with equal sets are one class from the start. A class has
``BANDS * ROWS`` minima of multiply-add-shift hashes, which are universal on 32-bit keys; classes that agree in all rows of a band are candidates.
A pair with a similarity of 0.8 fails to meet in any band with a chance of ``(1 - 0.8**4)**48``, about 1 in 10**11, and equally
seldom to agree in ``AGREE`` of its minima, of which a signature keeps the last 8 bits.

A bucket of up to ``BUCKET`` classes gives its pairs, and those whose signatures agree count; in a larger one all members are tied to the smallest. What is
tied together, by alternating large stars and small stars, is a group. Links are confirmed on full sets inside groups, so a set is moved once and
not for every pair. First the members that share most are compared with all others. Whoever is not in the largest component then is compared with
all members of other components. So of any two members in different components one was compared with the other, and no link is lost; only
links that tie components together are handed on, never all pairs of a group. A group that is larger than a task takes is dealt to chunks, and the members outside its largest
component to blocks; every block meets every chunk. Components of these links are the result.

Groups cost the product of their size and of the members outside the largest component: little for copies of one text, however many, and more
where very many texts share half of their words without being copies.

Defined results: texts without words, empty and null texts have an empty set and are linked with nothing; fewer words than a shingle are
one shingle; rows with a null id are left out; a repeated id joins all classes it occurs in, each row keeping its own ``n_shingles``; an empty
table gives no rows; other columns are left out, whatever they are called.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import forget, map_batches, small_or_plain, text_bytes, written
from tablewright.llm.components import smallest_reachable
from tablewright.llm.simhash import shingle_hashes

WORDS = 2
#: Links have 100 times the intersection at least this times the union.
PERCENT = 80
BANDS, ROWS = 48, 4
#: Minima of 192 that a pair has to have in common; at a similarity of 0.8 about 154 +- 6 are.
AGREE = 110
#: Classes of one bucket that are paired with each other.
BUCKET = 16
#: Members of a group that are compared with all others first.
CENTERS = 4
#: Bytes of sets and signatures in a chunk of a group, and in a block of members outside its largest component.
CHUNK_BYTES, BLOCK_BYTES = 8_000_000, 1_000_000
#: Bytes of text that are hashed at a time.
PORTION = 1_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _coefficients(count: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(seed).integers(0, 1 << 64, (2, count), np.uint64)
    return drawn[0] | np.uint64(1), drawn[1]


def signatures(sets: list[np.ndarray], count: int = BANDS * ROWS) -> np.ndarray:
    """The minima of each non-empty set, one row for each."""
    if not sets:
        return np.zeros((0, count), np.uint32)
    factors, shifts = _coefficients(count)
    keys = np.concatenate(sets) & np.uint64(0xFFFFFFFF)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((count, len(sets)), np.uint32)
    for k in range(count):
        out[k] = np.minimum.reduceat(keys * factors[k] + shifts[k], starts) >> np.uint64(32)
    return np.ascontiguousarray(out.T)


def band_keys(sigs: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One signed 64-bit key for each band (columns) of each signature (rows)."""
    parts = sigs.reshape(len(sigs), bands, -1).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(parts.shape[2]):
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 times their intersection at least ``percent`` times their union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _prints(rows: DataFrame, words: int) -> DataFrame:
    """``(doc_id, n, same, keys, sig)``: size, digest, band keys and signature of each row's set."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(t, words)) for t in text_bytes(batch.column("text"))]
        minima = signatures([s for s in sets if len(s)])
        keys, sigs = iter(band_keys(minima)), iter(minima.astype(np.uint8))
        columns = [
            batch.column("doc_id"),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
            pa.array([next(keys).tobytes() if len(s) else b"" for s in sets], pa.binary()),
            pa.array([next(sigs).tobytes() if len(s) else b"" for s in sets], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "same", "keys", "sig"])

    return map_batches(rows, of, "doc_id long, n long, same binary, keys binary, sig binary", PORTION)


def _banded(classes: DataFrame) -> DataFrame:
    """``(key, c)``: a row for each band of each class."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64).reshape(batch.num_rows, -1)
        numbers = np.repeat(batch.column("c").to_numpy(), keys.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel(), pa.int64()), pa.array(numbers, pa.int64())], ["key", "c"])

    return map_batches(classes.select("c", "keys"), of, "key long, c long")


def full_sets(rows: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """``(c, grams)``: the sorted set of each member class, cut from the text of its first document."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        numbers, grams = [], []
        columns = (batch.column(x).to_pylist() for x in ("c", "same"))
        for text, c, same in zip(text_bytes(batch.column("text")), *columns, strict=True):
            own = np.unique(shingle_hashes(text, words)).tobytes()
            if xxhash.xxh3_128_digest(own) == same:  # a repeated id has other texts, too
                numbers.append(c)
                grams.append(own)
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(grams, pa.binary())], ["c", "grams"])

    wanted = members.select(F.col("first").alias("doc_id"), "same", "c")
    texts = rows.join(small_or_plain(wanted, members.count(), 48), "doc_id").select("c", "same", "text")
    return map_batches(texts, of, "c long, grams binary", PORTION).dropDuplicates(["c"])


def _bucket_pairs(small: DataFrame) -> DataFrame:
    """``(a, b)``: the pairs of small buckets."""
    lists = small.groupBy("key").agg(F.collect_set("c").alias("cs")).select("cs")

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = {p for cs in batch.column("cs").to_pylist() for p in combinations(sorted(cs), 2)}
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return map_batches(lists, of, "a long, b long").distinct()


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose signatures agree in ``AGREE`` minima or more."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        one, other = (np.frombuffer(b"".join(batch.column(s).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for s in ("of_a", "of_b"))
        return batch.select(["a", "b"]).filter(pa.array(np.count_nonzero(one == other, axis=1) >= AGREE))

    sides = (classes.select(F.col("c").alias(x), F.col("sig").alias(f"of_{x}")) for x in "ab")
    joined = pairs.join(next(sides), "a").join(next(sides), "b")
    return map_batches(joined.select("a", "b", "of_a", "of_b"), of, "a long, b long")


class Members:
    """Classes of a group in a task: numbers, signatures, sets, and the components they are in so far."""

    def __init__(self, rows: list[dict]):
        self.c = np.array([r["c"] for r in rows], np.int64)
        self.sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint8).reshape(len(rows), -1)
        self.grams = [np.frombuffer(r["grams"], np.uint64) for r in rows]
        self.comp = self.c.copy()

    def ask(self, c: int, comp: int, sig: np.ndarray, grams: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """Links of a class with members of other components, one for each component; members take over the component."""
        links = []
        apart = np.flatnonzero(self.comp != comp)
        agree = np.count_nonzero(self.sig[apart] == sig, axis=1)
        for k in np.argsort(-agree, kind="stable"):
            if agree[k] < AGREE:
                break
            i = apart[k]
            if self.comp[i] != comp and linked(grams, self.grams[i], percent):
                links.append((c, int(self.c[i])))
                self.comp[self.comp == self.comp[i]] = comp
        return links


def _within(rows: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links that connect a whole group."""
    members, links = Members(sorted(rows, key=lambda r: (-r["weight"], r["c"]))), []

    def ask(i: int) -> None:
        links.extend(members.ask(int(members.c[i]), int(members.comp[i]), members.sig[i], members.grams[i], percent))

    for i in range(min(CENTERS, len(rows))):
        ask(i)
    labels, sizes = np.unique(members.comp, return_counts=True)
    for i in np.flatnonzero(members.comp != labels[sizes.argmax()]):
        ask(int(i))
    return links


def _across(rows: list[dict], strays: list[dict], block: list[dict], main: int, percent: int) -> list[tuple[int, int]]:
    """Links of a block of members outside the largest component with a chunk of the group."""
    members, links = Members(rows), []
    place = {s["c"]: s["comp"] for s in strays}
    members.comp = np.array([place.get(c, main) for c in members.c.tolist()], np.int64)
    others = Members(block)
    others.comp = np.array([s["comp"] for s in block], np.int64)
    for i, c in enumerate(others.c.tolist()):
        comp = int(others.comp[i])
        found = members.ask(c, comp, others.sig[i], others.grams[i], percent)
        links.extend(found)
    return links


def _pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def group_links(rows: DataFrame, classes: DataFrame, groups: DataFrame, words: int, percent: int, chunk_bytes: int, block_bytes: int) -> DataFrame:
    """``(a, b)``: links that connect what the links between members of each group ``(c, g, weight)`` connect.

    The order of the members by weight, the keys they share, decides only how fast a group falls into components.
    """
    nodes = written(classes.select("c", "first", "same", "sig").join(groups, "c"), "nodes")
    facts = nodes.select("c", "g", "weight", "sig").join(full_sets(rows, nodes, words), "c")
    facts = written(facts.withColumn("size", F.octet_length("grams") + 200), "facts")
    sizes = facts.groupBy("g").agg(F.ceil(F.sum("size") / chunk_bytes).alias("chunks"))
    large = written(sizes.where("chunks > 1"), "large_groups")
    n_large = large.count()
    row = F.struct("c", "weight", "sig", "grams")
    small = facts.join(small_or_plain(large.select("g"), n_large, 8), "g", "left_anti")

    def within(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _pairs_batch([p for group in batch.column("rows") for p in _within(group.as_py(), percent)])

    links = map_batches(small.groupBy("g").agg(F.collect_list(row).alias("rows")).select("rows"), within, "a long, b long", chunk_bytes, "rows")
    links = written(links, "links")
    forget(nodes)
    if not n_large:
        forget(facts, large)
        return links
    # Large groups: chunks of members against the centers first.
    dealt = facts.join(small_or_plain(large, n_large, 16), "g").withColumn("chunk", F.pmod(F.xxhash64("c"), F.col("chunks")))
    chunks = written(dealt.groupBy("g", "chunk").agg(F.collect_list(row).alias("rows")), "chunks")
    order = Window.partitionBy("g").orderBy(F.desc("weight"), "c")
    centers = dealt.withColumn("r", F.row_number().over(order)).where(F.col("r") <= CENTERS).groupBy("g").agg(F.collect_list(row).alias("block"))

    def center_links(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for group, heads in zip(batch.column("rows"), batch.column("block"), strict=True):
            members = Members(group.as_py())
            for h in heads.as_py():
                members.comp = members.c.copy()  # each center is compared with all
                found += members.ask(h["c"], h["c"], np.frombuffer(h["sig"], np.uint8), np.frombuffer(h["grams"], np.uint64), percent)
        return _pairs_batch(found)

    met = chunks.join(centers, "g").select("rows", "block")
    first = written(map_batches(met, center_links, "a long, b long", chunk_bytes, "rows"), "center_links")
    roots = smallest_reachable(first, "a", "b")
    placed = dealt.select("g", "c", "chunk", "size", "sig", "grams").join(roots, F.col("c") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "c"))
    counts = placed.groupBy("g", "comp").agg(F.count("*").alias("n"))
    main = written(counts.groupBy("g").agg(F.max(F.struct("n", "comp")).alias("top")).select("g", F.col("top.comp").alias("main")), "main")
    outside = placed.join(small_or_plain(main, n_large, 16), "g").where("comp <> main")
    outside = written(outside.select("g", "main", "c", "comp", "chunk", "size", "sig", "grams"), "outside")
    # Blocks of members outside the largest component meet all chunks of their group.
    blocks = outside.groupBy("g").agg(F.ceil(F.sum("size") / block_bytes).alias("blocks"))
    strays = outside.groupBy("g", "chunk").agg(F.collect_list(F.struct("c", "comp")).alias("strays"))
    block = outside.join(blocks, "g").withColumn("part", F.pmod(F.xxhash64("c", F.lit(1)), F.col("blocks")))
    block = block.groupBy("g", "main", "part").agg(F.collect_list(F.struct("c", "comp", "sig", "grams")).alias("block"))
    block = block.join(large, "g").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))

    def across(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = (batch.column(x) for x in ("rows", "strays", "block", "main"))
        return _pairs_batch([p for r, s, b, m in zip(*columns, strict=True) for p in _across(r.as_py(), s.as_py() or [], b.as_py(), m.as_py(), percent)])

    grid = chunks.join(strays, ["g", "chunk"], "left").join(block.select("g", "chunk", "main", "block"), ["g", "chunk"])
    second = map_batches(grid.select("rows", "strays", "block", "main"), across, "a long, b long", chunk_bytes, "rows")
    out = written(links.unionByName(first).unionByName(second), "group_links")
    forget(facts, large, chunks, main, outside, first, links)
    return out


def band_ties(classes: DataFrame, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """``(a, b)``: candidates that tie together all classes ``(c, keys, sig)`` that meet in a band and whose signatures agree; and ``(c, weight)``."""
    # How many share a key is counted before the shuffle, so a key that very many share is a row for each task.
    counted = _banded(classes).groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("least")).where("n > 1")
    counted = written(counted, "shared_keys")
    shared = written(_banded(classes).join(small_or_plain(counted, counted.count(), 32), "key"), "shared")
    large = shared.where(F.col("n") > bucket)
    ties = large.select(F.col("c").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
    ties = written(ties.unionByName(_agreeing(_bucket_pairs(shared.where(F.col("n") <= bucket)), classes)), "band_ties")
    weights = written(shared.groupBy("c").agg(F.sum("n").alias("weight")), "weights")
    forget(counted, shared)
    return ties, weights


def grouped(ties: DataFrame, weights: DataFrame) -> DataFrame:
    """``(c, g, weight)``: the groups that ties make."""
    groups = smallest_reachable(ties, "a", "b").select(F.col("node").alias("c"), F.col("root").alias("g"))
    return written(groups.join(weights, "c", "left").fillna(0, "weight"), "groups")


def minhash_components(
    docs: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
    bucket: int = BUCKET,
    chunk_bytes: int = CHUNK_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``: the smallest id that links lead to, and whether it is the document's own."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    prints = written(_prints(rows, words), "prints")
    one = [F.any_value(x).alias(x) for x in ("keys", "sig")]
    classes = prints.where("n > 0").groupBy("same").agg(F.min("doc_id").alias("first"), *one)
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    ties, weights = band_ties(classes, bucket)
    groups = grouped(ties, weights)
    links = group_links(rows, classes, groups, words, percent, chunk_bytes, block_bytes).unionByName(_repeated(prints, classes))
    roots = smallest_reachable(links, "a", "b")
    placed = classes.select("same", "first", "c").join(roots, F.col("c") == F.col("node"), "left")
    placed = placed.select("same", "first", F.coalesce("root", "c").alias("comp"))
    least = placed.groupBy("comp").agg(F.min("first").alias("component_id"))
    placed = written(placed.join(least, "comp").select("same", "component_id"), "placed")
    out = prints.join(placed, "same", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    forget(ties, weights, groups)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _repeated(prints: DataFrame, classes: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between the classes that one id occurs in."""
    several = prints.where("n > 0").groupBy("doc_id").agg(F.min("same").alias("lo"), F.max("same").alias("hi")).where("lo < hi").select("doc_id")
    held = prints.join(several, "doc_id").join(classes.select("same", "c"), "same").select("doc_id", "c")
    least = held.groupBy("doc_id").agg(F.min("c").alias("b"))
    return held.join(least, "doc_id").where("c <> b").select(F.col("c").alias("a"), "b")
