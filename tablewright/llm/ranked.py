"""Ranked lexical search with bag deduplication: documents that look alike to all items are scored once.

Terms are runs of ASCII letters, digits and characters beyond ASCII, with A-Z in lower case. A document is restricted to the items' vocabulary; what is
left of it, its bag, is a vector of term frequencies. Its score depends on the bag and on the length norm ``m`` alone, so documents are grouped by a hash
of bag and ``m``, with equality of both verified by the grouping itself. Tasks score classes against all items as matrix products of whole numbers and
hand on their best ``k`` classes for each item; a class stands for its smallest doc_id there. The best classes are then expanded to their
members by ascending doc_id. A class of very many members is a list of its ``k`` smallest ids before anything is shuffled.

Score of a document for an item: the sum over the item's terms, once each, of ``w * ((1000000000*tf) div (1000*tf + 20*m))`` with
``w = floor(1000*ln((2N+2)/(2df+1)))`` and ``m = 50 + (50*n*N) div L``.

The items' terms travel to every task, so items are dealt by hash to portions of about ``ITEM_BYTES`` of text;
each portion reads the documents again. N and L are the same for all.

Defined results: null and empty texts have no terms; rows with a null doc_id count in N, L and df but are not ranked; rows that share a doc_id are ranked one
by one; items with a null id are left out and rows that share an item_id are one item; empty tables give no rows; other columns are left out,
whatever they are called.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import BLOCK_BYTES, forget, map_batches, small_or_plain, text_bytes, written

K = 50
ITEM_BYTES = 4_000_000
#: An item counts for so many bytes beside its text.
_ITEM_WIDTH = 200
#: Bytes of text that a task turns into bags at a time.
PORTION = 8_000_000
#: Cells of a block's table of items by terms, and classes that meet it in one product.
_CELLS, _CLASSES = 2_000_000, 512
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms in order, a block of text at a time."""
    at = 0
    while at < len(text):
        stop = min(len(text), at + BLOCK_BYTES)
        if stop < len(text) and (last := _TERM.match(text, stop)):
            stop = last.end()  # the term that goes on across the border stays whole
        yield _TERM.findall(text[at:stop].lower())
        at = stop


def bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``(doc_id, n, bag)``: the number of terms, and term numbers and frequencies of those in the vocabulary as 32-bit numbers."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, out = [], []
        for text in text_bytes(batch.column("text")):
            n, held = 0, Counter()
            for block in terms(text):
                n += len(block)
                held.update(map(vocabulary.get, block))
            held.pop(None, None)
            sizes.append(n)
            out.append(np.array(sorted(held.items()), np.int32).reshape(-1, 2).T.tobytes())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n", "bag"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(rows, of, "doc_id long, n long, bag binary", PORTION)


def _opened(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and frequency of all entries of a batch of bags."""
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 4
    sizes = np.diff(edges)
    values = np.frombuffer(column.buffers()[2] or b"", np.int32, edges[-1] - edges[0], 4 * int(edges[0]))
    inside = np.arange(len(values)) - np.repeat(edges[:-1] - edges[0], sizes)
    first_half = inside < np.repeat(sizes // 2, sizes)
    return np.repeat(np.arange(len(column)), sizes // 2), values[first_half], values[~first_half]


def document_frequencies(held: DataFrame, size: int) -> np.ndarray:
    """For each term of the vocabulary the documents that hold it; tasks add up their own first."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_opened(batch.column("bag"))[1], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["term", "df"])

    out = np.zeros(size, np.int64)
    for row in held.select("bag").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row["term"]] = row["df"]
    return out


class ItemBlock:
    """Some items over their own terms."""

    def __init__(self, items: list[tuple[int, np.ndarray]], weights: np.ndarray):
        self.items = np.array([i for i, _ in items], np.int64)
        self.terms = np.unique(np.concatenate([t for _, t in items]))
        self.weights = weights[self.terms]
        self.member = np.zeros((len(self.terms), len(items)))
        for k, (_, own) in enumerate(items):
            self.member[np.searchsorted(self.terms, own), k] = 1.0
        #: Up to 2**53 doubles hold whole sums exactly; every summand is below a million times its weight.
        self.exact = 1e6 * float(self.weights.sum()) < 2**53

    def scores(self, n_rows: int, row: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Whole scores of rows by items."""
        at = np.searchsorted(self.terms, term)
        at[at == len(self.terms)] = 0
        mine = self.terms[at] == term
        row, at, tf = row[mine], at[mine], tf[mine].astype(np.int64)
        parts = self.weights[at] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
        if self.exact:
            return self._product(n_rows, row, at, parts).astype(np.int64)
        high, low = self._product(n_rows, row, at, parts >> 24), self._product(n_rows, row, at, parts & 0xFFFFFF)
        return (high.astype(np.int64) << 24) + low.astype(np.int64)

    def _product(self, n_rows: int, row: np.ndarray, at: np.ndarray, parts: np.ndarray) -> np.ndarray:
        dense = np.zeros((n_rows, len(self.terms)))
        dense[row, at] = parts
        return dense @ self.member


def item_blocks(items: list[tuple[int, np.ndarray]], weights: np.ndarray) -> list[ItemBlock]:
    """Items in blocks whose tables have a bounded number of cells."""
    out, block, width = [], [], 0
    for item in items:
        if block and (width + len(item[1])) * (len(block) + 1) > _CELLS:
            out.append(ItemBlock(block, weights))
            block, width = [], 0
        block.append(item)
        width += len(item[1])
    if block:
        out.append(ItemBlock(block, weights))
    return out


class Best:
    """The best ``k`` classes for each item of a block so far."""

    def __init__(self, items: int, k: int):
        self.k, self.floor, self.held = k, np.ones(items, np.int64), [np.zeros((4, 0), np.int64)]
        self.waiting = 0

    def add(self, scores: np.ndarray, first: np.ndarray, number: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.floor)
        self.held.append(np.stack([item, scores[row, item], first[row], number[row]]))
        self.waiting += len(row)
        if self.waiting > max(100_000, 4 * self.k * len(self.floor)):
            self.cut()

    def cut(self) -> np.ndarray:
        found = np.concatenate(self.held, axis=1)
        found = found[:, np.lexsort((found[2], -found[1], found[0]))]
        starts = np.flatnonzero(np.diff(found[0], prepend=-1))
        rank = np.arange(found.shape[1]) - np.repeat(starts, np.diff([*starts, found.shape[1]]))
        found = found[:, rank < self.k]
        last = np.flatnonzero(rank[rank < self.k] == self.k - 1)
        self.floor[found[0, last]] = np.maximum(self.floor[found[0, last]], found[1, last])
        self.held, self.waiting = [found], 0
        return found


def top_classes(classes: DataFrame, blocks: list[ItemBlock], k: int) -> DataFrame:
    """``(item_id, score, first, class)``: each task's best classes for each item, by score and then by their smallest id."""

    def scan(batches):
        best = [Best(len(b.items), k) for b in blocks]
        for batch in batches:
            for at in range(0, batch.num_rows, _CLASSES):
                part = batch.slice(at, _CLASSES)
                row, term, tf = _opened(part.column("bag"))
                m, first, number = (part.column(c).to_numpy() for c in ("m", "first", "class"))
                for block, top in zip(blocks, best, strict=True):
                    top.add(block.scores(part.num_rows, row, term, tf, m), first, number)
        for block, top in zip(blocks, best, strict=True):
            found = top.cut()
            columns = [block.items[found[0]], found[1], found[2], found[3]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "score", "first", "class"])

    return classes.select("class", "first", "m", "bag").mapInArrow(scan, "item_id long, score long, first long, class long")


def _item_terms(items: DataFrame) -> DataFrame:
    """``(item_id, term)``: the different terms of each item."""

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, out = [], []
        for item, text in zip(batch.column("item_id").to_pylist(), text_bytes(batch.column("text")), strict=True):
            own = set().union(*terms(text))
            ids.extend([item] * len(own))
            out.extend(own)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["item_id", "term"])

    return map_batches(items, split, "item_id long, term binary", PORTION).distinct()


def _portions(items: DataFrame, limit: int) -> Iterator[DataFrame]:
    """Items by hash of their ids, in as many portions as their bytes take."""
    size = items.agg(F.coalesce(F.sum(_ITEM_WIDTH + F.coalesce(F.octet_length("text"), F.lit(0))), F.lit(0))).first()[0]
    parts = 1 + size // limit
    for p in range(parts):
        yield items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents of each item with the highest scores above 0, ties by ascending doc_id."""
    asked = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null")
    out = None
    for portion in _portions(asked, item_bytes):
        found = _ranked(docs, portion, k)
        out = found if out is None else out.unionByName(found)
    return out


def _ranked(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    of_item: dict[int, list[int]] = {}
    vocabulary: dict[bytes, int] = {}
    for row in _item_terms(items).orderBy("item_id", "term").collect():  # bounded by the portion's bytes
        of_item.setdefault(row["item_id"], []).append(vocabulary.setdefault(bytes(row["term"]), len(vocabulary)))
    held = written(bags(docs, vocabulary), "bags")
    n_docs, n_terms = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(held, len(vocabulary))
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    blocks = item_blocks([(i, np.array(sorted(t))) for i, t in of_item.items()], weights)
    # Of bags, only those that some item can score.
    norm = F.expr(f"50L + (50L * n * {n_docs}L) div {max(n_terms, 1)}L")
    ranked = held.where("doc_id is not null and octet_length(bag) > 0").select("doc_id", "bag", norm.alias("m")).withColumn("h", F.xxhash64("bag", "m"))
    # The hash deals classes out; the bag and m beside it in the key verify that members are equal.
    classes = ranked.groupBy("h", "m", "bag").agg(F.min("doc_id").alias("first"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    by_item = Window.partitionBy("item_id").orderBy(F.desc("score"), "first", "class")
    best = top_classes(classes, blocks, k).withColumn("r", F.row_number().over(by_item)).where(F.col("r") <= k)
    best = written(best.select("item_id", "score", "class"), "best")
    chosen = best.select("class").distinct()
    wanted = written(classes.join(small_or_plain(chosen, best.count(), 8), "class").select("class", "h", "m", "bag"), "wanted")
    count, size = wanted.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("bag") + 32), F.lit(0))).first()
    members = ranked.join(small_or_plain(wanted, count, size // max(count, 1)), ["h", "m", "bag"]).select("class", "doc_id")
    members = members.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy("doc_id"))).where(F.col("r") <= k)
    by_rank = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    found = best.join(members.drop("r"), "class").withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
    found = written(found.select("item_id", "rank", "doc_id", "score"), "ranked")
    forget(held, classes, best, wanted)
    return found
