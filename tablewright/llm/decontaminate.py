"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

A seed is a run of ``SEED_WORDS`` words of a test item. Words of the items are counted over all documents first; a seed is rare if words
that are independent of each other would bring it up at most ``CHANCE`` times in the corpus. (Counting the seeds themselves would not do: a
passage that leaked into many documents makes its own seeds frequent.) An item without a rare seed keeps all of them. Every place
where a document holds a seed of an item is a passage to align with the item; the best local alignment counts 1 for a word that
agrees and takes ``PENALTY`` for one that differs, is missing or is added. Both passes read the documents once, as maps: texts are
never shuffled. Items go to the tasks in parts of bounded size, with both passes for each part, so that no more than one part is on the driver.

Defined results: null or empty texts and items have no words and no leaks; items of fewer words than a seed are one seed as a whole; rows with a
null ``item_id`` are left out, of repeated ones each is compared; repeated documents are judged each; a document is listed with
an item once, at its best passage (the first, if there are several). Other columns pass through ``find_leaks``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import extended, forget, map_batches, written
from tablewright.llm.words import Lookup, WordHasher, grams

SEED_WORDS = 4
CHANCE = 1.0
PENALTY = 0.5
#: Share of an item's words that the alignment must reach, and words that must agree (all, for shorter items).
LEAST_SCORE = 0.5
LEAST_WORDS = 8
#: Words of the items that are sent to the tasks in one pass.
PART_WORDS = 1_000_000
#: Alignments that numpy works on at a time, in cells of one row.
_ROW_CELLS = 1 << 16


def _lower(texts: pa.Array) -> list[bytes]:
    return [(t or "").lower().encode() for t in texts.to_pylist()]


class Items:
    """Test items as word hashes, with an index of their seeds."""

    def __init__(self, ids: list[int], words: list[np.ndarray]):
        self.ids, self.words = ids, words

    def index(self, rare: np.ndarray | None = None, seed: int = SEED_WORDS) -> None:
        """``rare``: sorted hashes of the words' probabilities are decided by the caller; see ``seeds``."""
        rows = []
        for k, w in enumerate(self.words):
            own = self.seeds(k, seed)
            keep = np.isin(own, rare) if rare is not None else np.ones(len(own), bool)
            if not keep.any():
                keep[:] = True
            rows.extend((int(h), k, p) for p, h in enumerate(own) if keep[p])
        rows.sort()
        self.hash = np.array([r[0] for r in rows], np.uint64)
        self.item = np.array([r[1] for r in rows], np.int64)
        self.place = np.array([r[2] for r in rows], np.int64)
        keys, self.first = np.unique(self.hash, return_index=True)
        self.last = np.append(self.first[1:], len(rows))
        self.sizes = sorted({min(seed, len(w)) for w in self.words})
        self.lookup = Lookup(keys)

    def seeds(self, k: int, seed: int = SEED_WORDS) -> np.ndarray:
        w = self.words[k]
        return grams(w, min(seed, len(w)))


def align(item: np.ndarray, passages: list[np.ndarray], penalty: float = PENALTY) -> list[tuple[float, int, int, int]]:
    """Best local alignment of ``item`` with each passage: ``(score, words that agree, first, last)`` (last exclusive)."""
    out = []
    width = max((len(p) for p in passages), default=0)
    if not width or not len(item):
        return [(0.0, 0, 0, 0)] * len(passages)
    for low in range(0, len(passages), max(1, _ROW_CELLS // width)):
        part = passages[low : low + max(1, _ROW_CELLS // width)]
        words = np.zeros((len(part), width), np.uint64)
        real = np.zeros((len(part), width), bool)
        for i, p in enumerate(part):
            words[i, : len(p)], real[i, : len(p)] = p, True
        steps = penalty * np.arange(width + 1)
        shape = (len(part), width + 1)
        score, agree, first = np.zeros(shape), np.zeros(shape, np.int64), np.broadcast_to(np.arange(width + 1), shape).copy()
        best, found = np.zeros(len(part)), np.zeros((len(part), 3), np.int64)
        row = np.arange(len(part))
        for w in item:
            same = real & (words == w)
            across = score[:, :-1] + np.where(same, 1.0, -penalty)
            down = score[:, 1:] - penalty
            new, new_agree, new_first = np.zeros(shape), np.zeros(shape, np.int64), np.broadcast_to(np.arange(width + 1), shape).copy()
            take = across >= down
            new[:, 1:] = np.where(take, across, down)
            new_agree[:, 1:] = np.where(take, agree[:, :-1] + same, agree[:, 1:])
            new_first[:, 1:] = np.where(take, first[:, :-1], first[:, 1:])
            gone = new <= 0
            new[gone], new_agree[gone] = 0.0, 0
            new_first[gone] = np.broadcast_to(np.arange(width + 1), shape)[gone]
            # Words that only the passage has: the best of all cells to the left, less a penalty for each step.
            lifted = new + steps
            top = np.maximum.accumulate(lifted, axis=1)
            source = np.maximum.accumulate(np.where(lifted >= top, np.arange(width + 1), 0), axis=1)
            score = np.maximum(top - steps, 0.0)
            agree, first = np.take_along_axis(new_agree, source, 1), np.take_along_axis(new_first, source, 1)
            at = score.argmax(axis=1)
            better = score[row, at] > best
            best[better] = score[row, at][better]
            found[better] = np.stack([agree[row, at], first[row, at], at], axis=1)[better]
        out.extend((float(b), *map(int, f)) for b, f in zip(best, found, strict=True))
    return out


def _passages(items: Items, hashes: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """For each item with a seed in the document, the ranges of words to align."""
    at, key = [], []
    for n in items.sizes:
        a, k = items.lookup.find(grams(hashes, n))
        at.append(a)
        key.append(k)
    at, key = np.concatenate(at), np.concatenate(key)
    if not len(at):
        return {}
    counts = items.last[key] - items.first[key]
    rows = np.repeat(items.first[key], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    item, start = items.item[rows], np.repeat(at, counts) - items.place[rows]
    order = np.lexsort((start, item))
    out: dict[int, list[tuple[int, int]]] = {}
    for k, s in zip(item[order].tolist(), start[order].tolist(), strict=True):
        size = len(items.words[k])
        slack = size // 4 + SEED_WORDS
        low, high = max(0, s - slack), min(len(hashes), s + size + slack)
        ranges = out.setdefault(k, [])
        # Seeds of one copy lie on neighbouring diagonals and share a range.
        if ranges and low <= ranges[-1][0] + slack:
            ranges[-1] = (ranges[-1][0], max(high, ranges[-1][1]))
        elif ranges and low < ranges[-1][1] and high <= ranges[-1][1]:
            continue
        else:
            ranges.append((low, high))
    return out


def _hashed_items(benchmark: DataFrame, part_words: int) -> tuple[DataFrame, int]:
    """Items as word hashes in a table ``(item_id, words)``, and the number of parts of about ``part_words`` words, dealt out in a column ``part`` if there are several."""
    hasher = WordHasher()

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [hasher.words(t).hashes.tobytes() for t in _lower(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(rows, pa.binary())], ["item_id", "words"])

    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null")
    items = written(map_batches(rows, hashed, "item_id long, words binary").where(F.octet_length("words") > 0), "items")
    size = items.agg(F.sum(F.octet_length("words").cast("long"))).first()[0] or 0
    count = -(-size // (8 * part_words))
    # The words that repeated rows share do not decide alone, so that copies of one item spread over the parts.
    salt = F.xxhash64("item_id", "words", F.monotonically_increasing_id())
    if count < 2:
        return items, count
    dealt = written(items.withColumn("part", F.pmod(salt, F.lit(count)).cast("int")), "item_parts")
    forget(items)
    return dealt, count


def _load(items: DataFrame, part: int) -> Items | None:
    """One part of the items; about ``part_words`` words, or one longer item, reach the driver."""
    rows = (items.where(F.col("part") == part) if "part" in items.columns else items).select("item_id", "words").collect()
    rows = sorted((r["item_id"], bytes(r["words"])) for r in rows)
    return Items([i for i, _ in rows], [np.frombuffer(w, np.uint64) for _, w in rows]) if rows else None


def _word_shares(docs: DataFrame, part: Items) -> tuple[np.ndarray, np.ndarray, int]:
    """Words of a part of the items, how often all documents hold them, and the number of all words."""
    vocabulary = np.unique(np.concatenate(part.words))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        hasher, lookup = WordHasher(), Lookup(shared.value)
        n, total = np.zeros(len(lookup.keys), np.int64), 0
        for batch in batches:
            for text in _lower(batch.column("text")):
                h = hasher.words(text).hashes
                total += len(h)
                n += np.bincount(lookup.find(h)[1], minlength=len(n))
        held = np.flatnonzero(n)
        place = pa.array(np.append(held, -1), pa.int64())
        yield pa.RecordBatch.from_arrays([place, pa.array(np.append(n[held], total), pa.int64())], ["place", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    counts, total = np.zeros(len(vocabulary), np.int64), 0
    for row in rows.collect():  # at most the words of a part
        if row["place"] < 0:
            total = row["n"]
        else:
            counts[row["place"]] = row["n"]
    return vocabulary, counts, total


def _index_rare(part: Items, vocabulary: np.ndarray, counts: np.ndarray, total: int) -> None:
    share = np.maximum(counts, 1) / max(total, 1)
    rare = []
    for k, w in enumerate(part.words):
        p = np.log(share[np.searchsorted(vocabulary, w)])
        n = min(SEED_WORDS, len(w))
        expected = np.log(max(total, 1)) + np.convolve(p, np.ones(n), "valid")
        rare.append(part.seeds(k)[expected <= np.log(CHANCE)])
    part.index(np.unique(np.concatenate(rare)))


def find_leaks(docs: DataFrame, benchmark: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """``docs`` with ``leaks`` by ``item_id``: ``array<struct<item_id, score, agree, first, last>>``, words counted from 0, last exclusive.

    Beyond ``part_words`` the items come part by part, and what a part found is written before the next one is loaded.
    """
    docs = docs.drop("leaks")
    kind = "array<struct<item_id:bigint,score:double,agree:int,first:int,last:int>>"
    out = docs.withColumn("leaks", F.array().cast(kind))
    items, count = _hashed_items(benchmark, part_words)
    before = None
    for number in range(count):
        part = _load(items, number)
        if part is None:
            continue
        _index_rare(part, *_word_shares(docs, part))
        out = _with_leaks(out, part, kind)
        if count > 1:
            done = written(out, "leaks")
            if before is not None:
                forget(before)
            out = before = done
    forget(items)
    return out.withColumn("leaks", F.array_sort("leaks")) if count > 1 else out


def _with_leaks(docs: DataFrame, part: Items, kind: str) -> DataFrame:
    hasher = WordHasher()

    def leaks_of(hashes: np.ndarray, items: Items) -> list[dict]:
        out = []
        for k, ranges in _passages(items, hashes).items():
            item = items.words[k]
            whole = [r for r in ranges if _holds(hashes[r[0] : r[1]], item) is not None]
            if whole:
                at = whole[0][0] + _holds(hashes[whole[0][0] : whole[0][1]], item)
                got = [(float(len(item)), len(item), at, at + len(item))]
            else:
                aligned = align(item, [hashes[a:b] for a, b in ranges])
                got = [(s, n, f + a, b + a) for (s, n, f, b), (a, _) in zip(aligned, ranges, strict=True)]
            score, agree, first, last = max(got, key=lambda g: (g[0], -g[2]))
            if score >= LEAST_SCORE * len(item) and agree >= min(LEAST_WORDS, len(item)):
                out.append({"item_id": items.ids[k], "score": score / len(item), "agree": agree, "first": first, "last": last})
        return out

    schema = extended(docs.drop("leaks"), f"leaks {kind}")

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        before = batch.column("leaks").to_pylist()
        found = [b + leaks_of(hasher.words(t).hashes, part) for b, t in zip(before, _lower(batch.column("text").cast(pa.string())), strict=True)]
        keep = [i for i, n in enumerate(batch.schema.names) if n != "leaks"]
        columns = [batch.column(i) for i in keep] + [pa.array(found, batch.schema.field("leaks").type)]
        return pa.RecordBatch.from_arrays(columns, [*(batch.schema.names[i] for i in keep), "leaks"])

    return docs.mapInArrow(lambda bs: map(find, bs), schema)


def _holds(words: np.ndarray, item: np.ndarray) -> int | None:
    """Where the words hold the whole item."""
    for at in np.flatnonzero(words[: max(0, len(words) - len(item) + 1)] == item[0]):
        if np.array_equal(words[at : at + len(item)], item):
            return int(at)
    return None
