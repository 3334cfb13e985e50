"""Personal data: patterns, and a semi-Markov conditional random field that finds further spans.

The field cuts a stretch of tokens into segments, each either one plain token or an entity of at most ``SPAN_TOKENS`` tokens of one kind. Features
describe whole segments: their shape, number of digits, check sums, neighbours. Dynamic programming picks boundaries and kinds
together; a long stretch is cut in blocks of tokens that hand on the states of the last ``SPAN_TOKENS`` tokens, with the same result in bounded
memory. It is trained on a bounded sample of stretches in which the patterns have marked the entities, with spoiled copies of entities as
counterexamples. Only stretches of tokens around digits and at signs are cut; elsewhere no entity can be.

Pattern spans always stay; spans of the field are added where they overlap none of them and its confidence is high enough.

Defined results: null and empty texts have no span; rows with a null or repeated id are scanned each; without any pattern span in the
sample the field adds nothing; an empty table gives no rows. Other columns pass through, unless they bear the name of a result column, which then
replaces them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import extended, map_batches

KINDS = ("email", "ip", "card", "phone")
SPAN_TOKENS = 16
#: Stretches that the field is trained on, and documents that they are taken from.
FIT_STRETCHES = 1000
FIT_DOCS = 3000
#: Stretches of one document that may be trained on, and their longest length in characters.
FIT_PARTS = 8
FIT_CHARS = 600
#: Stretches of more tokens are decoded block by block.
BLOCK_TOKENS = 4096
#: Posterior probability from which the field's spans count.
CONFIDENCE = 0.9
_BITS = 14

_TRIGGER = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs are taken whole (possessive), which finds the same matches: a later start inside a run fails as the first one does.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.DOTALL)


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octets(text: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in text.split("."))


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind, then start."""
    if not _TRIGGER.search(text):
        return []
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0])]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _window(text: str, at: int, step: int, tokens: int = 12, chars: int = 160) -> int:
    """Some tokens away from ``at``, but no further than ``chars`` and never inside a run of letters or digits, if there is a choice."""
    edge = max(0, at - chars) if step < 0 else min(len(text), at + chars)
    if step < 0:
        found = [m.start() + edge for m in _TOKEN.finditer(text[edge:at])]
        return found[-tokens] if len(found) >= tokens else (found[1] if len(found) > 1 and edge else edge)
    found = [m.end() + at for m in _TOKEN.finditer(text[at:edge])]
    return found[tokens - 1] if len(found) >= tokens else (found[-2] if len(found) > 1 and edge < len(text) else edge)


def stretches(text: str) -> list[tuple[int, int]]:
    """Ranges around digits and at signs, with room for an entity on both sides; ranges that touch are one."""
    out: list[list[int]] = []
    at = 0
    while m := _TRIGGER.search(text, at):
        low, high = _window(text, m.start(), -1), _window(text, m.end(), 1)
        if out and low <= out[-1][1]:
            out[-1][1] = max(high, out[-1][1])
        else:
            out.append([low, high])
        at = max(m.end(), out[-1][1] - 40)  # a trigger near the end widens the range; those before lie inside
    return [(a, b) for a, b in out]


@dataclass
class Lattice:
    """Tokens of a stretch, its possible segments ``(first, last, features)`` by their end, last exclusive."""

    text: str
    tokens: list[tuple[int, int]]
    segments: list[list[tuple[int, np.ndarray]]] = field(default_factory=list)


def _shape(token: str) -> str:
    if token[0].isascii() and token[0].isdigit():
        return f"d{min(len(token), 20)}"
    if token[0].isalpha():
        return "a"
    return " " if token.isspace() else token[0]


def lattice(text: str) -> Lattice:
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    out = Lattice(text, tokens, [[] for _ in range(len(tokens) + 1)])
    words = [text[a:b] for a, b in tokens]
    shapes = [_shape(w) for w in words]
    trigger = [s[0] == "d" or s == "@" for s in shapes]
    for i, first in enumerate(shapes):
        out.segments[i + 1].append((i, _features(words, shapes, i, i + 1, text[tokens[i][0] : tokens[i][1]])))
        if first[0] not in "ad+(":
            continue
        held = trigger[i]
        for j in range(i + 2, min(len(tokens), i + SPAN_TOKENS) + 1):
            last = shapes[j - 1]
            if "\n" in words[j - 1]:
                break
            held = held or trigger[j - 1]
            if held and last[0] in "ad":
                out.segments[j].append((i, _features(words, shapes, i, j, text[tokens[i][0] : tokens[j - 1][1]])))
    return out


def _features(words: list[str], shapes: list[str], i: int, j: int, span: str) -> np.ndarray:
    digits = _digits(span)
    own = shapes[i:j]
    before = shapes[i - 1] if i else "<"
    after = shapes[j] if j < len(shapes) else ">"
    kinds = "".join(s[0] for s in own)
    names = [
        "shape:" + "".join(own),
        "kinds:" + kinds,
        f"tokens:{j - i}",
        f"digits:{min(len(digits), 24)}",
        "ends:" + own[0] + own[-1],
        "before:" + before + "/" + own[0],
        "after:" + own[-1] + "/" + after,
        "edge:" + before[0] + after[0],
        f"at:{own.count('@')}:{kinds.rpartition('@')[2].count('.')}",
        f"dots:{kinds.count('.')}:{_octets(span) if kinds == 'd.d.d.d' else '-'}",
        f"check:{len(digits) if 13 <= len(digits) <= 19 and luhn(digits) else 0}:{kinds.strip('d- ') == ''}",
        f"plus:{own[0] == '+'}:{9 <= len(digits) <= 15}:{kinds.replace('d', '').strip('+() .-') == ''}",
        "word:" + next((w.lower() for w in reversed(words[max(0, i - 3) : i]) if w[0].isalpha()), "")[:12] if j - i > 1 or own[0][0] == "d" else "plain",
    ]
    return np.array([crc32(n.encode()) >> (32 - _BITS) for n in names], np.int64)


class Blocks:
    """A stretch of any length: where its tokens start, and its segments for a block of tokens at a time."""

    #: Tokens around a block that features of its segments look at: those of the longest segment and of its neighbours.
    _AROUND = SPAN_TOKENS + 4

    def __init__(self, text: str, size: int = BLOCK_TOKENS):
        self.text, self.size = text, size
        self.starts = np.append(np.fromiter((m.start() for m in _TOKEN.finditer(text)), np.int64), len(text))
        self.count = len(self.starts) - 1

    def ranges(self) -> list[tuple[int, int]]:
        return [(low, min(self.count, low + self.size)) for low in range(0, self.count, self.size)]

    def segments(self, low: int, high: int) -> list[list[tuple[int, np.ndarray]]]:
        """For each end from ``low + 1`` to ``high``, the segments ``(first, features)``."""
        left, right = max(0, low - self._AROUND), min(self.count, high + 1)
        part = lattice(self.text[int(self.starts[left]) : int(self.starts[right])])
        return [[(i + left, f) for i, f in part.segments[j - left]] for j in range(low + 1, high + 1)]


def _logsum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=0)
    return top + np.log(np.exp(x - top).sum(axis=0))


class SemiMarkov:
    """Labels: 0 is plain, 1.. are the kinds. Plain segments are single tokens."""

    def __init__(self):
        labels = len(KINDS) + 1
        self.weights = np.zeros((1 << _BITS, labels))
        self.steps = np.zeros((labels, labels))

    def _scores(self, lat: Lattice) -> list[list[tuple[int, np.ndarray]]]:
        out = []
        for ends in lat.segments:
            row = []
            for i, f in ends:
                s = self.weights[f].sum(axis=0)
                row.append((i, s))
            out.append(row)
        return out

    def _forward(self, lat: Lattice, scores) -> np.ndarray:
        n, labels = len(lat.tokens), len(self.steps)
        alpha = np.full((n + 1, labels), -1e30)
        alpha[0, 0] = 0.0
        for j in range(1, n + 1):
            parts = []
            for i, s in scores[j]:
                arrive = _logsum(alpha[i][:, None] + self.steps) + s
                if j - i > 1:
                    arrive[0] = -1e30
                parts.append(arrive)
            alpha[j] = _logsum(np.array(parts))
        return alpha

    def _backward(self, lat: Lattice, scores) -> np.ndarray:
        n, labels = len(lat.tokens), len(self.steps)
        beta = np.full((n + 1, labels), -1e30)
        beta[n] = 0.0
        for j in range(n, 0, -1):
            for i, s in scores[j]:
                leave = s + beta[j]
                if j - i > 1:
                    leave = leave.copy()
                    leave[0] = -1e30
                beta[i] = np.logaddexp(beta[i], _logsum((self.steps + leave).T))
        return beta

    def posteriors(self, lat: Lattice):
        """``(first, last, features, probabilities by label, of a step from label to label)``."""
        scores = self._scores(lat)
        alpha, beta = self._forward(lat, scores), self._backward(lat, scores)
        total = float(_logsum(alpha[-1]))
        for j, row in enumerate(scores):
            for k, (i, s) in enumerate(row):
                leave = s + beta[j]
                if j - i > 1:
                    leave = leave.copy()
                    leave[0] = -1e30
                pair = np.exp(np.minimum(alpha[i][:, None] + self.steps + leave - total, 0.0))
                yield i, j, lat.segments[j][k][1], pair.sum(axis=0), pair

    def decode(self, lat: Lattice) -> list[tuple[int, int, int]]:
        """Entities ``(kind, start, end)`` of the best segmentation, in characters of the stretch."""
        scores = self._scores(lat)
        n, labels = len(lat.tokens), len(self.steps)
        best = np.full((n + 1, labels), -1e30)
        best[0, 0] = 0.0
        back: list[list[tuple[int, int]]] = [[(0, 0)] * labels for _ in range(n + 1)]
        for j in range(1, n + 1):
            for i, s in scores[j]:
                arrive = best[i][:, None] + self.steps
                source = arrive.argmax(axis=0)
                value = arrive[source, np.arange(labels)] + s
                for y in range(1 if j - i > 1 else 0, labels):
                    if value[y] > best[j, y]:
                        best[j, y] = value[y]
                        back[j][y] = (i, int(source[y]))
        out, j, y = [], n, int(best[n].argmax())
        while j:
            i, before = back[j][y]
            if y:
                out.append((y - 1, lat.tokens[i][0], lat.tokens[j - 1][1]))
            j, y = i, before
        return out[::-1]

    def _through(self, rows, before: tuple[np.ndarray, np.ndarray], low: int):
        """States ``(best, alpha)`` from ``SPAN_TOKENS`` before ``low`` to the end of the block, and the way back of each best state."""
        labels = len(self.steps)
        best, alpha = (np.concatenate([b, np.full((len(rows), labels), -1e30)]) for b in before)
        back: list[list[tuple[int, int]]] = []
        for k, row in enumerate(rows):
            at, j = k + SPAN_TOKENS + 1, low + k + 1
            ways, parts = [(0, 0)] * labels, []
            for i, s in row:
                arrive = best[i - low + SPAN_TOKENS][:, None] + self.steps
                source = arrive.argmax(axis=0)
                value = arrive[source, np.arange(labels)] + s
                total = _logsum(alpha[i - low + SPAN_TOKENS][:, None] + self.steps) + s
                if j - i > 1:
                    value[0] = total[0] = -1e30
                for y in np.flatnonzero(value > best[at]):
                    best[at, y], ways[y] = value[y], (i, int(source[y]))
                parts.append(total)
            alpha[at] = _logsum(np.array(parts))
            back.append(ways)
        return best, alpha, back

    def decode_blocks(self, blocks: Blocks) -> list[tuple[int, int, int, float]]:
        """Entities ``(kind, start, end, probability)`` of the best segmentation of the whole stretch.

        A first pass keeps the states at the borders of blocks alone; a second one, from the last block to the first, makes the states of a block
        anew, follows the best way back through it and sums up what comes after each place.
        """
        labels = len(self.steps)
        state = np.full((SPAN_TOKENS + 1, labels), -1e30)
        state[-1, 0] = 0.0
        borders, ranges = [(state, state.copy())], blocks.ranges()
        for low, high in ranges:
            best, alpha, _ = self._through(self._rows(blocks, low, high), borders[-1], low)
            borders.append((best[-SPAN_TOKENS - 1 :].copy(), alpha[-SPAN_TOKENS - 1 :].copy()))
        j, y = blocks.count, int(borders[-1][0][-1].argmax())
        total = float(_logsum(borders[-1][1][-1]))
        after = np.full((SPAN_TOKENS + 1, labels), -1e30)
        after[-1] = 0.0
        out = []
        for (low, high), before in zip(reversed(ranges), reversed(borders[:-1]), strict=True):
            rows = self._rows(blocks, low, high)
            _, alpha, back = self._through(rows, before, low)
            # Places from SPAN_TOKENS before the block to its end; the last of them were reached from the block behind.
            beta = np.concatenate([np.full((len(rows), labels), -1e30), after])
            for k in range(len(rows) - 1, -1, -1):
                end, at = low + k + 1, k + SPAN_TOKENS + 1
                for i, s in rows[k]:
                    leave = s + beta[at]
                    if end - i > 1:
                        leave[0] = -1e30
                    start = i - low + SPAN_TOKENS
                    if end == j and y and i == back[k][y][0]:
                        p = float(np.exp(min(_logsum(alpha[start] + self.steps[:, y]) + leave[y] - total, 0.0)))
                        out.append((y - 1, int(blocks.starts[i]), int(blocks.starts[end]), p))
                    beta[start] = np.logaddexp(beta[start], _logsum((self.steps + leave).T))
                if end == j:
                    j, y = back[k][y]
            after = beta[: SPAN_TOKENS + 1]
        return out[::-1]

    def _rows(self, blocks: Blocks, low: int, high: int) -> list[list[tuple[int, np.ndarray]]]:
        return [[(i, self.weights[f].sum(axis=0)) for i, f in row] for row in blocks.segments(low, high)]

    def fit(self, data: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 4, rate: float = 0.3) -> None:
        """Stochastic gradient steps on the likelihood, with a step size for each weight."""
        seen = np.full(self.weights.shape, 1e-3)
        seen_steps = np.full(self.steps.shape, 1e-3)
        ready = []
        for text, spans in data:
            lat = lattice(text)
            gold = _gold(lat, spans)
            if gold is not None:
                ready.append((lat, gold))
        order = np.random.default_rng(0)
        for _ in range(rounds):
            for k in order.permutation(len(ready)):
                lat, gold = ready[k]
                step = np.zeros_like(self.steps)
                ids, values = [], []
                for i, j, features, p, pair in self.posteriors(lat):
                    step -= pair
                    g = -p
                    if (i, j) in gold:
                        y, before = gold[i, j]
                        g[y] += 1
                        step[before, y] += 1
                    if np.abs(g).max() > 1e-4:
                        ids.append(features)
                        values.append(np.broadcast_to(g, (len(features), len(g))))
                if ids:
                    flat, at = np.unique(np.concatenate(ids), return_inverse=True)
                    g = np.zeros((len(flat), len(self.steps)))
                    np.add.at(g, at, np.concatenate(values))
                    seen[flat] += g * g
                    self.weights[flat] += rate * g / np.sqrt(seen[flat])
                seen_steps += step * step
                self.steps += rate * step / np.sqrt(seen_steps)


def _gold(lat: Lattice, spans: list[tuple[int, int, int]]) -> dict[tuple[int, int], tuple[int, int]] | None:
    """The segmentation with these entities, if tokens and segments allow it; a span inside another one is left out."""
    starts = {a: k for k, (a, _) in enumerate(lat.tokens)}
    stops = {b: k + 1 for k, (_, b) in enumerate(lat.tokens)}
    entity = {}
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a not in starts or b not in stops:
            return None
        if not any(i <= starts[a] < j for i, (j, _) in entity.items()):
            entity[starts[a]] = (stops[b], kind + 1)
    gold, at, before = {}, 0, 0
    while at < len(lat.tokens):
        j, y = entity.get(at, (at + 1, 0))
        if all(i != at for i, _ in lat.segments[j]):
            return None
        gold[at, j] = (y, before)
        at, before = j, y
    return gold


def _spoiled(text: str, spans: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]] | None:
    """The stretch with its checkable entities broken, so that they are plain: a wrong check digit, a number beyond a byte."""
    out, changed = list(text), False
    for kind, a, b in spans:
        if kind == 2:
            out[b - 1] = str((int(text[b - 1]) + 1) % 10)
            changed = True
        elif kind == 1 and len(text[a:b].split(".")[0]) == 3:
            out[a] = "9"
            changed = True
    spoiled = "".join(out)
    return (spoiled, pattern_spans(spoiled)) if changed else None


def fit_field(docs: DataFrame, stretches_wanted: int = FIT_STRETCHES, docs_wanted: int = FIT_DOCS) -> SemiMarkov | None:
    """Train on stretches of a bounded sample of documents, chosen by a hash of their text."""
    text = F.col("text").cast("string")
    able = docs.select(text.alias("text")).where(F.col("text").rlike("[0-9@]"))
    chosen = able.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(docs_wanted)
    sample = able.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), "h", "left_semi").dropDuplicates(["h"])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        order, parts = [], []
        for t in batch.column("text").to_pylist():
            # Of a text full of numbers the first stretches will do for training.
            for low, high in stretches(t)[:FIT_PARTS]:
                if high - low <= FIT_CHARS:
                    order.append(crc32(t[low:high].encode()))
                    parts.append(t[low:high])
        return pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(parts, pa.string())], ["h", "part"])

    rows = map_batches(sample, cut, "h long, part string").distinct().orderBy("h", "part").limit(stretches_wanted).collect()
    data = [(r["part"], pattern_spans(r["part"])) for r in rows]
    if not any(spans for _, spans in data):
        return None
    data += [s for part, spans in data if (s := _spoiled(part, spans))]
    model = SemiMarkov()
    model.fit(data)
    return model


def field_spans(text: str, model: SemiMarkov, known: dict[str, list], confidence: float = CONFIDENCE, block: int = BLOCK_TOKENS) -> list[tuple[int, int, int]]:
    """Spans of the field in the whole text; ``known`` remembers short stretches."""
    out = []
    for low, high in stretches(text):
        part = text[low:high]
        # No more tokens than characters; texts of long stretches are not remembered.
        if high - low > block and (blocks := Blocks(part, block)).count > block:
            found = model.decode_blocks(blocks)
            out.extend((kind, a + low, b + low) for kind, a, b, p in found if p >= confidence)
            continue
        found = known.get(part)
        if found is None:
            lat = lattice(part)
            found = model.decode(lat)
            if found:
                starts = {a: k for k, (a, _) in enumerate(lat.tokens)}
                stops = {b: k + 1 for k, (_, b) in enumerate(lat.tokens)}
                p = {(i, j): probs for i, j, _, probs, _ in model.posteriors(lat)}
                found = [s for s in found if p[starts[s[1]], stops[s[2]]][s[0] + 1] >= confidence]
            if len(known) > 20_000:
                known.clear()
            known[part] = found
        out.extend((kind, a + low, b + low) for kind, a, b in found)
    return out


def find_personal(docs: DataFrame, model: SemiMarkov | None) -> DataFrame:
    """``docs`` with ``personal``: ``array<struct<kind, start, stop, base>>`` by kind, then start, in code points, the end exclusive."""
    docs = docs.drop("personal")
    kind_type = "array<struct<kind:int,start:bigint,stop:bigint,base:boolean>>"
    schema = extended(docs, f"personal {kind_type}")

    def find(batches):
        known: dict[str, list] = {}
        span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                base = pattern_spans(text or "")
                rows = [(k, a, b, True) for k, a, b in base]
                if model is not None and text and _TRIGGER.search(text):
                    more = field_spans(text, model, known)
                    rows += [(k, a, b, False) for k, a, b in _apart(more, base)]
                rows.sort(key=lambda r: r[:2])
                out.append([dict(zip(("kind", "start", "stop", "base"), r, strict=True)) for r in rows])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, span)], [*batch.schema.names, "personal"])

    return docs.mapInArrow(find, schema)


def _apart(more: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of ``more`` that overlap none of ``base``."""
    taken = sorted((a, b) for _, a, b in base)
    ends, top = [], 0
    for _, b in taken:
        top = max(top, b)
        ends.append(top)
    out, at = [], 0
    for s in sorted(more, key=lambda s: s[1]):
        while at < len(taken) and taken[at][0] < s[2]:
            at += 1
        if not at or ends[at - 1] <= s[1]:
            out.append(s)
    return out
