"""Chat formatting: a hidden Markov model recovers who speaks, then turns are rendered in one form.

A transcript is a sequence of texts; each is cut into blocks where a line begins with a speaker marker (``User:``, ``### Assistant``, ``<|system|>``
and the like). Hidden states are the roles. A block shows its marker, its length, its number of lines and its questions; rates of what roles
show, of first roles and of the steps from role to role are counted over all transcripts whose roles are given. Viterbi finds the best
sequence of roles.

A transcript of any length is decoded in chunks of ``CHUNK`` turn numbers: each chunk becomes a matrix of best scores from role to role, the
matrices of a transcript give the roles at the chunk borders, and each chunk then goes back over its own blocks.

Defined results: null texts are empty, and an empty text is one block; rows with a null ``conv_id`` are left out; a null turn comes first;
equal rows count once; different rows with the same turn follow each other by text; roles other than the three known ones teach nothing; an empty table gives no
rows. Other columns are not kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import map_batches, written

ROLES = ("system", "user", "assistant")
CHUNK = 1024
#: Names that speakers go by.
_NAMES = {
    "system": "system", "instruction": "system", "instructions": "system",
    "user": "user", "human": "user", "question": "user", "q": "user", "prompter": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "gpt": "assistant", "answer": "assistant", "a": "assistant",
}
_MARKER = re.compile(
    r"^[ \t]*(?:<\|(?:im_start\|>)?[ \t]*(?P<tag>[A-Za-z]{1,12})[ \t]*(?:\|>)?|\#{1,6}[ \t]*(?P<head>[A-Za-z]{1,12})[ \t]*:?"
    r"|\*\*(?P<bold>[A-Za-z]{1,12}):?\*\*:?|\[(?P<box>[A-Za-z]{1,12})\]:?|(?P<plain>[A-Za-z]{1,12})[ \t]*:)(?=\s|$|(?<=>)|(?<=\]))[ \t]*"
)


def marker(line: str) -> tuple[str, int]:
    """The role that a line's marker names ("" without one), and the length of the marker."""
    if (m := _MARKER.match(line)) and (name := next(g for g in m.groups() if g).lower()) in _NAMES:
        # Single letters are too common in prose unless a colon follows.
        if len(name) > 1 or m["plain"]:
            return _NAMES[name], m.end()
    return "", 0


def blocks(text: str) -> list[tuple[str, str]]:
    """``(marker's role, text without the marker)`` of the parts of a text."""
    out: list[tuple[str, list[str]]] = [("", [])]
    for line in text.split("\n"):
        role, size = marker(line)
        if role:
            out.append((role, [line[size:]]))
        else:
            out[-1][1].append(line)
    if not out[0][1] and len(out) > 1:
        out = out[1:]
    return [(role, "\n".join(lines).strip()) for role, lines in out]


def shown(role: str, text: str) -> list[str]:
    """What a block shows: one value for each feature."""
    return [
        f"marker:{role}",
        f"chars:{len(text).bit_length()}",
        f"lines:{min(text.count(chr(10)), 12)}",
        f"questions:{min(text.count('?'), 3)}:{text.rstrip().endswith('?')}",
    ]


@dataclass(frozen=True)
class RoleModel:
    """Logarithms of rates: of first roles, of steps, and of each shown value by role; a value never seen has ``unseen``."""

    first: np.ndarray
    steps: np.ndarray
    values: dict[str, np.ndarray]
    unseen: dict[str, np.ndarray]

    def evidence(self, role: str, text: str) -> np.ndarray:
        total = np.zeros(len(ROLES))
        for value in shown(role, text):
            total = total + self.values.get(value, self.unseen[value.partition(":")[0]])
        return total


def _turns(conversations: DataFrame) -> DataFrame:
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(
            ["role"] if "role" in conversations.columns else []
        )
    )
    return rows.distinct().withColumn("chunk", F.floor(F.coalesce("turn", F.lit(0)) / CHUNK))


def fit_roles(conversations: DataFrame) -> RoleModel:
    """Count what the given roles show, over all rows."""
    known = _turns(conversations).where(F.col("role").isin(*ROLES))

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[tuple[str, str], int] = {}
        for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            parts = blocks(text)
            for k, (named, part) in enumerate(parts):
                # A marker inside says who goes on; only the block that the row's role speaks for teaches.
                if k == 0 or named == role:
                    for value in shown(named, part):
                        counts[role, value] = counts.get((role, value), 0) + 1
        keys = list(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([counts[k] for k in keys], pa.int64())], ["role", "value", "n"]
        )

    order = Window.partitionBy("conv_id", "chunk").orderBy(F.asc_nulls_first("turn"), "text", "role")
    steps = known.select("role", F.lag("role").over(order).alias("before"), (F.col("chunk") == 0).alias("opens"))
    # The step over the border of two chunks goes from the last role of the one to the first role of the other.
    place = F.struct(F.coalesce("turn", F.lit(-(1 << 63))), "text", "role")
    ends = known.groupBy("conv_id", "chunk").agg(F.min_by("role", place).alias("role"), F.max_by("role", place).alias("last"))
    behind = F.lag("last").over(Window.partitionBy("conv_id").orderBy("chunk"))
    borders = ends.select("role", behind.alias("before"), F.lit(False).alias("opens"))
    steps = steps.unionByName(borders).where("before is not null or opens").groupBy(F.concat(F.lit("step:"), F.coalesce("before", F.lit(""))).alias("value"), "role")
    counted = map_batches(known, features, "role string, value string, n long").groupBy("value", "role").agg(F.sum("n").alias("n"))
    rows = counted.unionByName(steps.agg(F.count("*").alias("n"))).collect()  # values are few: lengths in powers of two, capped counts
    table: dict[str, np.ndarray] = {}
    for r in rows:
        table.setdefault(r["value"], np.zeros(len(ROLES)))[ROLES.index(r["role"])] += r["n"]
    totals: dict[str, np.ndarray] = {}
    kinds: dict[str, int] = {}
    for value, n in table.items():
        kind = value.partition(":")[0]
        totals[kind] = totals.get(kind, np.zeros(len(ROLES))) + n
        kinds[kind] = kinds.get(kind, 0) + 1
    names = ("marker", "chars", "lines", "questions")
    full = {k: totals.get(k, np.zeros(len(ROLES))) + kinds.get(k, 0) + 1 for k in names}
    values = {v: np.log((n + 1) / full[v.partition(":")[0]]) for v, n in table.items() if not v.startswith("step:")}
    # Markers that the given rows lack are trusted to name the speaker.
    for i, role in enumerate(ROLES):
        if f"marker:{role}" not in values:
            values[f"marker:{role}"] = np.log(np.where(np.arange(len(ROLES)) == i, 0.9, 0.05))
    first = np.log(table.get("step:", np.zeros(len(ROLES))) + 1)
    step = np.log(np.array([table.get(f"step:{r}", np.zeros(len(ROLES))) + 0.1 for r in ROLES]))
    norm = np.log(np.exp(step).sum(axis=1, keepdims=True))
    return RoleModel(first - np.log(np.exp(first).sum()), step - norm, values, {k: -np.log(full[k]) for k in names})


def transfer(evidence: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Best scores from the role before the blocks to the role of the last one."""
    best = np.where(np.eye(len(steps), dtype=bool), 0.0, -np.inf)
    for e in evidence:
        best = (best[:, :, None] + steps[None]).max(axis=1) + e
    return best


def path(evidence: np.ndarray, steps: np.ndarray, before: np.ndarray, last: int | None = None) -> list[int]:
    """Viterbi: roles of the blocks, after scores ``before`` of the role before them; ``last`` fixes the last role."""
    best, back = before, []
    for e in evidence:
        arrive = best[:, None] + steps
        back.append(arrive.argmax(axis=0))
        best = arrive.max(axis=0) + e
    at = int(best.argmax()) if last is None else last
    out = []
    for source in reversed(back):
        out.append(at)
        at = int(source[at])
    return out[::-1]


def _opening(model: RoleModel) -> tuple[np.ndarray, np.ndarray]:
    """Scores and steps with a state before the first block, the last index."""
    n = len(ROLES)
    steps = np.full((n + 1, n + 1), -np.inf)
    steps[:n, :n], steps[n, :n] = model.steps, model.first
    before = np.full(n + 1, -np.inf)
    before[n] = 0.0
    return before, steps


def format_chats(conversations: DataFrame, model: RoleModel) -> DataFrame:
    """``(conv_id, turn, part, role, rendered)``: every block of every transcript, in the order of ``turn`` and ``part``.

    ``role`` in the input is never looked at. Different rows with the same turn go on numbering their parts.
    """
    n = len(ROLES)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [[] for _ in range(4)]
        for turn, texts in zip(batch.column("turn").to_pylist(), batch.column("texts").to_pylist(), strict=True):
            part = 0
            for text in texts:
                for role, block in blocks(text):
                    for column, value in zip(out, (turn, part, model.evidence(role, block).tolist(), block), strict=True):
                        column.append(value)
                    part += 1
        return out

    def parts(batches):
        for batch in batches:
            conv, chunk = batch.column("conv_id").to_pylist(), batch.column("chunk").to_pylist()
            for i in range(batch.num_rows):
                turn, part, evidence, block = cut(batch.slice(i, 1))
                columns = [pa.array([conv[i]] * len(turn), pa.int64()), pa.array([chunk[i]] * len(turn), pa.int64()), pa.array(turn, pa.int64())]
                columns += [pa.array(part, pa.int64()), pa.array(evidence, pa.list_(pa.float64())), pa.array(block, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", "chunk", "turn", "part", "evidence", "block"])

    rows = _turns(conversations.drop("role")).groupBy("conv_id", "chunk", "turn").agg(F.sort_array(F.collect_list("text")).alias("texts"))
    kind = "conv_id long, chunk long, turn long, part long, evidence array<double>, block string"
    pieces = written(rows.mapInArrow(parts, kind), "chat_blocks")
    ordered = F.sort_array(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("at"), "part", "evidence", "turn")))
    chunks = written(pieces.groupBy("conv_id", "chunk").agg(ordered.alias("rows")), "chat_chunks")

    def wide(rows) -> np.ndarray:
        """Evidence with the opening state, which no block can have."""
        return np.array([[*r["evidence"], -np.inf] for r in rows])

    def matrices(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, steps = _opening(model)
        flat = [transfer(wide(rows), steps).ravel().tolist() for rows in batch.column("rows").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), pa.array(flat, pa.list_(pa.float64()))], ["conv_id", "chunk", "matrix"])

    def borders(batch: pa.RecordBatch) -> pa.RecordBatch:
        before, _ = _opening(model)
        out = ([], [], [], [])
        for conv, chain in zip(batch.column("conv_id").to_pylist(), batch.column("chain").to_pylist(), strict=True):
            best, back = before, []
            for link in chain:
                arrive = best[:, None] + np.array(link["matrix"]).reshape(n + 1, n + 1)
                back.append(arrive.argmax(axis=0))
                best = arrive.max(axis=0)
            last = int(best.argmax())
            for link, source in zip(reversed(chain), reversed(back), strict=True):
                for column, value in zip(out, (conv, link["chunk"], int(source[last]), last), strict=True):
                    column.append(value)
                last = int(source[last])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["conv_id", "chunk", "enters", "leaves"])

    chains = map_batches(chunks, matrices, "conv_id long, chunk long, matrix array<double>")
    chains = chains.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "matrix"))).alias("chain"))
    ends = map_batches(chains, borders, "conv_id long, chunk long, enters long, leaves long")

    def decide(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, steps = _opening(model)
        out = ([], [], [], [])
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "rows", "enters", "leaves"))
        for conv, rows, enters, leaves in zip(*columns, strict=True):
            before = np.where(np.arange(n + 1) == enters, 0.0, -np.inf)
            for r, role in zip(rows, path(wide(rows), steps, before, leaves), strict=True):
                for column, value in zip(out, (conv, r["turn"], r["part"], ROLES[role]), strict=True):
                    column.append(value)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["conv_id", "turn", "part", "role"])

    roles = map_batches(chunks.join(ends, ["conv_id", "chunk"]), decide, "conv_id long, turn long, part long, role string")
    roles = roles.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("part").alias("p"), "role")
    same = (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("part") == F.col("p"))
    # What looks like a frame inside a text is kept apart from the frames.
    spelled = F.concat(F.lit("<|"), "role", F.lit("|>\n"), F.replace("block", F.lit("<|"), F.lit("< |")), F.lit("\n<|end|>\n"))
    return pieces.join(roles, same).select("conv_id", "turn", "part", "role", spelled.alias("rendered"))
