"""Exact, interpolated quantiles of columns of any length."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import number

ONE_TASK_ROWS = 4_000_000
_ACCURACY = 10_000
_SKETCHES_PER_PASS = 200


def exact_quantiles(
    df: DataFrame, names: Sequence[str], shares: Sequence[float], one_task_rows: int = ONE_TASK_ROWS
) -> dict[str, list[float | None]]:
    """``{column: [quantile per share]}``, missing values left out.

    Spark's exact ``percentile`` gathers every distinct value in one task, which is fine up to ``one_task_rows``
    values over all columns. Beyond that each wanted order statistic is closed in on: a mergeable sketch gives a value
    range holding it, a count proves the range right, and the range shrinks about a thousandfold per round until it is
    small.
    """
    if not names:
        return {}
    values = df.select(*[number(df, n).alias(f"v{i}") for i, n in enumerate(names)])
    counts = values.agg(*[F.count(f"v{i}").alias(f"v{i}") for i in range(len(names))]).first()
    result: dict[str, list[float | None]] = {n: [None] * len(shares) for n in names}
    filled = [i for i in range(len(names)) if counts[f"v{i}"] > 0]
    fits = sum(counts[f"v{i}"] for i in filled) <= one_task_rows
    small, large = (filled, []) if fits else ([], filled)
    if small:
        row = values.agg(*[F.percentile(f"v{i}", F.array(*map(F.lit, shares))).alias(f"v{i}") for i in small]).first()
        for i in small:
            result[names[i]] = list(row[f"v{i}"])
    if large:
        wanted = {}
        for i in large:
            for s, share in enumerate(shares):
                at = share * (counts[f"v{i}"] - 1)
                wanted[(i, s)] = (math.floor(at), math.ceil(at), at - math.floor(at))
        ranks = sorted({(i, r) for (i, _), (lo, hi, _) in wanted.items() for r in (lo, hi)})
        found = _order_statistics(values, ranks, {i: counts[f"v{i}"] for i in large}, one_task_rows)
        for (i, s), (lo, hi, part) in wanted.items():
            low, high = found[(i, lo)], found[(i, hi)]
            result[names[i]][s] = low + (high - low) * part
    return result


def _order_statistics(
    values: DataFrame, ranks: Sequence[tuple[int, int]], counts: dict[int, int], one_task_rows: int
) -> dict[tuple[int, int], float]:
    """Value at each 0-based rank of each column."""
    span = {t: (None, None, 0, counts[t[0]], 2.0 / _ACCURACY) for t in ranks}  # low, high, rows below, rows in, slack
    found: dict[tuple[int, int], float] = {}

    def held(t):
        low, high = span[t][:2]
        v = F.col(f"v{t[0]}")
        return v.isNotNull() if low is None else v.between(low, high)

    while True:
        for t in [t for t in span if t not in found]:
            if span[t][0] is not None and span[t][0] == span[t][1]:
                found[t] = span[t][0]
        wide = [t for t in span if t not in found and span[t][3] > one_task_rows]
        if not wide:
            break
        # targets that still share a range share its sketch
        shared: dict[tuple, list[tuple[int, int]]] = {}
        for t in wide:
            shared.setdefault((t[0], *span[t][:2]), []).append(t)
        ends: dict[tuple[int, int], tuple[float, float]] = {}
        pools = list(shared.values())
        for start in range(0, len(pools), _SKETCHES_PER_PASS):
            part = pools[start : start + _SKETCHES_PER_PASS]
            sketches = []
            for n, pool in enumerate(part):
                wanted = []
                for t in pool:
                    _, _, below, inside, slack = span[t]
                    at = (t[1] - below + 0.5) / inside
                    wanted += [max(0.0, at - slack), min(1.0, at + slack)]
                held_value = F.when(held(pool[0]), F.col(f"v{pool[0][0]}"))
                sketches.append(F.approx_percentile(held_value, wanted, _ACCURACY).alias(f"s{n}"))
            row = values.agg(*sketches).first()
            for n, pool in enumerate(part):
                for j, t in enumerate(pool):
                    ends[t] = tuple(row[f"s{n}"][2 * j : 2 * j + 2])
        checks = []
        for n, t in enumerate(wide):
            v, (low, high) = F.col(f"v{t[0]}"), ends[t]
            checks += [F.count_if(v < low).alias(f"b{n}"), F.count_if(v.between(low, high)).alias(f"i{n}")]
        count_row = values.agg(*checks).first()
        for n, t in enumerate(wide):
            below, inside = count_row[f"b{n}"], count_row[f"i{n}"]
            if below <= t[1] < below + inside and inside < span[t][3]:
                span[t] = (*ends[t], below, inside, 2.0 / _ACCURACY)
            else:
                slack = span[t][4] * 4
                if slack > 1:  # the sketch cannot narrow it further: few distinct values are left
                    slack, span[t] = 1.0, (*span[t][:3], one_task_rows, 1.0)
                span[t] = (*span[t][:4], slack)
    rest = [t for t in span if t not in found]
    if rest:
        hits = F.array(
            *[F.struct(F.lit(n).alias("t"), F.when(held(t), F.col(f"v{t[0]}")).alias("v")) for n, t in enumerate(rest)]
        )
        need = F.create_map(*[F.lit(x) for n, t in enumerate(rest) for x in (n, t[1] - span[t][2])])
        upto = Window.partitionBy("t").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        picked = (
            values.select(F.inline(F.filter(hits, lambda h: h["v"].isNotNull())))
            .groupBy("t", "v")
            .count()
            .withColumn("upto", F.sum("count").over(upto))
            .where(F.col("upto") > need[F.col("t")])
            .groupBy("t")
            .agg(F.min("v").alias("v"))
        )
        for row in picked.collect():
            found[rest[row["t"]]] = row["v"]
    return found
