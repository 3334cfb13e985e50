"""Compare registered queries with their SQL: python tests/check_oracle.py SF_DIR [name ...]"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from tablewright.catalog import ORACLE, QUERIES  # noqa: E402
from tablewright.catalog.registry import BASE  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    """One spelling per value, so that rows of both engines compare exactly."""
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, str):
        return value
    number = float(value)
    if math.isnan(number):
        return "nan"
    if number == 0 and math.copysign(1, number) < 0:
        return "-0"
    return repr(number) if math.isinf(number) or number != int(number) else str(int(number))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str):
    """``(rows, difference or '')``."""
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE:
        return len(got[1]), "" if got[1] else "no rows"
    cursor = con.execute(ORACLE[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return len(got[1]), f"columns {got[0]} but SQL has {want[0]}"
    if got[1] != want[1]:
        extra, lost = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
        return len(got[1]), (
            f"{len(got[1])} rows, SQL {len(want[1])}; only here {len(extra)}: {sorted(extra)[:3]}; "
            f"only SQL {len(lost)}: {sorted(lost)[:3]}"
        )
    return len(got[1]), ""


def main():
    from tablewright.runtime import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con = local_session(8), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        start = time.perf_counter()
        try:
            n, difference = compare(spark, con, sf_dir, name)
        except Exception as problem:  # report it and go on with the next query
            n, difference = -1, f"{type(problem).__name__}: {str(problem)[:1500]}"
        bad += bool(difference)
        kind = "sql" if name in ORACLE else "rows"
        print(f"{'BAD' if difference else 'ok '} {kind:4} {name:26} rows={n} {time.perf_counter() - start:.1f}s {difference}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
