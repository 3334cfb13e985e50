"""Text and run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.registry import query, table, using, view
from tablewright.operators import textlog as L
from tablewright.runtime import scratch_path
from tablewright.sources import reports as R
from tablewright.streaming.event_log import append_to_table, closed_windows, first_occurrences_stream, follow_events, rollup_to_table


@query(
    "code_blocks",
    using("fx_code")
    + """, f as (select conv_id, turn, response, regexp_extract_all(response, '(?s)```(?:python)?\\s*\\n(.*?)\\n```', 1) as b
      from fx_code) select conv_id, turn, case when len(b) > 0 then array_to_string(b, chr(10) || chr(10))
      else regexp_replace(response, '^\\s+|\\s+$', '', 'g') end as code from f""",
)
def code_blocks(spark, sf_dir):
    return L.extract_code(view(spark, sf_dir, "fx_code"), "response").select("conv_id", "turn", "code")


@query(
    "error_types",
    using("fx_errors")
    + """select nullif(regexp_extract(line, '(\\w+Error|\\w+Exception):\\s*(.+)', 1), '') as error_type, count(*) as n
      from fx_errors group by 1""",
)
def errors(spark, sf_dir):
    return L.error_counts(view(spark, sf_dir, "fx_errors"), "line")


@query(
    "error_messages",
    using("fx_errors")
    + """select event_id, nullif(regexp_extract(line, '(\\w+Error|\\w+Exception):\\s*(.+)', 1), '') as error_type,
      case when regexp_matches(line, '(\\w+Error|\\w+Exception):') then regexp_extract(line,
      '(\\w+Error|\\w+Exception):\\s*(.+)', 2) else left(line, 500) end as error_message from fx_errors""",
)
def messages(spark, sf_dir):
    return L.with_error(view(spark, sf_dir, "fx_errors"), "line").drop("line")


@query("text_tail", "select doc_id, left(text, 2000) as head, right(text, 2000) as tail from documents")
def tails(spark, sf_dir):
    return L.excerpt(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")


@query(
    "run_rollup",
    """select user_id, event_type, count(*) as n_events, min(ts) as started, max(ts) as ended,
    round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 4) as seconds from events group by user_id, event_type""",
)
def rollup(spark, sf_dir):
    return R.run_rollup(table(spark, sf_dir, "events"), "user_id", "event_type", "ts")


@query(
    "artifact_dedupe",
    "select props, min(event_id) as first_seen from events group by props",
)
def artifacts(spark, sf_dir):
    return R.first_occurrences(table(spark, sf_dir, "events"), "props", "event_id")


@query("event_log", "select ts as timestamp, cast(user_id as varchar) as agent, event_type, props as payload from events")
def event_log(spark, sf_dir):
    """Append the events as JSON lines, then read the log back."""
    path = scratch_path(spark, "events")
    R.append_events(
        table(spark, sf_dir, "events").selectExpr(
            "ts as timestamp", "cast(user_id as string) as agent", "event_type", "props as payload"
        ),
        path,
    )
    return R.read_events(spark, path).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query(
    "run_rollup_stream",
    """select cast(user_id as varchar) as agent, event_type, count(*) as n_events, min(ts) as started, max(ts) as ended,
    round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 4) as seconds from events group by user_id, event_type""",
)
def rollup_stream(spark, sf_dir):
    """The rollup once more, over the events as an appended JSON log."""
    path, out = scratch_path(spark, "events"), scratch_path(spark, "rollup")
    R.append_events(
        table(spark, sf_dir, "events").selectExpr(
            "ts as timestamp", "cast(user_id as string) as agent", "event_type", "props as payload"
        ),
        path,
    )
    rollup_to_table(follow_events(spark, path), out).awaitTermination()
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")}
    return spark.read.parquet(out).withColumns(times)


def _logged(spark, sf_dir):
    path = scratch_path(spark, "events")
    columns = ("ts as timestamp", "cast(user_id as string) as agent", "event_type", "props as payload")
    R.append_events(table(spark, sf_dir, "events").selectExpr(*columns), path)
    return follow_events(spark, path)


@query(
    "closed_windows_stream",
    """with w as (select time_bucket(interval '1 day', ts) as window_start, event_type, cast(user_id as varchar) as agent, ts from events)
    select window_start, window_start + interval '1 day' as window_end, event_type, agent, count(*) as n_events, min(ts) as started, max(ts) as ended
    from w where window_start + interval '1 day' <= (select max(date_trunc('millisecond', ts)) from events) - interval '1 hour'
    group by window_start, event_type, agent""",
)
def closed_windows_stream(spark, sf_dir):
    """Windows of a day that the watermark has passed, from the events as an appended log."""
    out = scratch_path(spark, "windows")
    stream = append_to_table(closed_windows(_logged(spark, sf_dir)), out)
    stream.awaitTermination()
    times = ("window_start", "window_end", "started", "ended")
    return spark.read.parquet(out).withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


@query(
    "first_occurrences_stream",
    """with e as (select cast(user_id as varchar) as key, ts, lag(ts) over (partition by user_id order by ts) as prev from events),
    s as (select *, sum(case when prev is null or ts - prev > interval '1 hour' then 1 else 0 end)
          over (partition by key order by ts rows unbounded preceding) as n from e),
    g as (select key, min(ts) as first_time, max(ts) as last_time, count(*) as n_seen from s group by key, n)
    select * from g where last_time + interval '1 hour' <= (select max(date_trunc('millisecond', ts)) from events) - interval '1 hour'""",
)
def first_occurrences(spark, sf_dir):
    """Spells of each user that have ended by the end of the log."""
    out = scratch_path(spark, "spells")
    stream = append_to_table(first_occurrences_stream(_logged(spark, sf_dir), "agent", "1 hour", "1 hour"), out)
    stream.awaitTermination()
    return spark.read.parquet(out).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_time", "last_time")})
