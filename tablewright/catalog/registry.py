"""Where queries and their SQL are collected, and the views both sides start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# The same text runs in Spark SQL and in DuckDB.
VIEWS = {
    "fx_orders_nulls": """
        select o_orderkey, o_custkey, o_orderstatus,
               case when o_orderpriority = '4-NOT SPECIFIED' then null else o_totalprice end as o_totalprice,
               case when o_orderpriority = '4-NOT SPECIFIED' then null else o_totalprice end as dup_of_total,
               case when o_orderpriority = '3-MEDIUM' then null else o_orderpriority end as o_orderpriority,
               cast(null as double) as empty_col, 1 as const_col
        from orders""",
    "fx_model": """
        select o.o_orderkey as row_id, count(*) as n_lines, sum(l_quantity) as sum_qty,
               round(avg(l_discount), 6) as avg_disc, round(avg(l_tax), 6) as avg_tax, min(o_orderpriority) as priority,
               round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue
        from orders o join lineitem l on o.o_orderkey = l.l_orderkey group by o.o_orderkey""",
    "fx_places": """
        select s_suppkey as place_id, s_name as place, cast(s_suppkey * 7919 % 12000 as double) / 100 - 60 as lat,
               cast(s_suppkey * 104729 % 34000 as double) / 100 - 170 as lon,
               cast(floor(case when s_acctbal > 0 then s_acctbal else 0 end * 100) as bigint) as pop from supplier""",
    "fx_points": """
        select c_custkey as point_id, c_nationkey, cast(c_custkey * 3701 % 12000 as double) / 100 - 59.997 as lat,
               cast(c_custkey * 91193 % 34000 as double) / 100 - 169.995 as lon from customer""",
    "fx_items": "select p_partkey as row_id, replace(p_name, ' ', ',') as items, p_retailprice as target from part",
    "fx_chunks": """
        select doc_id as chunk_id, text as code, source, lang as cell_type, n_chars as cell_index,
               case when lang = 'en' then null else concat('text in ', lang) end as heading from documents""",
    "fx_queries": "select item_id as query_id, text as q from benchmark",
    "fx_classes": """
        select l.doc_id as row_id, l.quality as y, l.toxic as toxic,
               case when d.n_chars % 3 = 0 then 1 - l.quality else l.quality end as pred,
               cast(d.n_chars % 101 as double) as score, d.n_chars as n_chars, length(d.source) as source_len, d.lang as lang
        from labels l join documents d on l.doc_id = d.doc_id""",
    "fx_errors": """
        select event_id, concat(case event_type when 'error' then 'ValueError: ' when 'purchase' then 'RuntimeException: '
               else 'note ' end, 'user ', cast(user_id as varchar(20))) as line from events""",
    "fx_code": """
        select conv_id, turn, case when role = 'assistant' then concat('see ', chr(96), chr(96), chr(96), 'python', chr(10),
               text, chr(10), chr(96), chr(96), chr(96)) else text end as response from conversations""",
    "fx_headings": """
        select conv_id, turn, case when role = 'user' then 'markdown' else 'code' end as cell_type,
               case when role = 'user' then concat('# ', text) else text end as code from conversations""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    for base in BASE:
        if f" {base}" in text:
            table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(text)


def using(*names: str) -> str:
    """SQL prefix that defines views."""
    return "with " + ", ".join(f"{n} as ({VIEWS[n]})" for n in names) + " "


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)`` under ``name``, with SQL giving the same rows where there is one."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, **per_name: int) -> DataFrame:
    """Round double columns, so that the order of float additions does not show (nor the sign of a zero)."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), per_name.get(f.name, digits)) + 0.0).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def bucket_sql(key: str, salt: str = "") -> str:
    """The key hash as DuckDB spells it."""
    text = f"cast({key} as varchar)"
    if salt:
        text = f"concat('{salt}|', {text})"
    return f"cast(('0x' || substr(md5({text}), 1, 8)) as bigint)"
