"""Reading, writing and checking tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.registry import bucket_sql, query, table, using, view
from tablewright.operators.ordering import fill_forward, with_row_index
from tablewright.operators.split import sample_fraction
from tablewright.operators.validate import duplicate_rows, validate_table
from tablewright.runtime import scratch_path
from tablewright.sources.chunks import fetch_chunks, notebook_chunks, own_heading, percent_chunks, upsert
from tablewright.sources.csvfiles import read_csv, write_csv
from tablewright.sources.stored import read_stored, upsert_stored
from tablewright.sources.submissions import align_submission, check_submission


@query("csv_roundtrip", "select o_orderkey, concat('é ', o_orderstatus) as status, o_totalprice from orders")
def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    orders = table(spark, sf_dir, "orders").withColumn("status", F.concat(F.lit("é "), "o_orderstatus"))
    write_csv(orders.select("o_orderkey", "status", "o_totalprice", "o_orderpriority"), path, ";", "windows-1252")
    schema = "o_orderkey bigint, status string, o_totalprice double, o_orderpriority string"
    return read_csv(spark, path, schema, ";", "windows-1252", ["o_orderkey", "status", "o_totalprice"])


@query(
    "sample_fraction",
    f"select o_orderkey, o_totalprice from orders where {bucket_sql('o_orderkey', 'sample')} % 10000 < 2000",
)
def sample(spark, sf_dir):
    return sample_fraction(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 0.2)


_CELLS_SQL = """
    with cells as (
        select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as cell_index,
               unnest(string_split(text, chr(10))) as line
        from documents),
    typed as (
        select doc_id, cell_index, case when cell_index % 3 = 0 then 'markdown' else 'code' end as cell_type,
               case when cell_index % 3 = 0 then concat('# ', line) else line end as code, line from cells)
    select concat('doc', cast(doc_id as varchar), '_', cast(cell_index as varchar)) as chunk_id, code,
           concat('doc', cast(doc_id as varchar), '.{extension}') as source, cast(cell_index as int) as cell_index,
           cell_type, last_value(case when cell_type = 'markdown' then regexp_replace(line, '^\\s+|\\s+$', '', 'g') end
                     ignore nulls) over (partition by doc_id order by cell_index
                     rows between unbounded preceding and current row) as heading
    from typed where regexp_replace(code, '\\s+', '', 'g') <> ''"""


def _line_cells():
    """Cells made of a document's lines: every third a heading."""
    return F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            F.when(i % 3 == 0, "markdown").otherwise("code").alias("cell_type"),
            F.when(i % 3 == 0, F.concat(F.lit("# "), line)).otherwise(line).alias("code"),
        ),
    )


@query("notebook_chunks", _CELLS_SQL.format(extension="ipynb"))
def notebooks(spark, sf_dir):
    cells = F.transform(
        _line_cells(), lambda c: F.struct(c["cell_type"].alias("cell_type"), F.array(c["code"]).alias("source"))
    )
    files = table(spark, sf_dir, "documents").select(
        F.format_string("/notebooks/doc%d.ipynb", "doc_id").alias("path"),
        F.to_json(F.struct(cells.alias("cells"))).alias("content"),
    )
    return notebook_chunks(files)


@query("percent_chunks", _CELLS_SQL.format(extension="py"))
def scripts(spark, sf_dir):
    cells = F.transform(
        _line_cells(), lambda c: F.concat(F.lit("# %% ["), c["cell_type"], F.lit("]\n"), c["code"], F.lit("\n"))
    )
    files = table(spark, sf_dir, "documents").select(
        F.format_string("/scripts/doc%d.py", "doc_id").alias("path"), F.array_join(cells, "\n").alias("content")
    )
    return percent_chunks(files)


@query(
    "heading_fill",
    using("fx_headings")
    + """, own as (select conv_id, turn, cell_type, case when cell_type = 'markdown'
          then regexp_replace(substr(string_split(code, chr(10))[1], 3), '^\\s+|\\s+$', '', 'g') end as h from fx_headings)
      select conv_id, turn, cell_type, last_value(h ignore nulls) over (partition by conv_id order by turn
             rows between unbounded preceding and current row) as heading from own""",
)
def heading_fill(spark, sf_dir):
    cells = view(spark, sf_dir, "fx_headings")
    own = cells.withColumn("own", F.when(F.col("cell_type") == "markdown", own_heading(F.col("code"))))
    return fill_forward(own, "conv_id", "turn", "own", "heading").select("conv_id", "turn", "cell_type", "heading")


@query(
    "chunk_upsert",
    """with writes as (select doc_id as id, text as code, source, 0 as seq from documents
        union all select doc_id, concat(text, ' (edited)'), source, 1 from documents where lang = 'en')
    select id, code, source, seq from (select *, row_number() over (partition by id order by seq desc) as rn from writes)
    where rn = 1""",
)
def chunk_upsert(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    first = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("code"), "source", F.lit(0).alias("seq"))
    edited = first.where(F.col("id").isNotNull() & (docs["lang"] == "en")).select(
        "id", F.concat("code", F.lit(" (edited)")).alias("code"), "source", F.lit(1).alias("seq")
    )
    return upsert(first.unionByName(edited), "id", "seq")


@query(
    "stored_upsert",
    """with writes as (select doc_id as id, text as code, source, 0 as seq from documents
        union all select doc_id, concat(text, ' (edited)'), source, 1 from documents where lang = 'en'
        union all select doc_id, concat(text, ' (again)'), source, 2 from documents where doc_id % 97 = 0)
    select id, code, source, seq from (select *, row_number() over (partition by id order by seq desc) as rn from writes)
    where rn = 1""",
)
def stored_upsert(spark, sf_dir):
    """Three batches into one stored table; each rewrites the buckets of its keys."""
    docs, path = table(spark, sf_dir, "documents"), scratch_path(spark, "stored")
    first = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("code"), "source", F.lit(0).alias("seq"))

    def edited(rows, mark, number):
        return rows.select("id", F.concat("code", F.lit(mark)).alias("code"), "source", F.lit(number).alias("seq"))

    for batch in (first, edited(first.where(docs["lang"] == "en"), " (edited)", 1), edited(first.where("id % 97 = 0"), " (again)", 2)):
        upsert_stored(batch, path, "id", "seq", 32)
    return read_stored(spark, path)


@query(
    "chunk_fetch",
    using("fx_chunks") + "select * from fx_chunks where chunk_id in (select doc_id from labels where quality = 1)",
)
def chunk_fetch(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("chunk_id"))
    return fetch_chunks(view(spark, sf_dir, "fx_chunks"), ids)


@query(
    "with_row_index",
    'select o_orderkey, o_totalprice as prediction, row_number() over (order by o_orderkey) - 1 as "index" from orders',
)
def row_index(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("prediction"))
    return with_row_index(orders, "o_orderkey")


@query(
    "submission_align",
    using("fx_model") + "select o_orderkey as id, revenue as target from orders left join fx_model on row_id = o_orderkey",
)
def submission_align(spark, sf_dir):
    sample = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(0.0).alias("target"))
    scored = view(spark, sf_dir, "fx_model").select("row_id", F.col("revenue").alias("prediction"))
    return align_submission(scored, "row_id", sample=sample, sample_key="id", sample_target="target")


@query(
    "submission_check",
    using("fx_model")
    + """select 'columns' as "check", true as passed, 'id,target' as detail union all
    select 'rows', (select count(*) from fx_model) = (select count(*) from orders),
           concat(cast((select count(*) from fx_model) as varchar), '/', cast((select count(*) from orders) as varchar))""",
)
def submission_check(spark, sf_dir):
    sample = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(0.0).alias("target"))
    scored = view(spark, sf_dir, "fx_model").select(F.col("row_id").alias("id"), F.col("revenue").alias("target"))
    return check_submission(scored, sample)


@query(
    "validate_table",
    using("fx_orders_nulls")
    + """, s as (select count(*) as n, count(distinct o_totalprice) + max(cast(o_totalprice is null as int)) as u,
           cast(count(o_orderkey) = 0 as int) + cast(count(o_custkey) = 0 as int) + cast(count(o_orderstatus) = 0 as int)
           + cast(count(o_totalprice) = 0 as int) + cast(count(dup_of_total) = 0 as int)
           + cast(count(o_orderpriority) = 0 as int) + cast(count(empty_col) = 0 as int)
           + cast(count(const_col) = 0 as int) as e from fx_orders_nulls),
         d as (select count(*) as k from (select distinct * from fx_orders_nulls))
    select 'column_limit' as "check", 'error' as severity, cast(8 as bigint) as value, true as passed
    union all select 'unique_names', 'error', 0, true
    union all select 'target_present', 'error', 1, true
    union all select 'not_empty', 'error', n, n > 0 from s
    union all select 'row_limit', 'warning', n, n <= 2000000 from s
    union all select 'enough_rows', 'warning', n, n >= 20 from s
    union all select 'no_empty_columns', 'warning', e, e = 0 from s
    union all select 'no_duplicate_rows', 'warning', n - k, n - k = 0 from s, d
    union all select 'target_varies', 'error', u, u >= 2 from s""",
)
def validate(spark, sf_dir):
    return validate_table(view(spark, sf_dir, "fx_orders_nulls"), "o_totalprice")


@query(
    "duplicate_rows",
    "select count(*) - (select count(*) from (select distinct l_orderkey, l_linenumber, l_returnflag from lineitem)) "
    "as duplicate_rows from lineitem",
)
def duplicates(spark, sf_dir):
    return duplicate_rows(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))
