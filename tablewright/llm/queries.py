"""The operators of this subpackage as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.chat import fit_roles, format_chats
from tablewright.llm.common import held_out, table, written
from tablewright.llm.decontaminate import find_leaks
from tablewright.llm.middles import fill_in_middle, frame_store
from tablewright.llm.minhash import minhash_components
from tablewright.llm.packing import pack_documents
from tablewright.llm.personal import KINDS, find_personal, fit_field
from tablewright.llm.pivots import PivotIndex, top_products, whole_vectors
from tablewright.llm.quality import fit_quality, score_quality
from tablewright.llm.ranked import ranked_search
from tablewright.llm.secrets import BASE, RULES, find_secrets, span_text
from tablewright.llm.simhash import simhash_components
from tablewright.llm.suffixes import remove_repeats
from tablewright.llm.toxicity import fit_toxicity, score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


@query("op8_quality_classifier")
def quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


@query("op9_simhash_near_dedup")
def simhash_near_dedup(spark, sf_dir):
    parts = simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return parts.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    packed = pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def _found_sql(kind: str, order: int, pattern: str, group: int, least: int, hint: str) -> str:
    """One row for each span of a rule: a match and the text before it are one match of a longer pattern."""
    longer = f"'(.*?)({pattern}|$)'"
    return f"""
        select doc_id, {order} as ord, '{kind}' as kind, unnest(found) as found, unnest(judged) as judged,
               unnest(list_transform(range(1, len(found) + 1), lambda i: coalesce(list_sum(list_transform(before[1:i], lambda x: length(x))), 0)
                   + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0))) as start
        from (select doc_id, regexp_extract_all(coalesce(text, ''), {longer}, 1, 's') as before,
                     regexp_extract_all(coalesce(text, ''), {longer}, 2, 's') as found,
                     regexp_extract_all(coalesce(text, ''), {longer}, {2 + group}, 's') as judged
              from documents where regexp_matches(coalesce(text, ''), '{hint}'))"""


def _kept_sql(rules) -> str:
    parts = [
        _found_sql(r.kind, i, r.pattern.replace("'", "''"), r.group, r.least, (r.hint or r.pattern).replace("'", "''"))
        for i, r in enumerate(rules)
    ]
    return " union all ".join(f"select doc_id, ord, kind, start, start + length(found) as stop from ({p}) where length(judged) >= {r.least}" for p, r in zip(parts, rules, strict=True))


@query(
    "op2_secret_scans",
    f"""
    with found as ({_kept_sql(RULES)}),
    spelled as (select doc_id, ord, kind, start, concat(kind, ':', start::bigint, ':', stop::bigint) as span from found)
    select d.doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
           count(*) filter (kind = 'hex') as n_hex,
           sha256(coalesce(string_agg(span, ',' order by start, ord) filter (ord < 3), '')) as base_sha256,
           coalesce(string_agg(span, ',' order by start, ord), '') as spans
    from documents d left join spelled s on d.doc_id = s.doc_id group by d.doc_id""",
)
def secret_scans(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["ord"] < len(BASE))

    def count(order: int):
        return F.size(F.filter("secrets", lambda s: s["ord"] == order)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("secrets")).alias("spans"))


@query("op1_suffix_array_dedup")
def suffix_array_dedup(spark, sf_dir):
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_benchmark_decontamination")
def benchmark_decontamination(spark, sf_dir):
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


@query(
    "op10_exact_topk_search",
    """
    with v as (
        select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as q from embeddings
        where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
    scored as (
        select a.vec_id as query_id, b.vec_id as vec_id, list_inner_product(a.q, b.q)::bigint as score
        from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
    ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
    select query_id, rank::integer as rank, vec_id, score from ranked where rank <= 10""",
)
def exact_topk_search(spark, sf_dir):
    index = PivotIndex(whole_vectors(table(spark, sf_dir, "embeddings")))
    queries = index.vectors.where("vec_id % 100 = 0") if index.blocks is not None else table(spark, sf_dir, "embeddings")
    return top_products(index, queries, 10)


@query("op4_toxicity_weak_supervision")
def toxicity_weak_supervision(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


@query("op3_pii_semi_markov")
def pii_semi_markov(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal(docs, fit_field(docs))
    names = F.array(*[F.lit(k) for k in KINDS])

    def spelled(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["stop"])), ",")

    def count(kind: int):
        return F.size(F.filter("personal", lambda s: s["base"] & (s["kind"] == kind))).cast("long")

    base = F.sha2(spelled(F.filter("personal", lambda s: s["base"])).cast("binary"), 256)
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, base.alias("base_sha256"), spelled(F.col("personal")).alias("spans"))


@query("op7_chat_formatting")
def chat_formatting(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return format_chats(conversations, fit_roles(conversations))


@query(
    "op11_fill_in_middle",
    """
    with u as (
        select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units,
               sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
    c as (
        select *, len(units)::bigint as n, ('0x' || substr(h, 1, 8))::bigint % (len(units) + 1) as x, ('0x' || substr(h, 9, 8))::bigint % (len(units) + 1) as y,
               case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>')
                      or ('0x' || substr(h, 17, 8))::bigint % 100 >= 90 then 'plain'
                    when ('0x' || substr(h, 25, 8))::bigint % 100 < 20 then 'spm' else 'psm' end as form from u),
    p as (
        select doc_id, text, n, form, array_to_string(units[1:least(x, y)], '') as pre,
               array_to_string(units[least(x, y) + 1:greatest(x, y)], '') as mid, array_to_string(units[greatest(x, y) + 1:], '') as suf from c)
    select doc_id, n, form, case when form <> 'plain' then length(pre)::bigint end as prefix_chars,
           case when form <> 'plain' then length(mid)::bigint end as middle_chars,
           sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
                  else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
           sha256(text) as restored_sha256 from p""",
)
def fill_in_the_middle(spark, sf_dir):
    store = written(frame_store(table(spark, sf_dir, "documents").select("doc_id", "text")), "frames")
    return fill_in_middle(store, texts=False)


_PLAIN = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op12_minhash_near_dedup",
    f"""
    with recursive w as (select doc_id, regexp_extract_all({_PLAIN}, '[^\\x20\\x09-\\x0D]+') as w from documents),
    s as (
        select distinct doc_id, unnest(case when len(w) < 2 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s
        from w),
    size as (select doc_id, count(*) as n from s group by doc_id),
    pairs as (select x.doc_id as a, y.doc_id as b, count(*) as i from s x join s y on x.s = y.s and x.doc_id < y.doc_id group by x.doc_id, y.doc_id),
    links as (select a, b from pairs join size x on x.doc_id = a join size y on y.doc_id = b where 100 * i >= 80 * (x.n + y.n - i)),
    ways as (select a, b from links union all select b, a from links),
    reach(doc_id, root) as (
        select doc_id, doc_id from documents union select ways.b, reach.root from reach join ways on ways.a = reach.doc_id),
    c as (select doc_id, min(root) as component_id from reach group by doc_id)
    select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
    from documents d join c using (doc_id) left join size using (doc_id)""",
)
def minhash_near_dedup(spark, sf_dir):
    return minhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


_TERMS = f"regexp_extract_all({_PLAIN}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@query(
    "op13_ranked_lexical_search",
    f"""
    with d as (select doc_id, {_TERMS} as terms from documents),
    total as (select count(*) filter (len(terms) > 0) as docs, sum(len(terms)) as words from d),
    tf as (select doc_id, len(terms) as n, unnest(terms) as term from d),
    counts as (select doc_id, n, term, count(*) as tf from tf group by doc_id, n, term),
    w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w from counts, total group by term, docs),
    q as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
    scored as (
        select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::bigint as score
        from q join w using (term) join counts using (term), total group by item_id, doc_id),
    ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
    select item_id, rank::integer as rank, doc_id, score from ranked where rank <= 50""",
)
def ranked_lexical_search(spark, sf_dir):
    return ranked_search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
