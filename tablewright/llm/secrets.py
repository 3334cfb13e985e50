"""Secret scans with a trigram inverted index, in DataFrame functions only.

From the syntax tree of each rule's pattern follows a Boolean query of trigrams that every match must contain. Texts are indexed
by the trigrams that some query asks for: postings ``(trigram, key)``. Intersecting the postings leaves the documents that a rule
can match at all; only those are verified with the pattern itself. A rule without mandatory trigrams scans every text.

Defined results: null texts are empty and have no span; rows with a null or repeated id are scanned each; an empty table gives no
rows; other columns pass through, unless they bear the name of a result column, which then replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import forget, small_or_plain, written


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost matches that do not overlap; then those are dropped whose ``group`` is shorter than ``least``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    #: Full scans skip texts that do not match this simpler pattern.
    hint: str | None = None


BASE = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32, hint=r"[0-9a-f]{32}"),
)
#: What the base rules do not know: key files and tokens with a fixed head.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
)
RULES = BASE + MORE

#: Alternatives that a query follows before it takes their trigrams apart.
_MOST_STRINGS = 64


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _either(strings: set[str]) -> frozenset[frozenset[str]]:
    """One of the strings: alternatives of trigrams, all of which are needed. No trigrams in one of them: nothing is needed."""
    sets = {_trigrams(s) for s in strings}
    return frozenset() if frozenset() in sets else frozenset(s for s in sets if not any(o < s for o in sets))


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """All of these, each with one of its alternatives in full: lower-case trigrams that every match contains."""
    needed: set[frozenset[frozenset[str]]] = set()

    def need(strings: set[str]) -> None:
        if alternatives := _either(strings):
            needed.add(alternatives)

    def join(left: set[str], right: set[str] | None) -> set[str]:
        if right is None or len(left) * len(right) > _MOST_STRINGS:
            need(left)
            left = {""}
            if right is None or len(right) > _MOST_STRINGS:
                return left
        return {a + b for a in left for b in right}

    def strings(tree) -> set[str] | None:
        """All strings that the tree matches, if they are few; else what it needs is noted."""
        run, exact = {""}, True
        for op, value in tree:
            if op is sre.LITERAL:
                part = {chr(value).lower()}
            elif op is sre.SUBPATTERN:
                part = strings(value[3])
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in value):
                part = {chr(v).lower() for _, v in value}
            elif op is sre.BRANCH:
                noted = set(needed)
                options = [strings(t) for t in value[1]]
                needed.clear()
                needed.update(noted)  # what one branch needs, the others may not
                part = None if None in options else set().union(*options)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
                low, high, inner = value
                noted = set(needed)
                once = strings(inner)
                if not low:
                    needed.clear()
                    needed.update(noted)
                if (low, high) == (0, 1) and once is not None:
                    part = once | {""}
                elif low == high == 1:
                    part = once
                else:
                    part = None
            elif op is sre.AT:
                continue
            else:
                part = None
            exact = exact and part is not None and len(run) * len(part) <= _MOST_STRINGS
            run = join(run, part)
        if exact:
            return run
        need(run)
        return None

    whole = strings(parser.parse(pattern))
    if whole is not None:
        need(whole)
    return sorted((sorted(alternatives, key=sorted) for alternatives in needed), key=str)


def _holds(trigrams: Column, query: list[list[frozenset[str]]]) -> Column:
    """Whether a document with these trigrams satisfies the query."""
    out = F.lit(True)
    for alternatives in query:
        some = F.lit(False)
        for needed in alternatives:
            every = F.lit(True)
            for t in sorted(needed):
                every = every & F.array_contains(trigrams, t)
            some = some | every
        out = out & some
    return out


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """``(trigram, key)`` for the given lower-case trigrams; ``docs`` has ``key`` and ``text``."""
    wanted = F.array(*[F.lit(t) for t in trigrams])
    return docs.select("key", F.lower("text").alias("low")).select(
        F.explode(F.filter(wanted, lambda t: F.col("low").contains(t))).alias("trigram"), "key"
    )


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(key, rules)``: bit i is set if the document holds all that rule i needs. Rules that need nothing are left out."""
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted({t for q in queries for alternatives in q for needed in alternatives for t in needed})
    if not wanted:
        return docs.select("key", F.lit(0).alias("rules")).limit(0)
    index = written(postings(docs, wanted).distinct(), "postings")
    held = index.groupBy("key").agg(F.collect_set("trigram").alias("held"))
    bits = F.lit(0)
    for i, q in enumerate(queries):
        if q:
            bits = bits + F.when(_holds(F.col("held"), q), 1 << i).otherwise(0)
    found = written(held.select("key", bits.alias("rules")).where("rules <> 0"), "candidates")
    forget(index)
    return found


#: Matches of a text whose places are added up in one go.
CHUNK = 128


def matches(text: Column, rule: Rule, order: int) -> Column:
    """``array<struct<start, ord, stop>>`` of a rule's spans in code points, the end exclusive.

    A match together with the text before it is itself a match of a longer pattern; adding up lengths gives the places.
    """
    longer = f"(?s)(.*?)({rule.pattern}|\\z)"
    before = F.regexp_extract_all(text, F.lit(longer), F.lit(1))
    found = F.regexp_extract_all(text, F.lit(longer), F.lit(2))
    judged = F.regexp_extract_all(text, F.lit(longer), F.lit(2 + rule.group))
    parts = F.arrays_zip(before.alias("before"), found.alias("found"), judged.alias("judged"))
    empty = F.array().cast("array<struct<start:bigint,ord:int,stop:bigint>>")

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["before"])
        stop = start + F.length(part["found"])
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), stop.alias("stop"))
        kept = F.when(F.length(part["judged"]) >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(stop.alias("at"), kept.alias("spans"))

    def spans_from(chunk: Column, at: Column) -> Column:
        return F.aggregate(chunk, F.struct(at.alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])

    def length_of(chunk: Column) -> Column:
        return F.aggregate(chunk, F.lit(0).cast("bigint"), lambda n, p: n + F.length(p["before"]) + F.length(p["found"]))

    def by_chunks(chunks: Column) -> Column:
        starts = F.aggregate(
            F.transform(chunks, length_of),
            F.array(F.lit(0).cast("bigint")),
            lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)),
            lambda acc: F.slice(acc, 1, F.size(acc) - 1),
        )
        return F.flatten(F.zip_with(chunks, starts, spans_from))

    def cut(all_parts: Column) -> Column:
        count = F.ceil(F.size(all_parts) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(all_parts, i * CHUNK + 1, CHUNK))

    # A growing array is copied at each step, so texts of many matches are cut into chunks of parts. ``_once`` binds what is used twice.
    return _once(parts, lambda p: F.when(F.size(p) > CHUNK, _once(cut(p), by_chunks)).otherwise(spans_from(p, F.lit(0).cast("bigint"))))


def _once(value: Column, f) -> Column:
    """``f(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``secrets``: ``array<struct<start, ord, stop>>`` by start, then rule; ``ord`` is the rule's number."""
    docs = docs.drop("secrets")
    # Rows without an id meet under a number of their own.
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    indexed = docs.select(key.alias("key"), text.alias("text"))
    able = candidates(indexed, rules)
    count = able.count()
    able = able.select(F.col("key").alias("__key"), F.col("rules").alias("__rules"))
    joined = docs.join(small_or_plain(able, count), key == F.col("__key"), "left").withColumn("__text", text)
    none = F.array().cast("array<struct<start:bigint,ord:int,stop:bigint>>")
    spans = []
    for i, rule in enumerate(rules):
        if trigram_query(rule.pattern):
            may = F.coalesce(F.col("__rules").bitwiseAND(F.lit(1 << i)) != 0, F.lit(False))
        else:
            may = F.col("__text").rlike(rule.hint or rule.pattern)
        spans.append(F.when(may, matches(F.col("__text"), rule, i)).otherwise(none))
    return joined.withColumn("secrets", F.array_sort(F.concat(*spans))).drop("__key", "__rules", "__text")


def span_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["ord"]], s["start"], s["stop"])), ",")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` masked, overlapping ones together; expects the column ``secrets``, which goes."""

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    masked = F.aggregate("secrets", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"].cast("int") + 1, F.length("text"))))
    return docs.withColumn("text", F.when(F.size("secrets") > 0, masked).otherwise(F.col("text"))).drop("secrets")
