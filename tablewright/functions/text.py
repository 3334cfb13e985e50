"""Tokens of code and prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as a token. A run of letters and digits gives its camel-case words; if it has none
# (digits, or capitals each followed by a digit) it is a token as a whole. Digits next to words are dropped.
TOKEN = (
    r"[A-Z]?[a-z]+"
    r"|[A-Z]+(?=[A-Z]|(?![a-zA-Z0-9]))"
    r"|(?<![a-zA-Z0-9])(?:[A-Z]?[0-9])+(?![a-zA-Z0-9])"
)


def raw_tokens(text: Column) -> Column:
    """Tokens in order, case kept; lower them after exploding, where it is one plain expression per row."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def tokenize(text: Column) -> Column:
    return F.transform(raw_tokens(text), F.lower)
