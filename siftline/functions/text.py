"""Scalar expressions over text: lines, tokens, hashes, budgets, coverage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
BUDGETS = {"small": 256, "medium": 512, "large": 1024}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lines_of(text: Column | str) -> Column:
    """Lines without their ends; CRLF counts as one end, a final end opens no line, '' has none; null stays null."""
    t = _c(text)
    parts = F.split(F.regexp_replace(t, "\r\n", "\n"), "\n", -1)
    kept = F.when(F.endswith(t, F.lit("\n")), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.when(t.isNull(), None).when(t == "", F.array().cast("array<string>")).otherwise(kept)


def tokens_of(text: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN), F.lit(0))


def sha16(value: Column | str) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(_c(value).cast("binary"), 256), 1, 16)


def chunk_id(path: Column | str, start: Column | str, end: Column | str) -> Column:
    return sha16(F.concat(_c(path), F.lit(":"), _c(start).cast("string"), F.lit("-"), _c(end).cast("string")))


def djb2(value: Column | str) -> Column:
    """h = 33 h + byte from 5381, modulo 2^64, as decimal(20,0)."""
    raw = F.hex(_c(value).cast("binary"))
    codes = F.transform(F.sequence(F.lit(1), (F.length(raw) / 2).cast("int")), lambda i: F.conv(F.substr(raw, (i * 2 - 1).cast("int"), F.lit(2)), 16, 10).cast("decimal(38,0)"))
    codes = F.when(F.length(raw) > 0, codes).otherwise(F.array().cast("array<decimal(38,0)>"))
    wide = F.lit("18446744073709551616").cast("decimal(38,0)")
    folded = F.aggregate(codes, F.lit(5381).cast("decimal(38,0)"), lambda h, c: F.pmod((h * F.lit(33).cast("decimal(4,0)")).cast("decimal(38,0)") + c, wide).cast("decimal(38,0)"))
    return folded.cast("decimal(20,0)")


def token_estimate(text: Column | str) -> Column:
    """Bytes over four, rounded down."""
    return F.floor(F.octet_length(_c(text)) / 4).cast("long")


def budget_tokens(budget: Column | str) -> Column:
    """Named or numeric token budget; anything else is medium."""
    b = F.lower(F.trim(_c(budget)))
    number = F.when(b.rlike("^[0-9]{1,9}$"), b.try_cast("long"))
    return F.coalesce(*[F.when(b == k, F.lit(v).cast("long")) for k, v in BUDGETS.items()], number, F.lit(BUDGETS["medium"]).cast("long"))


def budget_chars(budget: Column | str) -> Column:
    return budget_tokens(budget) * 4


def budget_overlap(budget: Column | str) -> Column:
    return F.floor(budget_chars(budget) / 4).cast("long")


def query_terms(query: str, least: int = 2) -> list[str]:
    """Distinct lower-case tokens of a query, in order, of at least so many bytes."""
    import re

    found = re.findall(r"[^\W_]+", query.lower())
    return list(dict.fromkeys(w for w in found if len(w.encode()) >= least))


def coverage(query: str, content: Column | str) -> Column:
    """Share of the query's words (longer than one byte) that the content contains."""
    words = [w for w in query.lower().split() if len(w.encode()) > 1]
    if not words:
        return F.lit(0.0)
    low = F.lower(_c(content))
    return sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)).cast("double") / float(len(words))


def parse_timestamp(text: Column | str) -> Column:
    """Epoch seconds from epoch seconds, RFC 3339 or a date (UTC); null if none of these."""
    t = F.trim(_c(text))
    whole = F.unix_timestamp(F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    return F.coalesce(t.try_cast("long"), whole, F.unix_timestamp(F.try_to_timestamp(t, F.lit("yyyy-MM-dd"))))


def stable_score(score: Column) -> Column:
    """Scores rounded to six digits, so that order does not hang on the order of summation."""
    return F.round(score, 6)
