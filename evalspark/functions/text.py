"""String expressions shared by the loaders, the lints and the reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from evalspark.constants import FALSE_WORDS, TRUE_WORDS

# The characters that count as white space at the ends of a field.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
FIRST_TOKEN_PATTERN = r"\A[^\t-\r\x1c-\x20\x{85}\p{Z}]+"

# SQL comments, blind to string literals: the lint is a backstop, not a parser.
SQL_COMMENT_PATTERN = r"(--[^\n]*)|((?s:/\*.*?\*/))"
WRITE_AFTER_WITH_PATTERN = r"(?i)\A\s*with\b[\s\S]*\)\s*insert\b"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE_SPACE))


def clean(text: Column) -> Column:
    """Missing cell to '', then strip."""
    return strip(F.coalesce(text, F.lit("")))


def parse_flag(text: Column, default: bool = False) -> Column:
    """Y/N words to boolean; a missing cell gives ``default``, junk gives null."""
    word = F.lower(strip(text))
    return (
        F.when(text.isNull(), F.lit(default))
        .when(word.isin(*FALSE_WORDS), F.lit(False))
        .when(word.isin(*TRUE_WORDS), F.lit(True))
    )


def parse_list(text: Column) -> Column:
    """Comma list to an array of stripped, non-empty items."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), ","), strip)
    return F.filter(items, lambda item: item != "")


def percent(rate: Column) -> Column:
    """A rate as whole percent, half-even."""
    return F.concat(F.bround(rate * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def signed_percent(rate: Column) -> Column:
    sign = F.when(rate < 0, F.lit("-")).otherwise(F.lit("+"))
    return F.concat(sign, percent(F.abs(rate)))


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text of a double, rounded from its exact binary value, ties to even.

    The product with the power of ten is itself rounded, which matters only when
    it lands on a tie. Its rounding error (Dekker's exact product) then says on
    which side the true value lies.
    """
    scale = 10**digits
    size = F.abs(value.cast("double"))
    product = size * scale
    high = size * 134217729.0 - (size * 134217729.0 - size)
    error = (high * scale - product) + (size - high) * scale
    base = F.floor(product)
    over = product - base
    up = (over > 0.5) | ((over == 0.5) & ((error > 0) | ((error == 0) & (base % 2 == 1))))
    units = base + F.when(up, 1).otherwise(0)
    text = F.floor(units / scale).cast("string")
    if digits:
        text = F.concat(text, F.lit("."), F.lpad((units % scale).cast("string"), digits, "0"))
    return F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), text)


def preview(text: Column, size: int) -> Column:
    return F.when(
        F.char_length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))
    ).otherwise(text)


def read_only_reason(sql: Column) -> Column:
    """Why a SQL text is refused as a read query; null when it may run."""
    bare = strip(F.regexp_replace(sql, SQL_COMMENT_PATTERN, " "))
    body = F.when(F.endswith(bare, F.lit(";")), strip(F.regexp_replace(bare, r";\z", ""))).otherwise(bare)
    rest = F.when(F.instr(body, ";") > 0, strip(F.regexp_replace(body, r"\A[^;]*;", "")))
    first = F.upper(F.regexp_extract(body, FIRST_TOKEN_PATTERN, 0))
    return (
        F.when(body == "", F.lit("empty SQL"))
        .when(rest != "", F.lit("multi-statement queries not allowed"))
        .when(
            ~first.isin("SELECT", "WITH"),
            F.concat(F.lit("only SELECT/WITH queries are allowed; got '"), first, F.lit("'")),
        )
        .when(body.rlike(WRITE_AFTER_WITH_PATTERN), F.lit("WITH must not lead into a write"))
    )
