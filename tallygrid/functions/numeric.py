"""Column expressions for numbers written in financial tables.

``compat=True`` keeps the observable behaviour users may rely on,
including its oddities; ``compat=False`` (default) repairs them (see README, "Compatibility").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: unit words in the order they are tried, and their scale -------
UNIT_SCALES = {
    "billion": 1_000_000_000,
    "bn": 1_000_000_000,
    "b": 1_000_000_000,
    "million": 1_000_000,
    "mn": 1_000_000,
    "m": 1_000_000,
    "k": 1_000,
    "thousand": 1_000,
    "'000": 1_000,
    "000": 1_000,
}

# --- fixed values: currency codes and the patterns that reveal them, in order ----
# (patterns run on lower-cased text)
CURRENCY_PATTERNS = {
    "SGD": r"\bsgd\b|s\$",
    "USD": r"\busd\b|us\s*dollar|(^|[^a-z])\$",
    "RM": r"\brm\b|\bmyr\b|ringgit",
    "EUR": r"\beur\b|euro|€",
    "GBP": r"\bgbp\b|£|\bpound\b|sterling",
    "AUD": r"\baud\b|a\$",
    "CAD": r"\bcad\b|c\$",
    "HKD": r"\bhkd\b|hk\$",
    "JPY": r"\bjpy\b|¥|yen",
    "CNY": r"\bcny\b|rmb|yuan",
    "IDR": r"\bidr\b|rupiah",
    "THB": r"\bthb\b|baht",
    "PHP": r"\bphp\b|peso",
    "VND": r"\bvnd\b|dong",
}

# --- fixed values: cell-type patterns -------------------------------------------
YEAR = r"^(19|20)\d{2}$"
NOTE = r"(?i)^(note|notes)$"
UNIT_HEADER = r"(?i)(rm|usd|sgd|eur|gbp|'000|million|billion)"
NUMERIC_CHARS = "0123456789,.-+()%$£€¥ \t\n\r\x0b\x0c"
UNIT_TOKENS = r"(?i)\b(rm|usd|sgd|eur|gbp|myr)\b|'000|\b(billion|million|thousand|bn|mn)\b"
PLAIN_AMOUNT = r"^(?:[0-9][0-9,]*|\([0-9][0-9,]*\))$"
SUFFIX = r"\d[\d,\.]*\s*(bn|b|mn|m|k)"
SUFFIX_STRICT = r"\d[\d,\.]*\s*(bn|b|mn|m|k)\b"

# --- fixed values: evaluation suffixes, longest-shadowed-first as they are tried --
EVAL_SUFFIXES = [
    ("k", 1e3), ("K", 1e3), ("m", 1e6), ("M", 1e6), ("mn", 1e6), ("Mn", 1e6), ("MM", 1e6),
    ("b", 1e9), ("B", 1e9), ("bn", 1e9), ("Bn", 1e9),
    ("t", 1e12), ("T", 1e12), ("tn", 1e12), ("Tn", 1e12),
]
EVAL_SYMBOLS = r"\$|£|€|¥|₹|USD|GBP|EUR|JPY|CNY"
EVAL_NIL = ("", "-", "--", "nil", "Nil", "NIL", "n/a", "N/A")

_FLOAT = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"


def strip(text: Column) -> Column:
    """Trim all white space at both ends (``trim`` alone removes blanks only)."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def to_double(text: Column) -> Column:
    """Parse text that is a plain decimal number, else null."""
    return F.when(text.rlike(_FLOAT), text.try_cast("double"))


def plain_amount(text: Column) -> Column:
    """Digits and separators, bracketed or not: one cheap test that most amounts pass."""
    return text.rlike(PLAIN_AMOUNT)


def cell_type(text: Column, compat: bool = False) -> Column:
    """empty / year / note / unit_header / numeric / header / text."""
    s = strip(text)
    has_digit = s.rlike(r"\d")
    counted = s if compat else F.regexp_replace(s, UNIT_TOKENS, "")
    leftover = F.length(F.translate(counted, NUMERIC_CHARS, ""))
    bare = F.regexp_replace(s, "'?000", "")
    return (
        F.when(text.isNull() | (text == ""), "empty")
        .when(plain_amount(text), F.when(text.rlike(YEAR), "year").otherwise("numeric"))
        .when(s == "", "empty")
        .when(s.rlike(YEAR), "year")
        .when(s.rlike(NOTE), "note")
        .when(s.rlike(UNIT_HEADER) & ~bare.rlike(r"\d"), "unit_header")
        .when(has_digit & (leftover <= 2), "numeric")
        .when(~has_digit & (F.length(s) < 20), "header")
        .otherwise("text")
    )


def currency(text: Column, compat: bool = False) -> Column:
    """Code of the first currency whose pattern occurs, else null."""
    s = F.lower(text)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    if not compat:
        out = out.when(s.rlike(r"us\$"), "USD")
    for code, pattern in CURRENCY_PATTERNS.items():
        out = out.when(s.rlike(pattern), code)
    return out


def unit(text: Column, compat: bool = False) -> Column:
    """Name of the unit (``'000``, ``million``, ``k`` ...), else null."""
    s = F.lower(text)
    out = F.when(F.instr(s, "'000") > 0, "'000")
    for word in UNIT_SCALES:
        if word == "'000" or (word == "000" and not compat):
            continue
        out = out.when(s.rlike(rf"\b{word}\b"), word)
    suffix = F.regexp_extract(s, SUFFIX if compat else SUFFIX_STRICT, 1)
    return out.when(suffix != "", suffix)


def bare_number(text: Column) -> Column:
    """Nothing but digits, separators, signs and brackets: no currency, no unit word.

    Most amounts look like this, and the test is one pass over the text where the
    currency and unit patterns would be two dozen.
    """
    return F.translate(text, "0123456789,.-+() ", "") == ""


def unit_scale(unit_name: Column) -> Column:
    out = F.when(unit_name.isNull(), F.lit(1).cast("bigint"))
    for scale in sorted(set(UNIT_SCALES.values())):
        out = out.when(unit_name.isin([u for u, v in UNIT_SCALES.items() if v == scale]), scale)
    return out.cast("bigint")


def unit_header(text: Column, compat: bool = False) -> Column:
    """STRUCT<currency, scale, unit> of a header cell such as ``RM'000``."""
    u = unit(text, compat)
    return F.struct(
        currency(text, compat).alias("currency"), unit_scale(u).alias("scale"), u.alias("unit")
    )


def first_number(text: Column) -> Column:
    """First decimal number once thousand separators are gone."""
    cleaned = F.translate(text, ",'", "")
    return F.regexp_extract(cleaned, r"[-+]?\d+(?:\.\d+)?", 0).try_cast("double")


def unsigned(text: Column) -> Column:
    """Text without enclosing brackets, leading sign and trailing minus."""
    s = strip(text)
    s = F.when(s.contains("(") & s.contains(")"), F.translate(s, "()", "")).otherwise(s)
    return F.regexp_replace(F.regexp_replace(s, r"^[-+]", ""), "-$", "")


def is_negative(text: Column) -> Column:
    s = strip(text)
    bracketed = s.contains("(") & s.contains(")")
    inner = F.when(bracketed, F.translate(s, "()", "")).otherwise(s)
    return bracketed | inner.startswith("-") | F.regexp_replace(inner, r"^[-+]", "").endswith("-")


def money_text(value: Column, currency_code: Column) -> Column:
    """``CUR 1,234`` — no decimals for whole numbers, else two."""
    number = F.when(value == F.floor(value), F.format_number(value, 0)).otherwise(
        F.format_number(value, 2)
    )
    return F.when(currency_code.isNull(), number).otherwise(
        F.concat(currency_code, F.lit(" "), number)
    )


# --- evaluation parsers ----------------------------------------------------------


def evaluation_numbers(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``value`` and ``error`` with suffix, percent and nil handling.

    Written as steps over columns: each step reads the one before several times, so a
    single nested expression would grow out of hand.
    """
    t, s, b, stem = F.col(text), F.col("_s"), F.col("_b"), F.col("_stem")
    bracketed = s.startswith("(") & s.endswith(")")
    body = (
        F.when(bracketed, F.expr("substring(_s, 2, length(_s) - 2)"))
        .when(s.startswith("-"), F.expr("substring(_s, 2)"))
        .when(s.endswith("-"), F.expr("substring(_s, 1, length(_s) - 1)"))
        .otherwise(s)
    )
    scale, cut = F.when(F.lit(False), F.lit(1.0)), F.when(F.lit(False), F.lit(0))
    for suffix, factor in EVAL_SUFFIXES:
        scale = scale.when(b.endswith(suffix), factor)
        cut = cut.when(b.endswith(suffix), len(suffix))
    number = F.when(F.col("_percent"), F.col("_n") / 100.0).otherwise(F.col("_n"))
    return (
        df.withColumn("_s", strip(t))
        .withColumn("_neg", bracketed | s.startswith("-") | s.endswith("-"))
        .withColumn("_b", strip(F.regexp_replace(strip(body), EVAL_SYMBOLS, "")))
        .withColumn("_percent", b.endswith("%"))
        .withColumn("_b", F.when(F.col("_percent"), strip(F.regexp_replace(b, "%$", ""))).otherwise(b))
        .withColumn("_scale", scale.otherwise(1.0))
        .withColumn("_cut", cut.otherwise(0))
        .withColumn("_stem", F.translate(F.expr("substring(_b, 1, length(_b) - _cut)"), ", ", ""))
        .withColumn("_n", to_double(stem) * F.col("_scale"))
        .withColumn(
            "value",
            F.when(stem.isin(*EVAL_NIL), 0.0).when(F.col("_neg"), -number).otherwise(number),
        )
        .withColumn(
            "error",
            F.when(t.isNull() | (t == ""), "empty_input")
            .when(s == "", "empty_after_strip")
            .when(F.col("value").isNull(), "parse_error")
            .otherwise(""),
        )
        .withColumn("value", F.when(F.col("error") == "", F.col("value")))
        .drop("_s", "_neg", "_b", "_percent", "_scale", "_cut", "_stem", "_n")
    )


def gt_number(text: Column) -> Column:
    """Plain ground-truth parse: brackets or leading minus, commas dropped."""
    s = strip(text)
    bracketed = s.startswith("(") & s.endswith(")")
    negative = bracketed | s.startswith("-")
    body = F.when(bracketed, F.regexp_replace(s, r"^\(|\)$", "")).otherwise(
        F.regexp_replace(s, "^-", "")
    )
    number = to_double(strip(F.regexp_replace(body, ",", "")))
    return F.when(negative, -number).otherwise(number)


def lenient_number(text: Column) -> Column:
    """First number in a raw cell; dashes are null, brackets negative."""
    s = strip(text)
    bracketed = s.contains("(") & s.contains(")")
    body = F.when(bracketed, F.translate(s, "()", "")).otherwise(s)
    number = F.regexp_extract(
        F.regexp_replace(body, "[$€£¥₹,]", ""), r"[-+]?\d+\.?\d*", 0
    ).try_cast("double")
    return F.when(
        ~s.isin("", "-", "—"), F.when(bracketed, -number).otherwise(number)
    )


def strict_number(text: Column, percent: bool = False, drop: str = r",\s$£€¥") -> Column:
    """STRUCT<value, ok>: whole-cell parse, ok is false when it is not a number.

    Blank and dash cells are valid without a value.  ``drop`` is the character class
    removed first; with ``percent`` a cell holding ``%`` is divided by 100.
    """
    s = strip(text)
    bracketed = s.startswith("(") & s.endswith(")")
    body = F.when(bracketed, F.regexp_replace(s, r"^\(|\)$", "")).otherwise(s)
    body = F.regexp_replace(body, f"[{drop}]", "")
    if percent:
        has_percent = body.contains("%")
        number = to_double(F.regexp_replace(body, "%", ""))
        number = F.when(has_percent, number / 100.0).otherwise(number)
    else:
        number = to_double(body)
    number = F.when(bracketed, -number).otherwise(number)
    blank = text.isNull() | s.isin("", "-", "–", "—")
    return F.struct(
        F.when(~blank, number).alias("value"), (blank | number.isNotNull()).alias("ok")
    )


# --- answers ----------------------------------------------------------------------


def answer_key(text: Column, drop: str = r" ',") -> Column:
    """Comparable answer: separators dropped, ``(x)`` to ``-x``, lower case."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{drop}]", "")
    return F.lower(F.regexp_replace(s, r"^\((.*)\)$", "-$1"))


def two_decimals(text: Column) -> Column:
    """Two-decimal form of a number (brackets as minus), other text unchanged."""
    cleaned = F.regexp_replace(F.lower(strip(text)), r"[,$%)]", "")
    cleaned = F.replace(cleaned, F.lit("("), F.lit("-"))
    number = to_double(cleaned)
    return F.when(number.isNull(), cleaned).otherwise(F.format_string("%.2f", number))


def answer_number(text: Column) -> Column:
    """Number in a free-text answer after dropping RM, USD, $ and separators."""
    s = strip(F.regexp_replace(F.regexp_replace(text, "[,' ]", ""), r"RM|\$|USD", ""))
    return to_double(F.regexp_replace(s, r"^\((.*)\)$", "-$1"))


def same_answer(pred: Column, gt: Column, drop: str = r" ',") -> Column:
    """Equal once separators, brackets and case are normalised."""
    return answer_key(pred, drop) == answer_key(gt, drop)


def near_answer(pred: Column, gt: Column, tolerance: float = 0.001) -> Column:
    """Equal, or numerically closer than the relative tolerance."""
    p, g = to_double(answer_key(pred)), to_double(answer_key(gt))
    gap = F.when(g == 0, F.abs(p)).otherwise(F.abs(p - g) / F.abs(g))
    return same_answer(pred, gt) | F.coalesce(gap < tolerance, F.lit(False))


def same_amount(pred: Column, gt: Column, tolerance: float = 0.01) -> Column:
    """Equal digits and signs, or amounts closer than the absolute tolerance."""

    def key(c: Column) -> Column:
        kept = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\d.\-()]", "")
        return F.regexp_replace(kept, r"^\((.*)\)$", "-$1")

    p, g = key(pred), key(gt)
    near = F.abs(to_double(p) - to_double(g)) < tolerance
    return (p == g) | F.coalesce(near, F.lit(False))
