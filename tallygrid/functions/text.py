"""Column expressions for labels and recognised text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions import edits
from tallygrid.functions.numeric import strip

# --- fixed values: canonical field per normalised label ---------------------------
ALIASES = {
    "turnover": "revenue",
    "sales": "revenue",
    "revenue": "revenue",
    "total revenue": "revenue",
    "pbt": "profit_before_tax",
    "profit before tax": "profit_before_tax",
    "ebt": "profit_before_tax",
    "ebit": "ebit",
    "ebitda": "ebitda",
    "pat": "net_income",
    "net profit": "net_income",
    "net income": "net_income",
    "profit after tax": "net_income",
    "operating profit": "operating_profit",
    "operating income": "operating_profit",
    "total assets": "assets_total",
    "assets": "assets_total",
    "total liabilities": "liabilities_total",
    "liabilities": "liabilities_total",
    "equity": "equity_total",
    "shareholders equity": "equity_total",
}

# --- fixed values: misread words and what they stand for --------------------------
OCR_FIXES = {
    "otal": "Total",
    "perating": "Operating",
    "ncome": "Income",
    "evenue": "Revenue",
    "xpenses": "Expenses",
    "rofit": "Profit",
    "ssets": "Assets",
    "iabilities": "Liabilities",
    "quity": "Equity",
    "ash": "Cash",
    "ctivities": "Activities",
    "nvesting": "Investing",
    "inancing": "Financing",
    "lows": "Flows",
    "et": "Net",
    "ross": "Gross",
    "ost": "Cost",
    "oods": "Goods",
    "old": "Sold",
    "hird": "Third",
    "irst": "First",
    "econd": "Second",
    "ourth": "Fourth",
    "ntangible": "Intangible",
    "angible": "Tangible",
    "eferred": "Deferred",
    "tatutory": "Statutory",
    "eposits": "Deposits",
    "nvestment": "Investment",
    "roperty": "Property",
    "quipment": "Equipment",
    "oodwill": "Goodwill",
    "erivative": "Derivative",
    "oans": "Loans",
    "dvances": "Advances",
    "rassets": "assets",
    "rasset": "asset",
    "ther": "Other",
    "otal assets": "Total assets",
    "otal liabilities": "Total liabilities",
    "otal equity": "Total equity",
}

# --- fixed values: misread spellings replaced anywhere, in this order --------------
OCR_SPELLINGS = {
    "Oroup": "Group",
    "oroup": "group",
    "S'000": "$'000",
    "S'00O": "$'000",
    "curent": "current",
    "Non-curent": "Non-current",
}

# --- fixed values: known line items of financial statements ------------------------
FINANCIAL_TERMS = [
    "cash and short-term funds",
    "cash and cash equivalents",
    "reverse repurchase agreements",
    "deposits and placements",
    "financial investments",
    "debt instruments",
    "equity instruments",
    "derivative financial instruments",
    "loans and advances",
    "loans, advances and financing",
    "other assets",
    "tax recoverable",
    "deferred tax assets",
    "statutory deposits",
    "investment in associates",
    "investment in joint ventures",
    "property, plant and equipment",
    "right-of-use assets",
    "investment properties",
    "goodwill",
    "intangible assets",
    "non-current assets held for sale",
    "total assets",
    "deposits from customers",
    "deposits and placements of banks",
    "obligations on securities",
    "derivative financial liabilities",
    "bills and acceptances payable",
    "other liabilities",
    "provisions",
    "current tax liabilities",
    "deferred tax liabilities",
    "borrowings",
    "subordinated obligations",
    "total liabilities",
    "share capital",
    "reserves",
    "retained earnings",
    "equity attributable to owners",
    "non-controlling interests",
    "total equity",
    "interest income",
    "interest expense",
    "net interest income",
    "fee and commission income",
    "fee and commission expense",
    "net fee and commission income",
    "other operating income",
    "total operating income",
    "personnel expenses",
    "other operating expenses",
    "total operating expenses",
    "operating profit",
    "allowance for impairment",
    "profit before tax",
    "tax expense",
    "profit for the year",
    "net profit",
    "earnings per share",
]


def lookup(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def words(text: Column) -> Column:
    """White-space separated words; blank text has none."""
    return F.filter(F.split(strip(text), r"\s+"), lambda w: w != "")


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def correct_ocr(text: Column) -> Column:
    """Repair labels whose first letter was lost (``otal`` to ``Total``)."""
    fixes = lookup(OCR_FIXES)
    upper_first = F.substring(text, 1, 1).rlike(r"\p{Lu}")
    whole = F.try_element_at(fixes, F.lower(strip(text)))
    whole = F.when(
        upper_first, F.concat(F.upper(F.substring(whole, 1, 1)), F.substring(whole, 2, 1 << 30))
    ).otherwise(F.lower(whole))

    def repair(w: Column) -> Column:
        fix = F.try_element_at(fixes, F.lower(F.regexp_replace(w, "[^a-zA-Z]", "")))
        return F.coalesce(
            F.when(F.substring(w, 1, 1).rlike(r"\p{Lu}"), capitalised(fix)).otherwise(F.lower(fix)),
            w,
        )

    return F.when(text == "", text).otherwise(
        F.coalesce(whole, F.array_join(F.transform(words(text), repair), " "))
    )


def fix_spellings(text: Column) -> Column:
    """Replace known misread spellings anywhere in the text."""
    for wrong, right in OCR_SPELLINGS.items():
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def set_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays taken as sets; 0 when both are empty."""
    return F.coalesce(
        F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0)
    )


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is named inside functions."""
    return F.transform(F.array(value), use)[0]


def correct_financial_label(text: Column, threshold: float = 0.7) -> Column:
    """OCR repair, then the closest known line item above the threshold.

    The closest term is found inside the row, against a constant array: the label
    column is neither shuffled nor joined.  Only terms with enough words to pass the
    threshold are compared.  Ties go to the alphabetically first term.
    """
    terms = F.array(
        *[
            F.struct(
                F.array(*[F.lit(w) for w in dict.fromkeys(t.split())]).alias("words"),
                F.lit(t).alias("term"),
                F.lit(t.title()).alias("title"),
            )
            for t in sorted(FINANCIAL_TERMS)
        ]
    )

    def closest(label_words: Column) -> Column:
        n = F.size(label_words)

        def possible(t: Column) -> Column:
            m = F.size(t["words"])
            return F.try_divide(F.least(n, m), F.greatest(n, m)) > threshold

        return F.array_min(
            F.transform(
                F.filter(terms, possible),
                lambda t: F.struct(
                    (-set_overlap(label_words, t["words"])).alias("score"),
                    t["term"].alias("term"),
                    t["title"].alias("title"),
                ),
            )
        )

    def decided(corrected: Column) -> Column:
        lowered = F.lower(strip(corrected))
        best = bound(F.array_distinct(words(lowered)), closest)
        near = bound(best, lambda b: F.when(b["score"] < -threshold, b["title"]).otherwise(corrected))
        return F.when(text.isNull() | (text == "") | lowered.isin(FINANCIAL_TERMS), corrected).otherwise(near)

    return bound(correct_ocr(text), decided)


def label_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def map_alias(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """Canonical field of a label; unknown labels give their normalised key."""
    key = label_key(text)
    return F.when(text.isNull(), "").otherwise(
        F.coalesce(F.try_element_at(lookup(aliases or ALIASES), key), key)
    )


def plain(text: Column) -> Column:
    """Lower case with single blanks."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


# --- edit distances ----------------------------------------------------------------


def cer(gt: Column, pred: Column) -> Column:
    """Character edits per ground-truth character; empty truth scores 0 or 1."""
    return F.when(F.length(gt) == 0, F.when(F.length(pred) == 0, 0.0).otherwise(1.0)).otherwise(
        F.levenshtein(gt, pred) / F.length(gt)
    )


def ned(gt: Column, pred: Column) -> Column:
    """Character edits over the longer length."""
    longest = F.greatest(F.length(gt), F.length(pred))
    return F.coalesce(F.try_divide(F.levenshtein(gt, pred), longest), F.lit(0.0))


def as_symbols(items: Column, shared: Column, other: int) -> Column:
    """Write an array as a string with one code point per item.

    Only items the other side also has need a code point of their own (from U+10000,
    clear of the surrogates, room for a million); all others become ``other``.
    """
    return F.array_join(
        F.transform(
            items,
            lambda w: F.decode(
                F.unhex(
                    F.lpad(
                        F.hex(
                            F.array_position(shared, w)
                            + F.when(F.array_contains(shared, w), 0x10000).otherwise(other)
                        ),
                        8, "0",
                    )
                ),
                "UTF-32",
            ),
        ),
        "",
    )


def with_list_distance(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Add the Levenshtein distance of two array columns, by built-in ``levenshtein``.

    Each step is a column of its own: an expression repeated inside a lambda would be
    evaluated again for every element.
    """
    shared = F.col("_shared")
    return (
        df.withColumn("_shared", F.array_intersect(a, b))
        .withColumn("_sa", as_symbols(F.col(a), shared, 0xE000))
        .withColumn("_sb", as_symbols(F.col(b), shared, 0xE001))
        .withColumn(name, F.levenshtein("_sa", "_sb"))
        .drop("_shared", "_sa", "_sb")
    )


def with_wer(df: DataFrame, gt: Column, pred: Column, name: str = "wer") -> DataFrame:
    """Add word edits per ground-truth word; empty truth scores 0 or 1."""
    e = F.col("_edits")
    scored = df.withColumn("_edits", edits.word_edits(gt, pred))
    return scored.withColumn(name, edits.rate(e["words"], e["gt_words"], e["pred_words"])).drop("_edits")


# --- set overlaps --------------------------------------------------------------------


def word_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def word_accuracy(pred: Column, gt: Column) -> Column:
    """Share of ground-truth words found in the prediction."""
    g, p = word_set(gt), word_set(pred)
    return (
        F.when(gt == "", F.when(pred == "", 1.0).otherwise(0.0))
        .when(F.size(g) == 0, 1.0)
        .otherwise(F.size(F.array_intersect(g, p)) / F.size(g))
    )


def f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(
        F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)
    )


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 when the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def word_prf(pred: Column, gt: Column) -> Column:
    """STRUCT<precision, recall, f1, tp, fp, fn> over word sets."""
    g, p = word_set(gt), word_set(pred)
    tp = F.size(F.array_intersect(g, p))
    some = F.size(g) > 0
    precision = F.when(some, ratio(tp, F.size(p))).otherwise(0.0)
    recall = F.when(some, ratio(tp, F.size(g))).otherwise(0.0)
    return F.struct(
        precision.alias("precision"),
        recall.alias("recall"),
        f1(precision, recall).alias("f1"),
        tp.alias("tp"),
        F.size(F.array_except(p, g)).alias("fp"),
        F.size(F.array_except(g, p)).alias("fn"),
    )


def characters(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def contains_either(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def similar_term(
    a: Column, b: Column, char_overlap: float = 0.85, word_share: float | None = None
) -> Column:
    """Equal, one inside the other, or enough shared characters (or words).

    Blank text is similar to nothing.
    """
    x, y = F.lower(strip(a)), F.lower(strip(b))
    hit = contains_either(x, y) | (set_overlap(characters(x), characters(y)) >= char_overlap)
    if word_share is not None:
        wx, wy = F.array_distinct(words(x)), F.array_distinct(words(y))
        shared = F.size(F.array_intersect(wx, wy)) / F.greatest(F.size(wx), F.size(wy), F.lit(1))
        hit = hit | (shared >= word_share)
    return F.coalesce((a != "") & (b != "") & hit, F.lit(False))
