"""Keyed lookups: which row and which column does a question mean?

Cheap tiers come first and only keys they leave open go on.  Inexact tiers never pair
every key with every label of a table: containment is found through shared letter
groups, similarity through the rarest letters two similar strings must share.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions import numeric as N
from tallygrid.functions import text as T
from tallygrid.functions.similarity import with_ratio
from tallygrid.partitioning import first_k
from tallygrid.storage import stored

#: Keys over which the texts of one table are dealt where facts of the table join them.
_SALTS = 16
# Frequent letters are moved behind all others so that rare ones are compared first.
_COMMON = " etaoinshrdlu"
_LATE = "".join(chr(0xE000 + i) for i in range(len(_COMMON)))
#: Letters that are counted one by one.
_COUNTED = " abcdefghijklmnopqrstuvwxyz"
#: Tables of up to so many labels pair each of them with each key, by counts of letters.
_SMALL = 128
#: So many beginnings of small texts are sought in a large text; beyond, its groups are listed.
_FEW = 64


def normal(text: Column) -> Column:
    return F.lower(N.strip(text))


def _entries(df: DataFrame, label: str, idx: str) -> DataFrame:
    """Distinct normalised labels per table with their first position."""
    return df.groupBy("table_id", normal(F.col(label)).alias("label")).agg(
        F.min(idx).alias("idx")
    )


def _grams(text: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))
    )


def contained(inner: DataFrame, outer: DataFrame, small: str, large: str) -> DataFrame:
    """Pairs where ``small`` occurs inside ``large``, found through one shared group.

    The small text offers its first letters (up to three) and the large one all its
    groups of that length; both frames are keyed by table_id.
    """
    short = inner.where(F.length(small) > 0).withColumn("_n", F.least(F.length(small), F.lit(3)))
    short = short.withColumn("_g", F.substring(F.col(small), F.lit(1), F.col("_n")))
    starts = F.collect_set("_g")
    lengths = short.groupBy("table_id", "_n").agg(F.when(F.size(starts) <= _FEW, starts).alias("_starts"))
    # a table's few lengths meet its texts salt by salt, so no table is one join key
    lengths = lengths.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = outer.withColumn("_salt", F.pmod(F.xxhash64(large), F.lit(_SALTS)).cast("int"))
    held = F.filter("_starts", lambda g: F.col(large).contains(g))
    long = (
        salted.join(lengths, ["table_id", "_salt"]).drop("_salt")
        .where(F.length(large) >= F.col("_n"))
        .withColumn("_g", F.explode(F.coalesce(held, _grams(F.col(large), F.col("_n")))))
        .drop("_starts")
    )
    return short.join(long, ["table_id", "_n", "_g"]).where(F.col(large).contains(F.col(small))).drop(
        "_n", "_g"
    )


def _letters(text: Column, multiset: bool) -> Column:
    """Distinct letters, rare ones first; of a ``multiset`` each letter with its number."""
    cs = F.sort_array(F.array_remove(F.split(F.translate(text, _COMMON, _LATE), ""), ""))
    if not multiset:
        return F.array_distinct(cs)
    # the sorted letters are computed once, and not again for each of them
    return T.bound(cs, lambda s: F.transform(
        s, lambda c, i: F.concat(c, (i - F.array_position(s, c) + 1).cast("string"))
    ))


def _signature(text: Column) -> list[Column]:
    """How often each of 27 letters and all others occur: four numbers of seven bytes."""
    n = F.length(text)
    counts = [n - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in _COUNTED]
    counts.append(n - reduce(add, counts))
    packed = [F.shiftleft(F.least(c, F.lit(255)).cast("bigint"), 8 * (i % 7)) for i, c in enumerate(counts)]
    return [reduce(add, packed[i : i + 7]) for i in range(0, 28, 7)]


def _common(a: str, b: str) -> Column:
    """At most so many letters two texts of up to 255 letters have in common."""
    byte = lambda c, i: F.shiftright(c, 8 * i).bitwiseAND(F.lit(255))
    return reduce(add, [
        F.least(byte(F.col(f"{a}{j}"), i), byte(F.col(f"{b}{j}"), i)) for j in range(4) for i in range(7)
    ])


def _mask(text: Column) -> Column:
    """One bit for each of 27 letters that occurs, and above them how many letters are others."""
    bits = [F.when(text.contains(c), 1 << i).otherwise(0).cast("bigint") for i, c in enumerate(_COUNTED)]
    others = F.length(F.translate(text, _COUNTED, "")).cast("bigint")
    return reduce(add, bits) + F.shiftleft(others, 32)


def _may_overlap(a: str, b: str, floor: float) -> Column:
    """False where the letters of two texts, taken as sets, overlap by less than ``floor``."""
    known, x, y = F.lit((1 << 32) - 1), F.col(a), F.col(b)
    both = F.bit_count(x.bitwiseAND(y).bitwiseAND(known)) + F.least(F.shiftright(x, 32), F.shiftright(y, 32))
    return both >= floor * F.bit_count(x.bitwiseOR(y).bitwiseAND(known)) - 1e-9


def similar_candidates(
    left: DataFrame, right: DataFrame, a: str, b: str, floor: float, multiset: bool
) -> DataFrame:
    """Distinct pairs that can reach the floor: all that exact tests accept, and few others.

    ``multiset=False``: Jaccard of letter sets; ``multiset=True``: matching ratio
    2M/(|a|+|b|).  Tables of few labels pair them with their keys where both lie, by counts
    of letters.  In others, prefix filtering on letters: two strings reaching the floor must
    share a letter among the first n - need + 1 of either, with letters sorted rare-first.
    """
    need = (lambda n: n * floor) if not multiset else (lambda n: n * floor / (2 - floor))
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_salt")
    big = right.groupBy("table_id").agg(F.count(F.lit(1)).alias("_big")).where(F.col("_big") > _SMALL)
    big = big.select("table_id", "_big", salts).hint("shuffle_hash")

    def prefixed(df: DataFrame, c: str, side: str) -> DataFrame:
        def first(ls: Column) -> Column:
            keep = F.size(ls) - F.greatest(F.ceil(need(F.size(ls)) - 1e-9), F.lit(1)) + 1
            return F.slice(ls, F.lit(1), keep.cast("int"))

        text = F.col(c)
        facts = _signature(text) if multiset else [_mask(text)]
        rare = T.bound(_letters(text, multiset), first)
        salted = df.where(F.length(c) > 0).select(
            "*", F.pmod(F.xxhash64(c), F.lit(_SALTS)).cast("int").alias("_salt"),
            *[f.alias(f"{side}{i}") for i, f in enumerate(facts)],
        )
        met = salted.join(big, ["table_id", "_salt"], "left")
        tokens = F.when(F.col("_big").isNull(), F.array(F.lit(""))).otherwise(rare)
        return met.withColumn("_t", F.explode(tokens)).drop("_salt", "_big")

    x, y = F.length(a), F.length(b)
    if multiset:
        can = (2 * F.least(x, y) >= floor * (x + y)) & (
            (F.greatest(x, y) > 255) | (2 * _common("_p", "_q") >= floor * (x + y) - 1e-9)
        )
    else:
        can = _may_overlap("_p0", "_q0", floor)
    pairs = prefixed(left, a, "_p").join(prefixed(right, b, "_q"), ["table_id", "_t"]).where(can)
    extra = [f"{side}{i}" for side in ("_p", "_q") for i in range(4)]
    return pairs.drop("_t", *extra).distinct()


def match_keys(
    keys: DataFrame,
    labels: DataFrame,
    key: str,
    label: str = "label",
    idx: str = "row_idx",
    char_overlap: float | None = 0.85,
    word_share: float | None = None,
    corrected: bool = True,
    either_way: bool = True,
    blank_hits: bool = True,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """table_id, <key>, idx, tier: first label meeting the best tier.

    Tiers: 0 equal; 1 equal after OCR repair, containment or similarity (when
    ``char_overlap`` is set); 2 containment of the key in the label, and with
    ``either_way`` the reverse.  ``blank_hits`` keeps the rule that a blank label is
    contained in every key, as the last resort of an ``either_way`` search.  ``keep`` stores
    labels and open keys, which every tier reads, as they are dealt.
    """
    wanted = keys.select("table_id", key).distinct().withColumn("_key", normal(F.col(key)))
    known = keep(_entries(labels, label, idx))
    exact = (
        wanted.join(known.withColumnRenamed("label", "_key"), ["table_id", "_key"])
        .select("table_id", key, "idx", F.lit(0).alias("tier"))
    )
    open_ = keep(wanted.join(exact.select("table_id", key), ["table_id", key], "left_anti"))
    left = open_.select("table_id", "_key").distinct()
    right = known.where(F.col("label") != "")
    fuzzy_tier = 1 if char_overlap is not None else 2
    found = [
        contained(left, right, "_key", "label").select(
            "table_id", "_key", "idx", F.lit(fuzzy_tier).alias("tier")
        )
    ]
    if either_way:
        found.append(
            contained(right, left, "label", "_key").select(
                "table_id", "_key", "idx", F.lit(fuzzy_tier).alias("tier")
            )
        )
        if blank_hits:
            blanks = known.where(F.col("label") == "").select("table_id", "idx")
            found.append(
                left.join(blanks, "table_id").select(
                    "table_id", "_key", "idx", F.lit(2).alias("tier")
                )
            )
    if char_overlap is not None:
        likely = similar_candidates(left, right, "_key", "label", char_overlap, multiset=False)
        likely = likely.where(
            T.set_overlap(T.characters(F.col("_key")), T.characters(F.col("label"))) >= char_overlap
        )
        found.append(likely.select("table_id", "_key", "idx", F.lit(1).alias("tier")))
    if word_share is not None:
        found.append(_word_matches(left, right, word_share))
    if corrected:
        repaired = _entries(
            labels.withColumn("_fixed", T.correct_ocr(F.col(label))), "_fixed", idx
        ).withColumnRenamed("label", "_key")
        found.append(
            left.join(repaired, ["table_id", "_key"]).select(
                "table_id", "_key", "idx", F.lit(1).alias("tier")
            )
        )
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = every.groupBy("table_id", "_key").agg(F.min(F.struct("tier", "idx")).alias("m"))
    loose = open_.join(best, ["table_id", "_key"]).select("table_id", key, "m.idx", "m.tier")
    return exact.unionByName(loose)


def _word_matches(left: DataFrame, right: DataFrame, share: float) -> DataFrame:
    """Pairs sharing enough words, joined through the words themselves."""
    a = left.withColumn("_w", T.word_set(F.col("_key"))).withColumn("_t", F.explode("_w"))
    b = right.withColumn("_v", T.word_set(F.col("label"))).withColumn("_t", F.explode("_v"))
    both = a.join(b, ["table_id", "_t"]).groupBy("table_id", "_key", "label", "idx").agg(
        F.count(F.lit(1)).alias("n"),
        F.first(F.greatest(F.size("_w"), F.size("_v"))).alias("m"),
    )
    return both.where(F.col("n") / F.col("m") >= share).select(
        "table_id", "_key", "idx", F.lit(1).alias("tier")
    )


#: Without a floor, keys that reach this score are settled through rare letters first.
_SETTLED = 0.6


def _scored(
    left: DataFrame, known: DataFrame, floor: float, boost: float | None, strict: bool
) -> DataFrame:
    """table_id, _key, m (idx, score): the best label that reaches the floor."""
    if floor > 0:
        pairs = similar_candidates(left, known, "_key", "label", floor, multiset=True)
    else:
        salt = F.pmod(F.xxhash64("label"), F.lit(_SALTS)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
        pairs = left.withColumn("_a", _letters(F.col("_key"), True)).withColumn("_salt", every).join(
            known.withColumn("_b", _letters(F.col("label"), True)).withColumn("_salt", salt),
            ["table_id", "_salt"],
        )
        most = 2 * F.size(F.array_intersect("_a", "_b")) / (F.size("_a") + F.size("_b"))
        pairs = pairs.withColumn("_most", most).where("_most > 0").drop("_salt", "_a", "_b")
    if boost is not None and floor > 0:
        held = contained(left, known, "_key", "label").unionByName(
            contained(known, left, "label", "_key"), allowMissingColumns=True
        )
        pairs = pairs.unionByName(held.select(*pairs.columns)).distinct()
    if floor <= 0:
        # What the letters of a pair allow at most; pairs below the score of the most
        # promising one are not scored.
        pairs = stored(pairs)
        top = pairs.groupBy("table_id", "_key").agg(F.max_by("label", "_most").alias("label"))
        top = with_ratio(stored(top), "_key", "label", "_least").select("table_id", "_key", "_least")
        pairs = pairs.join(top, ["table_id", "_key"]).where(F.col("_most") >= F.col("_least") - 1e-9)
        pairs = pairs.drop("_most", "_least")
    scored = with_ratio(stored(pairs), "_key", "label", "score")
    if boost is not None:
        hit = T.contains_either(F.col("_key"), F.col("label"))
        scored = scored.withColumn(
            "score", F.when(hit, F.greatest("score", F.lit(boost))).otherwise(F.col("score"))
        )
    reached = F.col("score") > floor if strict else F.col("score") >= floor
    return scored.where(reached).groupBy("table_id", "_key").agg(
        F.min_by(F.struct("idx", "score"), F.struct(-F.col("score"), F.col("idx"))).alias("m")
    )


def best_similar(
    keys: DataFrame, labels: DataFrame, key: str, label: str = "label", idx: str = "row_idx",
    floor: float | None = 0.5, boost: float | None = 0.9, strict: bool = False,
) -> DataFrame:
    """table_id, <key>, idx, score: the most similar label at or above the floor.

    ``strict`` wants more than the floor; without a floor (None) the best label counts
    whatever its score, if it is above 0.  Containment raises a score to at least
    ``boost``.  Equal texts and contained ones are settled without scoring; the rest is
    scored once per distinct pair.  Blank keys and labels are similar to nothing.
    """
    wanted = keys.select("table_id", key).distinct().withColumn("_key", normal(F.col(key)))
    known = stored(_entries(labels, label, idx).where(F.col("label") != ""))
    exact = wanted.join(known.withColumnRenamed("label", "_key"), ["table_id", "_key"]).select(
        "table_id", key, "idx", F.lit(1.0).alias("score")
    )
    open_ = stored(wanted.join(exact.select("table_id", key), ["table_id", key], "left_anti"))
    left = open_.select("table_id", "_key").distinct()
    if floor is None:
        lowest = _SETTLED if boost is None else min(_SETTLED, boost)
        best = stored(_scored(left, known, lowest, boost, False))
        rest = left.join(best, ["table_id", "_key"], "left_anti")
        best = best.unionByName(_scored(rest, known, 0.0, boost, True))
    else:
        best = _scored(left, known, floor, boost, strict)
    loose = open_.join(best, ["table_id", "_key"]).select("table_id", key, "m.idx", "m.score")
    return exact.unionByName(loose)


def first_hit(
    keys: DataFrame, labels: DataFrame, key: str, label: str = "text", idx: str = "row_idx",
    texts: DataFrame | None = None, floor: float = 0.7, blank_hits: bool = True,
) -> DataFrame:
    """table_id, <key>, idx: the first label, by ``idx``, that passes any test.

    A label passes if it contains the key or is contained in it, or is similar by
    ``floor``; and a place of ``texts`` (table_id, idx, text) passes if its text contains
    the key.  The first place wins, whichever test it passes.  With ``blank_hits`` a blank
    label is contained in every key, and a blank key in every label.  Containment is found
    through shared letter groups; only labels before the first hit so found, and with
    enough letters in common, are scored.
    """
    wanted = keys.select("table_id", key).distinct().withColumn("_key", normal(F.col(key)))
    left = wanted.select("table_id", "_key").distinct()
    known = _entries(labels, label, idx)
    filled, whole = known.where("label <> ''"), left.where("_key <> ''")
    hit = lambda df: df.select("table_id", "_key", "idx")
    found = hit(contained(whole, filled, "_key", "label")).unionByName(
        hit(contained(filled, whole, "label", "_key"))
    )
    if texts is not None:
        lower = texts.select("table_id", F.col(idx).alias("idx"), F.lower("text").alias("text"))
        found = found.unionByName(hit(contained(whole, lower, "_key", "text")))
    sure = found.groupBy("table_id", "_key").agg(F.min("idx").alias("idx"))
    if blank_hits:
        salt = F.pmod(F.xxhash64("_key"), F.lit(_SALTS)).cast("int")
        firsts = known.groupBy("table_id").agg(
            F.min("idx").alias("_any"), F.min(F.when(F.col("label") == "", F.col("idx"))).alias("_blank")
        ).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        blank = left.withColumn("_salt", salt).join(firsts, ["table_id", "_salt"])
        blank = blank.withColumn("idx", F.when(F.col("_key") == "", F.col("_any")).otherwise(F.col("_blank")))
        sure = sure.unionByName(hit(blank.where("idx is not null")))
        sure = sure.groupBy("table_id", "_key").agg(F.min("idx").alias("idx"))
    sure = stored(sure)
    likely = similar_candidates(whole, filled, "_key", "label", floor, multiset=True)
    likely = likely.join(sure.withColumnRenamed("idx", "_sure"), ["table_id", "_key"], "left")
    likely = likely.where("_sure is null or idx < _sure").drop("_sure")
    scored = with_ratio(stored(likely), "_key", "label", "_score").where(F.col("_score") >= floor)
    best = sure.unionByName(hit(scored)).groupBy("table_id", "_key").agg(F.min("idx").alias("idx"))
    return wanted.join(best, ["table_id", "_key"]).select("table_id", key, "idx")


def first_row_hits(
    keys: DataFrame, cells: DataFrame, key: str = "row_key", floor: float = 0.7, blank_hits: bool = True
) -> DataFrame:
    """table_id, <key>, row_idx: the first row whose first cell contains the key, is
    contained in it or resembles it, or whose joined text contains it."""
    items = F.array_sort(F.collect_list(F.struct("col_idx", "text")))
    rows = cells.groupBy("table_id", "row_idx").agg(
        F.array_join(F.transform(items, lambda c: c["text"]), " ").alias("text")
    )
    found = first_hit(keys, cells.where("col_idx = 0"), key, "text", "row_idx", rows, floor, blank_hits)
    return found.withColumnRenamed("idx", "row_idx")


def first_column_hits(
    keys: DataFrame, cells: DataFrame, key: str = "col_key", rows: int = 3, floor: float = 0.7,
    blank_hits: bool = True,
) -> DataFrame:
    """table_id, <key>, col_idx: the column of the first cell, row by row through the first
    ``rows`` of the table, that contains the key, is contained in it or resembles it."""
    place = F.shiftleft(F.col("row_idx").cast("long"), 32) + F.col("col_idx")
    heads = cells.where(F.col("row_idx") < rows).withColumn("place", place)
    found = first_hit(keys, heads, key, "text", "place", None, floor, blank_hits)
    return found.select("table_id", key, F.col("idx").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("col_idx"))


def header_texts(cells: DataFrame, rows: int = 3) -> DataFrame:
    """table_id, col_idx, header: texts of the first rows joined per column."""
    items = F.array_sort(F.collect_list(F.struct("row_idx", "text")))
    return (
        cells.where((F.col("row_idx") < rows) & (F.col("text") != ""))
        .groupBy("table_id", "col_idx")
        .agg(F.array_join(F.transform(items, lambda s: s["text"]), " ").alias("header"))
    )


def answer_questions(
    questions: DataFrame, cells: DataFrame, rows: DataFrame, columns: DataFrame
) -> DataFrame:
    """questions with row_idx, col_idx and pred ('NOT_FOUND' where a key is missing)."""
    r = rows.select("table_id", "row_key", F.col("idx").alias("row_idx"))
    c = columns.select("table_id", "col_key", F.col("idx").alias("col_idx"))
    texts = cells.select("table_id", "row_idx", "col_idx", F.col("text").alias("pred"))
    return (
        questions.join(r, ["table_id", "row_key"], "left")
        .join(c, ["table_id", "col_key"], "left")
        .join(texts, ["table_id", "row_idx", "col_idx"], "left")
        .withColumn("pred", F.coalesce("pred", F.lit("NOT_FOUND")))
    )


def lookup_answers(
    questions: DataFrame, cells: DataFrame, preset: str = "semantic",
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Answer (row_key, col_key) questions.

    ``semantic``: equal, repaired or similar rows, then containment; column keys inside
    headers.  ``fuzzy``: similar rows with word overlap; columns either way.
    """
    labels = cells.where(F.col("col_idx") == 0)
    headers = cells.where(F.col("row_idx") == 0)
    if preset == "semantic":
        rows = match_keys(questions, labels, "row_key", "text", "row_idx", keep=keep)
        columns = match_keys(
            questions, headers, "col_key", "text", "col_idx", char_overlap=None,
            corrected=False, either_way=False, keep=keep,
        )
    else:
        rows = match_keys(
            questions, labels, "row_key", "text", "row_idx", char_overlap=0.8, word_share=0.7,
            corrected=False, blank_hits=False,
        )
        columns = match_keys(
            questions, headers, "col_key", "text", "col_idx", char_overlap=None, corrected=False,
        )
    return answer_questions(questions, cells, rows, columns)


# --- ground truth -------------------------------------------------------------------------------


def qa_pairs(cells: DataFrame, per_table: int = 10) -> DataFrame:
    """Questions made from numeric cells: row label, column header, expected answer.

    ``cells`` carries ``value``.  One question per (row label, column header), the
    first cells in reading order; the limit is part of the report.
    """
    labels = cells.where(F.col("col_idx") == 0).select(
        "table_id", "row_idx", F.col("text").alias("row_key")
    )
    headers = cells.where(F.col("row_idx") == 0).select(
        "table_id", "col_idx", F.col("text").alias("col_key")
    )
    data = cells.where(
        (F.col("row_idx") > 0) & (F.col("col_idx") > 0) & F.col("value").isNotNull()
    )
    named = data.join(labels, ["table_id", "row_idx"]).where(F.col("row_key") != "")
    # The limit runs before the header join, on what a table's first cells can supply.
    unique = named.groupBy("table_id", "row_key", "col_idx").agg(
        F.min_by(F.struct("row_idx", "text", "value"), "row_idx").alias("c")
    ).select("table_id", "row_key", "col_idx", "c.*")
    top = first_k(unique, ["table_id"], ["row_idx", "col_idx"], per_table, "question_id")
    return top.join(headers, ["table_id", "col_idx"]).select(
        "table_id", "question_id", "row_key", "col_key", F.col("text").alias("expected_text"),
        F.col("value").alias("expected_value"),
    )


def contained_texts(gt: DataFrame, found: DataFrame, both_ways: bool = False) -> DataFrame:
    """gt rows whose text occurs among, or inside, the found texts of the same table."""
    left = gt.select("table_id", F.col("text").alias("_a")).distinct()
    right = found.select("table_id", F.col("text").alias("_b")).where(F.col("_b") != "").distinct()
    hits = contained(left, right, "_a", "_b").select("table_id", "_a")
    if both_ways:
        hits = hits.unionByName(contained(right, left, "_b", "_a").select("table_id", "_a"))
    hits = hits.withColumnRenamed("_a", "text")
    return gt.join(hits, ["table_id", "text"], "left_semi")


def closest_texts(gt: DataFrame, found: DataFrame) -> DataFrame:
    """Error of each gt text against the best equal or containing text; 1 when none."""
    left = gt.select("table_id", F.col("text").alias("_a")).distinct()
    right = found.select("table_id", F.col("text").alias("_b")).where(F.col("_b") != "").distinct()
    pairs = contained(left, right, "_a", "_b").unionByName(
        contained(right, left, "_b", "_a"), allowMissingColumns=True
    )
    error = F.when(F.col("_a") == F.col("_b"), 0.0).otherwise(T.cer(F.col("_a"), F.col("_b")))
    best = pairs.groupBy("table_id", "_a").agg(F.min(error).alias("cer")).withColumnRenamed(
        "_a", "text"
    )
    return gt.join(best, ["table_id", "text"], "left").withColumn(
        "cer", F.coalesce("cer", F.lit(1.0))
    )


def first_gt_for_pred(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """Each predicted text with the first gt row equal to it or containing it."""
    left = pred.select("table_id", F.col("text").alias("_a")).distinct()
    right = gt.groupBy("table_id", F.col("text").alias("_b")).agg(
        F.min(F.struct("gt_id", "gt_type")).alias("g")
    )
    best = contained(left, right, "_a", "_b").groupBy("table_id", "_a").agg(F.min("g").alias("g"))
    return pred.join(
        best.select("table_id", F.col("_a").alias("text"), "g.*"), ["table_id", "text"], "left"
    )


def header_pairs(questions: DataFrame, cells: DataFrame) -> DataFrame:
    """First numeric cell whose row label and column header both match the keys.

    A text matches when either contains the other.  ``cells`` carries ``value``.
    """
    labels = cells.where((F.col("col_idx") == 0) & (F.col("text") != ""))
    headers = cells.where((F.col("row_idx") == 0) & (F.col("text") != ""))

    def sides(frame: DataFrame, key: str, idx: str) -> DataFrame:
        keys = questions.select("table_id", key).distinct().withColumn("_a", normal(F.col(key)))
        names = frame.select("table_id", F.col(idx).alias("idx"), normal(F.col("text")).alias("_b"))
        cols = ["table_id", key, "idx"]
        return (
            contained(keys, names, "_a", "_b").select(*cols)
            .unionByName(contained(names, keys, "_b", "_a").select(*cols))
            .distinct()
            .withColumnRenamed("idx", idx)
        )

    numeric = cells.where(F.col("value").isNotNull()).select("table_id", "row_idx", "col_idx", "text")
    asked = questions.select("table_id", "question_id", "row_key", "col_key")
    hits = (
        asked.join(sides(headers, "col_key", "col_idx"), ["table_id", "col_key"])
        .join(sides(labels, "row_key", "row_idx"), ["table_id", "row_key"])
        .join(numeric, ["table_id", "row_idx", "col_idx"])
        .groupBy("table_id", "question_id")
        .agg(F.min_by("text", F.struct("row_idx", "col_idx")).alias("pred"))
    )
    return questions.join(hits, ["table_id", "question_id"], "left").withColumn(
        "pred", F.coalesce("pred", F.lit("NOT_FOUND"))
    )


# --- cross-checks --------------------------------------------------------------------------------


# fixed values: labels of section rows (``section_words``)
def cells_to_verify(cells: DataFrame, per_table: int = 5, section_words: Sequence[str] = (
    "ASSETS", "LIABILITIES", "EQUITY", "",
)) -> DataFrame:
    """Up to five cells per table for an outside check.

    Year columns (2015-2029 in the header), else columns 2 and 3; the first data row
    and the five after it, without section rows.
    """
    r, c, t = F.col("row_idx"), F.col("col_idx"), F.col("text")
    year = t.rlike("201[5-9]|202[0-9]")
    head = cells.where(r == 0).groupBy("table_id").agg(
        F.min(F.when(year, c)).alias("first_year"), F.max(c).alias("last_col")
    )
    second = cells.where((r == 0) & year).join(head, "table_id").where(c > F.col("first_year"))
    second = second.groupBy("table_id").agg(F.min(c).alias("second_year"))
    picked = head.join(second, "table_id", "left").select(
        "table_id",
        F.explode(
            F.when(F.col("first_year").isNull(), F.array(F.lit(2), F.lit(3))).otherwise(
                F.array_compact(F.array("first_year", "second_year"))
            )
        ).alias("col_idx"),
    )
    labels = cells.where(c == 0).select("table_id", "row_idx", F.col("text").alias("row_label"))
    noted = cells.where((c == 1) & t.rlike(r"\d")).select("table_id", "row_idx")
    start = (
        labels.where(F.col("row_label") != "").join(noted, ["table_id", "row_idx"])
        .groupBy("table_id").agg(F.min("row_idx").alias("start"))
    )
    first = labels.select("table_id").distinct().join(start, "table_id", "left").withColumn(
        "start", F.coalesce("start", F.lit(1))
    ).withColumn("row_idx", F.explode(F.sequence("start", F.col("start") + 5))).drop("start")
    titles = cells.where(r == 0).select("table_id", "col_idx", F.col("text").alias("col_label"))
    wanted = (
        first.join(labels, ["table_id", "row_idx"])
        .where(~F.upper("row_label").isin(*section_words))
        .join(picked, "table_id")
        .join(cells, ["table_id", "row_idx", "col_idx"])
        .where(t.rlike(r"\d"))
        .join(titles, ["table_id", "col_idx"], "left")
    )
    return first_k(wanted, ["table_id"], ["row_idx", "col_idx"], per_table).select(
        "table_id", "row_idx", "col_idx", "row_label", "col_label", t.alias("cell_value")
    )
