"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows,
columns whose names clash with those of results."""

import random
import re
import tempfile

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KIND = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, "
    "shard int, slot string, size long, hash string, row string, node string, copies int"
)
SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "fr": "é ou eau les qu è tre ai ç ent".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def texts(seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        out.append((sentence(rng, lang, rng.randint(12, 90)) + "\n" + sentence(rng, lang, 15), lang))
    base = sentence(rng, "en", 120)
    words = base.split()
    for k in range(12):  # near copies, each with one word changed
        w = list(words)
        w[7 * k + 3] = f"new{k}"
        out.append((" ".join(w), "en"))
    out += [(base, "en")] * 3 + [(base.upper(), "en")]
    out += [(None, "en"), (None, None), ("", "fr"), ("   \n\t", "en"), ("One", "en"), ("one TWO three", None)]
    out += [("12 34 -- 56", "en"), ("中文 文本 中文", None), ("x" * 3000, "en"), ("a b " * 4000, "en")]
    out += [("good line of some words here\n" * 3 + sentence(rng, "fr", 40), "fr")]
    return out


def documents(spark, rows=None):
    """A stored table; the last rows repeat earlier ones, and two have no id."""
    rows = texts() if rows is None else rows
    data = []
    for i, (text, lang) in enumerate(rows):
        source = None if i % 11 == 5 else f"s{i % 4 if i % 2 else 0}"
        data.append((i, text, lang, source, None if text is None else len(text)))
    if data:
        last = data[min(61, len(data) - 1)]
        data += [data[0], last, (None, *last[1:]), (None, None, None, None, None)]
    full = [(*d, 0.5, 9, "slot", -1, "h", "r", "n", 7) for d in data]
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/documents"
    spark.createDataFrame(full, KIND).repartition(3).write.parquet(path)
    return spark.read.parquet(path)
