"""Phrases, periodic runs and main text against brute force and hand-made cases."""

import collections
import hashlib
import html.parser
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallygrid.llm import arrays, main_text, phrases, queries, runs
from tests.llm.fixtures import LOW, WORD, documents, sentence


def keyed(found):
    return sorted(found, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


# --- phrases ---------------------------------------------------------------------------


def phrases_plainly(rows, least, longest, percent, most):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    hidden = set()
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * a >= percent * f[lang, p[i : i + k]]:
                    hidden.add((lang, p[i : i + k]))
    out = []
    for (lang, p), a in found.items():
        if (lang, p) not in hidden:
            score, cut = min((1000 * a * n[lang] // (f[lang, p[:c]] * f[lang, p[c:]]), c) for c in range(1, len(p)))
            out.append((lang, -score, -a, " ".join(p), f[lang, p[:cut]], f[lang, p[cut:]], n[lang]))
    ranked, seen = [], collections.Counter()
    for lang, score, a, p, left, right, total in sorted(out, key=lambda r: (*r[:3], r[3].encode())):
        seen[lang] += 1
        if seen[lang] <= most:
            ranked.append((lang, seen[lang], p, -a, left, right, total, -score))
    return ranked


def repeated_texts():
    rng = random.Random(5)
    stock = [sentence(rng, lang, 6) for lang in ("en", "fr") for _ in range(8)]
    rows = []
    for i in range(120):
        parts = [rng.choice(stock) for _ in range(rng.randint(1, 8))]
        rows.append((rng.choice([" ", ". ", "\n", "\t ", ", "]).join(parts), rng.choice(["en", "fr", None])))
    return [*rows, (None, None), ("", "en"), (" \t\n,.", "xx"), ("a a a a a a a a b", "en"), ("ÉÀ éà É", "fr")]


@pytest.mark.parametrize(("sample", "percent"), [(1, 100), (3, 90), (1 << 30, 100)])
def test_phrases(spark, none, monkeypatch, sample, percent):
    # with next to no sample every phrase is found through the border, pass by pass
    monkeypatch.setattr(phrases, "SAMPLE", sample)
    monkeypatch.setattr(phrases, "ENTRIES", 500)
    monkeypatch.setattr(phrases, "HASHES", 300)
    monkeypatch.setattr(phrases, "PART_BYTES", 5000)
    docs = documents(spark, repeated_texts())
    rows = [(r.text, r.lang) for r in docs.select("text", "lang").collect()]
    got = phrases.top(phrases.collocations(docs, least=6, longest=4, covered_percent=percent), 40).collect()
    want = phrases_plainly(rows, 6, 4, percent, 40)
    assert keyed(map(tuple, got)) == keyed(want) and len(want) > 60
    assert phrases.top(phrases.collocations(none)).count() == 0


def test_words_that_name_their_language(spark):
    rows = [("en de en de x", "en"), ("es es y", "es"), ("de en de z", "de")]
    docs = documents(spark, rows * 2)
    got = {(r.lang, r.phrase): r.f for r in phrases.frequent(docs, least=2, longest=1).collect()}
    kept = docs.where("lang is not null").collect()
    want = collections.Counter((r.lang, w) for r in kept for w in r.text.split())
    assert {k: f for k, f in got.items() if k[1]} == want


def test_scores_beyond_64_bits(spark):
    """1000 * a * n of a table of ten billion words, by the same expressions."""
    rows = [("en", "p q", 10**10), ("en", "p", 2 * 10**10), ("en", "q", 10**10), ("en", None, 10**13)]
    found = spark.createDataFrame(rows, "lang string, phrase string, f long")
    got = phrases.scored(found, 5, 100).collect()
    assert [tuple(r) for r in got] == [("en", "p q", 10**10, 2 * 10**10, 10**10, 10**13, 10**13 * 1000 // (2 * 10**10))]


def test_bitmap_errs_on_one_side(spark):
    hashes = arrays.mix(np.arange(2000, dtype=np.uint64))
    names = [(int(x),) for x in hashes[:1000] >> np.uint64(16)]
    bits = phrases.Bitmap(phrases.bitmap(spark.createDataFrame(names, "name long")))
    assert bits.has(hashes[:1000]).all() and bits.has(hashes[1000:]).sum() < 5


# --- periodic runs -----------------------------------------------------------------------


def runs_plainly(words, power=4, shortest=6):
    n, found = len(words), {}
    for q in range(1, n // power + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(shortest, power * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 9), st.integers(0, 40), st.integers(3, 5))
def test_runs_of_words(words, period, repeats, power):
    words = words + [i % period for i in range(period * repeats // 4)] + words[:3]
    h = arrays.mix(np.array(words, np.uint64) + np.uint64(9))
    got = []
    for a, b in runs.segments(h, np.zeros(len(h)), power, 6).tolist():
        got += [(a + s, n, q) for s, n, q in runs.lag_scan(h[a:b], power, 6)]
    assert sorted(got) == runs_plainly(words, power)


def test_long_runs_take_little_time():
    words = arrays.mix(np.arange(200_000, dtype=np.uint64) % np.uint64(40_000))
    (span,) = runs.segments(words, np.zeros(len(words)), 4, 6).tolist()
    assert runs.lag_scan(words[slice(*span)], 4, 6) == [(0, 200_000, 40_000)]
    assert runs.lag_scan(words[:1].repeat(100_000), 4, 6) == [(0, 100_000, 1)]


def test_periodic_runs(spark, none):
    rng = random.Random(2)
    texts = [(" ".join(rng.choices("ab", k=rng.randint(0, 90))), "en") for _ in range(60)]
    texts += [("x " * 9 + "y\t" * 7, "en"), ("one two three four " * 5, None), (None, None), ("", "en"), (" \n", "en")]
    docs = documents(spark, texts)
    got = runs.digests(runs.periodic_runs(docs)).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        words = WORD.findall(r.text or "")
        found = runs_plainly(words)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = min(((-n, s, q) for s, n, q in found), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda x: (x[0], x[2])))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        want.append((r.doc_id, len(found), *longest, sha(lines), sha(kept)))
    assert keyed(map(tuple, got)) == keyed(want)
    assert runs.digests(runs.periodic_runs(none)).count() == 0


def test_repeated_ends(spark):
    docs = documents(spark, [(" ".join(f"w{j}" for j in range(3 * i % 70)), "en") for i in range(80)])
    got, changed = collections.defaultdict(list), 0
    for r in queries.with_repeated_ends(docs).collect():
        got[r.doc_id].append(WORD.findall(r.text or ""))
    for r in docs.collect():
        words = WORD.findall(r.text or "")
        h = zlib.crc32(str(r.doc_id).encode())
        if r.doc_id is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        assert words in got[r.doc_id]
    assert changed > 3


# --- main text ---------------------------------------------------------------------------

PROSE = "The house of the king was built on a hill by the river and it is not far from the town. "
TEXT = PROSE.strip()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("<p>", ""),
        ("<script>if (a < b) '</p>'", ""),
        ("<article>Be.<p>1 &lt; 2 &amp; &eacute;&#x41;&nbsp;x  y<br>z", "Be. 1 < 2 & éA x y z"),
        ("<article><h1>T</h1><p>Be. <p class=ad>Buy<p>Or <b>not<p>x</article>tail", "T Be. Or not x"),
        (f"<nav><p>{PROSE}</p></nav><article><p>a <i>b</i>c</p></article><footer>{PROSE}</footer>", "a bc"),
        (f"<article><header><h1>T</h1>by me</header><p>{PROSE}<button>Share</button> more</p>"
         f"<aside>{PROSE}</aside><form>{PROSE}</form><section id='comments'><article class='comment'>"
         f"<p>{PROSE}</p></article></section></article>", f"T {TEXT} more"),
        (f"<div class=ad>{PROSE}<article><p>Hi.</p></article>", "Hi."),
        (f"<div id=m><a href=x>Home</a> <a href=y>News</a></div><div id=c><h1>Title</h1><p>{PROSE * 3}</p>"
         f"<p>Short.</p><p>{PROSE * 4}</p><p>End.</p></div><div class='cookie-notice'>{PROSE * 3}</div>"
         "<div>© 2020 all of it</div>", f"Title {(PROSE * 3).strip()} Short. {(PROSE * 4).strip()} End."),
        (f"<body class='has-sidebar'><div class='page no-sidebar'><p>{PROSE * 3}</p><ul><li><a href=q>x</a>"
         f"<li><a href=r>y</a></ul><p>after.</p></div>", f"{(PROSE * 3).strip()} after."),
        (f"<article><p>{PROSE}</p><ul><li><a href=q>more of this</a></ul></article>", TEXT),
        ("<!-- <article>no</article> --><article title='a > b'>yes</article>", "yes"),
        (f"<main><p>{PROSE}</p></main><div><p>{PROSE}</p></div>", TEXT),
    ],
)
def test_main_text_of(page, want):
    assert main_text.extract(page) == want


class Article(html.parser.HTMLParser):
    """What stands in the article element, by another parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.parts = False, []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.parts.append(" " if tag in ("p", "h1", "br") else "")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.parts.append(" " if tag in ("p", "h1") else "")

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_main_text_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r for r in pages.collect()}
    got = main_text.main_text(pages.withColumnRenamed("html", "HTML")).collect()
    assert len(got) == len(source)
    for r in got:
        parser = Article()
        parser.feed(source[r.page_id].html)
        assert (r.text, r.url) == (" ".join("".join(parser.parts).split()), source[r.page_id].url)
        assert r.n_chars == len(r.text) > 0


def test_main_text_of_odd_rows(spark):
    rows = [(1, "u", None, "t"), (None, None, "<article>x", "t"), (1, "u", "<article>" + "é " * 600_000, "t"), (1, "u", None, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = keyed((r.page_id, r.url, r.text[:3], r.n_chars) for r in main_text.main_text(pages).collect())
    assert got == keyed([(1, "u", "", 0), (None, None, "x", 1), (1, "u", "é é", 1_199_999), (1, "u", "", 0)])
    assert main_text.main_text(pages.limit(0)).count() == 0


def test_deep_and_unclosed_pages_take_little_time():
    assert main_text.extract("<b><p>" * 100_000 + "<article>x" + "<div>" * 100_000 + "</b>" * 100_000 + "y") == "x y"
    assert math.isclose(len(main_text.extract("<article>" + "<a title=\"'>" * 5000)), 0, abs_tol=100_000)
