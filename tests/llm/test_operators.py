"""Operators against brute force, on tables with every awkward case."""

import base64
import collections
import functools
import hashlib
import itertools
import math
import zlib

import pytest

from tallygrid.llm import (
    decontaminate,
    jaccard,
    katz,
    language,
    line_dedup,
    mixture,
    quality,
    sharding,
    store,
    token_files,
    warc_zip,
)
from tests.llm.fixtures import LOW, WORD, documents


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark)


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text", "lang", "source").collect()


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def keyed(found):
    return sorted(found, key=lambda r: tuple((x is None, x) for x in r))


def test_quality_measures(docs, rows):
    want = []
    for r in rows:
        text = r.text or ""
        words = WORD.findall(text)
        grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        inside = set()
        for i in range(len(words) - 4):
            if grams[tuple(words[i : i + 5])] > 1:
                inside.update(range(i, i + 5))
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want.append((r.doc_id, len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(inside)))
    got = quality.score(docs).select("doc_id", "n_words", "word_chars", "n_dup_lines", "n_repeat_words")
    assert keyed(map(tuple, got.collect())) == keyed(want)


def test_quality_verdict_keeps_columns(docs, none):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    verdicts = collections.Counter(r.kept for r in quality.score(docs).collect())
    assert kept.count() == verdicts[True] > 40 and verdicts[False] > 8
    assert quality.score(none).count() == quality.keep_good(none).count() == 0


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOW))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_jaccard_classes(docs, rows, width, percent):
    sets = [shingles(r.text, width) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    members = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            members[find(i)].append(r.doc_id)
    want = [(r.doc_id, len(sets[i]), min(members[find(i)], default=None)) for i, r in enumerate(rows)]
    got = jaccard.jaccard_classes(docs, width, percent).select("doc_id", "n_shingles", "component_id")
    assert keyed(map(tuple, got.collect())) == keyed(want)


def test_jaccard_keeps_one_of_each(docs, rows, none):
    kept = jaccard.one_per_class(docs, 5, 80)
    assert kept.columns == docs.columns
    found = jaccard.jaccard_classes(docs, 5, 80).collect()
    blank = sum(not shingles(r.text, 5) for r in rows)
    assert kept.count() == len({r.component for r in found if r.node is not None}) + blank
    assert jaccard.one_per_class(none).count() == jaccard.jaccard_classes(none).count() == 0


def test_jaccard_bitmaps_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (1, 3, 40, 700):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n // 3 + 1, dtype=np.uint64)]))
        x, y = jaccard.parities(a, 512), jaccard.parities(b, 512)
        apart = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b))


def distance(a, b):
    return line_dedup._table(a, b)


def test_edit_distance_by_windows():
    import random

    rng = random.Random(2)
    for _ in range(4000):
        a = "".join(rng.choices("abé", k=rng.randint(0, 13)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            b[rng.randint(0, len(b)) :][:1] = []
            b.insert(rng.randint(0, len(b)), rng.choice("abé"))
            if b and rng.random() < 0.5:
                b.pop(rng.randrange(len(b)))
        most = rng.randint(0, 4)
        b = "".join(b)
        assert line_dedup.within(a, b, most) == (distance(a, b) <= most)


def test_lines(spark, none):
    base = "the quick brown fox jumps over it"
    variants = [base, base + "!", base[1:], base.replace("quick", "quack"), base.replace("fox", "f0xx")]
    lines = [*variants, "short", "shor", "ten chars!", "ten chars?", "été à la plage", "ete à la plage"]
    rows = [("\n".join(lines[i:] + ["", " "]), "en") for i in range(len(lines))] + [(None, None), ("", "en")]
    docs = documents(spark, rows)
    got = keyed(map(tuple, line_dedup.per_document(docs).collect()))
    flat = [
        (r.doc_id is None, r.doc_id or 0, i, k, x)
        for i, r in enumerate(docs.select("doc_id", "text").collect())
        for k, x in enumerate((r.text or "").split("\n"))
        if WORD.search(x)
    ]
    names = sorted({f[4] for f in flat})
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(names, 2):
        if distance(a, b) <= min(2, max(len(a), len(b)) // 10):
            root[find(b)] = find(a)
    first, removed, total = set(), collections.Counter(), collections.Counter()
    for _, _, i, _, x in sorted(flat):
        total[i] += 1
        removed[i] += find(x) in first
        first.add(find(x))
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    want = [(d, total[i], removed[i]) for i, d in enumerate(ids)]
    assert sum(r[2] for r in got) == sum(removed.values())
    assert sorted((r[0] is None, r[1]) for r in got) == sorted((d is None, t) for d, t, _ in want)
    assert line_dedup.per_document(none).count() == 0


def test_tiling_finds_reordered_passages(spark, docs, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    w = item.split()
    texts = [
        f"before {item.upper()} after", " ".join(w[5:] + ["x"] + w[:5]), " ".join(w[:4]), " ".join(w[::-1]),
        None, "", "tiny item!", f"{item} {item}",
    ]
    some = documents(spark, [(t, "en") for t in texts])
    bench = spark.createDataFrame(
        [(1, item), (2, "tiny item"), (3, None), (None, "??"), (4, "no such thing at all here")], "item_id long, text string"
    )
    found = decontaminate.leaks(some, bench)
    got = {(r.doc_id, r.item_id, r.matched_words, r.n_tiles) for r in found.collect() if r.doc_id is not None}
    assert got == {(0, 1, 10, 1), (1, 1, 10, 2), (6, 2, 2, 1), (7, 1, 10, 1)}
    split = decontaminate.leaks(some, bench, block_bytes=20)
    assert {(r.doc_id, r.item_id) for r in split.collect() if r.doc_id is not None} == {g[:2] for g in got}
    kept = decontaminate.clean(some, bench)
    assert kept.columns == some.columns and kept.count() == some.count() - found.count()
    assert decontaminate.leaks(none, bench).count() == decontaminate.leaks(docs, bench.limit(0)).count() == 0


def tile_plainly(a, b, least):
    """Greedy tiling by looking at all places, longest first."""
    used_a, used_b, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            n = 0
            while (
                i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]
                and i + n not in used_a and j + n not in used_b
            ):
                n += 1
            if n > best[0]:
                best = (n, i, j)
        if best[0] < least:
            return out
        n, i, j = best
        out.append((i, j, n))
        used_a.update(range(i, i + n))
        used_b.update(range(j, j + n))


def test_tiling_against_all_places():
    import random

    import numpy as np

    rng = random.Random(4)
    for _ in range(150):
        a, b = (rng.choices("abc", k=rng.randint(0, 18)) for _ in range(2))
        hits = [(i, j) for i in range(len(a) - 2) for j in range(len(b) - 2) if a[i : i + 3] == b[j : j + 3]]
        got = decontaminate.tiles(np.array(hits, np.int64).reshape(-1, 2), 3, 3) if hits else []
        assert got == tile_plainly(a, b, 3)


def test_letters_of_any_script_are_lowered_alike(spark):
    items = ["ΟΔΟΣ ΤΗΣ ΠΟΛΗΣ ΚΑΙ ΤΟΥ ΛΟΓΟΥ", "İSTANBUL IŞIK GÖL ÇAĞ ÜÇ ŞÖLEN", "STRASSE ẞ ǅ ﬁne Ωhm K"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [(i, f"before {t} after") for i, t in enumerate([*items, *(x.lower() for x in items[:1])])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert {(0, 0), (1, 1), (2, 2)} <= found


def test_one_block_of_many_documents(spark, tmp_path):
    """Time in proportion to the documents of a block: each has three tokens and an end."""
    import numpy as np

    n = 200_000
    path = f"{tmp_path}/a.bin"
    tokens = np.tile(np.array([5, 6, 7, 0], token_files.KIND), n)
    tokens.tofile(path)
    files = spark.createDataFrame([(path, tokens.nbytes)], "path string, size long")
    found = token_files.scan(files, str(tmp_path), store.Scratch(spark, "many"), end=0)
    got = found.selectExpr("count(*)", "sum(n_tokens)", "min(n_tokens)", "max(ordinal)", "count(distinct start)").first()
    assert tuple(got) == (n, 3 * n, 3, n - 1, n)


def test_katz_against_plain_counts(docs, rows, none):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = [(r.doc_id, WORD.findall((r.text or "").translate(LOW)) + [None]) for r in rows]
    one, two = collections.Counter(), collections.Counter()
    for i, ts in tokens:
        if not held(i):
            one.update(ts)
            two.update(zip(["<s>", *ts], ts, strict=False))
    total, times = sum(one.values()), collections.Counter()
    follow = collections.defaultdict(dict)
    for (h, w), c in two.items():
        times[h] += c
        follow[h][w] = c

    def discounts(counts):
        n = collections.Counter(counts.values())
        common = 6 * n[6] / n[1]
        out = {}
        for r in range(1, 6):
            v = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 1
            out[r] = v if 0 < v < 1 else 1
        return out

    d1, d2 = discounts(one), discounts(two)
    free = sum((1 - d1[c]) * c for c in one.values() if c <= 5)

    def p1(w):
        whole = total if free > 0 else total + 1
        return (d1.get(one[w], 1) * one[w] if one[w] else free or 1) / whole

    def p2(h, w):
        if h not in follow:
            return p1(w)
        spared = any(d2.get(c, 1) < 1 for c in follow[h].values())
        whole = times[h] if spared else times[h] + 1
        if w in follow[h]:
            return d2.get(follow[h][w], 1) * follow[h][w] / whole
        left = 1 - sum(d2.get(c, 1) * c for c in follow[h].values()) / whole
        return left / (1 - sum(p1(x) for x in follow[h])) * p1(w)

    for h in ["<s>", "the", *list(follow)[:5]]:
        assert math.isclose(sum(p2(h, w) for w in [*one, "<unknown>"]), 1, rel_tol=1e-9)
    want = []
    for i, ts in tokens:
        base = sum(math.log10((one[w] + 0.1) / (total + 0.1 * (len(one) + 1))) for w in ts)
        full = sum(math.log10(p2(h, w)) for h, w in zip(["<s>", *ts], ts, strict=False))
        want.append((i, held(i), len(ts), sum(one[w] > 0 for w in ts), total, round(base, 6), round(full, 6)))
    # small chunks and partitions: every answer crosses pieces
    got = katz.score(docs, chunk_bytes=2000, part_entries=300).collect()
    assert keyed((*r[:5], round(r[5], 6), round(r[6], 6)) for r in got) == keyed(want)
    assert katz.score(none).count() == 0


def test_katz_of_order_three(spark, docs, rows, none, monkeypatch):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = [(r.doc_id, WORD.findall((r.text or "").translate(LOW)) + [None]) for r in rows]
    grams = lambda ts, k: [tuple(["<s>", *ts][max(0, i - k + 2) : i + 2]) for i in range(len(ts))]
    counts = [collections.Counter() for _ in range(3)]
    for i, ts in tokens:
        if not held(i):
            counts[0].update((w,) for w in ts)
            counts[1].update(grams(ts, 2))
            counts[2].update(g for g in grams(ts, 3) if len(g) == 3)
    total, follow, drop = sum(counts[0].values()), collections.defaultdict(dict), []
    for level in counts:
        n = collections.Counter(level.values())
        common, d = 6 * n[6] / n[1], {}
        for r in range(1, 6):
            v = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 1
            d[r] = v if 0 < v < 1 else 1
        drop.append(d)
        for g, c in level.items():
            follow[g[:-1]][g[-1]] = c
    free = sum((1 - drop[0][c]) * c for c in counts[0].values() if c <= 5)

    @functools.cache
    def rest(h):
        d, seen = drop[len(h)], follow[h]
        whole = sum(seen.values()) + (not any(d.get(c, 1) < 1 for c in seen.values()))
        left = 1 - sum(d.get(c, 1) * c for c in seen.values()) / whole
        return whole, left / (1 - sum(p(h[1:], x) for x in seen))

    def p(h, w):
        if not h:
            c = counts[0][(w,)]
            return (drop[0].get(c, 1) * c if c else free or 1) / (total if free > 0 else total + 1)
        if h not in follow:
            return p(h[1:], w)
        whole, weight = rest(h)
        c = follow[h].get(w)
        return drop[len(h)].get(c, 1) * c / whole if c else weight * p(h[1:], w)

    for h in [("<s>", "the"), *[h for h in list(follow) if len(h) == 2][:5]]:
        assert math.isclose(sum(p(h, w) for (w,) in [*counts[0], ("<unknown>",)]), 1, rel_tol=1e-9)
    want = keyed(
        (i, len(ts), round(sum(math.log10(p(g[:-1], g[-1])) for g in grams(ts, 3)), 6)) for i, ts in tokens
    )
    got = katz.score(docs, chunk_bytes=2000, part_entries=300, order=3).collect()
    assert keyed((r[0], r[2], round(r[6], 6)) for r in got) == want
    assert katz.score(none, order=3).count() == 0
    ends = documents(spark, [(None, None), ("", "en")])
    assert all(r[2] == 1 and r[6] <= 0 for r in katz.score(ends, order=3).collect())
    monkeypatch.setattr(katz, "HOT_SHARE", 1 << 40)
    got = katz.score(docs, chunk_bytes=2000, part_entries=300, order=3).collect()
    assert keyed((r[0], r[2], round(r[6], 6)) for r in got) == want


def test_katz_divides_hot_histories(docs, monkeypatch):
    plain = keyed((r[0], r[2], round(r[6], 6)) for r in katz.score(docs).collect())
    monkeypatch.setattr(katz, "HOT_SHARE", 1 << 40)
    again = katz.score(docs, chunk_bytes=2000, part_entries=300)
    assert keyed((r[0], r[2], round(r[6], 6)) for r in again.collect()) == plain


def test_language(docs, rows, none):
    got = {(r.doc_id, r.lang_pred) for r in language.identify(docs).collect()}
    by_id = dict(got)
    real = [(r.doc_id, r.lang) for r in rows if r.lang and r.doc_id is not None and len(r.text or "") > 50]
    assert sum(by_id[i] == lang for i, lang in real) >= 0.95 * len(real)
    for r in language.identify(docs).collect():
        assert 0 <= r.score <= 1
    for r in rows:
        if r.doc_id is not None and not any(c.isalpha() for c in r.text or ""):
            assert by_id[r.doc_id] == "und"
    assert by_id[next(r.doc_id for r in rows if r.text and "中" in r.text)] in ("en", "fr")
    assert language.identify(none).count() == 0
    assert {r.lang_pred for r in language.identify(docs.where("lang is null")).collect()} == {"und"}


def test_mixture(docs, rows, none):
    got = mixture.mix(docs).collect()
    size = collections.Counter()
    for r in rows:
        size[r.source] += len(WORD.findall(r.text or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: 3.0 * size[s] if s in full else rest * weight[s] / share for s in names}
        over = {s for s in names if target[s] > 3 * size[s] + 1e-9}
        if not over:
            break
        full |= over
    taken = collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source])
        assert r.taken in (r["size"] * k for k in range(4))
        taken[r.source] += r.taken
    largest = max(len(WORD.findall(r.text or "")) for r in rows)
    assert all(abs(taken[s] - target[s]) <= 2 * largest for s in names)
    assert keyed(map(tuple, mixture.mix(docs).collect())) == keyed(map(tuple, got))
    copies = mixture.mixed(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r.copies for r in got)
    assert mixture.mix(none).count() == mixture.mixed(none).count() == 0


@pytest.mark.parametrize("bucket_bytes", [500, 1 << 24])
def test_sharding(docs, none, bucket_bytes):
    found = sharding.shuffled(docs, 16, bucket_bytes=bucket_bytes).select("row.doc_id", "row.text", "shard", "slot")
    rows = found.collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    n = docs.count()
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {len(s) for s in slots.values()} <= {n // 16, n // 16 + 1} and len(slots) == 16
    assert keyed((r.doc_id, r.text) for r in rows) == keyed(map(tuple, docs.select("doc_id", "text").collect()))
    assert keyed(map(tuple, found.collect())) == keyed(map(tuple, rows))
    in_order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in in_order] != [r.doc_id for r in docs.select("doc_id").collect()]
    out = sharding.sharded(docs)
    assert out.columns == [*("input_shard" if c == "shard" else "input_slot" if c == "slot" else c for c in docs.columns), "shard", "slot"]
    assert sharding.sharded(none).count() == 0


def test_token_files(spark, docs, rows, none, tmp_path):
    encode = token_files.encoder(token_files.RANKS).encode_ordinary
    got = keyed(map(tuple, token_files.token_counts(docs).collect()))
    assert got == keyed((r.doc_id, len(encode(r.text or ""))) for r in rows)
    assert token_files.token_counts(none).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_separator_scan(spark, tmp_path, block):
    import numpy as np

    lists = [[0], [5], [5, 0], [0, 0, 5, 6, 7, 8, 9, 0, 1], [1] * 20 + [0] + [2] * 9 + [0, 0], []]
    files = []
    for i, x in enumerate(lists):
        path = f"{tmp_path}/{i}.bin"
        np.array(x, token_files.KIND).tofile(path)
        files.append((path, 2 * len(x)))
    table = spark.createDataFrame(files, "path string, size long")
    found = token_files.scan(table, str(tmp_path), store.Scratch(spark, "t"), end=0, block_tokens=block)
    want = []
    for (path, _), x in zip(files, lists, strict=True):
        at = k = 0
        for stop in [i for i, v in enumerate(x) if v == 0]:
            want.append((path, k, at, stop - at, True))
            at, k = stop + 1, k + 1
        if at < len(x):
            want.append((path, k, at, len(x) - at, False))
    assert sorted(map(tuple, found.collect())) == sorted(want)


@pytest.mark.parametrize("zip64", [False, True])
def test_warc_round_trip(spark, zip64):
    html = [None, "", "<p>a</p>", "<p>a</p>", "<p>é</p>" * 900, "<p>a</p>", "x\r\n\r\ny"]
    rows = [(i, f"http://h/{i} x\n", h, "c") for i, h in enumerate(html)] + [(None, None, "<p>a</p>", "c")]
    rows += [rows[5], (None, None, None, None)]
    path = store.shared_folder(spark) + f"/pages-{zip64}-{id(rows)}"
    spark.createDataFrame(rows, "page_id long, url string, html string, digest string").write.parquet(path)
    pages = spark.read.parquet(path)
    got = warc_zip.round_trip(pages, package_bytes=600, zip64=zip64).collect()
    last, want = {}, []
    for i, _, h, _ in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    seen = set()
    for i, _, h, _ in sorted(rows, key=lambda r: r[0] is None):
        data = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = last[h or ""] == (-1 if i is None else i) and (h or "") not in seen
        if first:
            seen.add(h or "")
        want.append((i, len(data), digest, "response" if first else "revisit", None if first else last[h or ""]))
    assert keyed((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == keyed(want)
    for r in got:
        if r.record_type == "response":
            assert base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode() == r.payload_digest
    assert warc_zip.round_trip(pages.limit(0)).count() == 0


def test_zip_directory_of_another_writer(tmp_path):
    import zipfile

    path = f"{tmp_path}/a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\x05\x06 a comment that looks like an end"
        z.writestr("one", b"first")
        with z.open("two", "w", force_zip64=True) as f:
            f.write(b"second" * 10)
        z.writestr("three", b"third" * 50, zipfile.ZIP_DEFLATED)
    size = len(open(path, "rb").read())
    with open(path, "rb") as f:
        found = warc_zip.members(f, size)
        assert [(m.name, m.stored) for m in found] == [("one", True), ("two", True), ("three", False)]
        f.seek(found[1].offset)
        assert f.read(found[1].size) == b"second" * 10


def test_packages_open_with_other_readers(tmp_path):
    import zipfile

    for wide in (False, True):
        path = f"{tmp_path}/{wide}.zip"
        with open(path, "wb") as f:
            w = warc_zip.PackageWriter(f, wide)
            for name, data in (("a", b"12"), ("b/c", b"")):
                w.begin(name)
                w.write(data)
                w.finish()
            w.close()
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and z.read("a") == b"12" and z.namelist() == ["a", "b/c"]
