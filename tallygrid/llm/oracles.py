"""DuckDB SQL for the queries that SQL can state."""

from __future__ import annotations

from tallygrid.llm import quality

WORD = r"[^\x20\x09-\x0D]+"


def _quality() -> str:
    """Whole n-grams are compared as strings; no hash is involved."""
    limits = quality.NGRAM_LIMITS
    grams, cover, sums = [], [], []
    for n in limits:
        parts = " || ' ' || ".join(["w", *(f"lead(w, {j}) OVER p" for j in range(1, n))])
        grams.append(f"{parts} AS g{n}")
        cover.append(
            f"max(CASE WHEN g{n} IS NOT NULL AND c{n} > 1 THEN 1 ELSE 0 END) OVER "
            f"(PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS in{n}"
        )
        sums.append(f"sum(CASE WHEN in{n} = 1 THEN length(w) ELSE 0 END)::BIGINT AS dup_chars_{n}")
    counts = ", ".join(f"count(*) OVER (PARTITION BY r, g{n}) AS c{n}" for n in limits)
    zero = ", ".join(f"coalesce(dup_chars_{n}, 0) AS dup_chars_{n}" for n in limits)
    over = " OR ".join(f"dup_chars_{n} > {v}::DOUBLE * word_chars" for n, v in limits.items())
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT r, w, i FROM (
    SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (
      SELECT r, regexp_extract_all(text, '{WORD}') AS ws FROM d))
), grams AS (
  SELECT r, w, i, {", ".join(grams)} FROM words WINDOW p AS (PARTITION BY r ORDER BY i)
), counted AS (SELECT *, {counts} FROM grams
), covered AS (SELECT r, w, {", ".join(cover)} FROM counted
), by_word AS (
  SELECT r, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars,
         sum(in5)::BIGINT AS n_repeat_words, {", ".join(sums)}
  FROM covered GROUP BY r
), lines AS (
  SELECT r, l, row_number() OVER (PARTITION BY r, l) AS k FROM (
    SELECT r, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '{WORD}')
), by_line AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (k > 1) AS n_dup_lines,
         sum(length(l))::BIGINT AS line_chars,
         coalesce(sum(length(l)) FILTER (k > 1), 0)::BIGINT AS dup_line_chars
  FROM lines GROUP BY r
), joined AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(line_chars, 0) AS line_chars, coalesce(dup_line_chars, 0) AS dup_line_chars,
         coalesce(n_repeat_words, 0) AS n_repeat_words, {zero}
  FROM d LEFT JOIN by_word USING (r) LEFT JOIN by_line USING (r)
), based AS (
  SELECT *, n_words < {quality.MIN_WORDS}
         OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM joined
)
SELECT *, NOT (base_failed OR n_dup_lines > {quality.LINE_LIMIT}::DOUBLE * n_lines
               OR dup_line_chars > {quality.LINE_CHAR_LIMIT}::DOUBLE * line_chars OR {over}) AS kept
FROM based"""


QUALITY = _quality()


JACCARD = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(ws) = 0 THEN []
         WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 2),
                lambda i: array_to_string(ws[i:i+3], ' ')) END) AS g
  FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b
  WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT reach.doc_id, b FROM reach JOIN both_ways ON a = r
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) AS c USING (doc_id)"""


#: The mix by sorting all rows of a source by hash, where the query needs no sort.
MIXTURE = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', '0', coalesce(doc_id::VARCHAR, ''),
           coalesce(md5(text), ''))), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight,
         3 * source_size AS most
  FROM s
), r AS (
  SELECT *, row_number() OVER o AS place, sum(source_size) OVER () AS total,
         coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_ones,
         sum(weight) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight
  FROM w WINDOW o AS (ORDER BY most::DOUBLE / weight, source NULLS LAST)
), l AS (
  SELECT *, (total - full_ones)::DOUBLE / rest_weight::DOUBLE AS level FROM r
), t AS (
  SELECT source, source_size, least(most::DOUBLE, weight *
    (SELECT level FROM l WHERE level * weight <= most ORDER BY place LIMIT 1)) AS target
  FROM l
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole
  FROM t
), sums AS (
  SELECT source, h, sum(size) AS amount FROM d GROUP BY source, h
), upto AS (
  SELECT source, h, amount, sum(amount) OVER (PARTITION BY source ORDER BY h) AS upto FROM sums
), chosen AS (
  SELECT u.source, h, CASE WHEN upto <= target - whole * source_size THEN 1
    WHEN upto - amount <= target - whole * source_size
      AND 2 * (target - whole * source_size - (upto - amount)) > amount THEN 1 ELSE 0 END AS extra
  FROM upto AS u JOIN b ON u.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, size * (whole + extra) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
JOIN chosen AS c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h"""


WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, row_number() OVER () AS r FROM pages
), d AS (
  SELECT page_id, r, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex,
         row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, r) AS k,
         max(page_id) OVER (PARTITION BY html) AS last
  FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0],
    lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(hex, 5 * g::INT + 1, 5))::INT >> b) & 31) + 1)::INT, 1)), '')), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k > 1 THEN last END AS refers_to
FROM d"""


#: All pairs of lines of nearly one length; ``levenshtein`` counts bytes, so letters
#: beyond ASCII are first mapped one to one to single bytes that no text holds.
LINES = rf"""
WITH RECURSIVE letters AS (
  SELECT string_agg(c, '' ORDER BY c) AS s FROM (
    SELECT DISTINCT unnest(string_split(coalesce(text, ''), '')) AS c FROM documents) WHERE unicode(c) > 127
), free AS (
  SELECT string_agg(chr(i::INT), '' ORDER BY i) AS s FROM range(1, 128) AS t(i)
  WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(text, chr(i::INT))) AND i NOT IN (9, 10, 11, 12, 13)
), o AS (
  SELECT doc_id, number, l FROM (
    SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS number FROM (
      SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
  WHERE regexp_matches(l, '{WORD}')
), d AS (
  SELECT l, length(l) AS n, translate(l, (SELECT s FROM letters), (SELECT s FROM free)) AS t
  FROM (SELECT DISTINCT l FROM o)
), links AS (
  SELECT a.l AS a, b.l AS b FROM d AS a JOIN d AS b
  ON b.n BETWEEN a.n AND a.n + 2 AND a.l <> b.l AND b.n >= 10
  WHERE levenshtein(a.t, b.t) <= least(2, b.n // 10)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(l, r) AS (
  SELECT a, a FROM both_ways UNION SELECT reach.l, b FROM reach JOIN both_ways ON a = r
), classes AS (SELECT l, min(r) AS c FROM reach GROUP BY l
), ranked AS (
  SELECT doc_id, row_number() OVER (PARTITION BY coalesce(c, o.l) ORDER BY doc_id, number) AS k
  FROM o LEFT JOIN classes USING (l)
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents AS d LEFT JOIN (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k > 1) AS n_removed FROM ranked GROUP BY doc_id
) USING (doc_id)"""


#: CRC-32 runs over a list of bytes, each followed by eight shifts; runs are the islands of
#: positions whose word comes again one period later.
RUNS = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
         flatten(list_transform(string_split(doc_id::VARCHAR, ''),
           lambda c: list_concat([ascii(c)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]))) AS steps
  FROM documents
), hashed AS (
  SELECT r, doc_id, ws, len(ws) AS n, xor(4294967295, list_reduce(list_concat([4294967295], steps),
    lambda c, s: CASE WHEN s >= 0 THEN xor(c, s)
                      ELSE xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END) END)) AS h
  FROM d
), placed AS (
  SELECT *, (h // 10) % greatest(n, 1) AS a FROM hashed
), cut AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM placed
), words AS (
  SELECT r, i, ws[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS w
  FROM (SELECT *, unnest(range(n)) AS i FROM cut)
), same AS (
  SELECT x.r, y.i - x.i AS q, x.i FROM words AS x
  JOIN words AS y ON x.r = y.r AND x.w = y.w AND y.i > x.i
  JOIN cut ON cut.r = x.r AND 4 * (y.i - x.i) <= cut.n
), islands AS (
  SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same
), runs AS (
  SELECT r, start, length, min(q) AS period FROM (
    SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands
    GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q))
  GROUP BY r, start, length
), dropped AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT r, string_agg(w, ' ' ORDER BY i) AS collapsed
  FROM words ANTI JOIN dropped USING (r, i) GROUP BY r
), listed AS (
  SELECT r, count(*) AS n_runs,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         first(start ORDER BY length DESC, start, period) AS start,
         first(period ORDER BY length DESC, start, period) AS period, max(length) AS length
  FROM runs GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period,
       1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)"""


#: Every phrase of every piece is counted, then the rules are read off the counts.
PHRASES = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), starts AS (
  SELECT lang, ws, len(ws) AS size, unnest(range(1, len(ws) + 1)) AS i FROM split
), grams AS (
  SELECT lang, k, array_to_string(ws[i:i+k-1], ' ') AS phrase
  FROM starts, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= size
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
), n AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM split GROUP BY lang
), inside AS (
  SELECT lang, array_to_string(ws[i:i+m-1], ' ') AS phrase, max(f) AS over FROM (
    SELECT lang, f, string_split(phrase, ' ') AS ws, k, unnest(range(2, k)) AS m FROM f WHERE k > 2),
    (SELECT unnest(range(1, 5)) AS i) WHERE i + m - 1 <= k GROUP BY ALL
), cuts AS (
  SELECT f.lang, f.phrase, f.f AS a, k, string_split(f.phrase, ' ') AS ws, unnest(range(1, k)) AS cut
  FROM f LEFT JOIN inside USING (lang, phrase) WHERE k > 1 AND (over IS NULL OR 100 * over < 100 * f.f)
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, cut, l.f AS l, r.f AS r, n,
         (1000::HUGEINT * a * n // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts JOIN f AS l ON l.lang = cuts.lang AND l.phrase = array_to_string(ws[1:cut], ' ')
  JOIN f AS r ON r.lang = cuts.lang AND r.phrase = array_to_string(ws[cut+1:], ' ')
  JOIN n ON n.lang = cuts.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM best QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""
