"""DuckDB SQL twins, written on the tables' definitions."""

from __future__ import annotations

from .quality import RULES, Risk

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_MIX = f"""
WITH sized AS (
  SELECT doc_id, source, len({_WORDS}) AS size, ('0x' || substr(md5('17:' || doc_id), 1, 15))::BIGINT AS key FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight
  FROM sized GROUP BY source),
steps AS (  -- sources in the order in which they reach twice their size
  SELECT *, 2.0 * source_size AS most, coalesce(sum(2.0 * source_size) OVER before, 0) AS given,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weights, row_number() OVER turn AS turn,
         1.5 * sum(source_size) OVER () AS budget
  FROM sources WINDOW turn AS (ORDER BY 2.0 * source_size / weight, source),
    before AS (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT coalesce(arg_min((budget - given)::DOUBLE / weights, turn) FILTER (weight * ((budget - given)::DOUBLE / weights) <= most), 0.0) AS level
  FROM steps),
targets AS (SELECT source, source_size, least(weight * level, most)::DOUBLE AS target FROM steps, level),
ranked AS (
  SELECT s.*, source_size, target, round(target)::BIGINT AS words,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END) * size + greatest(0, least(size,
          words - (CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END) * source_size - before)))::BIGINT AS taken
FROM ranked
"""

_LINKS = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s
  FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * shared.n >= 90 * (p.n + q.n - shared.n)),
reached AS (SELECT DISTINCT x AS doc_id, x AS other FROM links UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON r.other = l.x)
SELECT d.doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(other), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN reached r ON d.doc_id = r.doc_id GROUP BY d.doc_id
"""

_GRID = " UNION ALL ".join(
    f"SELECT '{rule.name}' AS rule, {i} AS step, {cut}::DOUBLE AS cut" for rule in RULES for i, cut in enumerate(rule.cutoffs))
_SIGNALS = " UNION ALL ".join(f"SELECT doc_id, lang, '{rule.name}' AS rule, {rule.signal} AS signal FROM counts" for rule in RULES)
_RISK = Risk()
_SHARE = _RISK.false_rejection / len(RULES)

_QUALITY = rf"""
WITH docs AS (SELECT doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n
  FROM (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i,
               unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM docs)),
repeats AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS j FROM windows WHERE n > 1) GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper
  FROM docs d LEFT JOIN repeats r ON d.doc_id = r.doc_id),
signals AS ({_SIGNALS}),
known AS (SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
tried AS (
  SELECT lang, rule, step, cut, count(*) FILTER (good) AS n, count(*) FILTER (good AND signal >= cut) AS lost,
         count(*) FILTER (NOT good AND signal >= cut) AS caught
  FROM signals JOIN known USING (doc_id) JOIN ({_GRID}) USING (rule) GROUP BY ALL),
tested AS (
  SELECT *, lost <= n * {_SHARE} AND list_sum(list_transform(range(0, lost + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
      + i * ln({_SHARE}) + (n - i) * ln(1 - {_SHARE})))) <= {_RISK.error} / ({len(RULES)} * (SELECT count(*) FROM (SELECT DISTINCT lang FROM tried))) AS passed
  FROM tried),
certified AS (
  SELECT *, bool_and(passed) OVER (PARTITION BY lang, rule ORDER BY step) AS all_passed FROM tested),
chosen AS (
  SELECT lang, rule, arg_max(cut, (caught - lost) * 1000 - step) AS cut FROM certified WHERE all_passed AND caught > lost GROUP BY lang, rule),
hits AS (
  SELECT DISTINCT doc_id FROM signals s JOIN chosen c ON s.lang IS NOT DISTINCT FROM c.lang AND s.rule = c.rule AND signal >= cut)
SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND h.doc_id IS NULL AS kept
FROM counts c LEFT JOIN hits h ON c.doc_id = h.doc_id
"""

_REPEATS = f"""
WITH words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS turn
  FROM (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i,
               unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS s FROM words)),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i, unnest(range(0, 20)) AS j FROM windows WHERE turn > 1)),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS t FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i
         WHERE g.i IS NULL GROUP BY e.doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id LEFT JOIN lost l ON w.doc_id = l.doc_id
"""


def _crc(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, with ``tab.t`` the table of the reversed polynomial."""
    digits = f"hex(encode({text}))"
    codes = f"list_transform(range(1, len({digits}) // 2 + 1), lambda j: ('0x' || substr({digits}, (2 * j - 1)::BIGINT, 2))::UBIGINT)"
    return (f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {codes}), "
            "lambda c, b: xor(tab.t[((xor(c, b) & 255) + 1)::BIGINT], c >> 8)), 4294967295::UBIGINT)::BIGINT")


_CRC_TABLE = ("SELECT list(list_reduce(list_prepend(i::UBIGINT, [0::UBIGINT for _ in range(8)]), "
              "lambda c, b: xor(c >> 1, (c & 1) * 3988292384::UBIGINT)) ORDER BY i) AS t FROM range(256) r(i)")

_DRAW = f"""
WITH tab AS ({_CRC_TABLE}),
texts AS (SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
words AS (SELECT side, r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (
  SELECT side, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words),
coded AS (SELECT f, {_crc("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM features), tab),
hashed AS (SELECT side, r, bucket FROM features JOIN coded USING (f)),
counts AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM hashed GROUP BY bucket),
sums AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain
  FROM counts, sums),
weights AS (SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM hashed JOIN gains USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
           / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights ON words.r = weights.r WHERE side = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS turn, count(*) FILTER (n_words >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND turn <= 25 * able // 100 THEN turn END AS rank FROM ranked
"""

_VARIANTS = f"""
WITH RECURSIVE tab AS ({_CRC_TABLE}),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
hashed AS (SELECT run, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, tab),
results AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, count(*) AS n FROM results WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3),
shorter AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS word, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN shorter b ON a.word = b.s
  UNION SELECT b.word, a.word, a.n FROM words a JOIN shorter b ON a.word = b.s),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS most FROM pairs GROUP BY word),
tops AS (SELECT p.word, min(other) AS other FROM pairs p JOIN best b ON p.word = b.word AND p.other_n = b.most GROUP BY p.word),
judged AS (
  SELECT w.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 2 * n THEN other END AS form, CASE WHEN most >= 2 * n THEN most END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word LEFT JOIN tops t ON w.word = t.word),
steps AS (
  SELECT word, word AS reached, 0 AS step FROM judged
  UNION ALL SELECT s.word, j.form, step + 1 FROM steps s JOIN judged j ON s.reached = j.word WHERE j.form IS NOT NULL),
ends AS (SELECT word, arg_max(reached, step) AS root FROM steps GROUP BY word)
SELECT j.word, n, n_near, form, form_n, root FROM judged j JOIN ends e ON j.word = e.word
"""

ORACLES: dict[str, str] = {
    "op2_mix_sources": _MIX,
    "op3_ngram_jaccard_join": _LINKS,
    "op7_quality_rules": _QUALITY,
    "op8_substring_dedup": _REPEATS,
    "op12_importance_resampling": _DRAW,
    "op13_spelling_variants": _VARIANTS,
}
