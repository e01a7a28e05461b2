"""The catalog's queries as SQL over the given tables.

One chain of common table expressions mirrors the stages; each query selects from it.
"""

from __future__ import annotations

_CUTS = ("86400", "345600", "691200", "(SELECT h FROM hz)")
_CATS = ("campaign", "cat1", "cat2", "cat3", "cat4")
_NUMS = ("time_since_last_impression", "time_since_last_click", "n_previous_conversions",
         "impression_number")
_TRAIN_START, _TRAIN_END, _CAL_END, _TEST_END = 1704067200, 1705363200, 1705449600, 1705536000


def _r6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"


def _sig(expr: str) -> str:
    return f"(1.0 / (1.0 + exp(-({expr}))))"


def _clip(expr: str, eps: str) -> str:
    return f"least(greatest({expr}, {eps}), 1.0 - {eps})"


def _logit(expr: str) -> str:
    c = _clip(expr, "1e-12::DOUBLE")
    return f"(ln({c}) - ln(1.0 - {c}))"


_BUCKET = """CASE WHEN conversion_delay >= 0 AND conversion_delay < 86400 THEN 1
 WHEN conversion_delay >= 86400 AND conversion_delay < 345600 THEN 2
 WHEN conversion_delay >= 345600 AND conversion_delay < 691200 THEN 3
 WHEN conversion_delay >= 691200 AND conversion_delay <= (SELECT h FROM hz) THEN 4 END"""

_FORMULA = ("(-0.2::DOUBLE + 0.3::DOUBLE * ln(1.0 + n_previous_conversions) - 0.05::DOUBLE * (campaign - 4) "
            "+ 0.4::DOUBLE * click - 0.1::DOUBLE * ln(1.0 + impression_number))")


def _mask(train_end: str) -> str:
    known = f"(conversion = 1 AND event_s IS NOT NULL AND event_s <= {train_end})"
    return ", ".join(
        f"CASE WHEN {known} THEN 1 WHEN {train_end} - start_s >= {c} THEN 1 ELSE 0 END AS m{k}"
        for k, c in enumerate(_CUTS, 1)
    )


_FOLDS = """folds AS (
 SELECT i::INTEGER + 1 AS fold_id, {a} + i * 2 * 86400 AS train_start_s,
  {a} + (i * 2 + 15) * 86400 AS train_end_s, {a} + (i * 2 + 17) * 86400 AS test_end_s
 FROM (SELECT unnest(generate_series(0, 30)) AS i)
 WHERE {a} + (i * 2 + 17) * 86400 <= (SELECT max(start_s) // 86400 * 86400 FROM buck))""".format(a=_TRAIN_START)

_CHAIN = f"""WITH RECURSIVE imp AS (
 SELECT event_id, user_id, ts, event_type, value, CAST(props->>'$.k' AS INTEGER) AS k
 FROM events WHERE event_type IN ('view', 'click')),
nextp AS (
 SELECT i.event_id, min(p.ts) AS purchase_ts FROM imp i
 JOIN events p ON p.user_id = i.user_id AND p.event_type = 'purchase' AND p.value >= 100 AND p.ts >= i.ts
 GROUP BY 1),
lastc AS (
 SELECT i.event_id, max(c.ts) AS click_ts FROM imp i
 JOIN imp c ON c.user_id = i.user_id AND c.event_type = 'click' AND (c.ts, c.event_id) < (i.ts, i.event_id)
 GROUP BY 1),
raw AS (
 SELECT i.event_id AS impression_id, i.user_id AS uid,
  floor(epoch(i.ts))::BIGINT - 1704067200 AS "timestamp",
  coalesce(floor(epoch(n.purchase_ts))::BIGINT - 1704067200, -1) AS conversion_timestamp,
  (n.purchase_ts IS NOT NULL)::INTEGER AS conversion,
  (i.event_type = 'click')::INTEGER AS click,
  (i.k % 10)::INTEGER AS campaign, i.k AS cat1,
  least(floor(i.value / 25), 8)::INTEGER AS cat2,
  hour(i.ts)::INTEGER AS cat3,
  CASE WHEN i.k % 7 <> 0 THEN (i.k % 7)::INTEGER END AS cat4,
  (floor(epoch(i.ts))::BIGINT - floor(epoch(l.click_ts))::BIGINT)::DOUBLE AS time_since_last_click
 FROM imp i LEFT JOIN nextp n ON n.event_id = i.event_id LEFT JOIN lastc l ON l.event_id = i.event_id),
timed AS (
 SELECT *, CASE WHEN conversion_timestamp <> -1 THEN conversion_timestamp - "timestamp" ELSE -1 END AS conversion_delay,
  1704067200 + "timestamp" AS start_s,
  CASE WHEN conversion_timestamp <> -1 THEN 1704067200 + conversion_timestamp END AS event_s FROM raw),
hist AS (
 SELECT *,
  coalesce(sum(conversion) OVER (PARTITION BY uid ORDER BY start_s, impression_id
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_previous_conversions,
  start_s - lag(start_s) OVER (PARTITION BY uid ORDER BY start_s, impression_id) AS time_since_last_impression,
  row_number() OVER (PARTITION BY uid ORDER BY start_s, impression_id)::INTEGER AS impression_number
 FROM timed),
kept AS (SELECT * FROM hist WHERE NOT (conversion = 1 AND conversion_delay > 1036800)),
hz AS (SELECT max(conversion_delay)::DOUBLE AS h FROM kept),
buck AS (SELECT *, {_BUCKET} AS bucket_id FROM kept),
conf AS (
 SELECT impression_id, conversion, click, start_s, event_s, conversion_delay,
  {", ".join(f"coalesce({c}, 0) AS {c}" for c in _CATS)},
  {", ".join(f"{c}::DOUBLE AS {c}" for c in _NUMS)},
  {", ".join(f"coalesce((bucket_id = {k})::INTEGER, 0) AS b{k}" for k in (1, 2, 3, 4))}
 FROM buck),
masked AS (
 SELECT *, {_mask(str(_TRAIN_END))} FROM conf WHERE start_s >= {_TRAIN_START} AND start_s < {_TEST_END}),
sup AS (SELECT * FROM masked WHERE start_s < {_TRAIN_END} AND m4 = 1),
prep AS (
 SELECT * REPLACE ({", ".join(f"CASE WHEN {c} IN (SELECT {c} FROM sup) THEN {c} ELSE -1 END AS {c}" for c in _CATS)})
 FROM masked),
tr AS (SELECT * FROM prep WHERE start_s < {_TRAIN_END} AND m4 = 1),
trm AS (SELECT * FROM prep WHERE start_s < {_TRAIN_END} AND m1 + m2 + m3 + m4 > 0),
scored AS (SELECT *, {_FORMULA} AS z, {_sig(_FORMULA)} AS p, conversion AS y FROM prep),
te AS (SELECT * FROM scored WHERE start_s >= {_TRAIN_END}),
cal AS (SELECT * FROM te WHERE start_s < {_CAL_END}),
tst AS (SELECT * FROM te WHERE start_s >= {_CAL_END}),
"""


def _q(ctes: str, select: str) -> str:
    """The chain, extra expressions, and the final select."""
    head = _CHAIN + (ctes + ",\n" if ctes else "") + "done AS (SELECT 1)\n"
    return head + select


def _platt(x: str, y: str, slope: bool, steps: int = 25) -> str:
    """Newton's method as a recursive query over the ``cal`` rows."""
    p = _sig("a * x + b")
    det = "(haa * hbb - hab * hab)"
    da = f"(hbb * ga - hab * gb) / {det}" if slope else "0.0"
    db = f"(haa * gb - hab * ga) / {det}" if slope else "gb / hbb"
    return f"""pc AS (SELECT {x} AS x, ({y})::DOUBLE AS y FROM cal),
newton(i, a, b) AS (
 SELECT 0, 1.0::DOUBLE, 0.0::DOUBLE
 UNION ALL
 SELECT i + 1, a - {da}, b - {db} FROM (
  SELECT i, a, b, sum({p} - y) AS gb, sum(({p} - y) * x) AS ga, sum({p} * (1 - {p})) AS hbb,
   sum({p} * (1 - {p}) * x) AS hab, sum({p} * (1 - {p}) * x * x) AS haa
  FROM newton JOIN pc ON true WHERE i < {steps} GROUP BY i, a, b)),
platt AS (SELECT a, b FROM newton WHERE i = {steps})"""


def _platt_groups(rows: str, by: tuple[str, ...], slope: bool, steps: int = 25) -> str:
    """Newton's method for every group of ``rows`` (by, x, y) at once."""
    keys, same = ", ".join(by), " AND ".join(f"n.{c} = r.{c}" for c in by)
    p = _sig("a * x + b")
    det = "(haa * hbb - hab * hab)"
    da = f"(hbb * ga - hab * gb) / {det}" if slope else "0.0"
    db = f"(haa * gb - hab * ga) / {det}" if slope else "gb / hbb"
    return f"""pc AS ({rows}),
newton AS (
 SELECT {keys}, CASE WHEN min(y) < max(y) THEN 0 ELSE {steps} END AS i, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM pc GROUP BY {keys}
 UNION ALL
 SELECT {keys}, i + 1, a - {da}, b - {db} FROM (
  SELECT {", ".join(f"n.{c}" for c in by)}, i, a, b, sum({p} - y) AS gb, sum(({p} - y) * x) AS ga, sum({p} * (1 - {p})) AS hbb,
   sum({p} * (1 - {p}) * x) AS hab, sum({p} * (1 - {p}) * x * x) AS haa
  FROM newton n JOIN pc r ON {same} WHERE i < {steps} GROUP BY {", ".join(f"n.{c}" for c in by)}, i, a, b)),
platt AS (SELECT {keys}, a, b FROM newton WHERE i = {steps})"""


def _hazard(z: str = "z") -> str:
    survival = " * ".join(f"(1.0 - {_sig(f'{z} - 0.5::DOUBLE * {k}')})" for k in (1, 2, 3, 4))
    return f"(1.0 - {survival})"


_CLICK = "(-0.1::DOUBLE + 0.02::DOUBLE * cat1)"
_CTCVR = f"({_sig(_CLICK)} * {_sig('z')})"
_HEADS = """pp AS (
 SELECT impression_id, {z} 1 AS head, b1 AS label, m1 AS mature, 1 AS at_risk FROM {t}
 UNION ALL SELECT impression_id, {z} 2, b2, m2, (b1 = 0)::INTEGER FROM {t}
 UNION ALL SELECT impression_id, {z} 3, b3, m3, (b1 + b2 = 0)::INTEGER FROM {t}
 UNION ALL SELECT impression_id, {z} 4, b4, m4, (b1 + b2 + b3 = 0)::INTEGER FROM {t})"""


def _nll(y: str, p: str) -> str:
    c = _clip(p, "1e-15::DOUBLE")
    return f"(-({y} * ln({c}) + (1 - {y}) * ln(1.0 - {c})))"


def _losses(source: str, by: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return f"""loss AS (
 SELECT {keys}avg({_nll('y', 'p')}) AS nll_mean, avg(y) AS base_rate FROM {source} {group}),
loss2 AS (SELECT *, (1.0 - nll_mean / greatest({_nll('base_rate', 'base_rate')}, 1e-15)) * 100.0 AS rce FROM loss)"""


def _curves(source: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""sc AS (SELECT {keys}p, count(*) AS n, sum(y) AS pos FROM {source} GROUP BY {keys}p),
cum AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(pos) OVER ({part}) AS tp_all
 FROM sc WINDOW w AS ({part} ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT {keys}sum(CASE WHEN tp_all > 0 THEN pos / tp_all ELSE 0 END * cp / cn) AS ap,
 CASE WHEN max(tp_all) > 0 THEN sum(pos / tp_all * (cp / cn
  + CASE WHEN cn > n THEN (cp - pos) / (cn - n) ELSE 1.0 END) / 2) ELSE 0.5 END AS pr_auc
 FROM cum {'GROUP BY ' + by if by else ''})"""


def _tops(source: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    shares = "\n UNION ALL ".join(
        f"SELECT {keys}{int(f * 100)} AS share, greatest(1, round_even({f}::DOUBLE * max(n_all), 0))::BIGINT AS k,"
        f" sum(y) FILTER (WHERE rk <= greatest(1, round_even({f}::DOUBLE * n_all, 0)))::BIGINT AS tp,"
        f" max(n_all) AS n_all, max(pos_all) AS pos_all FROM rk {'GROUP BY ' + by if by else ''}"
        for f in (0.05, 0.1, 0.2)
    )
    return f"""rk AS (SELECT *, row_number() OVER ({part} ORDER BY p DESC, md5(impression_id::VARCHAR)) AS rk,
 count(*) OVER ({part}) AS n_all, sum(y) OVER ({part}) AS pos_all FROM {source}),
hits AS ({shares}),
tops AS (SELECT {keys}{", ".join(
    f"max(tp / k) FILTER (WHERE share = {s}) AS prec_{s}, "
    f"max(CASE WHEN pos_all > 0 THEN (tp / k) / (pos_all / n_all) ELSE 0.0 END) FILTER (WHERE share = {s}) AS lift_{s}, "
    f"max(CASE WHEN pos_all > 0 THEN tp / pos_all ELSE 0.0 END) FILTER (WHERE share = {s}) AS recall_{s}"
    for s in (5, 10, 20))}
 FROM hits {'GROUP BY ' + by if by else ''})"""


_METRICS = ("nll_mean", "rce", "ap", "pr_auc", "base_rate") + tuple(
    f"{m}_{s}" for s in (5, 10, 20) for m in ("prec", "lift", "recall"))
_METRICS_R = ", ".join(f"{_r6(m)} AS {m}" for m in _METRICS)
_TOPS_R = ", ".join(f"{_r6(m)} AS {m}" for m in _METRICS[5:])


def _quantile(q: float, part: str) -> str:
    """Linear interpolation between order statistics, by row number."""
    at = f"((max(n_all) - 1) * {q}::DOUBLE)"
    low = f"max(p) FILTER (WHERE rn = floor((n_all - 1) * {q}::DOUBLE))"
    high = f"max(p) FILTER (WHERE rn = ceil((n_all - 1) * {q}::DOUBLE))"
    return f"{low} + ({high} - {low}) * ({at} - floor({at}))"


def _bins() -> str:
    edges = ", ".join(_quantile(i / 10, "") for i in range(11))
    return f"""ord AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS rn, count(*) OVER () AS n_all FROM te),
edges AS (SELECT list_sort(list_distinct([{edges}])) AS e FROM ord),
inner_e AS (SELECT unnest(e[2:len(e) - 1]) AS edge FROM edges),
binned AS (SELECT te.*, (SELECT count(*) FROM inner_e WHERE edge < te.p) AS bin FROM te),
rel AS (SELECT bin::INTEGER AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS mean_y FROM binned GROUP BY 1)"""


def _box(label: str) -> str:
    return _q(f"""ord AS (SELECT p, {label}, row_number() OVER (PARTITION BY {label} ORDER BY p) - 1 AS rn,
 count(*) OVER (PARTITION BY {label}) AS n_all FROM te),
qs AS (SELECT {label}, {_quantile(.25, label)} AS q1, {_quantile(.5, label)} AS median,
 {_quantile(.75, label)} AS q3 FROM ord GROUP BY {label})""", f"""
SELECT {label}, {_r6('q1')} AS q1, {_r6('median')} AS median, {_r6('q3')} AS q3, count(*) AS n,
 {_r6('least(min(p) FILTER (WHERE p >= q1 - 1.5 * (q3 - q1)), q1)')} AS whisker_low,
 {_r6('greatest(max(p) FILTER (WHERE p <= q3 + 1.5 * (q3 - q1)), q3)')} AS whisker_high
FROM te JOIN qs USING ({label}) GROUP BY {label}, q1, median, q3""")


def _scale(column: str, kind: str) -> str:
    """z-score of a column with statistics of the single-head training rows."""
    log1p = f"ln(1.0 + greatest({column}, 0.0))"
    if kind == "log1p":
        value = f"CASE WHEN {column} IS NOT NULL THEN {log1p} END"
        stat = value
    else:
        positive = f"(SELECT min({column}) > 0 FROM tr)"
        value = (f"CASE WHEN {column} IS NULL THEN NULL WHEN {positive} THEN "
                 f"CASE WHEN {column} > 0 THEN ln({column}) END ELSE {log1p} END")
        stat = value
    mean = f"coalesce((SELECT avg({stat}) FROM tr), 0.0)"
    sd = f"coalesce(nullif((SELECT stddev_pop({stat}) FROM tr), 0.0), 1.0)"
    return f"coalesce((({value}) - {mean}) / {sd}, 0.0)"


def _scaled(kind: str) -> str:
    columns = ", ".join(
        f"{_r6(_scale(c, kind))} AS {c}_z, ({c} IS NULL)::INTEGER AS {c}_miss" for c in _NUMS)
    return _q("", f"SELECT impression_id, {columns} FROM prep")


def _train_stats() -> str:
    parts = []
    for c in _NUMS:
        log1p = f"CASE WHEN {c} IS NOT NULL THEN ln(1.0 + greatest({c}, 0.0)) END"
        log = f"CASE WHEN {c} > 0 THEN ln({c}) END"
        parts.append(
            f"SELECT '{c}' AS \"column\", {_r6(f'min({c})')} AS minimum, {_r6(f'avg({log1p})')} AS log1p_mean,"
            f" {_r6(f'stddev_pop({log1p})')} AS log1p_sd, {_r6(f'avg({log})')} AS log_mean,"
            f" {_r6(f'stddev_pop({log})')} AS log_sd FROM tr")
    return _q("", "\nUNION ALL ".join(parts))


def _index(keep_unseen: bool) -> str:
    ctes, columns, joins = [], [], []
    for c in _CATS:
        extra = " UNION SELECT -1" if keep_unseen else ""
        ctes.append(f"v_{c} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM "
                    f"(SELECT DISTINCT {c} AS v FROM tr{extra}))")
        columns.append(f"coalesce(v_{c}.i, 0)::INTEGER AS {c}_idx")
        joins.append(f"LEFT JOIN v_{c} ON v_{c}.v = prep.{c}")
    return _q(",\n".join(ctes), f"SELECT impression_id, {', '.join(columns)} FROM prep {' '.join(joins)}")


_FEATURES = ("impression_id, n_previous_conversions, time_since_last_impression, impression_number, "
             "time_since_last_click")
_FOLD_CAL = "SELECT fp.* FROM fp JOIN folds USING (fold_id) WHERE start_s < train_end_s + 86400"
_FOLD_PRED = _FOLDS + f""",
fp AS (SELECT f.fold_id, c.impression_id, c.start_s, c.b1, c.b2, c.b3, c.b4, c.conversion AS y, {_FORMULA} AS z, {_sig(_FORMULA)} AS p
 FROM conf c JOIN folds f ON c.start_s >= f.train_end_s AND c.start_s < f.test_end_s)"""
_DATE = "strftime(to_timestamp({}) AT TIME ZONE 'UTC', '%Y-%m-%d')"
_OBS = f"""obs AS (SELECT *, (conversion = 1 AND event_s IS NOT NULL AND event_s <= {_TRAIN_END})::INTEGER AS y_obs,
 ({_TRAIN_END} - start_s)::DOUBLE AS elapsed, ({_TRAIN_END - 172800} - start_s)::DOUBLE AS elapsed_deadline
 FROM scored WHERE start_s < {_TRAIN_END})"""


def _candidates(aggregate: str) -> str:
    return _q(_FOLD_PRED + f""",
cand AS (SELECT unnest([0.5::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE]) AS candidate),
cp AS (SELECT candidate, fold_id, y, {_sig('z * candidate')} AS p FROM fp JOIN cand ON true),
{_losses('cp', 'candidate, fold_id')}""",
              f"SELECT candidate, {_r6(f'{aggregate}(rce)')} AS score, count(*) AS n_folds FROM loss2 GROUP BY 1")


def oracle_sql() -> dict[str, str]:
    hashed = "cast('0x' || substr(md5('{s}:' || impression_id::VARCHAR), 1, 12) AS BIGINT)"
    fold_columns = ", ".join(f"{_DATE.format(a)} AS {b}" for a, b in (
        ("train_start_s", "train_start"), ("train_end_s", "train_end"),
        ("train_end_s", "test_start"), ("test_end_s", "test_end")))
    asof = _q("", """SELECT a.impression_id, count(b.impression_id) AS n_known_conversions
 FROM timed a LEFT JOIN timed b ON a.uid = b.uid AND b.conversion = 1 AND b.event_s < a.start_s GROUP BY 1""")
    _hot = [f"({c} IN (SELECT {c} FROM tr))::INTEGER" for c in _CATS]
    _hot += [f"{_scale(c, 'auto')} + ({c} IS NULL)::INTEGER" for c in _NUMS]
    w_obs = (f"CASE WHEN y_obs = 1 THEN 1.0 / {_clip(_sig('z + elapsed / 432000.0'), '1e-6::DOUBLE')} "
             f"ELSE {_clip(_sig('elapsed / 432000.0 - z'), '1e-6::DOUBLE')} END")
    stats = """count(*) AS n_rows, sum(conversion)::BIGINT AS n_conversions,
 count(*) FILTER (WHERE start_s < train_end_s) AS n_train,
 count(*) FILTER (WHERE start_s < train_end_s AND m1 + m2 + m3 + m4 < 4) AS n_immature,
 count(*) FILTER (WHERE start_s >= train_end_s) AS n_test"""
    return {
        "attribution": _q("", "SELECT * FROM raw"),
        "conversion_delay": _q("", "SELECT impression_id, conversion_delay FROM timed"),
        "timestamps": _q("", f"""SELECT impression_id, start_s, event_s, start_s // 86400 * 86400 AS day_s,
 {_DATE.format('start_s + 15 * 86400')} AS plus_15_days, {_DATE.format('start_s - 86400')} AS minus_1_day FROM timed"""),
        "user_features": _q("", f"SELECT {_FEATURES} FROM hist"),
        "user_features_split": _q("", f"SELECT {_FEATURES} FROM hist"),
        "user_features_asof": asof,
        "user_features_asof_split": asof,
        "content_ids": _q("", """SELECT impression_id,
 sha256(uid::VARCHAR || chr(1) || "timestamp"::VARCHAR || chr(1) || cat1::VARCHAR) AS row_key FROM raw"""),
        "late_cutoff": _q("", "SELECT impression_id, conversion, conversion_delay FROM kept"),
        "hash_downsample": _q("", f"""SELECT impression_id, conversion FROM kept
 WHERE (conversion = 1 OR {hashed.format(s='3')} < {round(0.75 * 2**48)}) AND {hashed.format(s='3-all')} < {round(0.02 * 2**48)}"""),
        "horizon": _q("", """SELECT max(conversion_delay) AS horizon,
 ceil(max(conversion_delay) / 86400)::BIGINT AS max_delay_days FROM kept"""),
        "delay_buckets": _q("", """SELECT impression_id, bucket_id,
 CASE bucket_id WHEN 1 THEN 0 WHEN 2 THEN 86400 WHEN 3 THEN 345600 WHEN 4 THEN 691200 END::DOUBLE AS lower_bound,
 CASE bucket_id WHEN 1 THEN 86400 WHEN 2 THEN 345600 WHEN 3 THEN 691200 WHEN 4 THEN (SELECT h FROM hz) END::DOUBLE AS upper_bound,
 coalesce((bucket_id = 1)::INTEGER, 0) AS b1, coalesce((bucket_id = 2)::INTEGER, 0) AS b2,
 coalesce((bucket_id = 3)::INTEGER, 0) AS b3, coalesce((bucket_id = 4)::INTEGER, 0) AS b4 FROM buck"""),
        "bucket_counts": _q("", "SELECT bucket_id, count(*) AS n FROM buck GROUP BY 1"),
        "bucket_cuts": _q("", """SELECT DISTINCT bucket_id,
 CASE bucket_id WHEN 1 THEN 86400 WHEN 2 THEN 345600 WHEN 3 THEN 691200 ELSE (SELECT h FROM hz) END::DOUBLE AS upper_bound
 FROM buck WHERE bucket_id IS NOT NULL"""),
        "conform": _q("", f"""SELECT impression_id, conversion, click, start_s, event_s,
 {', '.join(_CATS)}, {', '.join(_NUMS)}, b1, b2, b3, b4 FROM conf"""),
        "span": _q("", """SELECT min(start_s) AS first_start, max(start_s) AS last_start,
 min(event_s) AS first_event, max(event_s) AS last_event FROM buck"""),
        "outer_folds": _q(_FOLDS, f"SELECT fold_id, {fold_columns} FROM folds"),
        "inner_folds": _q(_FOLDS + """,
ins AS (SELECT f.fold_id AS outer_fold, j::INTEGER + 1 AS fold_id, f.train_start_s + j * 86400 AS train_start_s,
 f.train_start_s + (j + 12) * 86400 AS train_end_s, f.train_start_s + (j + 13) * 86400 AS test_end_s, f.train_end_s AS stop_s
 FROM folds f, (SELECT unnest(generate_series(0, 30)) AS j))""",
                          f"SELECT outer_fold, fold_id, {fold_columns} FROM ins WHERE test_end_s <= stop_s"),
        "fold_rows": _q(_FOLDS, """SELECT fold_id, (start_s < train_end_s)::INTEGER AS is_train, count(*) AS n
 FROM conf JOIN folds ON start_s >= train_start_s AND start_s < test_end_s GROUP BY 1, 2"""),
        "window_slice": _q("", "SELECT impression_id FROM masked"),
        "train_mask": _q("", "SELECT impression_id, 1 AS aux_mask, m1, m2, m3, m4, 1 AS e1, 1 AS e2, 1 AS e3, 1 AS e4 FROM masked"),
        "row_age": _q("", f"SELECT impression_id, {_TRAIN_END} - start_s AS age FROM masked"),
        "supervised": _q("", "SELECT impression_id FROM sup"),
        "unknown_categories": _q("", f"SELECT impression_id, {', '.join(_CATS)} FROM prep"),
        "unknown_categories_shuffled": _q("", f"SELECT impression_id, {', '.join(_CATS)} FROM prep"),
        "unknown_strings": _q("", """SELECT impression_id,
 CASE WHEN cat1 IN (SELECT cat1 FROM sup) THEN 'k' || cat1::VARCHAR ELSE '__MISSING__' END AS place FROM masked"""),
        "category_vocabulary": _q("", " UNION ".join(
            f"SELECT '{c}' AS \"column\", {c}::BIGINT AS value FROM sup" for c in _CATS)),
        "mask_stats": _q(_FOLDS + f""",
fm AS (SELECT fold_id, train_end_s, conversion, start_s, {_mask('train_end_s')}
 FROM conf JOIN folds ON start_s >= train_start_s AND start_s < test_end_s),
st AS (SELECT fold_id, {stats} FROM fm GROUP BY fold_id)""",
                         f"SELECT *, {_r6('n_immature / n_train * 100')} AS pct_immature FROM st"),
        "train_single": _q("", "SELECT impression_id FROM tr"),
        "train_multi": _q("", "SELECT impression_id FROM trm"),
        "test_split": _q("", "SELECT impression_id FROM te"),
        "cal_after": _q("", "SELECT impression_id FROM cal"),
        "cal_before": _q("", f"SELECT impression_id FROM prep WHERE start_s >= {_TRAIN_END - 86400} AND start_s < {_TRAIN_END}"),
        "fsiw_train": _q("", f"SELECT impression_id FROM prep WHERE start_s < {_TRAIN_END}"),
        "base_rate": _q("", f"""SELECT conversion, count(*) AS n_label, (SELECT count(*) FROM te) AS n_rows,
 {_r6('(SELECT avg(conversion) FROM te)')} AS base_rate FROM te GROUP BY 1"""),
        "cat_index": _index(True),
        "cat_index_zero": _index(False),
        "num_log1p_z": _scaled("log1p"),
        "num_auto_z": _scaled("auto"),
        "train_stats": _train_stats(),
        "organic_share": _q("", f"SELECT {_r6('coalesce(avg((click = 0)::INTEGER) FILTER (WHERE conversion = 1), 0.0)')} AS organic_share FROM tr"),
        "person_period": _q(_HEADS.format(z="", t="trm"), "SELECT *, mature * at_risk AS weight FROM pp"),
        "risk_set": _q("", """SELECT impression_id, 1 AS r1, (b1 = 0)::INTEGER AS r2,
 (b1 + b2 = 0)::INTEGER AS r3, (b1 + b2 + b3 = 0)::INTEGER AS r4 FROM trm"""),
        "any_head_label": _q("", """SELECT impression_id, (b1 + b2 + b3 + b4 > 0)::INTEGER AS y_any,
 least(greatest(click, 0), 1)::DOUBLE AS click_clipped FROM trm"""),
        "hazard": _q("", f"SELECT impression_id, {_r6(_hazard())} AS p FROM te"),
        "masked_bce": _q(
            "trs AS (SELECT * FROM scored WHERE impression_id IN (SELECT impression_id FROM trm)),\n"
            + _HEADS.format(z="z,", t="trs") + """,
bce AS (SELECT head, label, mature * at_risk AS weight, z - 0.5::DOUBLE * head AS l FROM pp)""",
            f"""SELECT head, {_r6('sum((greatest(l, 0.0) - l * label + ln(1.0 + exp(-abs(l)))) * weight) / greatest(sum(weight), 1)')} AS loss,
 sum(weight)::BIGINT AS weight FROM bce GROUP BY head"""),
        "ctcvr": _q("", f"SELECT impression_id, {_r6(_CTCVR)} AS p FROM te"),
        "fsiw_observed": _q(_OBS, "SELECT impression_id, y_obs, elapsed, elapsed_deadline FROM obs"),
        "fsiw_d1": _q(_OBS, f"""SELECT impression_id, elapsed_deadline, (event_s < {_TRAIN_END - 172800})::INTEGER AS s
 FROM obs WHERE start_s < {_TRAIN_END - 172800} AND y_obs = 1"""),
        "fsiw_d0": _q(_OBS, f"""SELECT impression_id, elapsed_deadline, (y_obs = 0)::INTEGER AS s
 FROM obs WHERE start_s < {_TRAIN_END - 172800} AND (y_obs = 0 OR coalesce(event_s >= {_TRAIN_END - 172800}, false))"""),
        "fsiw_weights": _q(_OBS, f"SELECT impression_id, y_obs, {_r6(w_obs)} AS weight FROM obs"),
        "platt_intercept": _q(_platt("z", "y", False), f"SELECT {_r6('a')} AS slope, {_r6('b')} AS intercept FROM platt"),
        "platt_slope": _q(_platt("z", "y", True), f"SELECT {_r6('a')} AS slope, {_r6('b')} AS intercept FROM platt"),
        **{f"platt_{kind}_folds": _q(
            _FOLD_PRED + ",\n" + _platt_groups(f"SELECT fold_id, z AS x, y::DOUBLE AS y FROM ({_FOLD_CAL})", ("fold_id",), kind == "slope"),
            f"SELECT fold_id, {_r6('a')} AS slope, {_r6('b')} AS intercept FROM platt") for kind in ("intercept", "slope")},
        "calibrate_folds": _q(
            _FOLD_PRED + ",\n" + _platt_groups(f"SELECT fold_id, z AS x, y::DOUBLE AS y FROM ({_FOLD_CAL})", ("fold_id",), False),
            f"SELECT fold_id, impression_id, {_r6(_sig('a * z + b'))} AS p FROM fp JOIN folds USING (fold_id) JOIN platt USING (fold_id) "
            "WHERE start_s >= train_end_s + 86400"),
        "platt_heads_folds": _q(
            _FOLD_PRED + ",\n" + _platt_groups(
                f"SELECT fold_id, unnest([1, 2, 3, 4])::INTEGER AS head, z - 0.5::DOUBLE * unnest([1, 2, 3, 4]) AS x, "
                f"unnest([b1, b2, b3, b4])::DOUBLE AS y FROM ({_FOLD_CAL})", ("fold_id", "head"), True),
            f"SELECT fold_id, head, {_r6('a')} AS slope, {_r6('b')} AS intercept FROM platt"),
        "platt_apply": _q(_platt("z", "y", False),
                          f"SELECT impression_id, {_r6(_sig('a * z + b'))} AS p FROM tst JOIN platt ON true"),
        "calibrate_multi": _q(_platt(_logit(_hazard()), "b1 + b2 + b3 + b4 > 0", True),
                              f"SELECT impression_id, {_r6(_sig(f'a * {_logit(_hazard())} + b'))} AS p FROM tst JOIN platt ON true"),
        "calibrate_ctcvr": _q(_platt(_logit(_CTCVR), "y", False),
                              f"SELECT impression_id, {_r6(_sig(f'a * {_logit(_CTCVR)} + b'))} AS p FROM tst JOIN platt ON true"),
        "nll_rce": _q(_losses("te"), f"SELECT {_r6('nll_mean')} AS nll_mean, {_r6('base_rate')} AS base_rate, {_r6('rce')} AS rce FROM loss2"),
        "avg_precision": _q(_curves("te"), f"SELECT {_r6('ap')} AS ap FROM curve"),
        "pr_auc": _q(_curves("te"), f"SELECT {_r6('pr_auc')} AS pr_auc FROM curve"),
        "topk": _q(_tops("te"), f"SELECT {_TOPS_R} FROM tops"),
        "topk_ties": _q("tied AS (SELECT impression_id, y, round(p, 1) AS p FROM te),\n" + _tops("tied"),
                        "SELECT share, k, tp FROM hits"),
        "eval_all": _q(_losses("te") + ",\n" + _curves("te") + ",\n" + _tops("te"),
                       f"SELECT {_METRICS_R} FROM loss2 JOIN curve ON true JOIN tops ON true"),
        "eval_all_split": _q(_losses("te") + ",\n" + _curves("te") + ",\n" + _tops("te"),
                             f"SELECT {_METRICS_R} FROM loss2 JOIN curve ON true JOIN tops ON true"),
        "reliability": _q(_bins(), f"SELECT bin, n, {_r6('mean_p')} AS mean_p, {_r6('mean_y')} AS mean_y FROM rel"),
        "ece": _q(_bins(), f"SELECT {_r6('sum(n * abs(mean_y - mean_p)) / sum(n)')} AS ece FROM rel"),
        "box_stats": _box("y"),
        "box_stats_click": _box("click"),
        "eval_summary": _q(_platt("z", "y", False), f"""SELECT count(*) AS n, {_r6('avg(y)')} AS positive_rate,
 {_r6(f"avg({_sig('a * z + b')})")} AS mean_p, {_r6('avg(p)')} AS mean_p_raw FROM tst JOIN platt ON true"""),
        "fold_average": _q(
            _FOLD_PRED + ",\n" + _losses("fp", "fold_id") + ",\n" + _curves("fp", "fold_id") + ",\n"
            + _tops("fp", "fold_id") + """,
ev AS (SELECT * FROM loss2 JOIN curve USING (fold_id) JOIN tops USING (fold_id))""",
            f"SELECT fold_id::VARCHAR AS fold_id, {_METRICS_R} FROM ev UNION ALL SELECT 'AVG', "
            + ", ".join(_r6(f"avg({m})") for m in _METRICS) + " FROM ev"),
        "holdout": _q(_OBS, f"""SELECT impression_id, (y_obs = 0)::INTEGER AS s,
 (cast('0x' || substr(md5('42-holdout:' || ((y_obs = 0)::INTEGER)::VARCHAR || '/' || impression_id::VARCHAR), 1, 12) AS BIGINT)
  < 28147497671066)::INTEGER AS is_valid
 FROM obs WHERE start_s < {_TRAIN_END - 172800} AND (y_obs = 0 OR coalesce(event_s >= {_TRAIN_END - 172800}, false))"""),
        "one_hot": _q("", f"SELECT impression_id, {_r6(' + '.join(_hot))} AS total FROM prep"),
        "head_labels": _q("", "SELECT impression_id, b1, b2, b3, b4, m1, m2, m3, m4 FROM trm"),
        "lr_certificate": _q("", """SELECT count(*) AS n_rows, round(avg(conversion), 4) AS base_rate, round(avg(conversion), 4) AS mean_p,
 1 AS is_optimal FROM tr"""),
        **{f"rows_{m}": _q("", f"SELECT impression_id, {y} AS y, 1 AS is_probability FROM {rows}") for m, y, rows in (
            ("lr", "conversion", "te"), ("rf", "conversion", "te"), ("mlp_heads_click", "(b1 + b2 + b3 + b4 > 0)::INTEGER", "tst"),
            ("deep_fm_heads_click", "(b1 + b2 + b3 + b4 > 0)::INTEGER", "te"), ("esmm", "conversion", "tst"))},
        "sink_days": _q("", """SELECT start_s // 86400 * 86400 AS day_s, count(*) AS n, sum(conversion)::BIGINT AS conversions FROM buck
 WHERE conversion = 1 OR (start_s - 1704067200) // 86400 NOT IN (4, 5, 11) GROUP BY 1"""),
        **{name: _q(f"""wm AS (SELECT least(max(start_s), max(event_s)) - 3600 AS w FROM buck)""",
                            """SELECT impression_id, conversion, conversion_delay, bucket_id FROM buck
 WHERE conversion = 1 OR start_s + (SELECT h FROM hz) < (SELECT w FROM wm)""") for name in ("stream_labels", "stream_labels_restarted")},
        "stream_buckets": _q("", """SELECT start_s // 86400 * 86400 AS day_s, bucket_id, count(*) AS n FROM buck
 WHERE (start_s // 86400 + 1) * 86400 <= (SELECT max(start_s) - 3600 FROM buck) GROUP BY 1, 2"""),
        "candidate_scores": _candidates("avg"),
        "candidate_medians": _candidates("median"),
    }
