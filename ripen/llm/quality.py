"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every document gets counts of its whole text, from which rule signals are derived (larger is worse).  Per
stratum and rule, labelled documents are the holdout of a fixed list of cutoffs.  A cutoff is certified
when the exact binomial test rejects "more than ``false_rejection / rules`` of the good documents exceed
it" at level ``error / (strata * rules)``.  Cutoffs are tested from the most lenient on and testing stops
at the first failure, so the list itself needs no further correction; strata and rules are corrected by
Bonferroni.  With probability at least ``1 - error``, no stratum loses more than ``false_rejection`` of
its good documents to the certified rules.  Among certified cutoffs the one that removes most bad minus
good labelled documents is used; a rule without one rejects nothing.

Null and empty texts have no words and fail the base rule.  A null stratum is a stratum of its own.
Repeated document rows are judged one by one; a document labelled more than once counts as good if any of
its labels says so; labels that are null are ignored.  Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import prepare_session, small_side, store

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``signal`` is a share of [0, inf); ``cutoffs`` run from lenient to strict."""

    name: str
    signal: str
    cutoffs: tuple[float, ...]


_STEPS = (4.0, 2.0, 1.0, 0.75, 0.5, 0.35, 0.25, 0.18, 0.125, 0.09, 0.0625, 0.045, 0.03125)
RULES = (
    Rule("symbols", "n_symbols / greatest(n_words, 1)", _STEPS),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", _STEPS[2:]),
    Rule("lines", "n_dup_lines / greatest(n_lines, 1)", _STEPS[2:]),
    Rule("capitals", "n_upper / greatest(word_chars, 1)", _STEPS[3:9]),
)


@dataclass(frozen=True)
class Risk:
    """At most ``false_rejection`` of a stratum's good documents go, except with probability ``error``."""

    false_rejection: float = 0.02
    error: float = 0.05


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words within 3-word windows that the text holds at least twice."""

    def covered(hashes):
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

        def marks(rows):
            same = lambda row, i, step: row["h"] == F.get(rows, i + F.lit(step))["h"]
            at = F.transform(
                rows, lambda row, i: F.when(F.coalesce(same(row, i, -1), F.lit(False))
                                            | F.coalesce(same(row, i, 1), F.lit(False)), row["at"])
            )
            return F.aggregate(
                F.array_sort(F.filter(at, lambda x: x.isNotNull())),
                F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
                lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n")),
                lambda acc: acc["n"],
            )

        some = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(some, _let(ordered, marks)).otherwise(F.lit(0).cast("long"))

    def windows(w):
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(windows(words), covered))


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` as column ``row`` beside one struct column ``c`` of counts of the whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = docs.select(F.struct("*").alias("row"), text.alias("text"))
    length = lambda kept: F.length(kept).cast("long")
    split = raw.select(
        "row", "text",
        F.array_remove(F.split("text", SPACE + "+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    return split.select(
        "row",
        F.struct(
            F.size("words").cast("long").alias("n_words"),
            length(F.translate("text", " \t\n\x0b\f\r", "")).alias("word_chars"),
            (length("text") - length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            _repeat_words(F.col("words")).alias("n_repeat_words"),
            F.size("lines").cast("long").alias("n_lines"),
            (length("text") - length(F.regexp_replace("text", r"\p{Lu}", ""))).alias("n_upper"),
        ).alias("c"),
    )


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8, stepped back (error below 1e-12)."""
    z = x + 8.0
    series = (1 / (12 * z)) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5)))
    steps = x
    for k in range(1, 8):
        steps = steps * (x + float(k))
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - F.log(steps)


def binomial_tail(x: Column, n: Column, share: float) -> Column:
    """P(X <= x) of a binomial(n, share) for x <= n * share, summed exactly from its largest term down."""
    x, n = x.cast("double"), n.cast("double")
    top = (
        _log_gamma(n + 1) - _log_gamma(x + 1) - _log_gamma(n - x + 1)
        + x * F.log(F.lit(share)) + (n - x) * F.log(F.lit(1 - share))
    )
    # Terms fall at least like a Gaussian of this width; what lies beyond adds less than 1e-16.
    width = F.least(x, F.ceil(12 * F.sqrt(n * share) + 50).cast("double")).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(0), width),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda acc, i: F.struct(
            (acc["term"] * (x - i) * (1 - share) / ((n - x + i + 1) * share)).alias("term"),
            (acc["sum"] + acc["term"]).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return F.exp(top) * total


def fit_cutoffs(counts: DataFrame, labels: DataFrame, risk: Risk = Risk(), rules=RULES) -> DataFrame:
    """``stratum`` and one column ``cut_<rule>`` each (null: the rule rejects nothing there).

    ``counts`` has ``doc_id``, ``stratum`` and the counts of :func:`text_counts`; ``labels`` has ``doc_id``
    and ``quality`` (1: good).
    """
    known = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    )
    levels = F.array(*[
        F.struct(
            F.lit(rule.name).alias("rule"),
            sum(F.expr(f"{rule.signal} >= {cut}").cast("int") for cut in rule.cutoffs).alias("reached"),
        )
        for rule in rules
    ])
    # Cutoffs fall: a document that reaches ``reached`` of them reaches the last ones, from at = of - reached on.
    rows = (
        counts.join(known, "doc_id").select("stratum", "good", F.explode(levels).alias("x"))
        .groupBy("stratum", F.col("x.rule").alias("rule"), F.col("x.reached").alias("reached"))
        .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    )
    grid = F.explode(F.array(*[
        F.struct(F.lit(rule.name).alias("rule"), F.lit(i).alias("at"), F.lit(cut).alias("cut"),
                 F.lit(len(rule.cutoffs)).alias("of"))
        for rule in rules for i, cut in enumerate(rule.cutoffs)
    ]))
    totals = rows.groupBy("stratum", "rule").agg(F.sum("good").alias("n"))
    strata = totals.select("stratum").distinct()
    n_tests = len(rules) * max(1, strata.count())
    points = strata.select("stratum", grid.alias("g")).select("stratum", "g.*")
    joined = points.alias("p").join(totals.alias("t"), [
        F.col("p.stratum").eqNullSafe(F.col("t.stratum")), F.col("p.rule") == F.col("t.rule")]).select("p.*", "n")
    hits = joined.alias("p").join(rows.alias("r"), [
        F.col("p.stratum").eqNullSafe(F.col("r.stratum")), F.col("p.rule") == F.col("r.rule"),
        F.col("r.reached") >= F.col("p.of") - F.col("p.at")], "left").groupBy(
        "p.stratum", "p.rule", "p.at", "p.cut", "p.n").agg(
        F.coalesce(F.sum("r.good"), F.lit(0)).alias("lost"), F.coalesce(F.sum("r.bad"), F.lit(0)).alias("caught"))
    share = risk.false_rejection / len(rules)
    passed = F.when(F.col("lost") <= F.col("n") * share,
                    binomial_tail(F.col("lost"), F.col("n"), share) <= risk.error / n_tests)
    lenient_first = Window.partitionBy("stratum", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    certified = (
        hits.withColumn("passed", F.coalesce(passed, F.lit(False)))
        .withColumn("all_passed", F.min("passed").over(lenient_first)).where("all_passed and caught > lost")
    )
    best = certified.groupBy("stratum", "rule").agg(
        F.max(F.struct((F.col("caught") - F.col("lost")).alias("gain"), (-F.col("at")).alias("lenient"), "cut")).alias("b"))
    cuts = [F.max(F.when(F.col("rule") == rule.name, F.col("b.cut"))).alias(f"cut_{rule.name}") for rule in rules]
    return best.groupBy("stratum").agg(*cuts)


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def _verdict(rules) -> Column:
    bad = base_failed()
    for rule in rules:
        bad = bad | F.coalesce(F.expr(f"{rule.signal} >= cut_{rule.name}"), F.lit(False))
    return ~bad


def _fitted(docs, labels, risk, rules, id_col, text_col, stratum_col):
    """The documents beside their counts, the stored counts, and the stored cutoffs."""
    prepare_session(docs.sparkSession)
    stratum = F.lit("all") if stratum_col is None else F.col(f"row.{stratum_col}").cast("string")
    counted = text_counts(docs, text_col).withColumn("stratum", stratum)
    narrow = store(counted.select(F.col(f"row.{id_col}").alias("doc_id"), "stratum", "c.*"))
    return counted, narrow, store(fit_cutoffs(narrow, labels, risk, rules))


def judge(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), rules=RULES, *, id_col: str = "doc_id",
          text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """One row per document row: ``row`` (the given columns), ``c`` (counts), ``base_failed``, ``kept``.

    The counts are stored once (some bytes per document) for fitting; the verdict is one projection over
    the documents, with the cutoffs, a row per stratum, broadcast when their measured number allows.
    """
    counted, _, cuts = _fitted(docs, labels, risk, rules, id_col, text_col, stratum_col)
    # A generator keeps the verdict from being pushed into the counts, which would compute them many times.
    once = counted.select("row", "stratum", F.explode(F.array("c")).alias("c"))
    return _apply(once.select("row", "c", "stratum", "c.*"), cuts, rules, ["row", "c"])


def judge_counts(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), rules=RULES, *, id_col: str = "doc_id",
                 text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """As :func:`judge` without the documents' other columns: id, counts and verdicts from the stored counts."""
    _, narrow, cuts = _fitted(docs, labels, risk, rules, id_col, text_col, stratum_col)
    return _apply(narrow, cuts, rules, [c for c in narrow.columns if c != "stratum"])


def _apply(rows: DataFrame, cuts: DataFrame, rules, columns) -> DataFrame:
    cuts = small_side(cuts.withColumnRenamed("stratum", "cut_stratum"), cuts.count())
    joined = rows.join(cuts, F.col("stratum").eqNullSafe(F.col("cut_stratum")), "left")
    return joined.select(*columns, base_failed().alias("base_failed"), _verdict(rules).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The document rows that pass, with their columns."""
    return judge(docs, labels, **options).where("kept").select("row.*")
