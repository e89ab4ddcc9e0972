"""Scoring of detections against labelled texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv, normalise as n, spans as sp, validators as v
from . import detectors
from .redact import categories

STATS = ("pii_type", "tp", "fp", "fn")


def either_contains(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def score_cases(df: DataFrame, spans: str = "spans") -> DataFrame:
    """Labelled cases (case_id, pii_type, expected array, spans): tp, fp, fn per case.

    Only detections of the case's own type count.
    """
    detected = F.transform(
        F.filter(F.col(spans), lambda s: s["pii_type"] == F.col("pii_type")), lambda s: s["value"]
    )
    staged = df.withColumn("_detected", detected)
    found = F.size(
        F.filter(
            "expected", lambda e: F.exists("_detected", lambda d: either_contains(e, d))
        )
    )
    extra = F.size(
        F.filter(
            "_detected", lambda d: ~F.exists("expected", lambda e: either_contains(e, d))
        )
    )
    return staged.select(
        "case_id",
        "pii_type",
        found.cast("long").alias("tp"),
        extra.cast("long").alias("fp"),
        (F.size("expected") - found).cast("long").alias("fn"),
    )


def score_negatives(df: DataFrame, spans: str = "spans") -> DataFrame:
    """Negative texts: one row (null, tn) plus false positives by type."""
    clean = df.agg(F.count(F.when(F.size(spans) == 0, 1)).alias("n")).select(
        F.lit("TRUE_NEGATIVE").alias("pii_type"), "n"
    )
    wrong = (
        sp.unnest(df, (), spans, "s")
        .groupBy(F.col("s.pii_type").alias("pii_type"))
        .agg(F.count("*").alias("n"))
    )
    return clean.unionByName(wrong)


def _match_form(value: Column) -> Column:
    """A value with the forms the fuzzy match compares."""
    normalised = n.match_text(v.strip(value))
    return F.struct(normalised.alias("text"), n.match_tokens(normalised).alias("tokens"))


def _forms_match(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a["tokens"], b["tokens"]))
    smaller = F.least(F.size(a["tokens"]), F.size(b["tokens"]))
    return (
        (a["text"] != "")
        & (b["text"] != "")
        & (either_contains(a["text"], b["text"]) | (shared >= smaller * fv.MATCH_TOKEN_SHARE))
    )


def values_match(a: Column, b: Column) -> Column:
    """Same entity after normalising: one contains the other, or they share half of the
    words of the shorter one.  Each value is normalised once."""
    forms = F.array(F.struct(_match_form(a).alias("a"), _match_form(b).alias("b")))
    return F.element_at(F.transform(forms, lambda f: _forms_match(f["a"], f["b"])), 1)


def match_passages(df: DataFrame, spans: str = "spans", truth: str = "truth") -> DataFrame:
    """Add ``matched``: the truth index taken by each prediction, in text order, or -1.

    ``truth`` is array<struct<type, value>>.  Each prediction takes the first free truth
    of its type that matches.  Everything is inside the passage row: no shuffle.
    """
    def with_form(value_of):
        return lambda x, i: F.struct(
            value_of(x)[0].alias("pii_type"), i.alias("idx"), _match_form(value_of(x)[1]).alias("form")
        )

    staged = df.withColumns(
        {
            "_pred": F.transform(spans, with_form(lambda s: (s["pii_type"], s["value"]))),
            "_true": F.transform(
                F.coalesce(F.col(truth), F.array().cast("array<struct<type:string,value:string>>")),
                with_form(lambda t: (t["type"], t["value"])),
            ),
        }
    )
    options = sp.with_each(
        "_pred",
        "_true",
        lambda p, labels: F.transform(
            F.filter(
                labels,
                lambda t: (t["pii_type"] == p["pii_type"]) & _forms_match(p["form"], t["form"]),
            ),
            lambda t: t["idx"],
        ),
    )

    def take(acc: Column, choices: Column) -> Column:
        return F.concat(
            acc, F.array(F.coalesce(F.get(F.array_except(choices, acc), F.lit(0)), F.lit(-1)))
        )

    matched = F.aggregate(options, F.array().cast("array<int>"), take)
    return staged.withColumn("matched", matched).drop("_pred", "_true")


def passage_outcomes(df: DataFrame, spans: str = "spans", truth: str = "truth") -> DataFrame:
    """One row (passage_id, pii_type, outcome) per prediction and per missed truth."""
    outcome = "array<struct<pii_type:string,outcome:string>>"
    hit = F.zip_with(
        spans,
        "matched",
        lambda s, m: F.struct(
            s["pii_type"].alias("pii_type"), F.when(m >= 0, "tp").otherwise("fp").alias("outcome")
        ),
    )
    free = F.array_except(F.transform(truth, lambda t, i: i), "matched")
    missed = F.transform(
        free,
        lambda i: F.struct(
            F.get(F.col(truth), i)["type"].alias("pii_type"), F.lit("fn").alias("outcome")
        ),
    )
    both = F.concat(hit, F.coalesce(missed, F.array().cast(outcome)))
    return sp.unnest(df, ["passage_id"], both, "o").select("passage_id", "o.*")


def passage_stats(outcomes: DataFrame) -> DataFrame:
    """tp, fp, fn per category."""
    def of(outcome: str) -> Column:
        return F.count(F.when(F.col("outcome") == outcome, 1)).alias(outcome)

    return outcomes.groupBy("pii_type").agg(of("tp"), of("fp"), of("fn"))


def observed_types(df: DataFrame, truth: str = "truth") -> DataFrame:
    return df.select(F.explode(truth).alias("t")).select(F.col("t.type").alias("pii_type")).distinct()


def _ratio(part: Column, whole: Column, empty: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(empty)


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def per_type(stats: DataFrame, observed: DataFrame | None = None) -> DataFrame:
    """Unrounded precision, recall and F1 for all nine categories.

    Without ``observed`` every category counts as observed.  A category with no counts
    scores 1; one with only misses has precision 0.
    """
    dimension = categories(stats.sparkSession)
    joined = dimension.join(stats, "pii_type", "left")
    if observed is None:
        joined = joined.withColumn("observed", F.lit(True))
    else:
        joined = joined.join(observed.withColumn("observed", F.lit(True)), "pii_type", "left")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    counted = joined.select(
        "pii_type",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in STATS[1:]],
        F.coalesce("observed", F.lit(False)).alias("observed"),
    )
    precision = _ratio(tp, tp + fp, F.when(fn == 0, 1.0).otherwise(0.0))
    recall = _ratio(tp, tp + fn, F.lit(1.0))
    return (
        counted.withColumns({"precision": precision, "recall": recall})
        .withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    )


def rounded(metrics: DataFrame) -> DataFrame:
    return metrics.withColumns(
        {c: F.round(c, 4) for c in ("precision", "recall", "f1")}
    )


def averages(metrics: DataFrame) -> DataFrame:
    """Micro and macro averages over categories that are observed or have truths."""
    counted = metrics.where(F.col("observed") | (F.col("tp") + F.col("fn") > 0))
    sums = counted.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in STATS[1:]],
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias("macro_" + c) for c in ("precision", "recall", "f1")],
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        sums.withColumns(
            {
                "micro_precision": _ratio(tp, tp + fp, F.lit(0.0)),
                "micro_recall": _ratio(tp, tp + fn, F.lit(0.0)),
            }
        )
        .withColumn("micro_f1", _f1(F.col("micro_precision"), F.col("micro_recall")))
        .select(
            *STATS[1:],
            *[
                F.round(f"{kind}_{m}", 4).alias(f"{kind}_{m}")
                for kind in ("micro", "macro")
                for m in ("precision", "recall", "f1")
            ],
        )
    )


def binary_accuracy(case_stats: DataFrame, negatives: DataFrame, cases: DataFrame, texts: DataFrame) -> DataFrame:
    """(true positives + true negatives) / (positive cases + negative cases), as one row."""
    parts = (
        case_stats.agg(F.sum("tp").alias("good")).withColumn("all", F.lit(0).cast("long"))
        .unionByName(
            negatives.where(F.col("pii_type") == "TRUE_NEGATIVE")
            .agg(F.sum("n").alias("good"))
            .withColumn("all", F.lit(0).cast("long"))
        )
        .unionByName(cases.agg(F.count("*").alias("all")).withColumn("good", F.lit(0).cast("long")))
        .unionByName(texts.agg(F.count("*").alias("all")).withColumn("good", F.lit(0).cast("long")))
    )
    return parts.agg(F.round(F.sum("good") / F.sum("all"), 4).alias("accuracy"))


def case_stats(cases: DataFrame, negatives: DataFrame, spans: str = "spans") -> DataFrame:
    """tp, fp, fn per category over labelled cases, with the detections in negative texts."""
    zero = F.lit(0).cast("long")
    wrong = sp.unnest(negatives, (), spans, "s").select(
        F.col("s.pii_type").alias("pii_type"), zero.alias("tp"), F.lit(1).cast("long").alias("fp"), zero.alias("fn")
    )
    return (
        score_cases(cases, spans).drop("case_id").unionByName(wrong)
        .groupBy("pii_type").agg(*[F.sum(c).alias(c) for c in STATS[1:]])
    )


def passage_metrics(passages: DataFrame) -> DataFrame:
    """Unrounded metrics over labelled passages that carry ``spans`` and ``truth``."""
    matched = match_passages(passages)
    return per_type(passage_stats(passage_outcomes(matched)), observed_types(matched))


SCOPED = ("pii_type", *STATS[1:], "precision", "recall", "f1", "observed")


def scoped(metrics: DataFrame) -> DataFrame:
    """Per-type metrics with ``tier``, and each tier's micro and macro averages, as rows.

    scope is ``type``, ``micro`` or ``macro``; the averages' pii_type is null.  They are made from
    the nine rows of a tier, so the detection below runs once.
    """
    counted = F.col("observed") | (F.col("tp") + F.col("fn") > 0)
    tiers = metrics.groupBy("tier").agg(
        F.collect_list(F.struct(*SCOPED)).alias("types"),
        *[F.coalesce(F.sum(F.when(counted, F.col(c))), F.lit(0)).alias(c) for c in STATS[1:]],
        *[F.coalesce(F.avg(F.when(counted, F.col(c))), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")],
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    micro_p, micro_r = _ratio(tp, tp + fp, F.lit(0.0)), _ratio(tp, tp + fn, F.lit(0.0))

    def row(scope: str, pii_type: Column, counts: Sequence[Column], p: Column, r: Column, f: Column, observed: Column):
        values = (pii_type, *counts, F.round(p, 4), F.round(r, 4), F.round(f, 4), observed)
        return F.struct(F.lit(scope).alias("scope"), *[v.alias(n) for v, n in zip(values, SCOPED)])

    none, yes, sums = F.lit(None).cast("string"), F.lit(True), (tp, fp, fn)
    rows = F.concat(
        F.transform("types", lambda t: row("type", t["pii_type"], [t[c] for c in STATS[1:]], t["precision"], t["recall"], t["f1"], t["observed"])),
        F.array(
            row("micro", none, sums, micro_p, micro_r, _f1(micro_p, micro_r), yes),
            row("macro", none, sums, F.col("precision"), F.col("recall"), F.col("f1"), yes),
        ),
    )
    return tiers.select("tier", F.explode(rows).alias("r")).select("tier", "r.*")


def run(cases: DataFrame, negatives: DataFrame, passages: DataFrame, **detection) -> DataFrame:
    """Both tiers: detect and score cases with negatives, and labelled passages.

    Rows per category and the micro and macro averages of each tier (see ``scoped``).  No passages
    at all give a second tier of zero counts, none of them observed.
    """
    def found(df: DataFrame) -> DataFrame:
        return detectors.detect(df, **detection)

    first = per_type(case_stats(found(cases), found(negatives)))
    second = passage_metrics(found(passages))
    return scoped(first.withColumn("tier", F.lit("cases")).unionByName(second.withColumn("tier", F.lit("passages"))))


def totals(outcomes: DataFrame) -> DataFrame:
    """Metrics of every category of a tier, of each tier and of all, from one grouped pass.

    ``outcomes``: (tier, pii_type, tp, fp, fn), any number of rows; a row without a category counts
    for its tier alone.  scope is ``type``, ``tier`` or ``all``; n is the number of decisions.
    Nothing predicted and nothing missed is precision 1, otherwise nothing right is 0.
    """
    named = F.when(F.grouping("tier") == 1, "all").when(F.grouping("pii_type") == 1, "tier").otherwise("type")
    sums = outcomes.groupingSets([["tier", "pii_type"], ["tier"], []], "tier", "pii_type").agg(
        named.alias("scope"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in STATS[1:]]
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rated = sums.where((F.col("scope") != "type") | F.col("pii_type").isNotNull()).withColumns({
        "precision": _ratio(tp, tp + fp, F.when(fn == 0, 1.0).otherwise(0.0)), "recall": _ratio(tp, tp + fn, F.lit(1.0)),
    })
    rated = rated.withColumn("f1", _f1(F.col("precision"), F.col("recall"))).withColumn("n", tp + fp + fn)
    return rounded(rated).select("scope", "tier", "pii_type", *STATS[1:], "n", "precision", "recall", "f1")


def full_run(cases: DataFrame, negatives: DataFrame, passages: DataFrame, as_of: str, **detection) -> DataFrame:
    """``totals`` of both tiers with the accuracy over the first, what was evaluated, and when.

    accuracy: found cases and clean negatives over all of them, on the rows of tier ``cases``
    as a whole.  n_texts: the texts of the tier, of both for all.
    """
    found = {k: detectors.detect(df, **detection) for k, df in (("cases", cases), ("negatives", negatives), ("passages", passages))}
    each = score_cases(found["cases"])
    clean = found["negatives"].select((F.size("spans") == 0).cast("long").alias("clean"), F.size("spans").cast("long").alias("fp"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    rows = each.select(
        F.lit("cases").alias("tier"), "pii_type", "tp", "fp", "fn", F.lit(1).cast("long").alias("texts"), F.col("tp").alias("right")
    ).unionByName(
        clean.select(F.lit("cases").alias("tier"), none.alias("pii_type"), zero.alias("tp"), zero.alias("fp"), zero.alias("fn"),
                     F.lit(1).cast("long").alias("texts"), F.col("clean").alias("right"))
    ).unionByName(
        sp.unnest(found["negatives"], (), "spans", "s").select(
            F.lit("cases").alias("tier"), F.col("s.pii_type").alias("pii_type"), zero.alias("tp"),
            F.lit(1).cast("long").alias("fp"), zero.alias("fn"), zero.alias("texts"), zero.alias("right"))
    )
    matched = passage_stats(passage_outcomes(match_passages(found["passages"])))
    second = matched.select(F.lit("passages").alias("tier"), "pii_type", "tp", "fp", "fn", zero.alias("texts"), zero.alias("right"))
    second = second.unionByName(passages.select(
        F.lit("passages").alias("tier"), none.alias("pii_type"), zero.alias("tp"), zero.alias("fp"), zero.alias("fn"),
        F.lit(1).cast("long").alias("texts"), zero.alias("right")))
    every = rows.unionByName(second)
    counted = every.groupingSets([["tier"], []], "tier").agg(F.sum("texts").alias("n_texts"), F.sum("right").alias("_right"))
    metrics = totals(every.select("tier", "pii_type", "tp", "fp", "fn"))
    joined = metrics.join(
        F.broadcast(counted.withColumnRenamed("tier", "_tier")),
        (F.col("scope") != "type") & F.col("tier").eqNullSafe(F.col("_tier")), "left",
    )
    first = (F.col("scope") == "tier") & (F.col("tier") == "cases") & (F.col("n_texts") > 0)
    return joined.withColumn("accuracy", F.when(first, F.round(F.col("_right") / F.col("n_texts"), 4))).withColumn(
        "as_of", F.lit(as_of)
    ).drop("_tier", "_right")


def report(metrics: DataFrame) -> DataFrame:
    """Metrics as printed: categories that were not observed show nulls."""
    shown = rounded(metrics)
    return shown.select(
        "pii_type",
        "observed",
        *[F.when(F.col("observed"), F.col(c)).alias(c) for c in (*STATS[1:], "precision", "recall", "f1")],
    )
