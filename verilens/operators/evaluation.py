"""Evaluation against gold labels, gates and log analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import hash_similarity  # noqa: F401  (part of the public surface)
from ..model import severity_rank
from ..plans import ranks as R


def case_recall(gold: DataFrame, findings: DataFrame) -> DataFrame:
    """Expected detectors that fired, per case.

    ``gold(case_id, expected_detectors ARRAY, absent_detectors ARRAY)``; findings carry doc_id = case_id.
    """
    fired = findings.select(F.col("doc_id").alias("case_id"), "detector").distinct().withColumn("_f", F.lit(1))

    def side(column: str, total: str, hit: str) -> DataFrame:
        wanted = gold.select("case_id", F.explode(F.array_distinct(column)).alias("detector"))
        return (
            wanted.join(fired, ["case_id", "detector"], "left")
            .groupBy("case_id")
            .agg(F.count(F.lit(1)).alias(total), F.count("_f").alias(hit))
        )

    return (
        gold.select("case_id")
        .join(side("expected_detectors", "expected", "found"), "case_id", "left")
        .join(side("absent_detectors", "absent", "false_alarms"), "case_id", "left")
        .na.fill(0, ["expected", "found", "absent", "false_alarms"])
        .withColumn("recall", F.when(F.col("expected") > 0, F.col("found") / F.col("expected")).otherwise(1.0))
    )


def overall_recall(cases: DataFrame, gate: float = 0.70) -> DataFrame:
    """Weighted recall over all cases and the gate."""
    return cases.agg(
        F.sum("expected").alias("expected"),
        F.sum("found").alias("found"),
        F.sum("false_alarms").alias("false_alarms"),
    ).withColumn("recall", F.try_divide("found", "expected")).withColumn("passed", F.col("recall") >= gate)


def target_recall(alignment: DataFrame) -> DataFrame:
    """(exact + partial) / (exact + partial + missed) per case."""
    of = lambda s: F.count_if(F.col("status") == s)
    return alignment.groupBy("case_id").agg(
        of("exact").alias("exact"), of("partial").alias("partial"), of("missed").alias("missed")
    ).withColumn(
        "recall",
        F.try_divide(F.col("exact") + F.col("partial"), F.col("exact") + F.col("partial") + F.col("missed")),
    )


def precision_at_k(scored: DataFrame, k: int = 20) -> DataFrame:
    """Share of relevant findings among the first ``k`` of each case.

    ``scored(case_id, finding_id, detector, severity, score, relevant)``; a hot
    case is cut to its first ``k`` per part before the final ranking.
    """
    order = [severity_rank("severity").desc(), F.col("score").desc(), F.col("detector"), F.col("finding_id")]
    part = scored.withColumn("_part", F.pmod(F.xxhash64("finding_id"), F.lit(64)))
    local = part.withColumn(
        "_l", F.row_number().over(W.partitionBy("case_id", "_part").orderBy(*order))
    ).filter(F.col("_l") <= k)
    top = local.withColumn("_r", F.row_number().over(W.partitionBy("case_id").orderBy(*order))).filter(F.col("_r") <= k)
    return top.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("considered"),
        F.count_if("relevant").alias("relevant"),
    ).withColumn("precision", F.col("relevant") / F.col("considered"))


def gates(cases: DataFrame, precision: DataFrame, min_recall: float = 0.70, min_precision: float = 0.15) -> DataFrame:
    """Recall and precision gates in one row."""
    r = overall_recall(cases, min_recall).select(F.col("recall"), F.col("passed").alias("recall_ok"))
    p = precision.agg(F.avg("precision").alias("precision")).withColumn(
        "precision_ok", F.col("precision") >= min_precision
    )
    return r.withColumn("_k", F.lit(1)).join(p.withColumn("_k", F.lit(1)), "_k").drop("_k")


def expectations(expected: DataFrame, findings: DataFrame) -> DataFrame:
    """Counts and required or forbidden titles per case (E5).

    ``expected(case_id, min_findings, max_findings, must ARRAY, must_not ARRAY)``.
    """
    text = F.lower("title")
    counts = findings.groupBy(F.col("doc_id").alias("case_id")).agg(F.count(F.lit(1)).alias("findings"))

    def named(column: str, out: str) -> DataFrame:
        words = expected.select("case_id", F.explode(F.array_distinct(column)).alias("word"))
        titles = findings.select(F.col("doc_id").alias("case_id"), text.alias("title")).distinct()
        hit = words.join(titles, "case_id").filter(F.col("title").contains(F.lower("word")))
        return hit.select("case_id", "word").distinct().groupBy("case_id").agg(F.count(F.lit(1)).alias(out))

    joined = (
        expected.join(counts, "case_id", "left")
        .join(named("must", "met"), "case_id", "left")
        .join(named("must_not", "broken"), "case_id", "left")
        .na.fill(0, ["findings", "met", "broken"])
    )
    ok = (
        (F.col("findings") >= F.coalesce("min_findings", F.lit(0)))
        & (F.col("max_findings").isNull() | (F.col("findings") <= F.col("max_findings")))
        & (F.col("met") == F.size(F.array_distinct("must")))
        & (F.col("broken") == 0)
    )
    return joined.select("case_id", "findings", "met", "broken", ok.alias("passed"))


def regression_gates(cases: DataFrame, findings: DataFrame, high_budget: float = 2.0) -> DataFrame:
    """Core recall is one, highs per paper within budget, no absent detector fires."""
    highs = findings.filter("severity = 'high'").groupBy(F.col("doc_id").alias("case_id")).agg(
        F.count(F.lit(1)).alias("high")
    )
    joined = cases.join(highs, "case_id", "left").na.fill(0, ["high"])
    return joined.groupBy("benchmark").agg(
        F.count(F.lit(1)).alias("cases"),
        F.every(F.col("found") == F.col("expected")).alias("recall_ok"),
        (F.avg("high") <= high_budget).alias("budget_ok"),
        (F.sum("false_alarms") == 0).alias("absent_ok"),
    )


def suggested_threshold(scores: DataFrame, target_fpr: float = 0.05) -> DataFrame:
    """Best Youden threshold and best threshold within a false-positive rate.

    ``scores(score, label)``.  Rates come from counts per distinct score;
    cumulative counts run bucket by bucket.
    """
    counts = scores.withColumn("_g", F.lit(0)).groupBy("_g", "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )
    below_pos = R.value_distribution(counts, ["_g"], "score", weight="pos").select(
        "score", F.col("before").alias("pos_below"), F.col("n").alias("pos_all")
    )
    below_neg = R.value_distribution(counts, ["_g"], "score", weight="neg").select(
        "score", F.col("before").alias("neg_below"), F.col("n").alias("neg_all")
    )
    rates = below_pos.join(below_neg, "score").select(
        "score",
        ((F.col("pos_all") - F.col("pos_below")) / F.nullif(F.col("pos_all"), F.lit(0))).alias("tpr"),
        ((F.col("neg_all") - F.col("neg_below")) / F.nullif(F.col("neg_all"), F.lit(0))).alias("fpr"),
    )
    best = F.max(F.struct((F.col("tpr") - F.col("fpr")).alias("j"), (-F.col("score")).alias("s"), "tpr", "fpr"))
    low = F.max(
        F.when(F.col("fpr") <= target_fpr, F.struct("tpr", (-F.col("score")).alias("s"), "fpr"))
    )
    return rates.agg(best.alias("b"), low.alias("l")).select(
        (-F.col("b.s")).alias("youden_threshold"),
        F.col("b.j").alias("youden"),
        (-F.col("l.s")).alias("fpr_threshold"),
        F.col("l.tpr").alias("fpr_tpr"),
    )


# --------------------------------------------------------------------------- logs


def tool_stats(log: DataFrame) -> DataFrame:
    """Calls, errors, mean, p50 and p95 per tool; percentiles are order statistics.

    ``log(tool, ok, duration_ms)``.
    """
    dist = R.value_distribution(log, ["tool"], "duration_ms")
    ranks = dist.groupBy("tool").agg(
        R.at_rank("duration_ms", F.floor(F.col("n") / 2)).alias("p50"),
        R.at_rank(
            "duration_ms", F.greatest(F.floor(F.col("n") * F.lit(0.95)) - 1, F.lit(0))
        ).alias("p95"),
    )
    counts = log.groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(~F.col("ok")).alias("errors"),
        F.avg("duration_ms").alias("avg_ms"),
    )
    return counts.join(ranks, "tool")


def call_cost(model: Column, in_tok: Column, out_tok: Column, prices: dict[str, tuple[float, float]], default: str) -> Column:
    """Token price per thousand of a model, or of the default one."""
    table = lambda i: F.create_map(*[F.lit(x) for k, v in prices.items() for x in (k, v[i])])
    price = lambda i: F.coalesce(F.try_element_at(table(i), model), F.lit(prices[default][i]))
    return in_tok / 1000 * price(0) + out_tok / 1000 * price(1)


def cost_summary(log: DataFrame, now: Column, days: int) -> DataFrame:
    """Cost by model over the last days with a total row (E9): ``log(ts, model, in_tok, out_tok, cost_usd)``."""
    recent = log.filter(F.col("ts") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))
    return recent.rollup("model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("in_tok").alias("in_tok"),
        F.sum("out_tok").alias("out_tok"),
        F.sum("cost_usd").alias("cost_usd"),
    ).withColumn("model", F.coalesce("model", F.lit("total")))
