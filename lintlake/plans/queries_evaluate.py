"""Registered queries that compare findings with labelled truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import evaluate as E
from lintlake.sources import views_projects as P
from lintlake.sources.views import table


def inputs(spark, sf):
    return P.labelled_truth(spark, sf), P.flagged_predictions(spark, sf)


def matches(spark, sf):
    truth, predictions = inputs(spark, sf)
    return E.match_findings(truth, predictions)


def metrics(spark, sf):
    truth, predictions = inputs(spark, sf)
    reported = predictions.select(*E.RUN, "title")
    return E.run_metrics(truth, predictions, P.labelled_causes(spark, sf), reported, P.run_costs(predictions))


def eval_matches(spark, sf):
    return matches(spark, sf).select(*E.RUN, "truth_id", "finding_id", "match_type")


def eval_metrics(spark, sf):
    return metrics(spark, sf)


def eval_root_causes(spark, sf):
    """Causes hit through their symptoms alone."""
    hits = E.root_cause_hits(P.labelled_causes(spark, sf), matches(spark, sf))
    return E.rounded(hits, "root_cause_hit_rate")


def eval_dedup(spark, sf):
    return E.rounded(E.dedup_effectiveness(P.flagged_predictions(spark, sf)), "dedup_effectiveness")


def eval_aggregate(spark, sf):
    return E.aggregate_runs(metrics(spark, sf))


def eval_gates(spark, sf):
    return E.decision_gates(E.aggregate_runs(metrics(spark, sf)))


def eval_missed(spark, sf):
    return E.missed_issues(matches(spark, sf))


def eval_missed_by_cause(spark, sf):
    return E.missed_by_cause(matches(spark, sf))


def similar_titles(spark, sf):
    """Part names that share most of their words with a type label."""
    p = table(spark, sf, "part")
    left = p.select("p_brand", F.concat_ws(" ", "p_name", "p_type").alias("title"))
    right = p.select("p_brand", F.concat_ws(" ", F.lower("p_type"), F.col("p_name"), F.lit("item")).alias("title"))
    return E.similar_titles(left, right, ["p_brand"])


QUERIES = {
    f.__name__: f
    for f in (
        eval_matches, eval_metrics, eval_root_causes, eval_dedup, eval_aggregate, eval_gates, eval_missed,
        eval_missed_by_cause, similar_titles,
    )
}
