"""Human review loop (H1-H13): work queues, consistency of reviewer decisions
with history, decision patterns, status changes and audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..policy import APPROVABLE_STATUSES, RATIONALE_CATEGORIES, REVIEW_DECISIONS, REVIEW_STATUS
from .prefix import prior_counts, ratio_half_even


def _map(col, mapping: dict):
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr


def review_problem(reviews: DataFrame, invoices: DataFrame) -> DataFrame:
    """H6: why a submitted review would be refused (NULL = accepted), checked
    in the order: invoice exists, decision valid, rationale valid."""
    known = invoices.select(F.col("invoice_id").alias("_iid"), F.lit(True).alias("_known"))
    j = reviews.join(known, reviews.invoice_id == known._iid, "left")
    return j.withColumn("problem",
                        F.when(F.col("_known").isNull(), "invoice_not_found")
                        .when(~F.col("decision").isin(*REVIEW_DECISIONS), "invalid_decision")
                        .when(~F.col("rationale_category").isin(*RATIONALE_CATEGORIES), "invalid_rationale")
                        ).drop("_iid", "_known")


def saved_reviews(reviews: DataFrame, invoices: DataFrame) -> DataFrame:
    """Reviews that pass H6: the invoice is stored, decision and rationale are valid."""
    valid = reviews.where(F.col("decision").isin(*REVIEW_DECISIONS)
                          & F.col("rationale_category").isin(*RATIONALE_CATEGORIES))
    return valid.join(invoices.select("invoice_id"), "invoice_id", "left_semi")


def consistency_scores(saved: DataFrame) -> DataFrame:
    """H4: share of earlier decisions on the same flag with the same outcome
    (-1 with fewer than 3 earlier decisions), rounded half-even to 3 places."""
    c = prior_counts(saved, "original_flag", "decision", ["timestamp", "seq"])
    return c.withColumn("consistency_score",
                        F.when(F.col("prior_n") < 3, F.lit(-1.0))
                        .otherwise(ratio_half_even(F.col("prior_same"), F.col("prior_n"), 3)))


def consistency_note(score) -> F.Column:
    """H5."""
    return (F.when(score < 0, "Not enough historical data")
            .when(score > 0.6, "Aligned with historical pattern")
            .otherwise("Deviates from historical pattern - flagged for review"))


def pending_reviews(scored: DataFrame, saved: DataFrame) -> DataFrame:
    """H1: held invoices x their escalating decisions, not yet reviewed
    (NOT IN written as a left anti join: no null-aware plan needed)."""
    held = scored.where(F.col("status").isin("flagged", "on_hold"))
    rows = (held.select("invoice_id", "created_at", "decisions", F.posexplode("fired").alias("p", "d"))
            .where(F.col("d.escalation_level") != "none")
            .select("invoice_id", (F.col("p") + 1).alias("seq"),
                    F.col("d.rule_triggered").alias("rule_triggered"),
                    F.col("d.escalation_level").alias("escalation_level"),
                    F.get("decisions", F.col("p"))["reason"].alias("escalation_reason"), "created_at"))
    return rows.join(saved.select("invoice_id"), "invoice_id", "left_anti")


def latest_escalation(scored: DataFrame) -> DataFrame:
    """H3 per invoice: the last escalating decision -> (original_flag, original_agent)."""
    last = F.try_element_at(F.filter("fired", lambda d: d["escalation_level"] != "none"), F.lit(-1))
    return scored.select("invoice_id", last["rule_triggered"].alias("original_flag"),
                         last["actor"].alias("original_agent"))


def review_status(saved: DataFrame) -> DataFrame:
    """H7: the last review of each invoice sets its status (partial aggregate)."""
    last = (saved.groupBy("invoice_id")
            .agg(F.max_by("decision", F.struct("timestamp", "seq")).alias("decision")))
    return last.withColumn("status", _map(F.col("decision"), REVIEW_STATUS))


def _decision_counts():
    d = F.col("decision")
    return [F.count(F.when(d == "approve", 1)).alias("approve_count"),
            F.count(F.when(d == "reject", 1)).alias("reject_count"),
            F.count(F.when(d == "adjust_and_approve", 1)).alias("adjust_count"),
            F.count(F.when(d == "escalate_further", 1)).alias("escalate_count")]


def _avg_hours():
    cents = F.round(F.col("resolution_time_hours") * 100).cast("bigint")
    return F.sum(cents).alias("_cents")


def decision_patterns(saved: DataFrame) -> DataFrame:
    """H8: per flag, decision counts and mean resolution hours (2 places)."""
    g = saved.groupBy("original_flag").agg(F.count(F.lit(1)).alias("total_decisions"),
                                           *_decision_counts(), _avg_hours())
    return (g.withColumn("avg_resolution_hours",
                         ratio_half_even(F.col("_cents"), F.col("total_decisions") * 100, 2))
            .drop("_cents").withColumnRenamed("original_flag", "flag_type"))


def reviewer_consistency(scores: DataFrame) -> DataFrame:
    """H9: per reviewer, mean consistency over scored decisions (-1 if none)."""
    k = F.round(F.col("consistency_score") * 1000).cast("bigint")
    pos = F.col("consistency_score") >= 0
    g = scores.groupBy("reviewer_id").agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.sum(F.when(pos, k)).alias("_k"), F.count(F.when(pos, 1)).alias("_nk"),
        *_decision_counts(), _avg_hours())
    return (g.withColumns({
        "avg_consistency": F.when(F.col("_nk") == 0, F.lit(-1.0))
                            .otherwise(ratio_half_even(F.col("_k"), F.col("_nk") * 1000, 3)),
        "avg_resolution_hours": ratio_half_even(F.col("_cents"), F.col("total_reviews") * 100, 2)})
        .drop("_k", "_nk", "_cents"))


def overview(saved: DataFrame, scores: DataFrame, newest_reviews: int | None = None) -> DataFrame:
    """Decision patterns by flag and consistency by reviewer, one row each
    (``part`` tells which), each with its total. ``newest_reviews`` limits the
    reviewers to those of the newest so many decisions."""
    counts = ["approve_count", "reject_count", "adjust_count", "escalate_count", "avg_resolution_hours"]
    flags = decision_patterns(saved).select(
        F.lit("flag").alias("part"), F.col("flag_type").alias("name"), F.col("total_decisions").alias("total"),
        *counts, F.lit(None).cast("double").alias("avg_consistency"))
    people = reviewer_consistency(scores)
    if newest_reviews is not None:
        people = people.join(newest(saved, newest_reviews).select("reviewer_id").distinct(), "reviewer_id", "left_semi")
    return flags.unionByName(people.select(
        F.lit("reviewer").alias("part"), F.col("reviewer_id").alias("name"), F.col("total_reviews").alias("total"),
        *counts, "avg_consistency"))


def newest(saved: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` decisions (a top-k: TakeOrderedAndProject)."""
    return saved.orderBy(F.col("timestamp").desc(), F.col("seq").desc()).limit(n)


def history_by(saved: DataFrame, who: str, n: int | None = None) -> DataFrame:
    """H10 for every invoice or reviewer (``who``) at once: position of each
    decision, newest first; ``n`` keeps the newest so many of each (planned as
    a group limit ahead of the shuffle)."""
    w = Window.partitionBy(who).orderBy(F.col("timestamp").desc(), F.col("seq").desc())
    out = saved.withColumn("position", F.row_number().over(w))
    return out if n is None else out.where(F.col("position") <= n)


def approval_rows(requests: DataFrame) -> DataFrame:
    """What an accepted request writes: a status change and the human
    decision, as audit rows."""
    ok = requests.where(F.col("outcome") == "accepted").withColumn(
        "kind", F.explode(F.array(F.lit("invoice.status_change"), F.concat(F.lit("human."), F.col("action")))))
    change = F.col("kind") == "invoice.status_change"
    return ok.select(
        F.md5(F.concat_ws("|", "request_id", "kind")).alias("entry_id"), "invoice_id", F.col("kind").alias("event_type"),
        F.concat(F.lit("human:"), F.col("requested_by")).alias("actor"),
        F.when(change, F.to_json(F.struct(F.col("prior_status").alias("status")))).alias("before_state"),
        F.when(change, F.to_json(F.struct(F.col("new_status").alias("status")))).alias("after_state"))


def approval_requests(reviews: DataFrame, stored: DataFrame) -> DataFrame:
    """Approve / reject requests against current statuses."""
    req = (reviews.where(F.col("decision").isin("approve", "reject"))
           .select(F.col("decision_id").alias("request_id"), "invoice_id",
                   F.col("decision").alias("action"), F.col("reviewer_id").alias("requested_by")))
    cur = stored.select(F.col("invoice_id").alias("_iid"), F.col("status").alias("prior_status"))
    j = req.join(cur, req.invoice_id == cur._iid, "left").drop("_iid")
    outcome = (F.when(F.col("prior_status").isNull(), "not_found")
               .when((F.col("action") == "approve") & ~F.col("prior_status").isin(*APPROVABLE_STATUSES), "conflict")
               .when((F.col("action") == "reject") & (F.col("prior_status") == "approved"), "conflict")
               .otherwise("accepted"))
    new = F.when(outcome == "accepted",
                 F.when(F.col("action") == "approve", "approved").otherwise("rejected"))
    return j.withColumns({"outcome": outcome, "new_status": new})


def review_audit_rows(scores: DataFrame) -> DataFrame:
    """One append-only audit row per saved review."""
    return scores.select(
        F.md5(F.concat_ws("|", "decision_id", F.lit("human_review"))).alias("entry_id"),
        "invoice_id", F.lit("human_review").alias("event_type"),
        F.concat(F.lit("human:"), F.col("reviewer_id")).alias("actor"),
        F.format_string("Human reviewer %s decided: %s", F.col("reviewer_name"), F.col("decision")).alias("description"),
        F.lit("escalated").alias("before_state"), F.col("decision").alias("after_state"),
        F.to_json(F.struct("rationale_category", "rationale_text", "consistency_score")).alias("metadata"),
        "timestamp")
