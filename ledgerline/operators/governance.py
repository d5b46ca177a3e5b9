"""Governance gates (F1-F13): each gate is a column that is a decision struct
or NULL; the ordered list, final status, first escalation level, notes, the
long decision table and its audit rows derive from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cols import compact, dec, missing, stable_id, units
from ..policy import (DEFAULT_POLICY, ROLE_ANOMALY, ROLE_EXTRACTION, ROLE_INTAKE,
                      ROLE_RECONCILIATION, ROLE_VALIDATION, Policy)
from .anomaly import outlier_applies
from .validate import abs_variance_exceeds, variance_double, variance_rounded

# Gate order (F7): intake, extraction, validation, anomaly stages.
GATE_ORDER = ("g_ocr", "g_dup", "g_conf_extract", "g_vendor", "g_variance",
              "g_conf_validate", "g_materiality", "g_conf_anomaly")

RULE_OF = {"g_ocr": "ocr_confidence_gate", "g_dup": "duplicate_detection", "g_conf_extract": "agent_confidence_gate",
           "g_vendor": "unknown_vendor", "g_variance": "variance_threshold",
           "g_conf_validate": "agent_confidence_gate", "g_materiality": "materiality_gate",
           "g_conf_anomaly": "agent_confidence_gate"}
ACTOR_OF = {"g_ocr": ROLE_INTAKE, "g_dup": ROLE_ANOMALY, "g_conf_extract": ROLE_EXTRACTION,
            "g_vendor": ROLE_VALIDATION, "g_variance": ROLE_VALIDATION, "g_conf_validate": ROLE_VALIDATION,
            "g_materiality": ROLE_RECONCILIATION, "g_conf_anomaly": ROLE_ANOMALY}


DECISION = ("rule_triggered", "decision", "escalation_level", "actor", "reason", "threshold_value", "actual_value",
            "metadata")
# a decision without its texts
OUTCOME = ("rule_triggered", "decision", "escalation_level", "actor", "threshold_value", "actual_value")


def _decision(rule: str, decision: str, level: Column | str, actor: str, reason: Column,
              threshold: Column | None = None, actual: Column | None = None,
              metadata: Column | None = None) -> Column:
    lvl = F.lit(level) if isinstance(level, str) else level
    return F.struct(
        F.lit(rule).alias("rule_triggered"), F.lit(decision).alias("decision"),
        lvl.alias("escalation_level"), F.lit(actor).alias("actor"), reason.alias("reason"),
        (threshold if threshold is not None else F.lit(None)).cast("double").alias("threshold_value"),
        (actual if actual is not None else F.lit(None)).cast("double").alias("actual_value"),
        F.to_json(metadata if metadata is not None else F.create_map().cast("map<string,string>"))
        .alias("metadata"))


def _pct(c: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", c * 100)


def gate_ocr(p: Policy) -> Column:
    """F1."""
    t = float(p.ocr_threshold)
    return (F.col("ocr_used") & (F.col("ocr_confidence") < F.lit(t)),
                  _decision("ocr_confidence_gate", "escalate", "human_review", ROLE_INTAKE,
                            F.format_string("Text recognition is only %s sure, %s are asked for; check by hand.",
                                            _pct(F.col("ocr_confidence")), F.lit(f"{t:.0%}")),
                            F.lit(t), F.col("ocr_confidence"),
                            F.struct(F.col("ocr_confidence"))))


def gate_duplicate(p: Policy) -> Column:
    """F2."""
    return (F.col("is_duplicate") & ~missing(F.col("invoice_number")) & ~missing(F.col("vendor_name")),
                  _decision("duplicate_detection", "block", "human_review", ROLE_ANOMALY,
                            F.format_string("Number %s of '%s' came as %s in the last %d days.",
                                            F.col("invoice_number"), F.col("vendor_name"),
                                            F.col("duplicate_of"), F.lit(p.duplicate_days)),
                            metadata=F.struct(F.col("duplicate_of").alias("existing_invoice_id"))))


def gate_unknown_vendor(p: Policy) -> Column:
    """F3."""
    return (missing(F.col("vendor_name")) | ~F.col("vendor_approved"),
            F.when(missing(F.col("vendor_name")),
                   _decision("unknown_vendor", "escalate", "human_review", ROLE_VALIDATION,
                             F.lit("Held for review: no vendor could be read.")))
            .otherwise(
                  _decision("unknown_vendor", "escalate", "human_review", ROLE_VALIDATION,
                            F.format_string("Held until '%s' is an approved vendor.",
                                            F.col("vendor_name")),
                            metadata=F.struct(F.col("vendor_name")))))


def gate_variance(p: Policy) -> Column:
    """F4."""
    t = float(p.variance_threshold)
    v = variance_double()
    return (outlier_applies() & abs_variance_exceeds(p.variance_threshold),
                  _decision("variance_threshold", "flag", "human_review", ROLE_VALIDATION,
                            F.format_string("Total %s against order %s of %s: off by %s, %s are tolerated.",
                                            F.col("total").cast("string"), F.col("po_number"),
                                            F.col("po_amount").cast("string"), _pct(variance_rounded(3)), F.lit(f"{t:.0%}")),
                            F.lit(t), v,
                            F.struct(F.col("po_amount").cast("double").alias("po_amount"),
                                     F.col("total").cast("double").alias("invoice_total"),
                                     v.alias("variance_pct"))))


def materiality_level(p: Policy) -> Column:
    t = F.col("total")
    return (F.when(t >= dec(p.materiality_l3), "l3_vp_cfo")
            .when(t >= dec(p.materiality_l2), "l2_controller")
            .when(t >= dec(p.materiality_l1), "l1_manager"))


def gate_materiality(p: Policy) -> Column:
    """threshold = the tier reached (the stored value in the reference)."""
    lvl = materiality_level(p)
    tier = (F.when(lvl == "l3_vp_cfo", F.lit(float(p.materiality_l3)))
            .when(lvl == "l2_controller", F.lit(float(p.materiality_l2)))
            .otherwise(F.lit(float(p.materiality_l1))))
    label = (F.when(lvl == "l3_vp_cfo", F.lit(f"${p.materiality_l3:,.0f} L3 VP/CFO"))
             .when(lvl == "l2_controller", F.lit(f"${p.materiality_l2:,.0f} L2 Controller"))
             .otherwise(F.lit(f"${p.materiality_l1:,.0f} L1 Manager")))
    return (lvl.isNotNull(),
                  _decision("materiality_gate", "escalate", lvl, ROLE_RECONCILIATION,
                            F.format_string("Total %s needs approval at %s.",
                                            F.col("total").cast("string"), label),
                            tier, F.col("total"),
                            F.struct(F.col("total").cast("double").alias("amount"),
                                     lvl.alias("escalation_level"))))


def gate_confidence(p: Policy, below: Column, value: Column, actor: str) -> Column:
    """strict '<' against the agent threshold."""
    t = float(p.agent_threshold)
    return (below,
                  _decision("agent_confidence_gate", "escalate", "human_review", actor,
                            F.format_string("%s is only %s sure, %s are asked for; a person decides.", F.lit(actor), _pct(value),
                                            F.lit(f"{t:.0%}")),
                            F.lit(t), value, F.struct(value.alias("agent_confidence"))))


def gate_columns(p: Policy = DEFAULT_POLICY) -> dict[str, tuple[Column, Column]]:
    """gate -> (fires?, decision struct). A disabled gate (F13) never fires."""
    t = p.agent_threshold
    gates = {
        "g_ocr": gate_ocr(p),
        "g_dup": gate_duplicate(p),
        "g_conf_extract": gate_confidence(p, F.col("extraction_confidence") < F.lit(float(t)),
                                          F.col("extraction_confidence"), ROLE_EXTRACTION),
        "g_vendor": gate_unknown_vendor(p),
        "g_variance": gate_variance(p),
        # validation confidence = sum/5 < t  <=>  sum < 5t (exact)
        "g_conf_validate": gate_confidence(p, F.col("validation_conf_cents") < units(t * 5, 2),
                                           F.col("validation_confidence"), ROLE_VALIDATION),
        "g_materiality": gate_materiality(p),
        "g_conf_anomaly": gate_confidence(p, F.col("anomaly_conf_thousandths") < units(t, 3),
                                          F.col("anomaly_confidence"), ROLE_ANOMALY),
    }
    return {k: ((c if p.enabled(RULE_OF[k]) else F.lit(False)), d) for k, (c, d) in gates.items()}


def govern(df: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """F7-F11 on a validated + analysed frame.

    Status, first escalation level and notes are computed from the gate
    columns with plain CASE / coalesce / concat_ws (all inside whole-stage
    codegen); the ordered array is built once, for output only. The gates'
    booleans stay as ``<gate>_on``; ``fired`` has the decisions without their texts.
    """
    specs = gate_columns(policy)
    # cheap boolean columns first; status and counts only read these
    out = df.withColumns({f"{g}_on": specs[g][0] for g in GATE_ORDER})
    on = [F.col(f"{g}_on") for g in GATE_ORDER]
    n = on[0].cast("int")
    for c in on[1:]:
        n = n + c.cast("int")
    # the duplicate gate is the only blocking one, all others escalate; each is read once
    escalates = reduce(lambda a, b: a | b, [F.col(f"{g}_on") for g in GATE_ORDER if g != "g_dup"])
    flagged = (F.col("validation_status") == "fail") & (F.col("risk_cents") > units(policy.flag_risk_floor, 2))
    # every gate escalates to a level other than 'none': the first fired gate's level
    first_level = F.coalesce(*[F.when(F.col(f"{g}_on"), specs[g][1]["escalation_level"]) for g in GATE_ORDER])
    out = out.withColumns({
        "status": F.when(F.col("g_dup_on"), "rejected").when(escalates, "on_hold").when(flagged, "flagged")
                   .otherwise("validated"),
        "escalation_level": F.coalesce(first_level, F.lit("none")),
        "n_decisions": n,
    })
    def decisions(fields) -> Column:
        return compact(*[F.when(F.col(f"{g}_on"), F.struct(*[specs[g][1][f].alias(f) for f in fields]))
                         for g in GATE_ORDER])

    return out.withColumns({
        "notes": F.concat_ws("; ", *[F.when(F.col(f"{g}_on"), specs[g][1]["reason"]) for g in GATE_ORDER]),
        "fired": decisions(OUTCOME), "decisions": decisions(DECISION)})


def gate_decisions(df: DataFrame, gates: list[str], policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """F7's rows of some gates alone: filtered on the gate's boolean before the
    decision is built. ``df`` needs the columns that these gates and those
    before them in the order read."""
    specs = gate_columns(policy)
    upto = GATE_ORDER[:max(GATE_ORDER.index(g) for g in gates) + 1]
    flags = df.withColumns({f"{g}_on": specs[g][0] for g in upto})
    fired = []
    for g in gates:
        before = sum((F.col(f"{x}_on").cast("int") for x in GATE_ORDER[:GATE_ORDER.index(g)]), F.lit(0))
        fired.append(F.when(F.col(f"{g}_on"), F.struct((before + 1).alias("seq"), specs[g][1].alias("d"))))
    on = flags.where(F.greatest(*[F.col(f"{g}_on") for g in gates]) if len(gates) > 1 else F.col(f"{gates[0]}_on"))
    rows = on.select("invoice_id", F.explode(compact(*fired)).alias("r"))
    return rows.select("invoice_id", F.col("r.seq").alias("seq"), "r.d.*")


def decision_rows(scored: DataFrame) -> DataFrame:
    """F7 long form: one row per triggered gate, with its position in the list.
    Texts are looked up in ``decisions``, which is built only if they are read."""
    # the outer form: else Spark filters on the list first and computes it twice
    rows = (scored.select("invoice_id", "created_at", "decisions", F.posexplode_outer("fired").alias("pos", "d"))
            .where(F.col("pos").isNotNull()))
    return (rows.withColumn("whole", F.get("decisions", F.col("pos")))
            .select("invoice_id",
                    (F.col("pos") + 1).alias("seq"),
                    stable_id(F.col("invoice_id"), F.col("pos"), F.col("d.rule_triggered")).alias("decision_id"),
                    F.col("d.rule_triggered").alias("rule_triggered"),
                    F.col("d.decision").alias("decision"),
                    F.col("d.escalation_level").alias("escalation_level"),
                    F.col("d.actor").alias("actor"),
                    F.col("whole.reason").alias("reason"),
                    F.col("d.threshold_value").alias("threshold_value"),
                    F.col("d.actual_value").alias("actual_value"),
                    F.col("whole.metadata").alias("metadata"),
                    F.col("created_at").alias("timestamp")))


def decision_audit_rows(decisions: DataFrame) -> DataFrame:
    """one audit row per decision (event governance.<rule>)."""
    return decisions.select(
        stable_id(F.col("decision_id"), F.lit("audit")).alias("entry_id"),
        "invoice_id",
        F.concat(F.lit("governance."), F.col("rule_triggered")).alias("event_type"),
        "actor", F.col("reason").alias("description"),
        F.lit(None).cast("string").alias("before_state"),
        F.lit(None).cast("string").alias("after_state"),
        "metadata", "timestamp")
