"""Auto-handle vs. human escalation, with reasons, as column expressions.

All signals are native ``rlike`` / comparison expressions inside one projection
(whole-stage codegen, no shuffle, no UDF). Signals keep their fixed order; the
first high one, else the first medium one, gives the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.rules import DEFAULT_RULES, SIGNAL_TEXT, EscalationRules
from threadlens.functions.text import format_fixed, format_percent, keyword_regex, token_count

SIGNAL_ORDER = ["explicit_human_request", "account_security_access", "payment_refund_dispute",
                "severe_hardware_safety_data_loss", "ambiguous_intent", "low_intent_confidence",
                "insufficient_retrieval_grounding", "unsupported_commitments"]


def _sig(cond: Column, name: str, severity: str, description: Column) -> Column:
    return F.when(cond, F.struct(F.lit(name).alias("signal"), F.lit(severity).alias("severity"),
                                 description.alias("description")))


def signal_array(text: Column, intent: Column, top_score: Column, reply: Column, confidence: Column,
                 rules: EscalationRules = DEFAULT_RULES) -> Column:
    """I1-I8 -> array<struct<signal, severity, description>> in fixed order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    human_re = keyword_regex(rules.human_words, rules.human_lead_in or None)
    acct = (intent.eqNullSafe(F.lit(rules.account_intent))) | low.rlike(keyword_regex(rules.account_phrases))
    pay = (intent.eqNullSafe(F.lit(rules.billing_intent))) | low.rlike(keyword_regex(rules.payment_phrases))
    safety = low.rlike(keyword_regex(rules.safety_phrases))
    ambiguous = intent.eqNullSafe(F.lit(rules.ambiguous_label)) | (token_count(text) < rules.min_tokens)
    low_conf = (~ambiguous) & confidence.isNotNull() & (confidence < rules.min_confidence)
    weak = top_score.isNotNull() & (top_score < rules.min_similarity)
    commit = (F.length(F.coalesce(reply, F.lit(""))) > 0) & \
        F.lower(F.coalesce(reply, F.lit(""))).rlike(keyword_regex(rules.commitment_phrases))
    conf_text = F.concat(F.lit("Classifier confidence ("), format_percent(confidence, 1),
                         F.lit(f") is near random chance ({rules.min_confidence * 100:.1f}%); intent is unverified."))
    score_text = F.concat(F.lit("Top retrieval similarity ("), format_fixed(top_score, 3),
                          F.lit(f") is below confidence threshold ({rules.min_similarity!r})."))
    sigs = [
        _sig(low.rlike(human_re), "explicit_human_request", "high", F.lit(SIGNAL_TEXT["explicit_human_request"])),
        _sig(acct, "account_security_access", "high", F.lit(SIGNAL_TEXT["account_security_access"])),
        _sig(pay, "payment_refund_dispute", "high", F.lit(SIGNAL_TEXT["payment_refund_dispute"])),
        _sig(safety, "severe_hardware_safety_data_loss", "high",
             F.lit(SIGNAL_TEXT["severe_hardware_safety_data_loss"])),
        _sig(ambiguous, "ambiguous_intent", "medium", F.lit(SIGNAL_TEXT["ambiguous_intent"])),
        _sig(low_conf, "low_intent_confidence", "medium", conf_text),
        _sig(weak, "insufficient_retrieval_grounding", "medium", score_text),
        _sig(commit, "unsupported_commitments", "high", F.lit(SIGNAL_TEXT["unsupported_commitments"])),
    ]
    return F.array_compact(F.array(*sigs))


def decide(df: DataFrame, text: str = "text", intent: str | None = None, top_score: str | None = None,
           reply: str | None = None, confidence: str | None = None,
           rules: EscalationRules = DEFAULT_RULES, evidence: str | None = None) -> DataFrame:
    """Add ``decision``, ``risk_level``, ``reason``, ``signals`` (names in
    order) and ``signal_details`` (structs). Missing inputs count as null.

    ``evidence`` names an array of structs with a ``sim_score``; where ``top_score`` is null
    or not given, the largest one counts (an empty or null array gives none). With it,
    ``metadata`` (intent, top_retrieval_score as used) is added."""
    def col(name, typ):
        return F.col(name) if name else F.lit(None).cast(typ)
    score_c = col(top_score, "double")
    if evidence:
        score_c = F.coalesce(score_c, F.array_max(F.transform(F.col(evidence), lambda e: e["sim_score"].cast("double"))))
    sig = signal_array(F.col(text), col(intent, "string"), score_c, col(reply, "string"),
                       col(confidence, "double"), rules)
    out = df.withColumn("signal_details", sig)
    high = F.filter("signal_details", lambda s: s["severity"] == "high")
    medium = F.filter("signal_details", lambda s: s["severity"] == "medium")
    intent_c = col(intent, "string")
    if evidence:
        out = out.withColumn("metadata", F.struct(intent_c.alias("intent"), score_c.alias("top_retrieval_score")))
    auto_reason = F.concat(
        F.lit("Routine troubleshooting query with clear "),
        F.when(F.length(F.coalesce(intent_c, F.lit(""))) > 0, F.concat(F.lit("'"), intent_c, F.lit("'")))
         .otherwise(F.lit("diagnosed")),
        F.lit(" intent and sufficient historical evidence grounding ("),
        F.when(score_c.isNotNull(), F.concat(F.lit("relevance: "), format_fixed(score_c, 3)))
         .otherwise(F.lit("grounded")),
        F.lit("); safe for automated response."))
    return (out
            .withColumn("decision", F.when(F.size("signal_details") > 0, F.lit("human_escalation"))
                        .otherwise(F.lit("auto_handle")))
            .withColumn("risk_level", F.when(F.size(high) > 0, F.lit("high"))
                        .when(F.size(medium) > 0, F.lit("medium")).otherwise(F.lit("low")))
            .withColumn("reason", F.when(F.size(high) > 0, F.element_at(high, 1)["description"])
                        .when(F.size(medium) > 0, F.element_at(medium, 1)["description"])
                        .otherwise(auto_reason))
            .withColumn("signals", F.transform("signal_details", lambda s: s["signal"])))


def decision_summary(decided: DataFrame) -> DataFrame:
    """N, auto and escalated counts and shares (denominator max(1, n))."""
    n = F.count(F.lit(1))
    auto = F.count_if(F.col("decision") == "auto_handle")
    esc = F.count_if(F.col("decision") == "human_escalation")
    return decided.agg(n.alias("n"), auto.alias("n_auto"), esc.alias("n_escalated"),
                       F.round(auto / F.greatest(n, F.lit(1)), 6).alias("share_auto"),
                       F.round(esc / F.greatest(n, F.lit(1)), 6).alias("share_escalated"))


def signal_counts(decided: DataFrame) -> DataFrame:
    """Rows per triggered signal (partial aggregation before the shuffle)."""
    return (decided.select(F.explode("signals").alias("signal"))
            .groupBy("signal").agg(F.count(F.lit(1)).alias("n_rows")))
