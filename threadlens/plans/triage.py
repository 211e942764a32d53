"""K1: batch triage — clean -> classify -> retrieve -> evidence -> reply ->
decide, one output row per message, plus six stage entries.

One retrieval feeds both the reply and the decision. The index side (records
and their vectors) is static and can be checkpointed once and reused by every
batch (K2 does).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions.rules import DEFAULT_RULES, FINAL_LEXICON, EscalationRules, Lexicon
from threadlens.functions.text import clean_ascii, format_fixed, format_percent, token_count
from threadlens.functions.vectors import hashed_tf_vectors
from threadlens.operators import escalation, lexicon, replies
from threadlens.operators.retrieval import topk_cosine
from threadlens.session import cut_lineage

VECTOR_DIM = 256


def lexicon_intent(msgs: DataFrame, lex: Lexicon = FINAL_LEXICON, ambiguous: str = "ambiguous") -> DataFrame:
    """SQL-only intent classifier: lexicon label, confidence = share of the
    top label's keyword hits (4 dp); fewer than 2 cleaned tokens -> ambiguous,
    0.0."""
    scored = lexicon.score_rows(msgs, "clean", lex)
    total = F.aggregate(F.transform("scores", lambda s: s["score"]), F.lit(0), lambda a, x: a + x)
    conf = F.when(total > 0, F.round(F.col("top_score") / total, 4)).otherwise(F.lit(0.0))
    amb = F.col("n_words") < 2
    return (scored.withColumn("intent", F.when(amb, F.lit(ambiguous)).otherwise(F.col("assigned_label")))
            .withColumn("intent_confidence", F.when(amb, F.lit(0.0)).otherwise(conf).cast("double"))
            .drop("scores", "top_label", "second_label", "top_score", "second_score", "margin", "assigned_label"))


def index_side(records: DataFrame, dim: int = VECTOR_DIM) -> DataFrame:
    """Records with their hashed text vectors (the retrieval index),
    materialised once: it is static and every batch reads it."""
    recs = cut_lineage(records)
    return cut_lineage(recs.join(hashed_tf_vectors(recs, "conversation_id", "text", dim), "conversation_id"))


def triage(messages: DataFrame, indexed_records: DataFrame, k: int = 3, rules: EscalationRules = DEFAULT_RULES,
           lex: Lexicon = FINAL_LEXICON, message_id: str = "message_id", text: str = "text",
           classify=lexicon_intent, dim: int = VECTOR_DIM, n_index: int | None = None) -> DataFrame:
    # an id of our own: message ids may repeat (a replayed stream delivers them twice)
    msgs = cut_lineage(messages.select(F.monotonically_increasing_id().alias("query_id"), F.col(message_id).alias("_mid"),
                                       F.col(text).alias("query")))
    msgs = msgs.withColumn("clean", clean_ascii("query")).withColumn("n_words", token_count("clean"))
    # read by the encoder, the reply and the decision: clean and classify once
    msgs = cut_lineage(classify(msgs, lex))
    qv = hashed_tf_vectors(msgs.select("query_id", "clean"), "query_id", "clean", dim)
    hits = topk_cosine(qv, indexed_records, k, query_id="query_id", vector_id="conversation_id",
                       materialize_index=False)     # ``index_side`` output is a checkpoint
    ev = replies.hit_evidence(hits, indexed_records.drop("embedding"))
    drafted = replies.template_replies(ev, msgs)
    evidence = (ev.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "conversation_id", F.round("score", 4).alias("sim_score"), "customer_excerpt", "support_excerpt",
        "n_messages"))).alias("_e"))
        .select("query_id", F.transform("_e", lambda x: x.dropFields("rank")).alias("evidence")))
    out = (msgs.join(drafted, "query_id").join(evidence, "query_id", "left")
           .withColumn("evidence", F.coalesce("evidence", F.array().cast(evidence.schema["evidence"].dataType))))
    out = escalation.decide(out, "query", "intent", "top_score", "reply", "intent_confidence", rules)
    badge = F.when(F.col("decision") == "auto_handle", F.lit("AUTO-HANDLE")).otherwise(F.lit("HUMAN ESCALATION"))
    n_idx = n_index if n_index is not None else "the"
    stages = F.array(
        _stage(1, "Reading Query", F.concat(F.lit("Sanitized input query ("), F.col("n_words").cast("string"),
                                            F.lit(" words)"))),
        _stage(2, "Classifying Intent", F.concat(F.lit("Detected intent: "), F.col("intent"),
                                                 F.lit(" (top class share: "),
                                                 format_percent(F.col("intent_confidence"), 1), F.lit(")"))),
        _stage(3, "Retrieving Historical Cases", F.concat(F.lit(f"Queried {n_idx} conversation index; retrieved top "),
                                                           F.size("evidence_ids").cast("string"),
                                                           F.lit(" conversations"))),
        _stage(4, "Reviewing Historical Evidence", F.concat(F.lit("Top similarity "), format_fixed("top_score", 4),
                                                             F.lit(f", threshold {rules.min_similarity}"))),
        _stage(5, "Generating Grounded Reply", F.lit(f"Draft built by {replies.FALLBACK_PROVIDER} "
                                                      f"({replies.FALLBACK_MODEL})")),
        _stage(6, "Making Escalation Decision", F.concat(badge, F.lit(": "), F.col("reason"))))
    return out.select(
        F.col("_mid").alias(message_id), "query", "intent", "intent_confidence",
        F.transform("evidence_ids", lambda i: i.cast("string")).alias("evidence_ids"), "evidence",
        "top_score", "reply",
        F.lit(replies.FALLBACK_PROVIDER).alias("provider_used"), F.lit(replies.FALLBACK_MODEL).alias("model_used"),
        F.lit(False).alias("remote_request_succeeded"),
        F.struct(badge.alias("decision"), F.col("decision").alias("raw_decision"), "reason", "risk_level",
                 F.col("signals").alias("signals_triggered")).alias("escalation"),
        stages.alias("pipeline_stages"))


def _stage(i: int, name: str, detail) -> F.Column:
    return F.struct(F.lit(i).alias("id"), F.lit(name).alias("name"), detail.alias("detail"),
                    F.lit("completed").alias("status"))
