"""Evidence, draft replies, prompts and reply checks.

Everything is per-query grouping of ranked hits (bounded by k) with ordered
collection and string assembly; remote model calls are not made here: model
responses arrive as a table and J3 picks among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.rules import NOT_FOUND_EVIDENCE, REPLY_CLOSE, REPLY_LEAD
from threadlens.functions.text import clean_ascii, extract_ints, keyword_regex

# The two provider chains, by the provider they start with.
PROVIDER_CHAINS = {"groq": ["groq", "gemini", "openrouter"], "gemini": ["gemini", "groq", "openrouter", "openai"]}
PROVIDER_ORDER = PROVIDER_CHAINS["groq"]
FALLBACK_PROVIDER = "deterministic_fallback"
FALLBACK_MODEL = "deterministic_template"

# Phrases of the reply checks named as fixes.
FORWARD_PHRASES = ["we will forward", "our team is working on"]
TRIED_PHRASES = ["already tried", "did reset", "restarted"]
VERSION_RE = r"\d+(?:\.\d+)+"


def hit_evidence(hits: DataFrame, records: DataFrame) -> DataFrame:
    """E2 + B10: ranked hits joined to their records, with the excerpts the
    triage output shows (customer: first 160 chars then clean; support: 180)."""
    # of repeated records the smallest row, by all columns in order
    rec = (records.groupBy("conversation_id").agg(F.min(F.struct(*[c for c in records.columns if c != "conversation_id"])).alias("_r"))
           .select(F.col("conversation_id").alias("vector_id"), "_r.*"))
    return hits.join(rec, "vector_id").select(
        "query_id", "rank", F.col("vector_id").alias("conversation_id"), "score",
        clean_ascii(F.left("customer_turns", F.lit(160))).alias("customer_excerpt"),
        clean_ascii(F.left("support_turns", F.lit(180))).alias("support_excerpt"),
        "support_turns", "customer_turns", "n_messages", "n_customer_turns", "n_support_turns")


def template_replies(evidence: DataFrame, queries: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Deterministic grounded reply per query: lead sentence, one line per
    hit ('- Conversation <id>: <cleaned support text, 180 chars, right-trimmed>'),
    closing line, 'Evidence IDs: a, b'. Queries without hits still get a reply.
    Also returns ``evidence_ids`` (array, rank order) and ``top_score``."""
    line = F.concat(F.lit("- Conversation "), F.col("conversation_id").cast("string"), F.lit(": "),
                    F.rtrim(F.left(clean_ascii("support_turns"), F.lit(180))))
    per = (evidence.groupBy("query_id")
           .agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line"), "conversation_id", "score")))
                .alias("h"), F.max("score").alias("top_score")))
    q = queries.select(F.col(query_id).alias("query_id")).join(per, "query_id", "left")
    h = F.coalesce(F.col("h"), F.array().cast(per.schema["h"].dataType))
    lines = F.transform(h, lambda x: x["line"])
    ids = F.transform(h, lambda x: x["conversation_id"])
    reply = F.array_join(F.concat(F.array(F.lit(REPLY_LEAD)), lines, F.array(F.lit(REPLY_CLOSE)),
                                  F.array(F.concat(F.lit("Evidence IDs: "),
                                                   F.array_join(F.transform(ids, lambda i: i.cast("string")), ", ")))),
                         "\n")
    return q.select("query_id", ids.alias("evidence_ids"), F.coalesce("top_score", F.lit(0.0)).alias("top_score"),
                    reply.alias("reply"))


def choose_reply(replies: DataFrame, responses: DataFrame, order=PROVIDER_ORDER) -> DataFrame:
    """The first provider in ``order`` whose response text is not blank,
    else the template (``reply`` column). ``responses``: (query_id, provider,
    model, text)."""
    rank = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("provider"))
    ok = (responses.filter((rank > 0) & (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0))
          .withColumn("_r", rank)
          .groupBy("query_id").agg(F.min_by(F.struct("provider", "model", "text"), "_r").alias("pick")))
    j = replies.join(ok, "query_id", "left")
    remote = F.col("pick").isNotNull()
    return (j.withColumn("generated_reply", F.when(remote, F.col("pick")["text"]).otherwise(F.col("reply")))
            .withColumn("provider_used", F.when(remote, F.col("pick")["provider"]).otherwise(F.lit(FALLBACK_PROVIDER)))
            .withColumn("model_used", F.when(remote, F.col("pick")["model"]).otherwise(F.lit(FALLBACK_MODEL)))
            .withColumn("remote_request_succeeded", remote)
            .drop("pick"))


def batch_check(batch: DataFrame, known=("groq", "gemini", "openai", "openrouter", FALLBACK_PROVIDER)) -> DataFrame:
    """One row of verification counts over a reply batch."""
    prov = F.col("provider_used")
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.count_if(prov == p).alias(f"n_{p}") for p in known]
    aggs += [F.count_if(~prov.isin(list(known)) | prov.isNull()).alias("n_other_provider"),
             F.count_if(F.length(F.trim(F.coalesce("evidence_ids_text", F.lit("")))) > 0).alias("n_with_evidence"),
             F.count_if(F.length(F.trim(F.coalesce("generated_reply", F.lit("")))) > 0).alias("n_nonblank_reply"),
             F.count_if(F.col("remote_request_succeeded")).alias("n_remote")]
    return batch.agg(*aggs)


def evidence_text(rows: DataFrame, cell_col: str, records: DataFrame, row_id: str = "row_id",
                  order_col: str = "conversation_id", cut: int = 200) -> DataFrame:
    """E3 + A7: evidence blocks for an id-list cell. Ids are every digit run of
    the cell; each matching record appears once, in index order (``order_col``),
    as 'Conversation ID <id>:\\n  Customer: <..>\\n  Support: <..>' (stripped,
    first ``cut`` chars), blocks separated by a blank line. No digits ->
    the no-evidence text; digits but no match -> the cited ids."""
    ids = rows.select(F.col(row_id).alias("row_id"), extract_ints(cell_col).alias("ids"),
                      F.regexp_extract_all(F.coalesce(F.col(cell_col), F.lit("")), F.lit(r"\d+"), 0).alias("raw"))
    rec = records.select(F.col("conversation_id").alias("id"), F.col(order_col).alias("_o"),
                         F.left(F.trim(F.coalesce("customer_turns", F.lit(""))), F.lit(cut)).alias("c"),
                         F.left(F.trim(F.coalesce("support_turns", F.lit(""))), F.lit(cut)).alias("s"))
    block = F.concat(F.lit("Conversation ID "), F.col("id").cast("string"), F.lit(":\n  Customer: "), F.col("c"),
                     F.lit("\n  Support: "), F.col("s"))
    matched = (ids.select("row_id", F.explode(F.array_distinct("ids")).alias("id"))
               .join(rec, "id")
               .groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("_o", "id", block.alias("b")))).alias("m")))
    j = ids.join(matched, "row_id", "left")
    text = (F.when(F.size("raw") == 0, F.lit(NOT_FOUND_EVIDENCE))
            .when(F.col("m").isNull(), F.concat(F.lit("Evidence IDs cited: "), F.array_join("raw", ", "),
                                                F.lit(" (details not found in index)")))
            .otherwise(F.array_join(F.transform("m", lambda x: x["b"]), "\n\n")))
    return j.select("row_id", text.alias("evidence_text"))


def reply_prompt(evidence: DataFrame, queries: DataFrame, query_col: str = "query_text") -> DataFrame:
    """J1 + B14: prompt text with the numbered evidence as JSON objects."""
    obj = F.to_json(F.struct(F.col("conversation_id"), F.round("score", 4).alias("retrieved_score"),
                             clean_ascii("customer_turns").alias("customer_turns"),
                             clean_ascii("support_turns").alias("support_turns"), "n_messages",
                             "n_customer_turns", "n_support_turns"))
    per = (evidence.groupBy("query_id")
           .agg(F.array_sort(F.collect_list(F.struct("rank", obj.alias("j")))).alias("e")))
    blocks = F.array_join(F.transform("e", lambda x, i: F.concat(F.lit("EVIDENCE #"), (i + 1).cast("string"),
                                                                  F.lit(": "), x["j"])), "\n\n")
    return queries.join(per, "query_id", "left").select(
        "query_id",
        F.concat(F.lit("Write a short support reply grounded only in the past conversations below. "
                       "Do not promise refunds, replacements, account changes or other outcomes the evidence "
                       "does not show; list the conversation ids you used.\n\nCustomer message:\n"),
                 F.col(query_col), F.lit("\n\nPast conversations:\n"),
                 F.coalesce(blocks, F.lit(""))).alias("prompt"))


def judge_prompt(rows: DataFrame, query_col: str, reply_col: str, evidence_col: str) -> DataFrame:
    """Judge prompt: query, evidence, reply and the 0-2 scale of each
    rating dimension (0 = clean for unsupported_claims), JSON answer asked."""
    rubric = ("Score each dimension 0, 1 or 2: factual_grounding (2 = fully grounded in the evidence), "
              "helpfulness (2 = actionable; 0 if broken or cut off), relevance (2 = addresses the issue), "
              "unsupported_claims (0 = none, 2 = significant), overall_quality (2 = strong). Answer with one JSON "
              "object with these five integer keys and a short 'rationale'.")
    return rows.withColumn("judge_prompt", F.concat(
        F.lit("Customer query:\n"), F.col(query_col), F.lit("\n\nRetrieved evidence:\n"), F.col(evidence_col),
        F.lit("\n\nDraft reply:\n"), F.col(reply_col), F.lit("\n\n" + rubric)))


def _body(reply: Column) -> Column:
    """The reply without its trailing evidence list."""
    return F.rtrim(F.regexp_replace(reply, r"(?s)\n\s*Evidence( IDs)?:.*$", ""))


def reply_checks(df: DataFrame, reply_col: str, query_col: str, evidence_col: str) -> DataFrame:
    """Flags named as fixes: body not ending in . ! ?; forwarding /
    commitment phrases; version numbers absent from the evidence; query says a
    step was already tried."""
    body = _body(F.coalesce(F.col(reply_col), F.lit("")))
    rv = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(reply_col), F.lit("")), F.lit(VERSION_RE), 0))
    ev = F.regexp_extract_all(F.coalesce(F.col(evidence_col), F.lit("")), F.lit(VERSION_RE), 0)
    return df.withColumns({
        "no_end_punctuation": ~body.rlike(r"[.!?]\z"),
        "forward_commitment": F.lower(F.coalesce(F.col(reply_col), F.lit(""))).rlike(keyword_regex(FORWARD_PHRASES)),
        "unsupported_versions": F.array_except(rv, ev),
        "already_tried": F.lower(F.coalesce(F.col(query_col), F.lit(""))).rlike(keyword_regex(TRIED_PHRASES)),
    })
