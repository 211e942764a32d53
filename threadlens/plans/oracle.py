"""DuckDB SQL twins of the registered queries (independent engine, same
column names). Written against the driver's pre-registered views.

Notes on dialect: RE2 classes are ASCII, so Unicode-sensitive steps are checked
on ASCII text; DuckDB wants ``lambda x: ...`` in list functions.
"""

from __future__ import annotations

from threadlens.functions.rules import TEST_RULES
from threadlens.functions.text import keyword_regex

ORACLE: dict[str, str] = {}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# The references that the driver's pages hold, written out here (the package has no table).
_PAGE_REFERENCES = [("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'")]


def sql_unescape(x: str) -> str:
    for ref, ch in _PAGE_REFERENCES:
        x = f"replace({x}, {_q(ref)}, {_q(ch)})"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def sql_clean_ascii(x: str) -> str:
    x = sql_unescape(f"coalesce({x}, '')")
    x = f"regexp_replace({x}, {_q(r'https?://\S+|www\.\S+')}, ' ', 'g')"
    x = f"regexp_replace({x}, '@[A-Za-z0-9_]+', ' ', 'g')"
    x = f"replace({x}, '&amp;', ' and ')"
    x = f"regexp_replace({x}, {_q(r'[^a-zA-Z0-9_\-\s]+')}, ' ', 'g')"
    x = f"regexp_replace({x}, {_q(r'\s+')}, ' ', 'g')"
    return f"trim({x}, ' ')"


def sql_tokens(x: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), {_q(r'\S+')}))"


ORACLE["clean_ascii_documents"] = f"""
SELECT doc_id, {sql_clean_ascii('text')} AS clean, length({sql_clean_ascii('text')}) > 0 AS is_nonempty
FROM documents"""

ORACLE["unescape_pages"] = f"SELECT page_id, {sql_unescape('coalesce(html, ' + chr(39) * 2 + ')')} AS text FROM pages"

ORACLE["turn_features"] = f"""
SELECT conv_id, turn, lower(trim(role)) AS role, {sql_tokens('text')} AS n_tokens,
       {sql_clean_ascii("left(coalesce(text, ''), 160)")} AS excerpt_160,
       left({sql_clean_ascii('text')}, 180) AS excerpt_180
FROM conversations"""

# --- threads: recursive walks over the derived message table -------------------

_MSGS = """
msgs AS (
  SELECT conv_id * 100 + turn AS tweet_id,
         CASE WHEN role = 'assistant' THEN 'support' ELSE role || '_' || CAST(conv_id AS VARCHAR) END AS author_id,
         role = 'user' AS inbound, coalesce(text, '') AS text,
         CAST(conv_id * 100 + turn + 1 AS VARCHAR) AS response_tweet_id,
         CASE WHEN turn > 0 THEN conv_id * 100 + turn - 1 END AS in_response_to_tweet_id
  FROM conversations),
nodes AS (
  SELECT m.tweet_id AS id, CASE WHEN p.tweet_id IS NOT NULL THEN m.in_response_to_tweet_id END AS parent
  FROM msgs m LEFT JOIN msgs p ON p.tweet_id = m.in_response_to_tweet_id),
edges AS (
  SELECT m.tweet_id AS src, CAST(r AS BIGINT) AS dst
  FROM msgs m, unnest(string_split(m.response_tweet_id, ',')) AS u(r)
  WHERE regexp_full_match(trim(r), '[0-9]+') AND CAST(trim(r) AS BIGINT) IN (SELECT id FROM nodes)
  UNION SELECT id, parent FROM nodes WHERE parent IS NOT NULL
  UNION SELECT parent, id FROM nodes WHERE parent IS NOT NULL),
reach(id) AS (
  SELECT tweet_id FROM msgs WHERE lower(author_id) = 'support'
  UNION
  SELECT e.dst FROM reach r JOIN edges e ON e.src = r.id),
walk(start, cur, depth) AS (
  SELECT id, id, 0 FROM nodes
  UNION ALL
  SELECT w.start, n.parent, w.depth + 1 FROM walk w JOIN nodes n ON n.id = w.cur
  WHERE n.parent IS NOT NULL AND w.depth < 10000),
ends AS (
  SELECT start, arg_max(cur, depth) AS last_node FROM walk GROUP BY start),
roots AS (
  SELECT e.start AS id, CASE WHEN n.parent IS NULL THEN e.last_node ELSE e.start END AS root
  FROM ends e JOIN nodes n ON n.id = e.last_node),
kept AS (
  SELECT m.* , r.root AS conversation_id FROM msgs m JOIN roots r ON r.id = m.tweet_id
  WHERE m.tweet_id IN (SELECT id FROM reach)
    AND (lower(m.author_id) = 'support' OR contains(m.text, 'the') OR contains(m.text, 'que')
         OR contains(m.text, 'und')))
"""

ORACLE["support_threads"] = f"""
WITH RECURSIVE {_MSGS}
SELECT tweet_id, conversation_id,
       CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY tweet_id) AS INTEGER) AS thread_order
FROM kept"""

ORACLE["thread_metrics"] = f"""
WITH RECURSIVE {_MSGS}
SELECT count(*) AS n_rows, count_if(inbound) AS n_inbound, count_if(lower(author_id) = 'support') AS n_support,
       count_if(response_tweet_id IS NULL) AS n_missing_response,
       count_if(in_response_to_tweet_id IS NULL) AS n_missing_parent,
       count(DISTINCT conversation_id) AS n_conversations
FROM kept"""

# --- records ------------------------------------------------------------------------

_RECORDS = f"""
turns AS (
  SELECT conv_id AS conversation_id, turn + 1 AS ord, role = 'assistant' AS is_support,
         {sql_clean_ascii('text')} AS clean
  FROM conversations WHERE lower(role) <> 'system'),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY ord) AS pos FROM turns WHERE length(clean) > 0),
records AS (
  SELECT conversation_id,
         string_agg(clean, ' ' ORDER BY pos) AS text,
         string_agg('[' || pos || '] ' || clean, ' ' ORDER BY pos) AS transcript,
         coalesce(string_agg(CASE WHEN NOT is_support THEN clean END, ' ' ORDER BY pos), '') AS customer_turns,
         coalesce(string_agg(CASE WHEN is_support THEN clean END, ' ' ORDER BY pos), '') AS support_turns,
         CAST(count(*) AS INTEGER) AS n_messages,
         CAST(count_if(NOT is_support) AS INTEGER) AS n_customer_turns,
         CAST(count_if(is_support) AS INTEGER) AS n_support_turns
  FROM numbered GROUP BY conversation_id
  HAVING count(*) >= 2 AND count_if(is_support) >= 1 AND count_if(NOT is_support) >= 1)
"""

ORACLE["conversation_records"] = f"WITH {_RECORDS} SELECT * FROM records"

ORACLE["sampled_records"] = f"""
WITH {_RECORDS}
SELECT conversation_id, n_messages FROM records
ORDER BY md5('42-' || CAST(conversation_id AS VARCHAR)), conversation_id LIMIT 40"""

# --- escalation -------------------------------------------------------------------


def _rx(phrases, lead=None) -> str:
    return _q(keyword_regex(phrases, lead))


def sql_escalation(rules=TEST_RULES) -> str:
    r = rules
    low = "lower(coalesce(text, ''))"
    rlow = "lower(coalesce(draft_reply, ''))"
    s_human = f"regexp_matches({low}, {_rx(r.human_words, r.human_lead_in or None)})"
    s_acct = f"(intent IS NOT DISTINCT FROM {_q(r.account_intent)} OR regexp_matches({low}, {_rx(r.account_phrases)}))"
    s_pay = f"(intent IS NOT DISTINCT FROM {_q(r.billing_intent)} OR regexp_matches({low}, {_rx(r.payment_phrases)}))"
    s_safe = f"regexp_matches({low}, {_rx(r.safety_phrases)})"
    s_amb = f"(intent IS NOT DISTINCT FROM {_q(r.ambiguous_label)} OR {sql_tokens('text')} < {r.min_tokens})"
    s_conf = f"(NOT {s_amb} AND confidence IS NOT NULL AND confidence < {r.min_confidence})"
    s_weak = f"(top_score IS NOT NULL AND top_score < {r.min_similarity})"
    s_commit = f"(length(coalesce(draft_reply, '')) > 0 AND regexp_matches({rlow}, {_rx(r.commitment_phrases)}))"
    from threadlens.functions.rules import SIGNAL_TEXT as T
    conf_txt = (f"'Classifier confidence (' || printf('%.1f', round(confidence * 100, 1)) || "
                f"{_q('%) is near random chance (' + format(r.min_confidence * 100, '.1f') + '%); intent is unverified.')}")
    score_txt = (f"'Top retrieval similarity (' || printf('%.3f', round(top_score, 3)) || "
                 f"{_q(') is below confidence threshold (' + repr(r.min_similarity) + ').')}")
    high = [(s_human, _q(T['explicit_human_request'])), (s_acct, _q(T['account_security_access'])),
            (s_pay, _q(T['payment_refund_dispute'])), (s_safe, _q(T['severe_hardware_safety_data_loss'])),
            (s_commit, _q(T['unsupported_commitments']))]
    medium = [(s_amb, _q(T['ambiguous_intent'])), (s_conf, conf_txt), (s_weak, score_txt)]
    any_high = " OR ".join(c for c, _ in high)
    any_med = " OR ".join(c for c, _ in medium)
    reason = "CASE " + " ".join(f"WHEN {c} THEN {t}" for c, t in high + medium) + \
        (" ELSE 'Routine troubleshooting query with clear ' || CASE WHEN length(coalesce(intent, '')) > 0 "
         "THEN '''' || intent || '''' ELSE 'diagnosed' END || ' intent and sufficient historical evidence "
         "grounding (' || CASE WHEN top_score IS NOT NULL THEN 'relevance: ' || printf('%.3f', round(top_score, 3)) "
         "ELSE 'grounded' END || '); safe for automated response.' END")
    names = [(s_human, "explicit_human_request"), (s_acct, "account_security_access"),
             (s_pay, "payment_refund_dispute"), (s_safe, "severe_hardware_safety_data_loss"),
             (s_amb, "ambiguous_intent"), (s_conf, "low_intent_confidence"),
             (s_weak, "insufficient_retrieval_grounding"), (s_commit, "unsupported_commitments")]
    signals = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in names) + ")"
    return f"""
  CASE WHEN ({any_high}) OR ({any_med}) THEN 'human_escalation' ELSE 'auto_handle' END AS decision,
  CASE WHEN {any_high} THEN 'high' WHEN {any_med} THEN 'medium' ELSE 'low' END AS risk_level,
  {reason} AS reason,
  {signals} AS signals"""


_ESC_BASE = """
base AS (
  SELECT conv_id, turn, {clean} AS text,
         CASE WHEN turn = 2 THEN 'ambiguous' WHEN conv_id % 7 = 0 THEN 'account_apple_id'
              WHEN conv_id % 11 = 0 THEN 'payments_billing' ELSE 'software_update' END AS intent,
         (conv_id % 20) / 100.0 + 0.04 AS confidence,
         (conv_id % 50) / 100.0 + 0.1 + turn / 100.0 AS top_score,
         CASE WHEN turn = 0 THEN {clean} END AS draft_reply
  FROM conversations WHERE role = 'user'),
decided AS (SELECT conv_id, turn, {esc} FROM base)
""".replace("{esc}", sql_escalation()).replace("{clean}", sql_clean_ascii("text"))

ORACLE["escalation_turns"] = f"WITH {_ESC_BASE} SELECT * FROM decided"

_SCORE = "(conv_id % 50) / 100.0 + 0.1 + turn / 100.0"
_EVIDENCE_BASE = _ESC_BASE.replace(_SCORE + " AS", f"CASE conv_id % 3 WHEN 0 THEN {_SCORE} WHEN 1 THEN {_SCORE} - 0.05 END AS").replace(
    "decided AS (SELECT conv_id, turn,", "decided AS (SELECT conv_id, turn, intent, round(top_score, 6) AS top_retrieval_score,")
ORACLE["escalation_evidence"] = f"WITH {_EVIDENCE_BASE} SELECT * FROM decided"

ORACLE["escalation_summary"] = f"""
WITH {_ESC_BASE}
SELECT count(*) AS n, count_if(decision = 'auto_handle') AS n_auto,
       count_if(decision = 'human_escalation') AS n_escalated,
       round(count_if(decision = 'auto_handle') / greatest(count(*), 1), 6) AS share_auto,
       round(count_if(decision = 'human_escalation') / greatest(count(*), 1), 6) AS share_escalated
FROM decided"""

ORACLE["escalation_signal_counts"] = f"""
WITH {_ESC_BASE}
SELECT s AS signal, count(*) AS n_rows
FROM decided, unnest(string_split(signals, ',')) AS u(s) WHERE signals <> '' GROUP BY s"""

# --- vectors and retrieval ---------------------------------------------------------

ORACLE["index_mapping"] = """
SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS vector_id, vec_id FROM embeddings"""

ORACLE["index_metadata"] = """
SELECT CAST(max(len(embedding)) AS INTEGER) AS dim, 'inner_product_normalized_cosine' AS metric,
       count(*) AS ntotal FROM embeddings"""

ORACLE["vector_text_roundtrip"] = "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n_dims, true AS same FROM embeddings"

_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"

ORACLE["normalized_embeddings"] = f"""
WITH n AS (SELECT vec_id, embedding, {_NORM} AS nrm FROM embeddings),
v AS (SELECT vec_id, nrm, CASE WHEN nrm > 0 THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE) / nrm)
                               ELSE list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS nv FROM n)
SELECT vec_id, round(nrm, 6) AS norm, round(sqrt(list_sum(list_transform(nv, lambda x: x * x))), 6) AS norm_after,
       round(list_sum(nv), 6) AS elem_sum FROM v"""

_PAIRS = """
pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vector_id, q.label AS q_label, v.label AS v_label,
         list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
  FROM embeddings q, embeddings v {cond}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) AS rank FROM pairs)
"""

ORACLE["embedding_topk"] = f"""
WITH {_PAIRS.replace('{cond}', '')}
SELECT query_id, CAST(rank AS INTEGER) AS rank, vector_id, round(score, 6) AS score FROM ranked WHERE rank <= 5"""

ORACLE["retrieval_parity"] = "SELECT count(*) * least(5, count(*)) AS n_pairs, 0 AS n_mismatch FROM embeddings"

ORACLE["neighbour_label_retrieval"] = f"""
WITH {_PAIRS.replace('{cond}', 'WHERE q.vec_id <> v.vec_id')},
firsts AS (SELECT query_id, min(rank) AS first_rank FROM ranked WHERE rank <= 5 AND q_label = v_label GROUP BY query_id),
allq AS (SELECT e.vec_id, f.first_rank FROM embeddings e LEFT JOIN firsts f ON f.query_id = e.vec_id)
SELECT count(*) AS n_queries,
       round(count_if(first_rank = 1) / greatest(count(*), 1), 6) AS hit_at_1,
       round(count_if(first_rank IS NOT NULL) / greatest(count(*), 1), 6) AS hit_at_k,
       round(sum(coalesce(1.0 / first_rank, 0.0)) / greatest(count(*), 1), 6) AS mrr_at_k
FROM allq"""

_PROBED = """
vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pivots AS (
  SELECT row_number() OVER (ORDER BY md5('42-' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS cell, v AS c
  FROM vecs QUALIFY cell < 16),
near AS (
  SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(v, c), 12) DESC, cell) AS r
  FROM vecs, pivots),
probed AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vector_id
  FROM near q JOIN near v ON q.cell = v.cell AND v.r = 1 WHERE q.r <= 10),
found AS (
  SELECT p.query_id, p.vector_id, p.score, row_number() OVER (PARTITION BY p.query_id ORDER BY p.score DESC, p.vector_id) AS rank
  FROM pairs p JOIN probed USING (query_id, vector_id))"""

ORACLE["probe_topk"] = f"""
WITH {_PAIRS.replace('{cond}', '')}, {_PROBED}
SELECT query_id, CAST(rank AS INTEGER) AS rank, vector_id, round(score, 6) AS score FROM found WHERE rank <= 5"""

ORACLE["probe_recall"] = f"""
WITH {_PAIRS.replace('{cond}', '')}, {_PROBED},
flagged AS (
  SELECT e.query_id, f.vector_id IS NOT NULL AS hit FROM ranked e
  LEFT JOIN (SELECT query_id, vector_id FROM found WHERE rank <= 5) f ON f.query_id = e.query_id AND f.vector_id = e.vector_id
  WHERE e.rank <= 5)
SELECT count(*) AS n_exact, count_if(hit) AS n_found, round(count_if(hit) / count(*), 6) AS recall_at_k FROM flagged"""

ORACLE["cell_exact_topk"] = f"""
WITH {_PAIRS.replace('{cond}', 'WHERE q.vec_id <> v.vec_id')}
SELECT query_id, CAST(rank AS INTEGER) AS rank, vector_id, round(score, 6) AS score FROM ranked WHERE rank <= 5"""

ORACLE["saved_index"] = """
SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS vector_id, vec_id AS conversation_id,
       CAST(max(len(embedding)) OVER () AS INTEGER) AS dim, 'inner_product_normalized_cosine' AS metric, count(*) OVER () AS ntotal,
       round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6)
         AS first_element
FROM embeddings"""

ORACLE["judged_evidence_summary"] = f"""
WITH {_PAIRS.replace('{cond}', 'WHERE q.vec_id <> v.vec_id')},
g AS (
  SELECT query_id, vector_id,
         CASE WHEN q_label = v_label THEN 2 WHEN score >= 0.4 THEN 1 ELSE 0 END AS issue_similarity,
         CASE WHEN q_label = v_label AND score >= 0.4 THEN 2 WHEN q_label = v_label OR score >= 0.45 THEN 1 ELSE 0 END
           AS response_usefulness,
         CASE WHEN q_label = v_label THEN 2 WHEN score >= 0.4 THEN 1 ELSE 0 END AS relevance
  FROM ranked WHERE rank <= 3)
SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_rows,
       round(avg(issue_similarity), 6) AS mean_issue_similarity,
       round(avg(response_usefulness), 6) AS mean_response_usefulness,
       round(avg(relevance), 6) AS mean_relevance,
       round(avg(CASE WHEN relevance = 2 THEN 1.0 ELSE 0.0 END), 6) AS share_relevance_2,
       count_if(relevance >= 2) AS n_good, count_if(relevance = 0) AS n_bad
FROM g"""


def sql_hashed(src: str, id_col: str, text_col: str, dim: int = 256) -> str:
    """Sparse twin of the hashed TF encoder: (id, bucket, w) with L2-normalised w."""
    return f"""(
  WITH toks AS (
    SELECT {id_col} AS id, t FROM {src}, unnest(regexp_extract_all(lower(coalesce({text_col}, '')), '\\b\\w\\w+\\b')) AS u(t)),
  tf AS (
    SELECT id, CAST(('0x' || left(md5(t), 8))::BIGINT % {dim} AS INTEGER) AS bucket, count(*) AS tf FROM toks GROUP BY ALL),
  w AS (SELECT id, bucket, 1.0 + ln(tf) AS w FROM tf),
  n AS (SELECT id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY id)
  SELECT w.id, w.bucket, w.w / n.nrm AS w FROM w JOIN n USING (id) WHERE n.nrm > 0)"""


ORACLE["self_retrieval_conversations"] = f"""
WITH {_RECORDS},
iv AS {sql_hashed('records', 'conversation_id', 'text')},
qv AS {sql_hashed('records', 'conversation_id', 'customer_turns')},
dots AS (SELECT qv.id AS query_id, iv.id AS vector_id, sum(qv.w * iv.w) AS score
         FROM qv JOIN iv ON qv.bucket = iv.bucket GROUP BY ALL),
allpairs AS (
  SELECT q.conversation_id AS query_id, v.conversation_id AS vector_id, coalesce(d.score, 0.0) AS score
  FROM records q CROSS JOIN records v LEFT JOIN dots d ON d.query_id = q.conversation_id AND d.vector_id = v.conversation_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vector_id) AS rank FROM allpairs),
firsts AS (SELECT query_id, min(rank) AS first_rank FROM ranked WHERE rank <= 5 AND query_id = vector_id GROUP BY query_id),
allq AS (SELECT r.conversation_id, f.first_rank FROM records r LEFT JOIN firsts f ON f.query_id = r.conversation_id)
SELECT count(*) AS n_queries,
       round(count_if(first_rank = 1) / greatest(count(*), 1), 6) AS hit_at_1,
       round(count_if(first_rank IS NOT NULL) / greatest(count(*), 1), 6) AS hit_at_k,
       round(sum(coalesce(1.0 / first_rank, 0.0)) / greatest(count(*), 1), 6) AS mrr_at_k
FROM allq"""

# --- lexicon, sampler, review ---------------------------------------------------

from threadlens.functions.rules import FINAL_INTENTS, TEST_LEXICON  # noqa: E402

# The rule's word characters (letters, numbers, '_') and blanks as RE2 classes.
_W = r"\p{L}\p{N}_"
_S = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"


def sql_clean_unicode(x: str, keep_apostrophe: bool = False) -> str:
    x = sql_unescape(f"coalesce({x}, '')")
    x = f"regexp_replace({x}, {_q('https?://[^' + _S + ']+|www[.][^' + _S + ']+')}, ' ', 'g')"
    x = f"regexp_replace({x}, '@[A-Za-z0-9_]+', ' ', 'g')"
    keep = _W + _S + "#\\-" + ("'" if keep_apostrophe else "")
    x = f"regexp_replace({x}, {_q('[^' + keep + ']+')}, ' ', 'g')"
    x = f"regexp_replace({x}, {_q('[' + _S + ']+')}, ' ', 'g')"
    return f"trim({x}, ' ')"


def sql_valid(x: str) -> str:
    return (f"(length(trim({x}, ' ')) >= 3 AND "
            f"length(regexp_replace(trim({x}, ' '), {_q('[^' + _W + ']+')}, '', 'g')) >= 3)")


def sql_lexicon_scores(x: str, lex=TEST_LEXICON) -> str:
    """Wide: one score column per label (s0, s1, ...)."""
    cols = []
    for i, (_, kws) in enumerate(lex.labels):
        terms = " + ".join(f"CAST(contains(lower({x}), {_q(k.lower())}) AS INTEGER)" for k in dict.fromkeys(kws))
        cols.append(f"({terms}) AS s{i}")
    return ", ".join(cols)


def sql_ranked(lex=TEST_LEXICON) -> str:
    """Sorted list of (score, -ord, label) structs, best first."""
    items = ", ".join(f"{{'score': s{i}, 'neg_ord': -{i}, 'label': {_q(lab)}}}" for i, (lab, _) in enumerate(lex.labels))
    return f"list_reverse(list_sort([{items}]))"


_LABELLED = f"""
docs AS (
  SELECT doc_id, source, {sql_clean_unicode('text', True)} AS clean FROM documents),
valid AS (SELECT * FROM docs WHERE {sql_valid('clean')}),
scored AS (SELECT doc_id, source, clean, {sql_ranked()} AS r FROM (SELECT *, {sql_lexicon_scores('clean')} FROM valid)),
labelled AS (
  SELECT doc_id, source, clean, r[1].label AS top_label, r[1].score AS top_score, r[2].label AS second_label,
         r[1].score - r[2].score AS margin,
         CASE WHEN r[1].score > 0 THEN r[1].label ELSE {_q(TEST_LEXICON.default_label)} END AS assigned_label
  FROM scored)
"""

ORACLE["lexicon_labels"] = f"""
WITH {_LABELLED}
SELECT doc_id, assigned_label, top_label, second_label, top_score, margin FROM labelled"""

_SPINE = " UNION ALL ".join(f"SELECT {_q(lab)} AS label, {i} AS label_ord" for i, lab in enumerate(TEST_LEXICON.names))

ORACLE["label_distribution"] = f"""
WITH {_LABELLED}, spine AS ({_SPINE})
SELECT s.label, s.label_ord, coalesce(c.n, 0) AS n_rows
FROM spine s LEFT JOIN (SELECT assigned_label, count(*) AS n FROM labelled GROUP BY 1) c ON c.assigned_label = s.label"""

ORACLE["label_examples"] = f"""
WITH {_LABELLED},
d AS (SELECT DISTINCT assigned_label, doc_id, source, clean FROM labelled),
r AS (SELECT assigned_label AS label, doc_id,
             row_number() OVER (PARTITION BY assigned_label ORDER BY doc_id, source, clean) AS example_rank FROM d)
SELECT label, doc_id, CAST(example_rank AS INTEGER) AS example_rank FROM r WHERE example_rank <= 20"""

_SAMPLE = f"""
sdocs AS (
  SELECT doc_id AS tweet_id, source AS conversation_id, text, {sql_clean_unicode('text')} AS clean_text FROM documents),
svalid AS (SELECT * FROM sdocs WHERE {sql_valid('clean_text')}),
sscored AS (SELECT *, {sql_ranked()} AS r FROM (SELECT *, {sql_lexicon_scores('clean_text')} FROM svalid)),
cand AS (
  SELECT tweet_id, conversation_id, text, e.label AS proposed_intent, e.score AS score,
         r[1].score - r[2].score AS margin,
         (r[1].score = e.score AND r[2].score >= e.score - 1) AS is_borderline
  FROM sscored, unnest(r) AS u(e) WHERE e.score > 0),
cls AS (
  SELECT *, (score >= 2 AND margin >= 2) AS is_clear, (score >= 1 AND margin <= 1) AS is_border FROM cand),
p1 AS (
  SELECT proposed_intent, tweet_id, 1 AS pass FROM (
    SELECT *, row_number() OVER (PARTITION BY proposed_intent, conversation_id ORDER BY score DESC, margin, tweet_id) AS rn
    FROM cls WHERE is_clear) WHERE rn = 1 OR conversation_id IS NULL),
p2 AS (SELECT proposed_intent, tweet_id, 2 AS pass FROM cls WHERE is_border),
used AS (SELECT DISTINCT proposed_intent, conversation_id FROM cls WHERE (is_clear OR is_border) AND conversation_id IS NOT NULL),
rest AS (
  SELECT c.* FROM cls c WHERE NOT c.is_clear AND NOT c.is_border
    AND NOT EXISTS (SELECT 1 FROM used u WHERE u.proposed_intent = c.proposed_intent AND u.conversation_id = c.conversation_id)),
p3 AS (
  SELECT proposed_intent, tweet_id, 3 AS pass FROM (
    SELECT *, row_number() OVER (PARTITION BY proposed_intent, conversation_id ORDER BY score DESC, margin, tweet_id) AS rn
    FROM rest) WHERE rn = 1 OR conversation_id IS NULL),
passes AS (SELECT proposed_intent, tweet_id, min(pass) AS pass FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) GROUP BY ALL),
tagged AS (
  SELECT c.*, coalesce(p.pass, 4) AS pass FROM cls c LEFT JOIN passes p USING (proposed_intent, tweet_id)),
sample AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY proposed_intent ORDER BY pass, score DESC, margin, tweet_id) AS sample_rank
                 FROM tagged) WHERE sample_rank <= 25)
"""

ORACLE["quota_sample"] = f"""
WITH {_SAMPLE}
SELECT proposed_intent, tweet_id, pass, CAST(sample_rank AS INTEGER) AS sample_rank, score, margin, is_borderline FROM sample"""

_NAMES = "[" + ", ".join(_q(x) for x in FINAL_INTENTS + ["Ambiguous", "not_a_label"]) + "]"

_REVIEW = f"""
sheet AS (
  SELECT tweet_id, conversation_id, text, proposed_intent,
         CASE WHEN tweet_id % 5 = 0 THEN 'ambiguous' WHEN tweet_id % 5 = 1 THEN {_q(FINAL_INTENTS[0])} END AS gold_intent,
         CAST(NULL AS INTEGER) AS label_confidence, CAST(NULL AS VARCHAR) AS notes, false AS ambiguous
  FROM sample),
answers AS (
  SELECT doc_id AS tweet_id, trim({_NAMES}[doc_id % 12 + 1]) AS a_label,
         CAST(quality * 4 + toxic * 3 - 1 AS VARCHAR) AS a_conf, 'q' || CAST(quality AS VARCHAR) AS a_notes
  FROM labels),
j AS (
  SELECT s.*, a.a_label, a.a_conf, a.a_notes,
         (s.gold_intent IS NOT NULL AND trim(s.gold_intent) <> '' AND trim(s.gold_intent) <> 'ambiguous') AS done,
         (lower(a.a_label) = 'ambiguous' OR a.a_label IN ({', '.join(_q(x) for x in FINAL_INTENTS)})) AS valid_label
  FROM sheet s LEFT JOIN answers a USING (tweet_id))
"""

ORACLE["review_merge"] = f"""
WITH {_SAMPLE}, {_REVIEW},
m AS (SELECT *, (NOT done AND a_label IS NOT NULL AND valid_label) AS take,
             CASE WHEN TRY_CAST(a_conf AS INTEGER) BETWEEN 1 AND 5 THEN TRY_CAST(a_conf AS INTEGER) ELSE 3 END AS conf
      FROM j)
SELECT tweet_id, proposed_intent,
       CASE WHEN take THEN CASE WHEN lower(a_label) = 'ambiguous' THEN 'ambiguous' ELSE a_label END ELSE gold_intent END AS gold_intent,
       CASE WHEN take THEN conf ELSE label_confidence END AS label_confidence,
       CASE WHEN take THEN coalesce(a_notes, '') ELSE notes END AS notes,
       CASE WHEN take THEN lower(a_label) = 'ambiguous' ELSE ambiguous END AS ambiguous
FROM m"""

ORACLE["review_rejects"] = f"""
WITH {_SAMPLE}, {_REVIEW}
SELECT 'label not allowed' AS reason, count(*) AS n_rows FROM j
WHERE NOT done AND a_label IS NOT NULL AND NOT valid_label HAVING count(*) > 0"""

# --- features, splits, classifiers ----------------------------------------------------

ORACLE["tfidf_doc_summary"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower({sql_clean_ascii('text')}), '\\b\\w\\w+\\b') AS t FROM documents),
terms AS (
  SELECT doc_id, x AS term FROM d, unnest(t) AS u(x)
  UNION ALL
  SELECT doc_id, t[i] || ' ' || t[i + 1] FROM d, range(1, len(t)) AS r(i)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS w
      FROM tf JOIN df USING (term)),
n AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)
SELECT doc_id, count(*) AS n_terms, round(sum(weight), 6) AS weight_sum, arg_min(term, (-weight, term)) AS top_term
FROM n GROUP BY doc_id"""

_SPLIT = """
sp AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42-' || CAST(vec_id AS VARCHAR)), vec_id) AS pos,
         count(*) OVER (PARTITION BY label) AS n FROM embeddings),
split AS (SELECT vec_id, label, embedding, CASE WHEN pos <= round(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM sp)
"""

ORACLE["stratified_split"] = f"WITH {_SPLIT} SELECT vec_id, label, split FROM split"

ORACLE["kfold_assignment"] = """
SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42-' || CAST(vec_id AS VARCHAR)), vec_id) - 1) % 5 AS INTEGER) AS fold
FROM embeddings"""

_NORMED = ("list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, "
           "lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))))")

_CENTROID = f"""
tr AS (SELECT vec_id, label, {_NORMED} AS v FROM split WHERE split = 'train'),
cd AS (SELECT label, i, avg(v[i]) AS x FROM tr, range(1, 65) AS r(i) GROUP BY ALL),
cent AS (SELECT label, list(x ORDER BY i) AS c FROM cd GROUP BY label),
te AS (SELECT vec_id, label FROM split WHERE split = 'test'),
scores AS (
  SELECT s.vec_id, s.label AS y_true, c.label AS y_pred,
         list_cosine_similarity(CAST(s.embedding AS DOUBLE[]), c.c) AS sc
  FROM split s, cent c WHERE s.split = 'test'),
pairs AS (SELECT vec_id, y_true, arg_max(y_pred, (sc, -y_pred)) AS y_pred FROM scores GROUP BY vec_id, y_true)
"""

_LAB_SPINE = "SELECT CAST(x AS BIGINT) AS label FROM range(0, 10) AS r(x)"


def _class_metrics(pairs: str) -> str:
    return f"""
SELECT s.label, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn,
       round(coalesce(coalesce(tp, 0) / nullif(coalesce(tp, 0) + coalesce(fp, 0), 0), 0), 6) AS precision,
       round(coalesce(coalesce(tp, 0) / nullif(coalesce(tp, 0) + coalesce(fn, 0), 0), 0), 6) AS recall,
       round(coalesce(2.0 * coalesce(tp, 0) / nullif(2 * coalesce(tp, 0) + coalesce(fp, 0) + coalesce(fn, 0), 0), 0), 6) AS f1
FROM ({_LAB_SPINE}) s
LEFT JOIN (SELECT y_true AS label, count(*) AS tp FROM {pairs} WHERE y_true = y_pred GROUP BY 1) a USING (label)
LEFT JOIN (SELECT y_pred AS label, count(*) AS fp FROM {pairs} WHERE y_true <> y_pred GROUP BY 1) b USING (label)
LEFT JOIN (SELECT y_true AS label, count(*) AS fn FROM {pairs} WHERE y_true <> y_pred GROUP BY 1) c USING (label)"""


ORACLE["centroid_class_f1"] = f"WITH {_SPLIT}, {_CENTROID} {_class_metrics('pairs')}"

ORACLE["intent_eval_summary"] = f"""
WITH {_SPLIT}, {_CENTROID},
cnt AS (SELECT label, count(*) AS n, min(vec_id) AS fp FROM split WHERE split = 'train' GROUP BY label),
maj AS (SELECT arg_max(label, (n, -fp)) AS m FROM cnt),
mpairs AS (SELECT CAST(label AS BIGINT) AS y_true, CAST((SELECT m FROM maj) AS BIGINT) AS y_pred FROM te),
cm_maj AS ({_class_metrics('mpairs')}),
cm_cen AS ({_class_metrics('pairs')})
SELECT count(*) AS n, round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       (SELECT round(avg(f1), 6) FROM cm_maj) AS macro_f1, 'majority' AS model FROM mpairs
UNION ALL
SELECT count(*), round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6),
       (SELECT round(avg(f1), 6) FROM cm_cen), 'centroid' FROM pairs"""

ORACLE["kfold_centroid_metrics"] = f"""
WITH f AS (
  SELECT vec_id, label, embedding, {_NORMED} AS v,
         (row_number() OVER (PARTITION BY label ORDER BY md5('42-' || CAST(vec_id AS VARCHAR)), vec_id) - 1) % 5 AS fold
  FROM embeddings),
folds AS (SELECT DISTINCT fold FROM f),
cd AS (
  SELECT fo.fold, t.label, i, avg(t.v[i]) AS x
  FROM folds fo JOIN f t ON t.fold <> fo.fold, range(1, 65) AS r(i) GROUP BY ALL),
cent AS (SELECT fold, label, list(x ORDER BY i) AS c FROM cd GROUP BY fold, label),
scores AS (
  SELECT s.vec_id, s.fold, s.label AS y_true, c.label AS y_pred,
         list_cosine_similarity(CAST(s.embedding AS DOUBLE[]), c.c) AS sc
  FROM f s JOIN cent c ON c.fold = s.fold),
pairs AS (SELECT vec_id, fold, CAST(y_true AS BIGINT) AS y_true, CAST(arg_max(y_pred, (sc, -y_pred)) AS BIGINT) AS y_pred
          FROM scores GROUP BY vec_id, fold, y_true),
spine AS (SELECT fo.fold, CAST(x AS BIGINT) AS label FROM folds fo, range(0, 10) AS r(x)),
pc AS (
  SELECT s.fold, s.label,
         coalesce((SELECT count(*) FROM pairs p WHERE p.fold = s.fold AND p.y_true = s.label AND p.y_pred = s.label), 0) AS tp,
         coalesce((SELECT count(*) FROM pairs p WHERE p.fold = s.fold AND p.y_pred = s.label AND p.y_true <> s.label), 0) AS fp,
         coalesce((SELECT count(*) FROM pairs p WHERE p.fold = s.fold AND p.y_true = s.label AND p.y_pred <> s.label), 0) AS fn
  FROM spine s),
f1 AS (SELECT fold, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM pc)
SELECT p.fold AS fold, count(*) AS n, round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       (SELECT round(avg(f1.f1), 6) FROM f1 WHERE f1.fold = p.fold) AS macro_f1
FROM pairs p GROUP BY p.fold"""

# --- judge parsing and agreement --------------------------------------------------

from threadlens.functions.rules import DIMENSION_DEFAULT, DIMENSIONS  # noqa: E402


def _grade(key: str) -> str:
    return f"CAST(('0x' || left(md5({key}), 4))::BIGINT % 3 AS INTEGER)"


def _obj(vals: dict, rationale: str | None = None) -> str:
    parts = ["'{'"]
    for i, d in enumerate(DIMENSIONS):
        parts += [_q(('' if i == 0 else ', ') + f'"{d}": '), vals[d]]
    rat = rationale or """'"doc ' || did || '"'"""
    parts += ["', \"rationale\": '", rat, "'}'"]
    return "(" + " || ".join(parts) + ")"


_J = {d: f"CAST({_grade(chr(100) + 'id || ' + _q('-j-' + d))} AS VARCHAR)" for d in DIMENSIONS}
_QUOTED = {d: "'\"' || " + _J[d] + " || '\"'" for d in DIMENSIONS}
_WILD = dict(_J, factual_grounding="'5'", helpfulness="'-1'")
_FRAC = dict(_J, factual_grounding="'1.7'")

_RATED = f"""
lab AS (SELECT doc_id, quality, CAST(doc_id AS VARCHAR) AS did FROM labels),
rated AS (
  SELECT doc_id,
         {', '.join(_grade("did || " + _q('-h-' + d)) + ' AS ' + d for d in DIMENSIONS)},
         CASE doc_id % 10
           WHEN 0 THEN {_obj(_J)}
           WHEN 1 THEN '```json' || chr(10) || {_obj(_J)} || chr(10) || '```'
           WHEN 2 THEN {_obj(_WILD)}
           WHEN 3 THEN 'Here is my verdict: ' || {_obj(_J)} || ' Hope this helps.'
           WHEN 4 THEN '{{"factual_grounding": ' || {_J['factual_grounding']} || ', "helpfulness": ' || {_J['helpfulness']} || ', "relevance": oops'
           WHEN 5 THEN ''
           WHEN 6 THEN {_obj(_QUOTED)}
           WHEN 7 THEN {_obj(_FRAC, "'null'")}
           WHEN 8 THEN '{{"helpfulness": ' || {_J['helpfulness']} || '}}'
           ELSE '[' || {_J['factual_grounding']} || ', ' || {_J['relevance']} || ']' END AS raw_response,
         CASE WHEN doc_id % 7 = 0 THEN 'Reply was TRUNCATED at the end' WHEN doc_id % 7 = 1 THEN NULL
              ELSE 'quality ' || CAST(quality AS VARCHAR) END AS notes
  FROM lab),
c0 AS (SELECT *, regexp_replace(coalesce(raw_response, ''), '^\\s+|\\s+$', '', 'g') AS c1 FROM rated),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(c1, '^```json\\s*', ''), '^```\\s*', ''), '\\s*```$', '') AS c FROM c0),
s AS (
  SELECT *, CASE WHEN json_valid(c) AND json_type(c) = 'OBJECT' THEN c
                 WHEN json_valid(regexp_extract(c, '\\{{.*\\}}', 0, 's'))
                      AND json_type(regexp_extract(c, '\\{{.*\\}}', 0, 's')) = 'OBJECT'
                 THEN regexp_extract(c, '\\{{.*\\}}', 0, 's') END AS src
  FROM c),
judged AS (
  SELECT doc_id, notes, {', '.join(DIMENSIONS)},
         {{JUDGE_COLS}},
         CASE WHEN src IS NULL THEN left(c, 200)
              WHEN list_contains(json_keys(src), 'rationale') AND json_extract_string(src, '$.rationale') IS NULL THEN 'None'
              ELSE regexp_replace(coalesce(json_extract_string(src, '$.rationale'), ''), '^\\s+|\\s+$', '', 'g') END
           AS judge_rationale
  FROM s)
"""


def _judge_col(d: str) -> str:
    v = f"json_extract_string(src, '$.{d}')"
    num = (f"CASE lower(trim({v})) WHEN 'true' THEN 1 WHEN 'false' THEN 0 "
           f"ELSE TRY_CAST(trunc(TRY_CAST({v} AS DOUBLE)) AS BIGINT) END")
    rx = f"regexp_extract(c, {_q(chr(34) + d + chr(34) + r'\s*:\s*(\d)')}, 1)"
    dflt = DIMENSION_DEFAULT[d]
    val = (f"CASE WHEN src IS NOT NULL THEN coalesce({num}, {dflt}) "
           f"ELSE CASE WHEN {rx} <> '' THEN CAST({rx} AS INTEGER) ELSE {dflt} END END")
    return f"CAST(greatest(0, least(2, {val})) AS INTEGER) AS judge_{d}"


_RATED = _RATED.replace("{JUDGE_COLS}", ", ".join(_judge_col(d) for d in DIMENSIONS))

ORACLE["judge_parse"] = f"WITH {_RATED} SELECT doc_id, {', '.join('judge_' + d for d in DIMENSIONS)}, judge_rationale FROM judged"

_LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT doc_id AS row_id, '{d}' AS dimension, {d} AS human, judge_{d} AS judge FROM judged" for d in DIMENSIONS) + ")"

_KAPPA_EXP = " + ".join(
    f"(count_if(human = {i}) / n::DOUBLE) * (count_if(judge = {j}) / n::DOUBLE) * {(i - j) ** 2}"
    for i in range(3) for j in range(3) if i != j)

ORACLE["rating_agreement"] = f"""
WITH {_RATED}, {_LONG},
m AS (
  SELECT dimension, count(*) AS n, avg(human::DOUBLE) AS mh, avg(judge::DOUBLE) AS mj,
         avg(CASE WHEN human = judge THEN 1.0 ELSE 0.0 END) AS ex, avg(CASE WHEN abs(judge - human) <= 1 THEN 1.0 ELSE 0.0 END) AS adj,
         avg(abs(judge - human)::DOUBLE) AS mae, avg(((judge - human) * (judge - human))::DOUBLE) AS msd,
         CASE WHEN var_pop(human) > 0 AND var_pop(judge) > 0 THEN corr(human, judge) ELSE 0.0 END AS corr,
         {_KAPPA_EXP.replace('n::DOUBLE', 'count(*)::DOUBLE')} AS expd
  FROM long GROUP BY dimension)
SELECT dimension, n, round(ex, 6) AS exact_agreement, round(adj, 6) AS adjacent_agreement, round(mae, 6) AS mae,
       round(mj - mh, 6) AS bias, round(mh, 6) AS human_mean, round(mj, 6) AS judge_mean, round(corr, 6) AS correlation,
       round(CASE WHEN expd > 0 THEN 1 - msd / expd WHEN msd = 0 THEN 1.0 ELSE 0.0 END, 6) AS quadratic_weighted_kappa
FROM m"""

ORACLE["rating_confusion"] = f"""
WITH {_RATED}, {_LONG},
spine AS (SELECT DISTINCT dimension, h.x AS human, j.x AS judge FROM long, range(0, 3) AS h(x), range(0, 3) AS j(x))
SELECT s.dimension, CAST(s.human AS INTEGER) AS human, CAST(s.judge AS INTEGER) AS judge,
       (SELECT count(*) FROM long l WHERE l.dimension = s.dimension AND l.human = s.human AND l.judge = s.judge) AS n
FROM spine s"""

ORACLE["disagreement_counts"] = f"""
WITH {_RATED}
SELECT count_if(contains(lower(coalesce(notes, '')), 'truncat')) AS n_truncated,
       count_if(abs(judge_overall_quality - overall_quality) >= 1) AS n_divergent FROM judged"""

ORACLE["divergent_rows"] = f"""
WITH {_RATED}
SELECT doc_id, overall_quality, judge_overall_quality, judge_overall_quality - overall_quality AS diff_overall_quality
FROM judged WHERE abs(judge_overall_quality - overall_quality) >= 1 ORDER BY doc_id LIMIT 8"""

# --- overlap audits ------------------------------------------------------------------

_NORM_TXT = "trim(regexp_replace(lower(coalesce({x}, '')), '\\s+', ' ', 'g'))"


def _norm(x: str) -> str:
    return _NORM_TXT.replace("{x}", x)


def _share(flag: str) -> str:
    return (f"count(*) AS n, round(avg(CASE WHEN {flag} THEN 1.0 ELSE 0.0 END), 6) AS share, "
            f"round(sqrt(avg(CASE WHEN {flag} THEN 1.0 ELSE 0.0 END) * (1 - avg(CASE WHEN {flag} THEN 1.0 ELSE 0.0 END)) "
            f"/ greatest(count(*), 1)), 6) AS std_error")


ORACLE["benchmark_overlap"] = f"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
ex AS (SELECT DISTINCT b.item_id, l.doc_id FROM benchmark b JOIN lines l
       ON {_norm('b.text')} = {_norm('l.line')} WHERE {_norm('b.text')} <> ''),
co AS (SELECT DISTINCT b.item_id, d.doc_id FROM benchmark b JOIN documents d
       ON length(coalesce(b.text, '')) > 0 AND contains(d.text, b.text)),
fx AS (SELECT b.item_id, b.item_id IN (SELECT item_id FROM ex) AS f FROM benchmark b),
fc AS (SELECT b.item_id, b.item_id IN (SELECT item_id FROM co) AS f FROM benchmark b)
SELECT {_share('f')}, (SELECT count(DISTINCT doc_id) FROM ex) AS n_docs_touched, 'exact_line' AS mode FROM fx
UNION ALL
SELECT {_share('f')}, (SELECT count(DISTINCT doc_id) FROM co), 'contains' FROM fc"""

ORACLE["unseen_benchmark"] = """
SELECT b.item_id, length(b.text) AS n_chars FROM benchmark b
WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE length(coalesce(b.text, '')) > 0 AND contains(d.text, b.text))"""

ORACLE["uncontaminated_documents"] = """
SELECT doc_id, lang, source FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE length(coalesce(b.text, '')) > 0 AND contains(d.text, b.text))"""

ORACLE["embedded_documents"] = "SELECT doc_id, " + " || ' ' || ".join(
    f"CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), '{c}', '')) AS VARCHAR)" for c in "aeinrst."
) + " AS vector FROM documents"

_WEAK = f"""
wd AS (SELECT doc_id, {sql_clean_ascii('text')} AS clean FROM documents),
wv AS (SELECT * FROM wd WHERE length(clean) > 0),
ws AS (SELECT doc_id, clean, {sql_ranked()} AS r FROM (SELECT *, {sql_lexicon_scores('clean')} FROM wv)),
weak AS (SELECT doc_id, clean, CASE WHEN r[1].score > 0 THEN r[1].label ELSE {_q(TEST_LEXICON.default_label)} END AS assigned_label FROM ws),
wp AS (SELECT *, row_number() OVER (PARTITION BY assigned_label ORDER BY md5('42-' || CAST(doc_id AS VARCHAR)), doc_id) AS pos,
              count(*) OVER (PARTITION BY assigned_label) AS n FROM weak),
dsplit AS (SELECT doc_id, clean, assigned_label, CASE WHEN pos <= round(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM wp),
ev AS (SELECT e.*, {_norm('e.clean')} IN (SELECT {_norm('clean')} FROM dsplit WHERE split = 'train') AS seen
       FROM dsplit e WHERE split = 'test')
"""

ORACLE["document_text_overlap"] = f"WITH {_WEAK} SELECT {_share('seen')} FROM ev"


def _summary(pairs: str, labels) -> str:
    spine = " UNION ALL ".join(f"SELECT {_q(x)} AS label" for x in labels)
    return f"""(
  SELECT (SELECT count(*) FROM {pairs}) AS n,
         (SELECT round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) FROM {pairs}) AS accuracy,
         round(avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1
  FROM (SELECT s.label,
               (SELECT count(*) FROM {pairs} p WHERE p.y_true = s.label AND p.y_pred = s.label) AS tp,
               (SELECT count(*) FROM {pairs} p WHERE p.y_pred = s.label AND p.y_true <> s.label) AS fp,
               (SELECT count(*) FROM {pairs} p WHERE p.y_true = s.label AND p.y_pred <> s.label) AS fn
        FROM ({spine}) s))"""


ORACLE["unseen_majority_eval"] = f"""
WITH {_WEAK},
cnt AS (SELECT assigned_label, count(*) AS n, min(doc_id) AS fp FROM dsplit WHERE split = 'train' GROUP BY 1),
maj AS (SELECT arg_max(assigned_label, (n, -fp)) AS m FROM cnt),
pa AS (SELECT seen, assigned_label AS y_true, (SELECT m FROM maj) AS y_pred FROM ev),
pu AS (SELECT * FROM pa WHERE NOT seen)
SELECT *, 'all' AS subset FROM {_summary('pa', TEST_LEXICON.names)}
UNION ALL
SELECT *, 'unseen' FROM {_summary('pu', TEST_LEXICON.names)}"""

# --- replies, evidence, triage -------------------------------------------------------

from threadlens.functions.rules import NOT_FOUND_EVIDENCE, REPLY_CLOSE, REPLY_LEAD  # noqa: E402

_NL = "chr(10)"


def _reply_expr(ranked: str, qid: str) -> str:
    """Template reply per query from a ranked-hits CTE (query_id, rank, vector_id, support_turns)."""
    line = f"'- Conversation ' || CAST(vector_id AS VARCHAR) || ': ' || rtrim(left({sql_clean_ascii('support_turns')}, 180))"
    return f"""(
  SELECT {qid} AS query_id,
         string_agg(CAST(vector_id AS VARCHAR), '|' ORDER BY rank) AS evidence_ids,
         max(score) AS top_score,
         {_q(REPLY_LEAD)} || {_NL} || string_agg({line}, {_NL} ORDER BY rank) || {_NL} || {_q(REPLY_CLOSE)} || {_NL}
           || 'Evidence IDs: ' || string_agg(CAST(vector_id AS VARCHAR), ', ' ORDER BY rank) AS reply
  FROM {ranked} GROUP BY {qid})"""


_DRAFTS = f"""
{_RECORDS},
iv AS {sql_hashed('records', 'conversation_id', 'text')},
qv AS {sql_hashed('records', 'conversation_id', 'customer_turns')},
dots AS (SELECT qv.id AS query_id, iv.id AS vector_id, sum(qv.w * iv.w) AS score FROM qv JOIN iv ON qv.bucket = iv.bucket GROUP BY ALL),
allpairs AS (
  SELECT q.conversation_id AS query_id, v.conversation_id AS vector_id, coalesce(d.score, 0.0) AS score, v.support_turns
  FROM records q CROSS JOIN records v LEFT JOIN dots d ON d.query_id = q.conversation_id AND d.vector_id = v.conversation_id
  WHERE q.conversation_id <> v.conversation_id),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vector_id) AS rank
                          FROM allpairs) WHERE rank <= 3),
drafts AS {_reply_expr('ranked', 'query_id')}
"""

ORACLE["template_replies"] = f"WITH {_DRAFTS} SELECT query_id, evidence_ids, round(top_score, 6) AS top_score, reply FROM drafts"

_RESP = """
answers AS (
  SELECT conv_id, arg_min(text, turn) AS text, arg_max(text, turn) AS last_text
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
resp AS (
  SELECT conv_id AS query_id, 'groq' AS provider, 'groq-model' AS model, text FROM answers WHERE conv_id % 5 = 0
  UNION ALL SELECT conv_id, 'groq', 'groq-model', '   ' FROM answers WHERE conv_id % 5 = 1
  UNION ALL SELECT conv_id, 'gemini', 'gemini-model', text FROM answers WHERE conv_id % 5 = 1
  UNION ALL SELECT conv_id, 'openrouter', 'router-model', last_text FROM answers WHERE conv_id % 5 = 2
  UNION ALL SELECT conv_id, 'other', 'other-model', text FROM answers WHERE conv_id % 5 = 3
  UNION ALL SELECT conv_id, 'openai', 'openai-model', text FROM answers WHERE conv_id % 5 = 4),
ok AS (
  SELECT query_id, arg_min({'provider': provider, 'model': model, 'text': text}, list_position(CHAIN, provider)) AS pick
  FROM resp WHERE list_contains(CHAIN, provider) AND length(trim(coalesce(text, ''))) > 0
  GROUP BY query_id),
chosen AS (
  SELECT d.query_id, d.evidence_ids AS evidence_ids_text,
         CASE WHEN o.pick IS NOT NULL THEN o.pick.text ELSE d.reply END AS generated_reply,
         CASE WHEN o.pick IS NOT NULL THEN o.pick.provider ELSE 'deterministic_fallback' END AS provider_used,
         CASE WHEN o.pick IS NOT NULL THEN o.pick.model ELSE 'deterministic_template' END AS model_used,
         o.pick IS NOT NULL AS remote_request_succeeded
  FROM drafts d LEFT JOIN ok o USING (query_id))
"""
_LONG_RESP = _RESP.replace("CHAIN", "['gemini', 'groq', 'openrouter', 'openai']")
_RESP = _RESP.replace("CHAIN", "['groq', 'gemini', 'openrouter']")

ORACLE["reply_provenance_long_chain"] = f"""
WITH {_DRAFTS}, {_LONG_RESP}
SELECT query_id, provider_used, model_used, remote_request_succeeded, length(generated_reply) AS reply_chars FROM chosen"""

ORACLE["reply_provenance"] = f"""
WITH {_DRAFTS}, {_RESP}
SELECT query_id, provider_used, model_used, remote_request_succeeded, length(generated_reply) AS reply_chars FROM chosen"""

ORACLE["reply_batch_check"] = f"""
WITH {_DRAFTS}, {_RESP}
SELECT count(*) AS n_rows, count_if(provider_used = 'groq') AS n_groq, count_if(provider_used = 'gemini') AS n_gemini,
       count_if(provider_used = 'openai') AS n_openai, count_if(provider_used = 'openrouter') AS n_openrouter,
       count_if(provider_used = 'deterministic_fallback') AS n_deterministic_fallback,
       count_if(provider_used NOT IN ('groq', 'gemini', 'openai', 'openrouter', 'deterministic_fallback') OR provider_used IS NULL)
         AS n_other_provider,
       count_if(length(trim(coalesce(evidence_ids_text, ''))) > 0) AS n_with_evidence,
       count_if(length(trim(coalesce(generated_reply, ''))) > 0) AS n_nonblank_reply,
       count_if(remote_request_succeeded) AS n_remote
FROM chosen"""

_VER = r"\d+(?:\.\d+)+"

ORACLE["reply_checks"] = f"""
WITH {_DRAFTS}, {_RESP},
evid AS (SELECT query_id, string_agg(support_turns, ' ') AS evidence FROM ranked GROUP BY query_id),
j AS (SELECT c.*, r.customer_turns AS query, e.evidence,
             rtrim(regexp_replace(coalesce(c.generated_reply, ''), '\\n\\s*Evidence( IDs)?:.*$', '', 's')) AS body
      FROM chosen c JOIN records r ON r.conversation_id = c.query_id LEFT JOIN evid e USING (query_id))
SELECT query_id, NOT regexp_matches(body, '[.!?]\\z') AS no_end_punctuation,
       regexp_matches(lower(coalesce(generated_reply, '')), {_q(keyword_regex(['we will forward', 'our team is working on']))}) AS forward_commitment,
       len(list_filter(list_distinct(regexp_extract_all(coalesce(generated_reply, ''), {_q(_VER)})),
                       lambda x: NOT list_contains(regexp_extract_all(coalesce(evidence, ''), {_q(_VER)}), x))) AS n_unsupported_versions,
       regexp_matches(lower(coalesce(query, '')), {_q(keyword_regex(['already tried', 'did reset', 'restarted']))}) AS already_tried
FROM j"""

ORACLE["evidence_text"] = f"""
WITH {_RECORDS},
rows AS (
  SELECT doc_id AS row_id,
         CASE doc_id % 4 WHEN 0 THEN CAST(doc_id // 10 AS VARCHAR) || '|' || CAST(doc_id * 3 // 40 AS VARCHAR) || '|99999'
                         WHEN 1 THEN ''
                         WHEN 2 THEN '[' || CAST(doc_id // 10 AS VARCHAR) || ', ' || CAST(doc_id * 3 // 40 AS VARCHAR) || ']'
                         ELSE '999998,999999' END AS cell
  FROM labels),
ids AS (SELECT row_id, regexp_extract_all(cell, '\\d+') AS raw FROM rows),
m AS (
  SELECT i.row_id, string_agg('Conversation ID ' || CAST(r.conversation_id AS VARCHAR) || ':' || chr(10) || '  Customer: '
           || left(trim(r.customer_turns), 200) || chr(10) || '  Support: ' || left(trim(r.support_turns), 200),
           chr(10) || chr(10) ORDER BY r.conversation_id) AS blocks
  FROM (SELECT DISTINCT row_id, CAST(x AS BIGINT) AS id FROM ids, unnest(raw) AS u(x)) i
  JOIN records r ON r.conversation_id = i.id GROUP BY i.row_id)
SELECT ids.row_id,
       CASE WHEN len(raw) = 0 THEN {_q(NOT_FOUND_EVIDENCE)}
            WHEN m.blocks IS NULL THEN 'Evidence IDs cited: ' || array_to_string(raw, ', ') || ' (details not found in index)'
            ELSE m.blocks END AS evidence_text
FROM ids LEFT JOIN m USING (row_id)"""

_TRIAGE = f"""
{_RECORDS},
msgs0 AS (SELECT conv_id * 100 + turn AS message_id, {sql_clean_ascii('text')} AS text FROM conversations WHERE role = 'user'),
msgs AS (SELECT message_id, text, {sql_clean_ascii('text')} AS clean FROM msgs0),
mscored AS (SELECT *, {sql_tokens('clean')} AS n_words, {sql_ranked()} AS r,
                  {' + '.join(f's{i}' for i in range(len(TEST_LEXICON.labels)))} AS total
            FROM (SELECT *, {sql_lexicon_scores('clean')} FROM msgs)),
cls AS (
  SELECT message_id, text,
         CASE WHEN n_words < 2 THEN 'ambiguous' WHEN r[1].score > 0 THEN r[1].label ELSE {_q(TEST_LEXICON.default_label)} END AS intent,
         CAST(CASE WHEN n_words < 2 THEN 0.0 WHEN total > 0 THEN round(r[1].score / total, 4) ELSE 0.0 END AS DOUBLE) AS confidence
  FROM mscored),
iv AS {sql_hashed('records', 'conversation_id', 'text')},
qv AS {sql_hashed('msgs', 'message_id', 'clean')},
dots AS (SELECT qv.id AS query_id, iv.id AS vector_id, sum(qv.w * iv.w) AS score FROM qv JOIN iv ON qv.bucket = iv.bucket GROUP BY ALL),
allpairs AS (
  SELECT q.message_id AS query_id, v.conversation_id AS vector_id, coalesce(d.score, 0.0) AS score, v.support_turns
  FROM msgs q CROSS JOIN records v LEFT JOIN dots d ON d.query_id = q.message_id AND d.vector_id = v.conversation_id),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vector_id) AS rank
                          FROM allpairs) WHERE rank <= 3),
drafts AS {_reply_expr('ranked', 'query_id')},
base AS (
  SELECT c.message_id, c.text, c.intent, c.confidence, d.evidence_ids, coalesce(d.top_score, 0.0) AS top_score,
         d.reply AS draft_reply
  FROM cls c JOIN drafts d ON d.query_id = c.message_id),
decided AS (SELECT *, {sql_escalation(TEST_RULES)} FROM base)
"""

ORACLE["triage_turns"] = f"""
WITH {_TRIAGE}
SELECT message_id, intent, confidence AS intent_confidence, evidence_ids, round(top_score, 6) AS top_score,
       decision, risk_level, signals, draft_reply AS reply
FROM decided"""

# the stream drops redelivered messages by id; the table holds each once
ORACLE["triage_stream"] = ORACLE["triage_turns"]

ORACLE["decision_rate_hourly"] = """
WITH e AS (
  SELECT time_bucket(INTERVAL '1 hour', ts) AS ws,
         CASE WHEN event_type = 'error' OR value >= 50 THEN 'human_escalation' ELSE 'auto_handle' END AS decision
  FROM events)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(ws + INTERVAL '1 hour', '%Y-%m-%d %H:%M:%S') AS window_end,
       decision, count(*) AS n_rows
FROM e GROUP BY ws, decision"""

ORACLE["decision_rate_stream"] = ORACLE["decision_rate_hourly"]

# --- cell parsing ----------------------------------------------------------------

ORACLE["id_list_parse"] = """
WITH c AS (
  SELECT o_orderkey,
         CASE o_orderkey % 7 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) || ',' || CAST(o_custkey AS VARCHAR)
              WHEN 1 THEN '[' || CAST(o_orderkey AS VARCHAR) || ']' WHEN 2 THEN 'nan'
              WHEN 3 THEN CAST(o_orderkey AS VARCHAR) || ',x,' || CAST(o_custkey AS VARCHAR)
              WHEN 4 THEN '"' || CAST(o_orderkey AS VARCHAR) || '", "' || CAST(o_custkey AS VARCHAR) || '"'
              WHEN 5 THEN NULL
              ELSE ' ' || CAST(o_orderkey AS VARCHAR) || ' | ' || CAST(o_custkey AS VARCHAR) || ' ' END AS cell,
         CASE WHEN o_orderkey % 5 = 0 THEN '#' || CAST(o_orderkey AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END AS raw_id,
         CASE WHEN o_orderkey % 3 = 0 THEN ' TRUE ' ELSE o_orderstatus END AS flag
  FROM orders),
p AS (
  SELECT *, CASE WHEN cell IS NULL OR trim(cell) IN ('nan', '', 'None', 'NaN') THEN [] ELSE
              list_transform(list_filter(list_transform(string_split(regexp_replace(trim(cell), '["\\[\\]]', '', 'g'), ','),
                                                        lambda t: trim(t)), lambda t: regexp_full_match(t, '[0-9]+')),
                             lambda t: CAST(t AS BIGINT)) END AS ids,
         list_transform(regexp_extract_all(coalesce(cell, ''), '\\d+'), lambda t: CAST(t AS BIGINT)) AS ints
  FROM c)
SELECT o_orderkey, CAST(len(ids) AS INTEGER) AS n_ids, array_to_string(ids, ',') AS ids, array_to_string(ints, ',') AS ints,
       TRY_CAST(raw_id AS BIGINT) AS coerced_id, lower(trim(flag)) = 'true' AS inbound
FROM p"""

ORACLE["reply_model_counts"] = f"""
WITH {_DRAFTS}, {_RESP}
SELECT provider_used, model_used, count(*) AS n_rows FROM chosen GROUP BY ALL"""

ORACLE["first_records"] = f"WITH {_RECORDS} SELECT conversation_id, n_messages FROM records ORDER BY conversation_id LIMIT 50"

# The same text with the references already decoded by hand.
_MARKED_DECODED = ("coalesce(text, '') || ' don’t été 20 m² ½ cup http://a.b/c' || chr(160) || 'my phone e' || chr(769) || "
                   "' €5 a&amp;b ⋉ ' || chr(2325) || chr(2367) || ' x_y #1 & done'")
ORACLE["clean_marked_documents"] = f"""
SELECT doc_id,
       {sql_clean_unicode(_MARKED_DECODED).replace(sql_unescape(f"coalesce({_MARKED_DECODED}, '')"), _MARKED_DECODED)} AS clean,
       {sql_clean_unicode(_MARKED_DECODED, True).replace(sql_unescape(f"coalesce({_MARKED_DECODED}, '')"), _MARKED_DECODED)} AS clean_apostrophe
FROM documents"""

ORACLE["unescape_pages_full"] = ORACLE["unescape_pages"]

# --- linear classifier on TF-IDF -----------------------------------------------------

_TFIDF = f"""
{_WEAK},
wt AS (SELECT doc_id, assigned_label AS label, regexp_extract_all(lower(clean), '\\b\\w\\w+\\b') AS t FROM weak),
wterms AS (
  SELECT doc_id, x AS term FROM wt, unnest(t) AS u(x)
  UNION ALL SELECT doc_id, t[i] || ' ' || t[i + 1] FROM wt, range(1, len(t)) AS r(i)),
wtf AS (SELECT doc_id, term, count(*) AS tf FROM wterms GROUP BY ALL),
wdf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM wt)) / (1.0 + count(*))) + 1 AS idf FROM wtf GROUP BY term),
ww AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM wtf JOIN wdf USING (term)),
feats AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM ww),
lsizes AS (SELECT label, CAST(count(*) AS DOUBLE) AS n_label FROM wt GROUP BY label),
own AS (SELECT label, term, sum(weight) AS own FROM feats JOIN wt USING (doc_id) GROUP BY ALL),
overall AS (SELECT term, sum(weight) AS total FROM feats GROUP BY term),
model AS (
  SELECT l.label, o.term, 4.0 * (coalesce(own.own, 0.0) / l.n_label - o.total / (SELECT count(*) FROM wt)) AS weight
  FROM overall o CROSS JOIN lsizes l LEFT JOIN own ON own.label = l.label AND own.term = o.term)"""


def sql_scored(rows: str) -> str:
    """(id, intent, confidence, n_classes) of ``rows`` (id, clean) under the fixed model."""
    return f"""
st AS (SELECT id, clean, regexp_extract_all(lower(clean), '\\b\\w\\w+\\b') AS t FROM {rows}),
sterms AS (
  SELECT id, x AS term FROM st, unnest(t) AS u(x)
  UNION ALL SELECT id, t[i] || ' ' || t[i + 1] FROM st, range(1, len(t)) AS r(i)),
sw AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM (SELECT id, term, count(*) AS tf FROM sterms GROUP BY ALL) JOIN wdf USING (term)),
sn AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM sw),
sm AS (SELECT id, label, sum(sn.weight * model.weight) AS m FROM sn JOIN model USING (term) GROUP BY ALL),
sg AS (SELECT st.id, l.label, 1 / (1 + exp(-(coalesce(sm.m, 0.0) + ln(l.n_label / (SELECT count(*) FROM wt))))) AS s
       FROM st CROSS JOIN lsizes l LEFT JOIN sm ON sm.id = st.id AND sm.label = l.label),
sp2 AS (SELECT id, label, s / sum(s) OVER (PARTITION BY id) AS p FROM sg),
scored AS (
  SELECT st.id, CASE WHEN {sql_tokens('any_value(st.clean)')} < 2 THEN 'ambiguous' ELSE arg_max(label, (p, -rank_no)) END AS intent,
         CAST(CASE WHEN {sql_tokens('any_value(st.clean)')} < 2 THEN 0.0 ELSE round(max(p), 4) END AS DOUBLE) AS confidence,
         CAST(CASE WHEN {sql_tokens('any_value(st.clean)')} < 2 THEN 0 ELSE count(*) END AS INTEGER) AS n_classes
  FROM st JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY label) AS rank_no FROM sp2) USING (id) GROUP BY st.id)"""


ORACLE["intent_scores"] = f"""
WITH {_TFIDF},
turns AS (SELECT conv_id * 100 + turn AS id, conv_id, turn, {sql_clean_ascii('text')} AS clean FROM conversations),
{sql_scored('turns')}
SELECT conv_id, turn, intent, confidence, n_classes FROM turns JOIN scored USING (id)"""

ORACLE["intent_gradient"] = f"""
WITH {_TFIDF}
SELECT label, CAST(n_label AS BIGINT) AS n_rows, (SELECT count(*) FROM overall) + 1 AS n_terms, CAST(0.0 AS DOUBLE) AS max_gradient
FROM lsizes"""

_CLASSIFIED = (_TRIAGE.replace("cls AS (", "lexicon_cls AS (")
               .replace("iv AS (", f"{_TFIDF},\nsrows AS (SELECT message_id AS id, clean FROM msgs),\n{sql_scored('srows')},\n"
                        "cls AS (SELECT m.message_id, m.text, s.intent, s.confidence, n_words FROM mscored m JOIN scored s ON s.id = m.message_id),\n"
                        "iv AS (", 1))

ORACLE["triage_classified"] = f"""
WITH {_CLASSIFIED},
ev2 AS (SELECT query_id, string_agg(CAST(vector_id AS VARCHAR) || ':' || CAST(round(score, 4) AS VARCHAR), '|' ORDER BY rank) AS evidence,
               count(*) AS n_ev FROM ranked GROUP BY query_id)
SELECT d.message_id, d.intent, d.confidence AS intent_confidence, coalesce(e.evidence, '') AS evidence, decision, reason, 6 AS n_stages,
       'Sanitized input query (' || CAST(c.n_words AS VARCHAR) || ' words); Classifying Intent; Queried the conversation index; retrieved top ' || CAST(coalesce(e.n_ev, 0) AS VARCHAR)
         || ' conversations' AS first_stages
FROM decided d JOIN cls c USING (message_id) LEFT JOIN ev2 e ON e.query_id = d.message_id"""
