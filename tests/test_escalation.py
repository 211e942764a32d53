"""I1-I10 with the default rules on the crafted messages (FIXTURES 3)."""

import pytest

from threadlens.functions.rules import DEFAULT_LEXICON, DEFAULT_RULES, FINAL_INTENTS, FINAL_LEXICON
from threadlens.operators import escalation, lexicon

ROWS = [
    # (id, text, intent, score, confidence, reply, decision, risk, required signal)
    (1, "No more menus please, give me a real person.", "connectivity", 0.45, None, None,
     "human_escalation", "high", "explicit_human_request"),
    (2, "Somebody hacked my login since Sunday.", "account_apple_id", 0.50, None, None,
     "human_escalation", "high", "account_security_access"),
    (3, "There is an unrecognized charge of nine euros, I dispute it.", "payments_billing", 0.42, None, None,
     "human_escalation", "high", "payment_refund_dispute"),
    (4, "Smoke comes out next to the charging port", "battery_charging", 0.48, None, None,
     "human_escalation", "high", "severe_hardware_safety_data_loss"),
    (5, "help pls", "ambiguous", 0.20, None, None, "human_escalation", "medium", "ambiguous_intent"),
    (6, "Which cable joins a gramophone and the tablet here", "software_update", 0.18, None, None,
     "human_escalation", "medium", "insufficient_retrieval_grounding"),
    (7, "The lower corner of the glass has a scratch.", "device_issue", 0.35, None,
     "Sorry about the scratch; we will replace the glass for you.",
     "human_escalation", "high", "unsupported_commitments"),
    (8, "Since the last update my battery is empty by noon.", "battery_charging", 0.45, None, None,
     "auto_handle", "low", None),
    (9, "violet teapots under seven bridges", "media_accessories", 0.45, 0.1097, None,
     "human_escalation", "medium", "low_intent_confidence"),
    (10, "My battery drains quickly after updating.", "battery_charging", 0.28, 0.13, None, "auto_handle", "low", None),
    (11, "nothing special here", None, None, None, None, "auto_handle", "low", None),
    (12, "Help me pls", "ambiguous", 0.2818, None, None, "human_escalation", "medium", "ambiguous_intent"),
]

SCHEMA = "id int, text string, intent string, score double, conf double, reply string"


@pytest.fixture(scope="module")
def decided(spark):
    df = spark.createDataFrame([r[:6] for r in ROWS], SCHEMA)
    out = escalation.decide(df, "text", "intent", "score", "reply", "conf", DEFAULT_RULES)
    return {r.id: r for r in out.collect()}


def test_decisions(decided):
    for r in ROWS:
        got = decided[r[0]]
        assert got.decision == r[6], r
        assert got.risk_level == r[7], r
        if r[8]:
            assert r[8] in got.signals, (r, got.signals)
        else:
            assert got.signals == []


def test_reasons(decided):
    assert "human" in decided[1].reason.lower()
    assert decided[6].reason == "Top retrieval similarity (0.180) is below confidence threshold (0.28)."
    assert decided[9].reason.startswith("Classifier confidence (11.0%) is near random chance (13.0%)")
    assert decided[8].reason == ("Routine troubleshooting query with clear 'battery_charging' intent and sufficient "
                                 "historical evidence grounding (relevance: 0.450); safe for automated response.")
    assert "(grounded)" in decided[11].reason and "diagnosed" in decided[11].reason
    # both thresholds are strict
    assert decided[10].signals == []
    # ambiguous suppresses low confidence; both medium signals keep their order
    assert decided[5].signals == ["ambiguous_intent", "insufficient_retrieval_grounding"]


def test_summary(spark, decided):
    df = spark.createDataFrame([r[:6] for r in ROWS], SCHEMA)
    out = escalation.decide(df, "text", "intent", "score", "reply", "conf", DEFAULT_RULES)
    s = escalation.decision_summary(out).first()
    assert s.n == len(ROWS) and s.n_auto == 3 and s.n_escalated == 9
    counts = {r.signal: r.n_rows for r in escalation.signal_counts(out).collect()}
    assert counts["ambiguous_intent"] == 2


def test_top_score_from_evidence(spark):
    rows = [(1, None, [0.2, 0.5, None]), (2, 0.1, [0.9]), (3, None, []), (4, None, None), (5, None, [0.2])]
    df = spark.createDataFrame([(i, "my battery drains quickly", "battery_charging", s, e and [(x,) for x in e] if e is None or e else [])
                                for i, s, e in rows], "id int, text string, intent string, score double, ev array<struct<sim_score:double>>")
    got = {r.id: r for r in escalation.decide(df, "text", "intent", "score", evidence="ev").collect()}
    assert {i: r.metadata.top_retrieval_score for i, r in got.items()} == {1: 0.5, 2: 0.1, 3: None, 4: None, 5: 0.2}
    assert [got[i].decision for i in (1, 2, 3, 4, 5)] == ["auto_handle", "human_escalation", "auto_handle", "auto_handle", "human_escalation"]
    assert all(r.metadata.intent == "battery_charging" for r in got.values())
    none = escalation.decide(df.drop("score"), "text", "intent", evidence="ev").filter("id = 2").first()
    assert none.metadata.top_retrieval_score == 0.9


def test_final_lexicon(spark):
    """Same keywords in the same order under the final names."""
    assert FINAL_LEXICON.names == FINAL_INTENTS
    assert [w for _, w in FINAL_LEXICON.labels] == [w for _, w in DEFAULT_LEXICON.labels]
    df = spark.createDataFrame([(1, "gift card billing"), (2, "the screen has a lag"), (3, "nothing at all")], "id int, t string")
    got = {r.id: r.assigned_label for r in lexicon.score_rows(df, "t", FINAL_LEXICON).collect()}
    assert got[1] == "payments_billing" and got[2] == "device_issue" and got[3] == FINAL_INTENTS[-1]
