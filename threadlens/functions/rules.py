"""Rule sets passed to operators as data: lexicon, escalation phrases, thresholds.

Defaults are the fixed values the original project uses; the small test sets
make every branch fire on the driver's invented prose (see SURVEY 7.6).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Fixed values (must equal the original for equal results).
# ---------------------------------------------------------------------------

# Intent lexicon used by the weak labeller: label order decides ties, the last
# label is also the default when nothing hits.
LABEL_KEYWORDS = {
    "software_update": ["update", "ios", "software", "upgrade", "version", "install"],
    "battery_charging": ["battery", "charge", "charging", "drain", "power"],
    "app_store_itunes": ["app store", "itunes", "app", "download", "song", "playlist", "music"],
    "account_apple_id": ["account", "apple id", "login", "password", "sign in", "icloud account", "recovery"],
    "connectivity": ["wifi", "bluetooth", "network", "connect", "signal", "internet"],
    "keyboard_input": ["keyboard", "text", "symbol", "letter", "typing", "spell", "input"],
    "device_performance": ["screen", "crash", "lag", "slow", "freeze", "performance", "device", "phone"],
    "payments_billing": ["payment", "purchase", "card", "gift card", "billing", "charged"],
    "mail_messages_icloud": ["mail", "email", "icloud", "message", "inbox", "sync", "messages"],
    "media_accessories_support": ["media", "music", "photos", "home sharing", "watch", "charger", "dock",
                                  "accessory", "support", "dm"],
}

# The ten final intents of the review and classifier stages (same keywords,
# shorter names).
FINAL_INTENTS = [
    "software_update", "battery_charging", "app_store", "account_apple_id", "connectivity",
    "keyboard_input", "device_issue", "payments_billing", "mail_messages", "media_accessories",
]

# Support account and the two accepted handle spellings of the thread builder.
SUPPORT_AUTHOR = "applesupport"
SUPPORT_HANDLES = ("@AppleSupport", "@applesupport")

# Escalation phrases, thresholds and wording.
HUMAN_LEAD_IN = ["speak to", "talk to", "connect me to", "transfer to", "need a", "want a"]
HUMAN_WORDS = ["human", "real person", "agent", "representative", "advisor", "operator", "manager",
               "supervisor", "someone"]
ACCOUNT_PHRASES = ["locked out", "lockout", "stolen", "hacked", "compromised", r"two[\s-]factor", "2fa",
                   "security question", "unauthorized access", "disabled account", "account disabled",
                   "activation lock", "passcode forgot", "forgot password", "reset password",
                   "apple id locked", "find my iphone", "lost mode"]
PAYMENT_PHRASES = ["unrecognized charge", "charged twice", "double charge", "unauthorized charge", "refund",
                   "dispute", "credit card", "debit card", "bank statement", "fraud", "fraudulent",
                   "overcharged", "billing error", "gift card balance", "subscription fee", "charged for",
                   "cancel subscription", "money stolen"]
SAFETY_PHRASES = ["burning", "burning up", "smoke", "smoking", "spark", "sparking", "fire", "exploded",
                  "swollen battery", "battery swollen", "shattered", "cracked screen", "water damage",
                  "dropped in water", "lost all my data", "photos deleted", "lost everything", "data lost",
                  "bricked", "wont turn on at all", "phone completely dead"]
COMMITMENT_PHRASES = ["we will refund", "we can refund", "we will replace", "we guarantee", "send you a new",
                      "warranty will cover", "free repair", "compensation"]
MIN_RETRIEVAL_SIMILARITY = 0.28
MIN_INTENT_CONFIDENCE = 0.13
MIN_TOKENS = 3
ACCOUNT_INTENT = "account_apple_id"
BILLING_INTENT = "payments_billing"
AMBIGUOUS = "ambiguous"

SIGNAL_TEXT = {
    "explicit_human_request":
        "Customer explicitly requested to interact with a human agent or representative.",
    "account_security_access":
        "Account security, credentials, or Apple ID access issue requires authenticated human support.",
    "payment_refund_dispute":
        "Financial, billing, or charge dispute involves monetary adjustments or payment details.",
    "severe_hardware_safety_data_loss":
        "Hardware safety hazard (overheating/battery swelling) or catastrophic data loss.",
    "ambiguous_intent": "Customer query intent is ambiguous or underspecified.",
    "unsupported_commitments":
        "Draft reply contains financial or replacement commitments requiring supervisor sign-off.",
}

# Rating dimensions of reply review, and the default the judge parser falls back to.
DIMENSIONS = ["factual_grounding", "helpfulness", "relevance", "unsupported_claims", "overall_quality"]
DIMENSION_DEFAULT = {"factual_grounding": 1, "helpfulness": 1, "relevance": 1, "unsupported_claims": 0,
                     "overall_quality": 1}

# Reply template lines.
REPLY_LEAD = ("Thanks for reaching out. Based on the historical AppleSupport conversation evidence, the closest "
              "matching cases suggest the following support path:")
REPLY_CLOSE = ("Please share the device model and current iOS version, then continue the conversation in DM as "
               "the historical examples do. Do not assume that a specific policy, refund, account change, or "
               "device swap is guaranteed from the historical evidence alone.")
NOT_FOUND_EVIDENCE = "No historical evidence provided."


@dataclass(frozen=True)
class EscalationRules:
    human_lead_in: tuple = tuple(HUMAN_LEAD_IN)
    human_words: tuple = tuple(HUMAN_WORDS)
    account_phrases: tuple = tuple(ACCOUNT_PHRASES)
    payment_phrases: tuple = tuple(PAYMENT_PHRASES)
    safety_phrases: tuple = tuple(SAFETY_PHRASES)
    commitment_phrases: tuple = tuple(COMMITMENT_PHRASES)
    min_similarity: float = MIN_RETRIEVAL_SIMILARITY
    min_confidence: float = MIN_INTENT_CONFIDENCE
    min_tokens: int = MIN_TOKENS
    account_intent: str = ACCOUNT_INTENT
    billing_intent: str = BILLING_INTENT
    ambiguous_label: str = AMBIGUOUS


DEFAULT_RULES = EscalationRules()

# Test rule set: phrases that occur in the driver's invented prose so that every
# signal fires; token limit 12 and similarity 0.35.
TEST_RULES = EscalationRules(
    human_lead_in=(), human_words=("this",), account_phrases=("are",), payment_phrases=("que", "des"),
    safety_phrases=("und", "die"), commitment_phrases=("thing", "hahe"),
    min_similarity=0.35, min_confidence=0.13, min_tokens=12,
)


@dataclass(frozen=True)
class Lexicon:
    """Ordered label -> keyword list; the last label is the no-hit default."""
    labels: tuple = field(default_factory=lambda: tuple((k, tuple(v)) for k, v in LABEL_KEYWORDS.items()))

    @property
    def names(self):
        return [lab for lab, _ in self.labels]

    @property
    def default_label(self):
        return self.labels[-1][0]

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(lab, i, kw) for i, (lab, kws) in enumerate(self.labels) for kw in kws]
        return spark.createDataFrame(rows, "label string, label_ord int, keyword string")


DEFAULT_LEXICON = Lexicon()

# The same keywords under the final intent names: the review sampler and triage use these.
FINAL_LEXICON = Lexicon(labels=tuple((name, words) for name, (_, words) in zip(FINAL_INTENTS, DEFAULT_LEXICON.labels, strict=True)))

# Test lexicon: one label per language of the driver's prose (so labels,
# margins and ties are meaningful), three rare labels and two that never hit
# (the distribution must still show them). On sf0.01 documents every sampler
# pass occurs (measured: 93 / 31 / 45 / 17 rows in passes 1-4).
TEST_LEXICON = Lexicon(labels=(
    ("lab_en", ("th", "the", "ing", "and", "ed ", "wh")),
    ("lab_fr", ("eau", "ment", "aux", "oi", "\u00ea", "\u00e8")),
    ("lab_de", ("sch", "ein", "ung", "ich", "\u00fc", "\u00e4")),
    ("lab_es", ("ci\u00f3n", "ado", "los", "\u00f1", "\u00eda", "del")),
    ("lab_trash", ("trash", "idiot")), ("lab_rare2", ("nding", "\u00e9ment")), ("lab_rare3", ("queque", "enlich")),
    ("lab_mail", ("mail",)), ("lab_xy", ("xyz",)), ("lab_default", ("zzq",)),
))
