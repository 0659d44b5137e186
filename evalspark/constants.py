"""Fixed values of the evaluation contract.

Everything in this module is part of the data contract (file headers, slugs,
thresholds, message formats). The values have to be exactly these for results
to be comparable, so they are kept as plain text in one place.
"""

# --- corpus and submission files -------------------------------------------
GOLDEN_SQL_COLUMN = "peak_sql"
GOLDEN_REQUIRED = (
    "id", "tier", "category", "domain", "prompt", "peak_sql",
    "golden_reasoning", "ambiguity_flag", "status",
)
GOLDEN_OPTIONAL = ("tables", "sql_features", "evidence_required")
SUBMISSION_REQUIRED = ("id", "agent_sql", "agent_explanation")
APPROVED = "approved"
TRUE_WORDS = ("y", "yes", "true", "1")
FALSE_WORDS = ("", "n", "no", "false", "0")

# --- tiers: tier, name, threshold aggregate, target share of the corpus ------
TIERS = (
    ("T1", "Floor check", "headline", 0.20),
    ("T2", "Main signal", "trust-critical", 0.65),
    ("T3", "Judgment calls", "calibration", 0.15),
)
TIER_NAMES = tuple(t[0] for t in TIERS)

# --- categories: slug, title, trust risk, trust-critical, calibration --------
CATEGORIES = (
    ("translation_correctness", "Translation correctness", "low", False, False),
    ("schema_selection", "Schema selection", "high", True, False),
    ("business_logic", "Business logic & domain knowledge", "high", True, False),
    ("temporal_logic", "Temporal & calendar logic", "high", True, False),
    ("silent_wrongness", "Silent-wrongness traps", "high", True, False),
    ("ambiguity_handling", "Ambiguity handling", "high", False, True),
    ("hallucination_resistance", "Hallucination resistance", "high", True, False),
    ("refusal_scope", "Refusal & scope awareness", "medium", False, True),
    ("efficiency", "Efficiency / cost", "medium", False, False),
    ("reasoning_faithfulness", "Reasoning faithfulness", "high", True, False),
    ("consistency_rephrasing", "Consistency under rephrasing", "medium", False, False),
    ("adversarial_robustness", "Adversarial / robustness", "low", False, False),
)
CATEGORY_SLUGS = tuple(c[0] for c in CATEGORIES)
TRUST_CRITICAL_SLUGS = tuple(c[0] for c in CATEGORIES if c[3])
CALIBRATION_SLUGS = tuple(c[0] for c in CATEGORIES if c[4])

# --- query guardrails -------------------------------------------------------
MAX_BYTES_SCANNED = 1 << 30
MAX_RESULT_ROWS = 10_000

# --- result comparison ------------------------------------------------------
REL_TOLERANCE = 1e-5
ABS_TOLERANCE = 1e-8
SAMPLE_ROWS = 5
GOLDEN_LABEL = "peak"  # how messages and error prefixes call the golden side
AGENT_LABEL = "agent"

# --- efficiency -------------------------------------------------------------
EFFICIENCY_BAND = 0.10

# --- scorecard --------------------------------------------------------------
HEADLINE_THRESHOLD = 0.90
TRUST_CRITICAL_THRESHOLD = 0.85
CALIBRATION_THRESHOLD = 0.80
MIN_CASES_PER_AGGREGATE = 5
TOP_FAILURE_CATEGORIES = 3
BAR_WIDTH = 20

# --- judge ------------------------------------------------------------------
DIMENSIONS = ("factual_accuracy", "completeness", "no_hallucination")
FAILURE_CATEGORIES = (
    "missing_filter", "wrong_filter", "wrong_aggregation", "wrong_grouping",
    "wrong_join", "wrong_table", "wrong_columns", "time_window", "precision", "other",
)
MAX_CALLS_PER_RUN = 75
RESULT_HEAD_ROWS = 200
USD_PER_MTOK_INPUT = 3.0
USD_PER_MTOK_OUTPUT = 15.0

# --- judge calibration ------------------------------------------------------
AGREEMENT_BAR = 0.85
KAPPA_BAR = 0.60
KAPPA_LABELS = (
    (0.20, "poor"), (0.40, "fair"), (0.60, "moderate"), (0.80, "substantial"),
)
KAPPA_TOP_LABEL = "almost perfect"
REASONING_PREVIEW = 90
CALIBRATION_FILE_PATTERN = r"^(\d{4}-\d{2}-\d{2}_\d{6})_([0-9a-f]{8})\.md$"
AGREEMENT_LINE_PATTERN = r"\*\*Overall agreement:\*\*\s*(\d+)%"

# --- run ledger -------------------------------------------------------------
FIELD_SEPARATOR = "\x1f"
FINGERPRINT_HEX = 16
PROMPT_HASH_HEX = 8
RECENT_RUNS = 25
