"""Status words, tokens, thresholds and name lists.

Everything here has to equal the published behaviour for results to agree, so
the values are written out plainly.
"""

# --- metric and support statuses (canonical spellings only) -----------------
VALID = "VALID"
UNDEFINED = "UNDEFINED"
INSUFFICIENT_GROUP = "INSUFFICIENT_GROUP_SUPPORT"
UNRELIABLE = "UNRELIABLE_ESTIMATE"
ZERO_POSITIVE = "ZERO_POSITIVE_SUBGROUP"
ZERO_NEGATIVE = "ZERO_NEGATIVE_SUBGROUP"
MISSING_SENSITIVE = "MISSING_SENSITIVE"
MISSING_VIOLATION = "MISSING_ATTRIBUTE_VIOLATION"
DEGENERATE_TARGET = "DEGENERATE_TARGET"
INSUFFICIENT_BOOTSTRAP = "INSUFFICIENT_BOOTSTRAP_SUPPORT"
INSUFFICIENT_CALIBRATION = "INSUFFICIENT_CALIBRATION_SUPPORT"
UNSTABLE_RATIO = "UNSTABLE_RATIO"

#: Older spellings that readers may still hand in.
STATUS_ALIASES = {
    "HEALTHY": VALID,
    "ZERO_SELECTION_RATE": UNDEFINED,
    "SPARSE_SUBGROUP": INSUFFICIENT_GROUP,
    "MISSING_SENSITIVE_ATTRIBUTE": MISSING_VIOLATION,
    "INSUFFICIENT_SUPPORT": INSUFFICIENT_BOOTSTRAP,
    "COLLAPSED_CONSTANT": "DEGENERATE",
    "COLLAPSED_SINGLE_CLASS": "DEGENERATE",
}

# --- predictor degeneracy ----------------------------------------------------
NORMAL = "NORMAL"
DEGENERATE = "DEGENERATE"
INSUFFICIENT_SIGNAL = "INSUFFICIENT_SIGNAL"

# --- metric names --------------------------------------------------------------
DP = "Demographic Parity Diff"
EO = "Equal Opportunity Diff"
EODDS = "Equalized Odds Diff"
PP = "Predictive Parity Diff"
DIR = "Disparate Impact Ratio"

# --- missing group labels, compared after trim + upper -------------------------
MISSING_GROUP_TOKENS = ["", "UNKNOWN", "NULL", "NONE", "OTHER", "MALFORMED", "MISSING", "NAN"]

# --- numeric limits --------------------------------------------------------------
DI_RATE_FLOOR = 1e-4
DI_RATIO_CEILING = 100.0
#: linspace(0, 1, 11); the entries at 3, 6 and 7 are not the short decimals.
ECE_EDGES = [
    0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5,
    0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0,
]
MAX_JSON_DEPTH = 10

# --- column names that give the outcome away ---------------------------------------
SUSPICIOUS_SUBSTRINGS = [
    "target", "not_target", "outcome", "future_outcome", "post_completion",
    "completion_status", "cutoff", "is_cutoff", "label", "actual_time",
    "actual_distance", "segment_actual", "delivered", "elapsed",
    "arrival_time", "delivery_time",
]
POST_OUTCOME_COLUMNS = [
    "actual_time", "actual_distance_to_destination", "segment_actual_time",
    "actual_vs_osrm_distance_ratio", "actual_vs_osrm_time_ratio",
    "time_per_distance_actual", "segment_deviation",
]

# --- decision-unit levels and collapse strategies -----------------------------------
COLLAPSE_STRATEGIES = [
    "NONE", "MAJORITY_VOTE", "ANY_FAILURE", "ALL_SUCCESS", "FIRST_RECORD",
    "LAST_RECORD", "ENTITY_WEIGHTED", "UNSUPPORTED_EVALUATION_UNIT",
]

# --- human-review codes ------------------------------------------------------------
REVIEW_ALIASES = {
    "MARGINAL_DISPARITY": "REVIEW_MATERIAL_POLICY_VIOLATION",
    "SPARSE_SUBGROUP": "REVIEW_LOW_SUPPORT",
    "SHIFT_DETECTED": "REVIEW_INCONCLUSIVE_EVIDENCE",
    "POLICY_AMBIGUITY": "REVIEW_POLICY_AMBIGUITY",
    "HIGH_STAKES_DECISION": "REVIEW_REGULATORY_MAPPING",
    "UNCALIBRATED_PROBABILITIES": "REVIEW_MATERIAL_POLICY_VIOLATION",
}
CONFIRMATORY = ["CONFIRMATORY_ANALYSIS", "CONFIRMATORY", "CONFIRMATORY_AUDIT"]
