"""Fixed values.

Every value in this module must equal the behaviour being reproduced
(vendor product names, category names, thresholds, model settings, report
wording). They are stated plainly, in natural order, and nowhere else.
"""

# --- fixed values: vendor service name -> unified category ---------------
AWS_SERVICE_MAP = {"AmazonEC2": "COMPUTE", "AmazonStorage": "STORAGE", "AmazonNetwork": "NETWORK"}
GCP_SERVICE_MAP = {"Compute Engine": "COMPUTE", "Cloud Storage": "STORAGE", "Cloud Network": "NETWORK"}
AZURE_SERVICE_MAP = {"Virtual Machines": "COMPUTE", "Storage": "STORAGE", "Network": "NETWORK"}
OTHER_CATEGORY = "OTHER"
UNKNOWN = "unknown"

PROVIDERS = ["AWS", "GCP", "Azure"]
CATEGORIES = ["COMPUTE", "STORAGE", "NETWORK"]

# --- fixed values: CSV tokens a billing export uses for "no value" -------
# (lower-case "none" is deliberately not a null token: anomaly_type "none")
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]

# --- fixed values: detector settings -------------------------------------
STL_PERIOD = 7                 # weekly season on daily sums
Z_WINDOW = 14                  # rolling z window, current row included
Z_THRESHOLD = 3.0              # flag when abs(z) > 3
STD_FLOOR = 1e-5               # std replaced when null or exactly 0
ROLL_WINDOW = 7                # tier-2 rolling features over 7 previous rows
RATIO_EPS = 1e-5               # cost / (rolling mean + 1e-5)
WEEKEND_DAYS = (5, 6)          # Monday = 0
IFOREST_TREES = 100
IFOREST_SAMPLES = 256
IFOREST_CONTAMINATION = 0.05
IFOREST_SEED = 42
IFOREST_FEATURES = ["cost", "cost_ratio", "day_of_week", "rolling_std_7d"]
SEQ_LEN = 14                   # tier-3 window length
SEQ_FEATURES = ["cost", "cost_ratio", "rolling_mean_7d"]
SEQ_HIDDEN = 8                 # bottleneck width
SEQ_PERCENTILE = 0.95

# --- fixed values: forecasting -------------------------------------------
VALIDATION_DAYS = 30
HORIZON_DAYS = 90
INTERVAL_Z = 1.645             # 90 % band
GBT_ROUNDS = 50
GBT_DEPTH = 5
GBT_LEARNING_RATE = 0.05
GBT_SEED = 42
CHANGEPOINT_PRIOR = 0.05
MEDIAN_WINDOW = 7              # centred median used to clean flagged days
LOOKAHEADS = [7, 30, 90]
ADDITIVE_MODEL = "additive"
GBT_MODEL = "boosted_trees"
BAND_MODEL = "Ensemble ML"
BAND_LOW = 0.85
BAND_HIGH = 1.15
BAND_MULTIPLIERS = {
    "AWS": {"COMPUTE": 1.0, "STORAGE": 0.4, "NETWORK": 0.15},
    "GCP": {"COMPUTE": 0.85, "STORAGE": 0.35, "NETWORK": 0.12},
    "Azure": {"COMPUTE": 0.95, "STORAGE": 0.5, "NETWORK": 0.22},
}

# --- fixed values: labelled perturbation (detector evaluation) ----------
SPIKE_DATE_INDEX = 45
SPIKE_MOD = 3
SPIKE_FACTOR = 3.5
DRIFT_FIRST_INDEX = 100
DRIFT_DAYS = 15
DRIFT_MOD = 2
DRIFT_BASE = 1.05
DRIFT_STEP = 0.025
CONTEXT_DATE_INDEX = 140
CONTEXT_WEEKDAY = 6            # Sunday, Monday = 0
CONTEXT_FACTOR = 1.55

# --- fixed values: serving -----------------------------------------------
DEFAULT_STREAM = "AWS-COMPUTE"
HISTORY_RANGES = [30, 90, 180]
RCA_DAYS_BEFORE = 2
RCA_DAYS_AFTER = 1

# --- fixed values: incident report wording -------------------------------
REPORT_HEADER = "=== FINOPS ROOT CAUSE ANALYSIS REPORT ==="
REPORT_FOOTER = "========================================="
REPORT_DEFAULT_TYPE = "Spike Variance Detected"
REPORT_DEFAULT_STREAM = "Multi-Vendor Architecture"
REPORT_NO_NOTES = "No triage notes compiled."
REPORT_SKIP_NOTE = ("Skipping LLM evaluation: No telemetry records available in the "
                    "database for this timeframe.")
REPORT_ACTIONS = [
    "1. Alert the engineering leads directly responsible for the highlighted team.",
    "2. Cross-reference AWS Auto-Scaling Group scaling logs matching the target timestamp.",
    "3. Validate lifecycle configuration policies for orphan storage mounts or non-terminated compute threads.",
]
