"""Thresholds, labels and formats that results depend on.

Most are defaults of keyword parameters, so callers can pass their own. ``RESPONSE_JSON_PATTERN``, ``REVIEW_STATUSES``
and ``IMPORT_WARNING`` are not: they are formats.
"""

# Age groups: (exclusive upper bound, label); anything else, null included, gets the last label.
AGE_GROUPS_CLEANING = ((25, "Young"), (65, "Adult"))
AGE_GROUPS_THREE = ((30, "Young"), (50, "Adult"))
AGE_GROUPS_FOUR = ((25, "Young"), (45, "Adult"), (65, "Middle-aged"))
AGE_GROUP_OTHER = "Senior"

# Income brackets: (exclusive upper bound, label).
INCOME_BRACKETS = ((40000, "Low"), (80000, "Medium"))
INCOME_BRACKET_OTHER = "High"

# Customer tiers by total transaction amount: (exclusive lower bound, label).
CUSTOMER_TIERS = ((10000, "Premium"), (5000, "Gold"), (1000, "Silver"))
CUSTOMER_TIER_OTHER = "Bronze"

# Customer segments: (income above, credit score above, label).
CUSTOMER_SEGMENTS = ((80000, 750, "Premium"), (60000, 700, "Gold"), (40000, 650, "Silver"))
CUSTOMER_SEGMENT_OTHER = "Bronze"

# Risk scores: (credit score above, risk).
RISK_SCORES = ((750, 1), (700, 2), (650, 3), (600, 4))
RISK_SCORE_OTHER = 5

# RFM scores: recency (days at most, score); frequency and monetary (at least, score).
RFM_REFERENCE_DATE = "2024-08-20"
RECENCY_SCORES = ((30, 5), (60, 4), (90, 3), (180, 2))
FREQUENCY_SCORES = ((20, 5), (15, 4), (10, 3), (5, 2))
MONETARY_SCORES = ((5000, 5), (2000, 4), (1000, 3), (500, 2))
RFM_SCORE_OTHER = 1

# Merchant size classes by merchant number: (exclusive upper bound, label).
MERCHANT_PATTERN = r"Merchant_(\d+)"
MERCHANT_SIZES = ((100, "Small"), (500, "Medium"))
MERCHANT_SIZE_OTHER = "Large"

# Right-closed bins.
CREDIT_BIN_EDGES = (0, 580, 669, 739, 799, 850)
CREDIT_BIN_LABELS = ("Poor", "Fair", "Good", "Very Good", "Excellent")
AGE_BIN_EDGES = (0, 25, 35, 50, 65, 100)
AGE_BIN_LABELS = ("18-25", "26-35", "36-50", "51-65", "65+")

# Left-closed age buckets.
AGE_BUCKET_SPLITS = (0.0, 25.0, 35.0, 45.0, 55.0, 65.0, float("inf"))

# Ordinal codes.
EDUCATION_CODES = {"High School": 1, "Bachelor": 2, "Master": 3, "PhD": 4}

# Percentile report.
REPORT_PERCENTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)

# Valid ranges: (rule, column, lowest valid, highest valid).
VALID_RANGES = (
    ("age", "age", 18, 100),
    ("income", "income", 0, None),
    ("credit_score", "credit_score", 300, 850),
)

# Scalar thresholds.
HIGH_INCOME = 80000
IMPORTANT_INCOME = 90000
FREQUENT_BUYER_TRANSACTIONS = 20
SIMILAR_INCOME_GAP = 5000
HIGH_VALUE_AMOUNT = 1000
DAYS_PER_YEAR = 365
STRONG_CORRELATION = 0.7
FREQUENT_ITEM_SUPPORT = 0.3
HIGH_EARNER_QUANTILE = 0.8
EXCELLENT_CREDIT = 740
IQR_FACTOR = 1.5
PCA_VARIANCE = 0.95

# Triage of import statements: substrings, and the three outcomes.
FATAL_KEYWORDS = ("config.spark_config", "requests", "boto3", "os.path.exists")
CUSTOM_MODULE_KEYWORDS = ("utils.", "libs.", "common.")
ABORT, ANNOTATE, MIGRATE = "ABORT_AND_FLAG", "PROCEED_AND_ANNOTATE", "PROCEED_AND_MIGRATE"

# Review reports.
REVIEW_STATUSES = ("PERFECT", "NEEDS_REFINEMENT")

# Artifact files a finished function has, in the single-track and the dual-track run.
ARTIFACTS_SINGLE_TRACK = (
    "01_enriched_code.py",
    "02_original_test.py",
    "03_final_migrated_code.py",
    "04_final_migrated_test.py",
)
ARTIFACTS_DUAL_TRACK = (
    "01_enriched_code.py",
    "02_original_test.py",
    "03_migrated_code.py",
    "04_review_report_main.json",
    "05_corrected_code_main.py",
    "06_migrated_test.py",
    "07_review_report_test.json",
    "08_corrected_code_test.py",
)

# Where JSON may stand in a model response: a json block, any block, the outermost braces.
RESPONSE_JSON_PATTERN = r"(?s)```json\s*(.*?)\s*```|```\s*(.*?)\s*```|(\{.*\})"

# Text put before an import of an own module.
IMPORT_WARNING = """# MIGRATION TOOL WARNING: Manual check required for the following custom import.
# Please ensure the module '{module}' is available in the {platform} environment
# and its internal logic is compatible.
{statement}"""

# Text that stands in for a function that has to be converted by hand.
MANUAL_STUB = """
# ##############################################################################
# ### MIGRATION SKIPPED: MANUAL INTERVENTION REQUIRED                          ###
# ##############################################################################
#
# REASON: {reason}
#
# The following PySpark function could not be automatically migrated.
# Please review the code and manually convert it to its {platform} equivalent.
#
# --- ORIGINAL PYSPARK CODE ---
#
'''
{source}
'''
"""
