"""Values that are part of the contract and must not drift."""

# ---- Fixed values: the ordered feature schema -------------------------------
NUMERIC_FEATURES = (
    "account_age_days",
    "followers_count",
    "following_count",
    "follower_following_ratio",
    "tweet_count",
    "posting_frequency",
    "description_length",
    "username_length",
    "profile_completeness",
)
BOOLEAN_FEATURES = ("verified", "uses_default_profile_image", "has_description")
FEATURES = NUMERIC_FEATURES + BOOLEAN_FEATURES

# Half of the features must be usable; three quarters for full confidence.
SUFFICIENT_USABLE = 6
CONFIDENT_USABLE = 9

# ---- Fixed values: reading text ---------------------------------------------
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# Every character a Unicode-aware strip removes.
WHITESPACE = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)
TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")
UNKNOWN_WORDS = ("unknown", "none", "n/a", "na")
# \z: unlike $, not before a last line break either
ACCOUNT_ID_PATTERN = r"^[0-9]{1,19}\z"

# ---- Fixed values: labelled sources -----------------------------------------
SOURCE_FILES = (
    "twitter_human_bots_cleaned.csv",
    "twitter_bot_training_data2_cleaned.csv",
)
REQUIRED_COLUMNS = ("account_id", "label", "source_dataset")
PRIVATE_COLUMNS = ("label", "quality_flag", "feature_completeness")
SEED = 42
DEMO_PER_CLASS = 50

# ---- Fixed values: threshold search -----------------------------------------
GRID_STEP = 0.05
MEDIUM_RANGE = (0.10, 0.66)
HIGH_RANGE = (0.40, 0.91)
MIN_BAND_WIDTH = 0.10
COST_MISSED_LOW = 5.0      # suspicious account placed in the low band
COST_MISSED_MEDIUM = 1.0   # suspicious account placed in the medium band
COST_FALSE_MEDIUM = 0.25   # ordinary account placed in the medium band
COST_FALSE_HIGH = 1.0      # ordinary account placed in the high band

# ---- Fixed values: model capacity -------------------------------------------
BOOST_ROUNDS = 150
BOOST_DEPTH = 4
BOOST_RATE = 0.05
BOOST_ROW_SHARE = 0.8
BOOST_COLUMN_SHARE = 0.8
BASELINE_MAX_ITER = 1000

# ---- Fixed values: decisions and wording ------------------------------------
CONFIDENCE_MARGIN = 0.08
TRIAGE_WARNING = "Triage evidence, not a verdict."
INSUFFICIENT_WARNING = (
    "Not enough public evidence is available to produce a risk assessment."
)
EXPLANATION_WARNING = (
    "The risk score is available, but its explanation could not be generated. "
    "Human review is required."
)
FEATURE_LABELS = {
    "account_age_days": "Account age",
    "followers_count": "Follower count",
    "following_count": "Following count",
    "follower_following_ratio": "The follower-to-following pattern",
    "tweet_count": "Tweet count",
    "posting_frequency": "Posting frequency",
    "description_length": "Description length",
    "username_length": "Username length",
    "profile_completeness": "Profile completeness",
    "verified": "Verification status",
    "uses_default_profile_image": "Use of a default profile image",
    "has_description": "Description availability",
}
OVERRIDE_LABELS = ("legitimate", "suspicious", "uncertain")
REASON_PATTERN = r"^[a-z0-9_]{1,64}\z"
ASSESSMENT_PREFIX = "asmt_"
UNKNOWN_MODEL = "unknown_model"
LIST_LIMITS = (1, 100)
LIST_DEFAULT = 20

# code -> message
ERROR_MESSAGES = {
    "invalid_request": "The request is invalid.",
    "model_unavailable": (
        "The model is unavailable. Run the local training command first."
    ),
    "data_adapter_unavailable": (
        "Demo account data is unavailable. Run the local training command first."
    ),
    "account_not_found": "The account is not available in the local demo dataset.",
    "feedback_store_unavailable": "The assessment could not be recorded safely.",
    "assessment_not_found": "The assessment does not exist.",
    "override_already_recorded": (
        "An override has already been recorded for this assessment."
    ),
    "internal_error": "An unexpected error occurred.",
}
OVERRIDE_STORE_MESSAGE = "The override could not be recorded safely."
