"""Fixed values and default parameters.

Everything under "fixed values" must equal the published definitions for the
results to be right; everything else is a default that callers may override.
"""

from __future__ import annotations

# --- fixed values: question types ------------------------------------------
ORDINAL_TYPES = ["likert_5", "likert_7", "nps", "top_box"]
SINGLE_TYPES = ["single_choice"]
MULTI_TYPES = ["multi_choice"]
SKIP_TYPES = ["open_end", "video_open_end", "stimulus_block"]
QUESTION_TYPES = [
    "likert_5", "likert_7", "single_choice", "multi_choice", "nps",
    "top_box", "open_end", "stimulus_block", "video_open_end",
]
SCORABLE_TYPES = ["likert_5", "likert_7", "single_choice", "multi_choice", "nps", "top_box"]
COMPARISONS = ["==", "!=", ">", ">=", "<", "<="]
OPERATORS = ["==", "!=", ">", ">=", "<", "<=", "in", "not_in"]
ACTIONS = ["terminate", "qualify"]
STIMULUS_KINDS = ["concept", "ad", "package", "storyboard", "ux_screen"]
PANEL_SOURCES = ["knit_panel", "crm", "hybrid"]
GENDERS = ["any", "male", "female"]
# inclusive scale ends by type; the choice types depend on the option count
SCALE_BOUNDS = {"likert_5": (1, 5), "likert_7": (1, 7), "nps": (0, 10), "top_box": (1, 5)}

# --- fixed values: severities ----------------------------------------------
SEVERITIES = ["none", "low", "medium", "high"]
WASSERSTEIN_HIGH, WASSERSTEIN_MED = 0.50, 0.25
JS_HIGH, JS_MED = 0.20, 0.10
COHENS_D_HIGH, COHENS_D_MED = 0.60, 0.30
MIN_MATCHED = 5
PEARSON_HIGH, PEARSON_MED, MIN_PAIRS = 0.85, 0.70, 20
A_POOR, A_STRONG, PROXY_LOW_VARIANCE = 0.5, 1.0, 0.05
IRT_MIN_PERSONS, IRT_MIN_ITEMS = 30, 2
QUOTA_INFEASIBLE_PCT, QUOTA_MARGINAL_PCT = 1.0, 5.0

# --- fixed values: population codes ----------------------------------------
# highest SCHL code of each education level
EDUCATION_UPTO = [(15, "less_than_hs"), (17, "hs"), (20, "some_college"), (21, "college"), (24, "graduate")]
EDUCATION_RANK = {"less_than_hs": 0, "hs": 1, "some_college": 2, "college": 3, "graduate": 4}
EDUCATION_MIN = {"any": 0, "hs": 1, "some_college": 2, "college": 3, "graduate": 4}
RACE = {
    1: "white", 2: "black", 3: "native", 4: "native", 5: "native",
    6: "asian", 7: "pacific_islander", 8: "other", 9: "multi",
}
MARITAL = {1: "married", 2: "widowed", 3: "divorced", 4: "separated", 5: "never_married"}
STATES = {
    1: "AL", 2: "AK", 4: "AZ", 5: "AR", 6: "CA", 8: "CO", 9: "CT", 10: "DE", 11: "DC", 12: "FL",
    13: "GA", 15: "HI", 16: "ID", 17: "IL", 18: "IN", 19: "IA", 20: "KS", 21: "KY", 22: "LA",
    23: "ME", 24: "MD", 25: "MA", 26: "MI", 27: "MN", 28: "MS", 29: "MO", 30: "MT", 31: "NE",
    32: "NV", 33: "NH", 34: "NJ", 35: "NM", 36: "NY", 37: "NC", 38: "ND", 39: "OH", 40: "OK",
    41: "OR", 42: "PA", 44: "RI", 45: "SC", 46: "SD", 47: "TN", 48: "TX", 49: "UT", 50: "VT",
    51: "VA", 53: "WA", 54: "WV", 55: "WI", 56: "WY",
}
AGE_BUCKETS = {
    "18-24": (18, 24), "25-34": (25, 34), "35-44": (35, 44),
    "45-54": (45, 54), "55-64": (55, 64), "65+": (65, 120),
}
INCOME_BRACKETS = {
    "low": (0, 35_000), "lower_middle": (35_000, 60_000), "middle": (60_000, 120_000),
    "upper_middle": (120_000, 200_000), "high": (200_000, 1_000_000),
}
ADULT_AGES = (18, 80)

# --- fixed values: response-style traits -----------------------------------
TRAITS = {
    "effort_level": {"optimizer": 0.70, "satisficer": 0.20, "speeder": 0.10},
    "acquiescence": {"low": 0.55, "medium": 0.30, "high": 0.15},
    "extreme_response": {"low": 0.60, "medium": 0.30, "high": 0.10},
    "social_desirability": {"low": 0.50, "medium": 0.35, "high": 0.15},
    "reading_level": {"college": 0.40, "hs": 0.45, "low": 0.15},
    "device": {"mobile": 0.65, "desktop": 0.35},
}

# --- fixed values: persona prompt wording ----------------------------------
PROMPT_INCOME = [
    (25_000, "lower-income"), (60_000, "lower-middle-income"),
    (120_000, "middle-income"), (200_000, "upper-middle-income"),
]
PROMPT_INCOME_TOP, PROMPT_INCOME_NONE = "high-income", "no reported income"
PROMPT_EDUCATION = {
    "less_than_hs": "did not finish high school",
    "hs": "have a high school diploma",
    "some_college": "have some college education",
    "college": "have a college degree",
    "graduate": "have a graduate degree",
}
PROMPT_RACE = {
    "white": "white", "black": "Black", "asian": "Asian", "native": "Native American",
    "pacific_islander": "Pacific Islander", "other": "of another race", "multi": "of mixed race",
}
PROMPT_MARITAL = {
    "married": "married", "widowed": "widowed", "divorced": "divorced",
    "separated": "separated", "never_married": "never married",
}
PROMPT_TRAITS = {
    "effort_level": {
        "optimizer": "You read survey questions carefully. You consider each option before answering and try to give the most accurate response.",
        "satisficer": "You skim survey questions and pick a 'good enough' answer rather than thinking hard about each one. You sometimes select the first reasonable option.",
        "speeder": "You rush through surveys to finish quickly. You read minimally and often pick the first or middle option without much thought.",
    },
    "acquiescence": {
        "low": "",
        "medium": "You have a mild tendency to agree with statements when uncertain.",
        "high": "You tend to agree with statements rather than disagree, especially when you're not sure. 'Yes' feels easier than 'No' to you.",
    },
    "extreme_response": {
        "low": "You tend to pick middle options on rating scales.",
        "medium": "",
        "high": "You tend to pick endpoints (1 or 7) on rating scales rather than middle values.",
    },
    "social_desirability": {
        "low": "",
        "medium": "You sometimes adjust answers to seem reasonable to others.",
        "high": "You strongly prefer answers that make you look good to others. You under-report behaviors you think are judged negatively.",
    },
    "reading_level": {
        "college": "You read fluently and parse complex survey wording without difficulty.",
        "hs": "You read at a high-school level. Long or jargon-heavy questions take you longer and you sometimes skim past complex phrasing.",
        "low": "You read slowly. Long or technical questions are hard for you to parse. You sometimes guess at meanings of unfamiliar words and pick a default answer.",
    },
    "device": {
        "mobile": "You're taking this survey on a phone. Long matrix questions are awkward to read and you may rush through them.",
        "desktop": "You're taking this survey on a desktop computer with a full screen.",
    },
}
PROMPT_FRAMING = (
    "You are answering a survey question. Respond as this specific person would, informed by their background and how they tend to take surveys. "
    "Be authentic to the persona — including any tendencies toward satisficing, agreement bias, or extreme/middle response patterns described above. "
    "Do not break character. Return only the structured answer requested; no preamble, no explanation."
)
SCALE_HINTS = {
    "likert_5": "Answer 1 (Very dissatisfied) to 5 (Very satisfied).",
    "likert_7": "Answer 1 (Strongly disagree) to 7 (Strongly agree).",
    "nps": "Answer 0 to 10.",
    "top_box": "Answer 1 (Definitely no) to 5 (Definitely yes).",
}

# --- fixed values: variant gate, panels, hashing ---------------------------
K_VARIANTS = 5
EQUIVALENCE_FLOOR, DIVERSITY_FLOOR, DIVERSITY_CEIL = 0.85, 0.70, 0.95
VARIANT_PLACEHOLDER = "<paraphrase>"
FALLBACK_AXIS = "fallback_original"
HASH_VERSION = "v1"
BASELINE_N, SUBPANEL_N = 1000, 200

# --- fixed values: planted defects -----------------------------------------
DEFECT_CLASSES = [
    "leading_wording", "double_barreled", "loaded_language",
    "redundant_pair", "fatigue_block", "infeasible_screener",
]
DEFECT_SEVERITIES = ["subtle", "moderate", "obvious"]
LEADING_PREFIXES = {
    "subtle": ["Would you say that ", "How much would you say ", "To what extent would you agree that "],
    "moderate": ["Many people feel that ", "Most users tend to think ", "Research suggests that "],
    "obvious": ["Obviously, you would agree that ", "Isn't it clear that ", "Wouldn't you say that "],
}
EXTRA_FACETS = {
    "subtle": ["price", "overall value", "affordability"],
    "moderate": ["customer service", "speed of delivery", "packaging design"],
    "obvious": [
        "customer service and shipping speed",
        "packaging design and brand reputation",
        "product features and after-sale support",
    ],
}
LOADED_PHRASES = {
    "subtle": [" (which most experts recommend)", " (a popular choice)", " (a well-regarded option)"],
    "moderate": [" (a truly outstanding option)", " (an exceptional choice)", " (a market leader)"],
    "obvious": [
        " (the absolute best, most-loved, top-rated option)",
        " (an extraordinary, world-class, award-winning choice)",
        " (a superior, premium, must-have option)",
    ],
}
SYNONYMS = {
    "subtle": [("satisfied", "content"), ("likely", "inclined"), ("important", "significant")],
    "moderate": [("satisfied", "happy"), ("likely", "willing"), ("important", "valuable")],
    "obvious": [("satisfied", "satisfied"), ("likely", "likely"), ("important", "important")],
}
CLONE_PREFIX = {"subtle": "In other words, ", "moderate": "In other words, ", "obvious": "Once again, "}
FATIGUE_SIZE = {"subtle": 8, "moderate": 12, "obvious": 20}
FATIGUE_ATTRIBUTES = [
    "value", "quality", "design", "trust", "innovation", "service", "convenience", "support",
    "reliability", "safety", "ease of use", "modernity", "sophistication", "warmth",
    "approachability", "simplicity", "credibility", "premium-ness", "transparency",
    "consistency", "responsiveness",
]
INFEASIBLE_CELLS = {
    "subtle": {"age_bucket": "65+", "state": "VT"},
    "moderate": {"age_bucket": "65+", "state": "WY", "income_bracket": "high"},
    "obvious": {"age_bucket": "18-24", "income_bracket": "high", "state": "WV"},
}
INFEASIBLE_TARGET_N = 200
# severity of a synthetic signature
SHIFT_FRACTION, TARGET_CORRELATION, CORRELATION_NOISE = 0.65, 0.92, 0.5
#: What is left of an answer's distance from the middle of its scale once it is drawn in.
MIDDLE_SHARE = 0.25

# --- fixed values: clean corpus --------------------------------------------
CORPUS_SUBJECTS = {
    "mobile_carrier": "your current mobile carrier",
    "streaming_service": "your primary streaming subscription",
    "online_retail": "your most-used online retail store",
    "fitness_app": "your fitness tracking app",
    "food_delivery": "your most-used food delivery service",
    "credit_card": "your primary credit card",
    "automotive": "your current vehicle",
    "athletic_apparel": "the athletic apparel brand you wear most",
    "home_insurance": "your home or renters insurance provider",
    "ride_share": "your most-used ride-share service",
}
# {subject} and {category} are filled per survey
CORPUS_QUESTIONS = [
    ("Q1", "likert_5", "How satisfied are you with {subject}?"),
    ("Q2", "nps", "How likely are you to recommend {subject} to a friend?"),
    ("Q3", "likert_5", "How well does {subject} meet your needs?"),
    ("Q4", "single_choice", "What matters most when choosing a {category}?"),
    ("Q5", "likert_5", "How would you rate the value for money of {subject}?"),
    ("Q6", "top_box", "Would you continue using {subject} over the next 12 months?"),
]
CORPUS_AGE_MIN, CORPUS_AGE_MAX, CORPUS_INCOME_MIN = [18, 21, 25], [54, 60, 65], [0, 35_000, 50_000]

# --- fixed values: run states, prices, alarms ------------------------------
RUN_TRANSITIONS = {
    "pending": ["personas_ready", "failed"],
    "personas_ready": ["paraphrases_ready", "failed"],
    "paraphrases_ready": ["probing", "failed"],
    "probing": ["stats_running", "failed"],
    "stats_running": ["completed", "failed"],
    "completed": [],
    "failed": [],
}
TERMINAL_STATUSES = ["completed", "failed"]
STATUS_PRIORITY = [
    "completed", "stats_running", "probing", "paraphrases_ready", "personas_ready", "pending", "failed",
]
# USD per million tokens: input, output, cache write, cache read
PRICES = {
    "claude-sonnet-4-6": (3.0, 15.0, 3.75, 0.30),
    "claude-haiku-4-5-20251001": (0.80, 4.0, 1.0, 0.08),
}
DAILY_CAP_USD = 20.0
ALARM_WINDOW, ALARM_RATIO, COOL_DOWN_SECONDS, HALF_OPEN_PROBES = 30, 0.5, 30.0, 3
MAX_ATTEMPTS = 3
F1_DROP_GATE = 0.02
HISTORY_LENGTH = 20

# --- defaults of ours ------------------------------------------------------
SEED = 42
# a per-key ordered window runs in one task, so larger groups are cut in chunks
DEFAULT_COUNTRY = "US"
MAX_GROUP_ROWS = 2_000_000
JOIN_SALTS = 16
REPORT_SHEET_ROWS = 5_000  # findings of a kind in one report document
