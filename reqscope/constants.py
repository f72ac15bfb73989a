"""Fixed values that results depend on.

FIXED VALUES - these must stay exactly as written (content and order) for
results to match the evaluated workload: the trigger lexicon, the seeds,
the model listing order, display names, the significance settings and the
metric names. Nothing else in the library hard-codes data.
"""

from __future__ import annotations

# --- FIXED VALUES: trigger lexicon, in list order (order matters for masking) ---
TRIGGER_TERMS = [
    "should", "may", "could", "might", "appropriate", "adequate", "fast", "quick",
    "efficient", "user-friendly", "as soon as possible", "if needed", "etc", "and/or",
]

# --- FIXED VALUES: experiment seeds ---
SEEDS = [13, 21, 42, 87, 123]

# --- FIXED VALUES: the seven metrics, in output order ---
METRICS = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "mcc", "cohen_kappa"]

# --- FIXED VALUES: model listing order and display names ---
MODEL_ORDER = [
    "MultinomialNB", "LinearSVM", "RandomForest", "LightGBM", "XGBoost",
    "distilbert-base-uncased", "bert-base-uncased", "roberta-base", "albert-base-v2",
    "t5-small", "google/flan-t5-small",
]
DISPLAY_NAME = {
    "MultinomialNB": "NB",
    "LinearSVM": "Linear SVM",
    "RandomForest": "Random Forest",
    "LightGBM": "LightGBM",
    "XGBoost": "XGBoost",
    "distilbert-base-uncased": "DistilBERT",
    "bert-base-uncased": "BERT-base",
    "roberta-base": "RoBERTa-base",
    "albert-base-v2": "ALBERT-base",
    "t5-small": "T5-small",
    "google/flan-t5-small": "FLAN-T5-small",
}

# --- FIXED VALUES: model groups used by the filtered report tables ---
TRANSFORMER_MODELS = [
    "distilbert-base-uncased", "roberta-base", "bert-base-uncased", "albert-base-v2",
    "t5-small", "google/flan-t5-small",
]
FINAL_TRANSFORMER_MODELS = [
    "distilbert-base-uncased", "bert-base-uncased", "roberta-base", "albert-base-v2", "t5-small",
]
COMPARISON_MODELS = [
    "LinearSVM", "LightGBM", "XGBoost", "distilbert-base-uncased", "bert-base-uncased",
    "roberta-base", "albert-base-v2", "t5-small",
]
ABLATION_COMPACT_MODELS = ["LinearSVM", "LightGBM", "XGBoost"]

# --- FIXED VALUES: encoder models compared by the signed-rank test (listed order) ---
ENCODER_SHORT_NAMES = {
    "BERT": "bert-base-uncased",
    "RoBERTa": "roberta-base",
    "DistilBERT": "distilbert-base-uncased",
    "ALBERT": "albert-base-v2",
}
ENCODER_ORDER = ["BERT", "RoBERTa", "DistilBERT", "ALBERT"]

# --- FIXED VALUES: significance settings (setting, train, test, label), listed order ---
SIGNIFICANCE_SETTINGS = [
    ("intra", "PURE", "PURE", "Intra PURE"),
    ("intra", "UserStories", "UserStories", "Intra User Stories"),
    ("cross", "PURE", "UserStories", "PURE to User Stories"),
    ("cross", "UserStories", "PURE", "User Stories to PURE"),
]
ALPHA = 0.05

# --- FIXED VALUES: text-to-text verbaliser and prompt ---
PROMPT_PREFIX = "is this requirement ambiguous? requirement: "
MASK_TOKEN = "[TRIGGER]"

# --- FIXED VALUES: split fractions and profiling parameters ---
TEST_SIZE = 0.2
VAL_SIZE_FROM_TRAIN = 0.125
TOP_N_REASONS = 12
HIST_BINS = 30

# --- FIXED VALUES: TF-IDF configuration (1-2 grams, min_df 2, max_df 0.95, sublinear tf) ---
TFIDF_MIN_DF = 2
TFIDF_MAX_DF = 0.95
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Key column sets.
KEY3 = ["setting", "train_dataset", "test_dataset"]
KEY4 = KEY3 + ["model"]
