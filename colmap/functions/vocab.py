"""Names, word lists and formats that results depend on."""

# ---- fixed values ---------------------------------------------------------

# canonical field -> column names that mean it (whole name, lower case)
FIELD_SYNONYMS = {
    "text": ["text", "sentence", "review", "body", "content", "tweet", "document"],
    "label": ["label", "target", "score", "class", "category", "sentiment"],
    "text_a": ["text_a", "premise", "sentence1", "context", "source", "question", "query", "prompt"],
    "text_b": ["text_b", "hypothesis", "sentence2", "response", "answer", "output"],
}

# fields the vector matcher looks for
STANDARD_FIELDS = ["text", "label", "text_a", "text_b", "question", "answer", "input", "output"]

# mapped fields that decide the task; the first family with a hit wins
TASK_KEYS = {
    "nli": ["text_a", "text_b", "premise", "hypothesis"],
    "qa": ["question", "answer"],
    "generation": ["input", "output"],
}
DEFAULT_TASK = "classification"

# task -> catalog task name
TASK_CATALOG = {
    "classification": "tasks.classification.binary",
    "nli": "tasks.classification.multi_class",
    "generation": "tasks.generation",
    "summarization": "tasks.summarization.abstractive",
    "translation": "tasks.translation",
    "regression": "tasks.regression",
}
DEFAULT_CATALOG_TASK = "tasks.classification.binary"

# task words that count as the same family when scoring
TASK_GROUPS = [
    ["classification", "binary", "multi_class", "sentiment"],
    ["nli", "entailment"],
    ["qa", "question_answering"],
    ["generation", "summarization", "translation"],
]

# card task families: (any of these words, none of these words)
CARD_FAMILIES = {
    "classification": (["classification"], ["relation"]),
    "nli": (["relation", "nli"], []),
    "qa": (["qa", "question_answering"], []),
    "generation": (["generation", "summarization", "translation"], []),
}
CARD_TYPE = "task_card"
CARD_LOADER_TYPE = "load_hf"

# mapping keys that describe the data instead of naming a column
ANNOTATION_KEYS = ["classes", "type_of_class", "type_of_relation"]
ANNOTATION_SUFFIX = "_type"

# keys of a ground-truth record that are not data
METADATA_KEYS = ["metadata", "data_classification_policy"]

# label-like column names, in order of preference
LABEL_NAMES = ["label", "labels", "target", "answer", "class"]

# value a declared spec carries when it does not set the field
SPEC_DEFAULTS = {
    "sentence1": "sentence1",
    "sentence2": "sentence2",
    "labels": "labels",
    "inputs": "input",
    "tokens": "tokens",
    "prompt": "prompt",
    "output": "output",
}
SPEC_CHOICE_PREFIX = "choice"
SPEC_PAIR_FIELD = "sentence2"

SPLITS = ["train", "test", "validation"]
JSON_MODE_PREFIXES = ["anthropic/", "openai/"]
JSON_MODE = "json_object"
TEMPERATURE = 0.0
MAX_NEW_TOKENS = 1024

METHOD_ORDER = ["keyword", "embedding", "local_llm", "api_llm"]
AVERAGE = "Average"

# (card id, name, config)
DATASET_REGISTRY = [
    ("sst2", "glue", "sst2"),
    ("mrpc", "glue", "mrpc"),
    ("qnli", "glue", "qnli"),
    ("mnli", "glue", "mnli"),
    ("wnli", "glue", "wnli"),
]

# result texts
RENAME_STEP = "Rename(field='%s', to_field='%s')"
PLAN_EMPTY = "# No rename steps needed"
PLAN_FAILED = "# Mapping failed"
NO_FEATURES = "# Error: no features"
UNREADABLE = "ValueError: a reference record is not a JSON object"
UNREADABLE_ROW = "ValueError: a row is not a JSON object"
INFER_FAILED = {"api": "# Error: LLM/API failed", "local": "# Error: local LLM failed"}

# response text patterns
BROKEN_KEY = r'"(\w+)"_(\w+)"\s*:'
FENCED_OBJECT = r"```(?:json)?\s*(\{[^`]*\})\s*```"
THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"

# sizes
PROMPT_ROWS = 5
SCORE_ROWS = 10
OVERLAP_ROWS = 10
EVAL_ROWS = 100
SPEC_EVAL_ROWS = 10
SAMPLE_SIZE = 20
SAMPLE_SEED = 42
SIMILARITY_THRESHOLD = 0.6

# ---- end of fixed values --------------------------------------------------
