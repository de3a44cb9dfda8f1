"""Label domain, aliases, key lists and policies.

The tuples and maps below are fixed values: results are only right when they
are exactly these. Every operator that uses one takes it as a parameter.
"""

from __future__ import annotations

# --- fixed values: labels -------------------------------------------------
LABELS = ("Error", "CONFIGURATION", "SYSTEM", "Noise")
LABEL_ALIASES = {label.lower(): label for label in LABELS}
DEFAULT_LABEL = "Noise"

# --- fixed values: column aliases, in priority order ----------------------
TEXT_KEYWORDS = ("log", "message", "msg", "text")
TRAINING_MESSAGE_COLUMNS = ("logmessage", "log_message", "message", "msg", "text", "log")
TRAINING_LABEL_COLUMNS = ("class", "label")
GOLDEN_MESSAGE_COLUMNS = ("logmessage", "log_message", "message", "errormessage", "error_message", "log")
GOLDEN_LABEL_COLUMNS = ("class", "label", "classification", "target", "y")
FEEDBACK_MESSAGE_COLUMNS = ("logmessage", "log_message", "message", "msg", "text", "log", "errormessage")
FEEDBACK_LABEL_COLUMNS = ("class", "label", "correctlabel", "correct_label")

# --- fixed values: payload keys, in priority order ------------------------
MESSAGE_KEYS = ("errorMessage", "LogMessage", "logMessage", "message", "log", "msg", "text")
CORRECT_LABEL_KEYS = ("correctLabel", "correct_label", "label", "class")
CONTAINER_KEYS = ("metadata", "context", "deployment", "git", "github")
COMMIT_SHA_KEYS = (
    "commitSha", "commit_sha", "commitId", "commit_id", "gitSha", "git_sha", "githubSha", "github_sha",
    "headSha", "head_sha", "sourceVersion", "source_version", "buildSourceVersion", "build_source_version",
    "revision", "commit", "GITHUB_SHA", "sha",
)
PREVIOUS_SHA_KEYS = (
    "previousSha", "previous_sha", "baseSha", "base_sha", "beforeSha", "before_sha", "before",
    "baseCommit", "base_commit", "GITHUB_BASE_SHA",
)
BRANCH_KEYS = (
    "branch", "gitBranch", "git_branch", "githubBranch", "github_branch", "sourceBranch", "source_branch",
    "GITHUB_REF", "github_ref", "ref",
)
EVENT_TIME_KEYS = ("received_at", "timestamp", "time", "eventTime", "created_at", "createdAt")
SOURCE_PATH_KEYS = ("sourcePath", "source_path", "file", "filename", "path")
PREDICTION_KEYS = (
    "prediction", "predictions", "class", "classes", "label", "labels", "predictedLabel", "predicted_label",
    "predictedClass", "predicted_class", "category", "categories", "result", "results", "output", "outputs",
    "response", "answer", "generated_text",
)
PREDICTION_SKIP_KEYS = (
    "errorMessage", "LogMessage", "logMessage", "message", "log", "msg", "text", "input", "inputs",
    "payload", "request", "raw_payload",
)
SENSITIVE_KEY_PARTS = (
    "token", "secret", "password", "authorization", "connection_string", "connectionstring", "access_key",
    "account_key", "api_key", "endpoint_key", "function_key", "prediction_key",
)
SENSITIVE_KEYS = ("code", "pat", "connection")

# --- fixed values: evidence terms and paths -------------------------------
STOP_WORDS = (
    "after", "azure", "because", "before", "called", "class", "code", "configuration", "could", "error",
    "failed", "failure", "from", "function", "github", "http", "jira", "log", "message", "monitor", "noise",
    "none", "null", "prediction", "request", "response", "runtime", "server", "service", "system", "trace",
    "true", "with",
)
EXCEPTION_SUFFIXES = (
    "Exception", "Error", "Failure", "Fault", "Timeout", "Denied", "NotFound", "Conflict", "BadRequest",
    "Unauthorized", "Forbidden", "Crash",
)
SOURCE_EXTENSIONS = (
    "py", "js", "jsx", "ts", "tsx", "java", "cs", "go", "rb", "php", "c", "cc", "cpp", "h", "hpp", "rs",
    "kt", "swift",
)

# --- fixed values: evidence points and caps -------------------------------
SOURCE_POINTS = {
    "consecutive_history_diff": 25,
    "payload_commit_sha": 100,
    "payload_sha_range": 75,
    "path": 45,
    "commit_message_search": 35,
    "recent_branch_history": 10,
}
PATH_POINTS, BASENAME_POINTS, PATCH_TERM_POINTS, FILENAME_TERM_POINTS = 70, 25, 15, 8
EVIDENCE_SCORE_CAP = 160
RELATED_SCORE = 35

# --- fixed values: gate and drift policies --------------------------------
GATE_POLICY = {
    "min_accuracy": 0.9,
    "min_weighted_f1": 0.9,
    "min_macro_f1": 0.88,
    "min_recall_per_class": {"Error": 0.85, "CONFIGURATION": 0.85, "SYSTEM": 0.85, "Noise": 0.9},
}
DRIFT_POLICY = {
    "warning": {
        "min_accuracy": 0.92,
        "min_weighted_f1": 0.92,
        "min_macro_f1": 0.86,
        "min_recall_per_class": {"Error": 0.8, "CONFIGURATION": 0.8, "SYSTEM": 0.8, "Noise": 0.94},
    },
    "critical": {
        "min_accuracy": 0.86,
        "min_weighted_f1": 0.86,
        "min_macro_f1": 0.78,
        "min_recall_per_class": {"Error": 0.7, "CONFIGURATION": 0.7, "SYSTEM": 0.7, "Noise": 0.88},
    },
}

# --- fixed values: text that a CSV reader takes as missing ----------------
CSV_MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- fixed values: rules of the offline scorer, first match wins ----------
# Patterns are read case-insensitively and hold for Java and RE2 alike.
LABEL_RULES = (
    ("CONFIGURATION", r"(missing|invalid|undefined|not set).{0,40}(environment variable|config|setting|credential|option|hostname|port\b|env\b|_key\b|refresh token|scope|mail_)"),
    ("CONFIGURATION", r"required option not passed|invalid_client|invalid_grant|unauthorized_client|feature flag"),
    ("SYSTEM", r"memory (limit|exhaust)|out of memory|allowed memory|cpu |disk|no space|read-only file|connection refused|network unreachable|kernel|service unavailable"),
    ("SYSTEM", r"application (booted|shutdown)|transaction (started|committed|rolled back)|artisan"),
    ("Error", r"(exception|error)\b *:|stack ?trace|null pointer|undefined (variable|property|route|method)|parse error|assertion failed"),
    ("Noise", r""),
)

# --- fixed values: types of follow-up actions -----------------------------
ACTION_TYPES = {
    "ignore": "ignore",
    "email": "email",
    "incident": "jira",
    "pull_request": "github_pull_request",
    "remediation": "github_copilot_remediation",
    "none": "none",
}
RECIPIENTS = {"CONFIGURATION": "configuration", "SYSTEM": "system"}
INCIDENT_LABEL = "Error"
