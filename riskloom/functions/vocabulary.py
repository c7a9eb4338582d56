"""Names, words and constants that results depend on."""

from __future__ import annotations

# Accepted column names per role of an event table, in order of preference.
EVENT_ALIASES = {
    "user": ("user_id", "userid", "user"),
    "time": ("timestamp", "datetime", "date", "time", "event_time"),
    "action": ("action", "activity", "event_type"),
    "file": ("file_accessed", "file", "resource", "path"),
    "device": ("device", "host", "pc", "computer"),
    "location": ("location", "geo", "city", "site"),
    "volume": ("data_volume_mb", "data_volume", "volume_mb", "volume", "bytes_mb"),
    "login": ("login_status", "login", "auth_status"),
    "failed": ("failed_attempts", "failures", "failed_login", "failed_logins"),
    "privilege": ("privilege_level", "privilege", "role", "access_level"),
    "label": ("label", "target", "y", "is_insider", "insider", "threat"),
}

# Accepted user columns of the four log tables, and the time columns of the logon table.
LOG_USER_ALIASES = {
    "logon": ("user", "username", "employee_name"),
    "device": ("user", "username", "employee_name"),
    "email": ("user", "username", "employee_name", "from"),
    "file": ("user", "username", "employee_name"),
}
LOG_TIME_ALIASES = ("date", "datetime", "time")

# Accepted columns of a wide per-user table.
TABULAR_USER_ALIASES = (
    "user_id", "userid", "user", "username", "employee_id", "employee_name", "emp_id", "employee", "name",
)
TABULAR_LABEL_ALIASES = (
    "label", "target", "y", "is_insider", "insider", "malicious", "class", "threat", "is_malicious", "anomaly",
)

# Columns that would leak the label into the features.
LEAKAGE_NAMES = ("label", "target", "y", "is_insider", "insider", "threat", "is_threat")

# Label texts that count as positive.
POSITIVE_WORDS = ("1", "true", "yes", "malicious", "insider", "positive", "attack", "threat", "anomaly")

ALLOWED_LOCATIONS = ("bangalore",)
DEFAULT_LOCATION = "Bangalore"
CATEGORICAL_COLUMNS = ("action", "device", "location")
EVENT_NUMERIC_COLUMNS = (
    "data_volume_mb", "failed_attempts", "privilege_level", "hour", "is_night",
    "high_data_transfer", "session_duration", "login_frequency", "file_sensitivity",
)

# Texts a CSV reader of data frames takes for a missing value.
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Time layouts tried in order after the ISO layout; month comes first.
# Month first; then 12-hour clocks, two-digit years and month names; day first is tried last, so only where unambiguous.
TIME_LAYOUTS = (
    "M/d/yyyy H:m:s", "M/d/yyyy H:m", "M/d/yyyy", "yyyy/M/d H:m:s", "yyyy/M/d H:m", "yyyy/M/d",
    "M-d-yyyy H:m:s", "M-d-yyyy H:m",
    "M/d/yyyy h:m:s a", "M/d/yyyy h:m a", "yyyy-M-d h:m:s a", "yyyy-M-d h:m a", "M/d/yy H:m:s", "M/d/yy H:m", "M/d/yy h:m a",
    "d MMM yyyy H:m:s", "d MMM yyyy H:m", "d MMM yyyy", "MMM d, yyyy H:m:s", "MMM d, yyyy h:m a", "MMM d, yyyy", "MMM d yyyy H:m:s",
    "d/M/yyyy H:m:s", "d/M/yyyy H:m", "d/M/yyyy", "d.M.yyyy H:m:s", "d.M.yyyy H:m", "d.M.yyyy", "d-M-yyyy H:m:s", "d-M-yyyy H:m",
)

MIN_EVENT_ROWS = 50
MIN_TABULAR_ROWS = 8
PREVIEW_ROWS = 15
MICRO_BATCH_ROWS = 50_000
DEFAULT_TRUST = 0.85
TRUST_FLOOR, TRUST_CEILING = 0.15, 1.0
PIPELINE_VERSION = "riskloom-1"

# Lower risk bound, level, actions and note, from the highest level down.
THREAT_LEVELS = (
    (0.78, "critical", ("block_high_risk_session", "alert_soc_priority", "forensic_snapshot"),
     "Combined model and low trust exceed critical threshold."),
    (0.55, "elevated", ("alert_analyst", "step_up_auth", "enhanced_monitoring_24h"),
     "Elevated insider-risk score; manual review recommended."),
    (0.35, "watch", ("log_for_trending", "optional_manager_notification"),
     "Borderline signals; continue passive monitoring."),
    (None, "normal", ("allow",), "Within expected behavior envelope."),
)

# Message formats.
OVERFIT_MESSAGE = "The clean model's %s of %.3f is above %.2f, which real data seldom allow."
OVERFIT_SUMMARY = "Look for leaked labels or classes that are too easy to tell apart."
LABEL_MESSAGES = {
    "provided": "The label column of the input was used.",
    "probabilistic_rules": "Labels come from the weighted risk rules with uniform noise added.",
    "logs": "Labels come from answer files or, without any, from the activity percentile.",
    "tabular": "Labels come from a column, answer files or the feature percentile.",
}
