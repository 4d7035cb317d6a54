"""Fixed values. They define the results, so they are stated once, here."""

# The 32 features, in model order.
FEATURES = [
    "amount", "log_amount", "payment_type_enc", "merchant_category_enc",
    "amount_to_balance_ratio",
    "hour_of_day", "day_of_week", "is_weekend", "is_night", "cyclic_hour_sin", "cyclic_hour_cos",
    "tx_count_1m", "tx_count_5m", "tx_count_15m", "tx_count_1h",
    "amount_sum_5m", "amount_sum_15m", "amount_sum_1h",
    "user_avg_amount_30d", "user_std_amount_30d", "amount_zscore", "user_category_frequency",
    "user_hourly_tx_deviation",
    "distance_from_home_km", "distance_from_prev_loc_km", "speed_kmh_from_prev_tx",
    "is_new_device", "is_new_location", "device_user_count_24h",
    "auth_factor_verified", "deterministic_rule_count", "isolation_forest_score",
]

# Ordinal code of each payment rail; anything else is 6.
PAYMENT_CODES = {"TRANSFER": 0, "CASH_OUT": 1, "PAYMENT": 2, "DEBIT": 3, "CASH_IN": 4, "CREDIT_CARD": 5}
OTHER_PAYMENT_CODE = 6

# Decision weights, bands and escalation.
WEIGHTS = {"ml": 0.45, "velocity": 0.15, "behavioral": 0.15, "rules": 0.15, "anomaly": 0.10}
REVIEW_SCORE, BLOCK_SCORE, HARD_BLOCK_SCORE = 30.0, 70.0, 85.0
ML_REVIEW, ML_BLOCK = 0.1580, 0.5516
TRIGGERS = {"ml": 0.40, "velocity": 0.30, "behavioral": 0.30, "rules": 0.40}
BOOST_PER_TRIGGER, MIN_TRIGGERS = 0.12, 2

# Candidate weight sets (ml, velocity, behavioral, rules, anomaly).
WEIGHT_SETS = {
    "Baseline": (0.45, 0.15, 0.15, 0.15, 0.10),
    "ML-heavy": (0.55, 0.125, 0.125, 0.125, 0.075),
    "ML-dominant": (0.60, 0.10, 0.10, 0.10, 0.10),
    "Behavior-heavy": (0.40, 0.15, 0.20, 0.15, 0.10),
    "Rule-heavy": (0.40, 0.15, 0.15, 0.20, 0.10),
    "Anomaly-heavy": (0.40, 0.15, 0.15, 0.15, 0.15),
    "Balanced": (0.20, 0.20, 0.20, 0.20, 0.20),
}

# Security event severities; unknown types count 0.1.
EVENT_SEVERITY = {
    "mfa_reset": 0.50, "password_change": 0.40, "new_device_registration": 0.35,
    "login_anomaly": 0.30, "profile_update": 0.25, "device_change": 0.20,
    "credential_stuffing_attempt": 0.60,
}

# Seconds between executions of a recurring mandate.
MANDATE_INTERVAL_S = {"DAILY": 86400, "WEEKLY": 7 * 86400, "MONTHLY": 30 * 86400, "ONCE": 0}

# Attribution sentences.
REASON_TEXT = {
    "amount_zscore": "Transaction amount significantly exceeds user historical 30-day average",
    "tx_count_1m": "High transaction velocity detected within 1 minute",
    "tx_count_5m": "Elevated transaction velocity detected (multiple transactions within 5 minutes)",
    "tx_count_15m": "High transaction volume spike over 15-minute window",
    "amount_sum_1h": "Cumulative 1-hour spending exceeds safe threshold",
    "is_new_device": "Transaction initiated from an unrecognized hardware device",
    "is_new_location": "Transaction originated from an unrecognized geographic location",
    "speed_kmh_from_prev_tx": "Impossible travel speed detected between consecutive transactions",
    "amount_to_balance_ratio": "Transaction amount drains over 90% of available origin balance",
    "isolation_forest_score": "Unsupervised anomaly detector flagged abnormal multivariate pattern",
    "auth_factor_verified": "Second-factor biometric or OTP authentication missing",
    "is_night": "Unusual late-night transaction execution",
}
DEFAULT_REASON = "Standard behavioral consistency verified; low risk indicators."

# Key fragments whose values are masked.
SENSITIVE_KEYS = [
    "password", "passwd", "secret", "token", "api_key", "authorization", "auth_token",
    "access_token", "card_number", "pan", "cvv", "cvc", "pin", "ssn", "credit_card",
]

# Accepted telemetry labels and histogram bounds (milliseconds).
COMPONENTS = ["kafka", "redis", "feature_engine", "model", "risk_engine", "rule_engine",
              "serialization", "publisher", "api"]
ERROR_TYPES = ["connection_error", "timeout", "validation_error", "schema_error", "internal_error",
               "not_found", "runtime_error", "circuit_open", "deserialization_error"]
LATENCY_BUCKETS = [0.25, 0.5, 1.0, 2.5, 5.0, 7.5, 10.0, 15.0, 20.0, 25.0, 50.0, 100.0, 250.0,
                   500.0, 1000.0]
STAGE_BUCKETS = [0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0]
END_TO_END = "e2e"

# Sentinels.
UNKNOWN_DEVICE = "unknown_device"

SECOND = 1_000_000
DAY = 86_400 * SECOND
