"""Business rules as data: an id, its evidence and a Column predicate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    severity: str
    points: int  # hundredths of risk
    reason: str
    when: str | Column
    hard: bool = False

    def evidence(self) -> Column:
        predicate = F.expr(self.when) if isinstance(self.when, str) else self.when
        return F.when(predicate, F.struct(
            F.lit(self.rule_id).alias("rule_id"), F.lit(self.category).alias("category"),
            F.lit(self.severity).alias("severity"), F.lit(self.hard).alias("hard_block"),
            F.lit(self.points).alias("points"), F.lit(self.reason).alias("reason")))


DRAIN = "origin_balance > 0 and cast(amount as double) / (origin_balance + 1e-5D) > {share}D"

# The rule set in evaluation order (ids, weights, limits and sentences).
DEFAULT_RULES = [
    Rule("VEL_MICRO_SPIKE", "velocity", "MEDIUM", 25,
         "Rapid micro-velocity spike (>=4 transactions in 1 minute)", "tx_count_1m >= 4"),
    Rule("VEL_5M_BURST", "velocity", "MEDIUM", 20,
         "Rapid transaction burst within 5 minutes (>=6 transactions)", "tx_count_5m >= 6"),
    Rule("VEL_1H_SURGE", "velocity", "HIGH", 25,
         "High transaction velocity surge within 1 hour (>=15 transactions)", "tx_count_1h >= 15"),
    Rule("AMT_BALANCE_DEPLETION", "amount", "MEDIUM", 25,
         "Transaction drains over 95% of origin balance", DRAIN.format(share="0.95")),
    Rule("AMT_EXTREME_ZSCORE", "amount", "HIGH", 30,
         "Transaction amount exceeds 4 standard deviations from user baseline", "amount_zscore >= 4"),
    Rule("AMT_ZERO_BALANCE_HIGH_VALUE", "amount", "HIGH", 30,
         "High monetary amount requested on zero-balance account",
         "origin_balance = 0 and amount > 5000"),
    Rule("DEV_SUSPICIOUS_MULTI_USER", "location_device", "HIGH", 30,
         "Suspicious shared device linked to 5 or more distinct users in 24 hours",
         "device_user_count_24h >= 5"),
    Rule("LOC_DEV_ANOMALOUS_COMBINATION", "location_device", "HIGH", 25,
         "Simultaneous new device and distant new location (>500 km from home)",
         "is_new_device = 1 and is_new_location = 1 and distance_from_home_km > 500"),
    Rule("AUTH_MISSING_STEP_UP", "authentication", "MEDIUM", 30,
         "Second-factor biometric or OTP authentication missing", "auth_factor_verified = 0"),
    Rule("AUTH_HIGH_VALUE_UNVERIFIED", "authentication", "HIGH", 35,
         "High-value transaction attempted without 2FA / biometric authentication",
         "auth_factor_verified = 0 and amount > 2500"),
    Rule("CTX_HIGH_AMOUNT_NIGHT_TRANSFER", "transaction_context", "MEDIUM", 20,
         "High-value nighttime transfer or cash-out transaction",
         "is_night = 1 and upper(payment_type) in ('TRANSFER', 'CASH_OUT') and amount > 3000"),
    Rule("CTX_HIGH_DRAIN_UNVERIFIED", "transaction_context", "HIGH", 85,
         "CRITICAL: High-value account balance drain without authentication",
         DRAIN.format(share="0.90") + " and auth_factor_verified = 0 and tx_count_1m < 3"),
    Rule("BLOCK_IMPOSSIBLE_TRAVEL", "location_device", "CRITICAL", 100,
         "CRITICAL: Impossible travel velocity (>800 km/h)", "speed_kmh_from_prev_tx > 800", True),
    Rule("BLOCK_ZERO_BALANCE_HIGH_DRAIN_NO_AUTH", "amount", "CRITICAL", 100,
         "CRITICAL: Zero-balance account high-value drain without authentication",
         "origin_balance = 0 and amount > 10000 and auth_factor_verified = 0", True),
    Rule("BLOCK_UNVERIFIED_RAPID_DRAIN", "transaction_context", "CRITICAL", 100,
         "CRITICAL: High-value account balance drain without authentication under rapid velocity",
         DRAIN.format(share="0.90") + " and auth_factor_verified = 0 and tx_count_1m >= 3", True),
]


def with_rule(rules: list[Rule], rule: Rule) -> list[Rule]:
    """Replace the rule of the same id in place, or append a new one."""
    if any(r.rule_id == rule.rule_id for r in rules):
        return [rule if r.rule_id == rule.rule_id else r for r in rules]
    return [*rules, rule]


def match(df: DataFrame, rules: list[Rule] = DEFAULT_RULES) -> DataFrame:
    """Evidence of every matched rule, in rule order."""
    return df.withColumn("matched_rules", F.array_compact(F.array(*[r.evidence() for r in rules])))


def evaluate(df: DataFrame, rules: list[Rule] = DEFAULT_RULES) -> DataFrame:
    """Matched rules, risk in [0, 1], hard block, reasons and the rule-only decision."""
    out = match(df, rules)
    points = F.aggregate("matched_rules", F.lit(0), lambda acc, m: acc + m["points"])
    hard = F.exists("matched_rules", lambda m: m["hard_block"])
    total = F.when(F.col("hard_block"), F.greatest(F.col("_points"), F.lit(100))).otherwise(F.col("_points"))
    return (
        out.withColumns({"_points": points, "hard_block": hard})
        .withColumn("_points", total)
        .withColumns({
            "rules_signal": F.least(F.col("_points"), F.lit(100)) / F.lit(100.0),
            "rule_decision": F.when(F.col("hard_block") | (F.col("_points") >= 70), "BLOCK")
            .when(F.col("_points") >= 30, "REVIEW").otherwise("APPROVE"),
            "hard_block_rules": F.transform(
                F.filter("matched_rules", lambda m: m["hard_block"]), lambda m: m["rule_id"]),
            "rule_reasons": F.transform("matched_rules", lambda m: m["reason"]),
        })
        .drop("_points")
    )


def hits(df: DataFrame) -> DataFrame:
    """Rule hits per category and rule."""
    m = df.select(F.explode("matched_rules").alias("m"))
    return m.groupBy(F.col("m.category").alias("category"), F.col("m.rule_id").alias("rule_id")).agg(
        F.count(F.lit(1)).alias("hits"), F.sum("m.points").alias("points"))
