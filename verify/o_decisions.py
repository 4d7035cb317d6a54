"""DuckDB SQL for rules, signals, fusion and events."""

from verify.o_features import feature_ctes, rnd
from verify.sql_views import tx_cte, with_

SQL: dict[str, str] = {}
D = lambda x: f"cast({x} as double)"
RATIO = f"(cast(amount as double) / (origin_balance + {D('0.00001')}))"
# id, category, hard, points, reason, condition
RULES = [
    ("VEL_MICRO_SPIKE", "velocity", 0, 25, "Rapid micro-velocity spike (>=4 transactions in 1 minute)", "tx_count_1m >= 4"),
    ("VEL_5M_BURST", "velocity", 0, 20, "Rapid transaction burst within 5 minutes (>=6 transactions)", "tx_count_5m >= 6"),
    ("VEL_1H_SURGE", "velocity", 0, 25, "High transaction velocity surge within 1 hour (>=15 transactions)", "tx_count_1h >= 15"),
    ("AMT_BALANCE_DEPLETION", "amount", 0, 25, "Transaction drains over 95% of origin balance", f"origin_balance > 0 and {RATIO} > {D('0.95')}"),
    ("AMT_EXTREME_ZSCORE", "amount", 0, 30, "Transaction amount exceeds 4 standard deviations from user baseline", "amount_zscore >= 4"),
    ("AMT_ZERO_BALANCE_HIGH_VALUE", "amount", 0, 30, "High monetary amount requested on zero-balance account", "origin_balance = 0 and amount > 5000"),
    ("DEV_SUSPICIOUS_MULTI_USER", "location_device", 0, 30, "Suspicious shared device linked to 5 or more distinct users in 24 hours", "device_user_count_24h >= 5"),
    ("LOC_DEV_ANOMALOUS_COMBINATION", "location_device", 0, 25, "Simultaneous new device and distant new location (>500 km from home)", "is_new_device = 1 and is_new_location = 1 and distance_from_home_km > 500"),
    ("AUTH_MISSING_STEP_UP", "authentication", 0, 30, "Second-factor biometric or OTP authentication missing", "not auth_verified"),
    ("AUTH_HIGH_VALUE_UNVERIFIED", "authentication", 0, 35, "High-value transaction attempted without 2FA / biometric authentication", "not auth_verified and amount > 2500"),
    ("CTX_HIGH_AMOUNT_NIGHT_TRANSFER", "transaction_context", 0, 20, "High-value nighttime transfer or cash-out transaction", "is_night = 1 and payment_type in ('TRANSFER', 'CASH_OUT') and amount > 3000"),
    ("CTX_HIGH_DRAIN_UNVERIFIED", "transaction_context", 0, 85, "CRITICAL: High-value account balance drain without authentication", f"origin_balance > 0 and {RATIO} > {D('0.90')} and not auth_verified and tx_count_1m < 3"),
    ("BLOCK_IMPOSSIBLE_TRAVEL", "location_device", 1, 100, "CRITICAL: Impossible travel velocity (>800 km/h)", "speed_kmh_from_prev_tx > 800"),
    ("BLOCK_ZERO_BALANCE_HIGH_DRAIN_NO_AUTH", "amount", 1, 100, "CRITICAL: Zero-balance account high-value drain without authentication", "origin_balance = 0 and amount > 10000 and not auth_verified"),
    ("BLOCK_UNVERIFIED_RAPID_DRAIN", "transaction_context", 1, 100, "CRITICAL: High-value account balance drain without authentication under rapid velocity", f"origin_balance > 0 and {RATIO} > {D('0.90')} and not auth_verified and tx_count_1m >= 3"),
]


def pick(rules, index):
    return "concat_ws('{}', ".format("|" if index == 4 else ",") + ", ".join(
        f"case when {r[5]} then '{r[index]}' end" for r in rules) + ")"


FEAT = [tx_cte(squeeze=300), *feature_ctes()]
POINTS = " + ".join(f"case when {r[5]} then {r[3]} else 0 end" for r in RULES)
HARD = " or ".join(f"({r[5]})" for r in RULES if r[2])
RULED = f"""ruled as (
  select *, case when {HARD} then greatest({POINTS}, 100) else {POINTS} end as points, ({HARD}) as hard_block,
    {pick(RULES, 4)} as rule_reasons, {pick([r for r in RULES if r[2]], 0)} as hard_rules
  from feat)"""

for _n, _c in {"r_velocity": "velocity", "r_amount": "amount", "r_location_device": "location_device",
               "r_authentication": "authentication", "r_context": "transaction_context"}.items():
    _r = [r for r in RULES if r[1] == _c and not r[2]]
    SQL[_n] = with_(*FEAT) + f"select * from (select transaction_id, {pick(_r, 0)} as rules from feat) where rules <> ''"
_r = [r for r in RULES if r[2]]
SQL["r_hard_block"] = with_(*FEAT) + f"select * from (select transaction_id, {pick(_r, 0)} as rules from feat) where rules <> ''"
SQL["r_evaluate"] = with_(*FEAT, RULED) + """
select transaction_id, least(points, 100) / cast(100 as double) as rules_signal, hard_block,
  case when hard_block or points >= 70 then 'BLOCK' when points >= 30 then 'REVIEW' else 'APPROVE' end as rule_decision,
  hard_rules as hard_block_rules, rule_reasons as reasons from ruled"""


def hits_sql(rules):
    return with_(*FEAT) + " union all ".join(
        f"select '{r[1]}' as category, '{r[0]}' as rule_id, count(*) as hits, sum({r[3]}) as points from feat where {r[5]}"
        " having count(*) > 0" for r in rules)


SQL["r_by_category"] = hits_sql(RULES)
SQL["r_custom"] = hits_sql(
    [r if r[0] != "AUTH_MISSING_STEP_UP" else (r[0], r[1], 0, 10, "", "not auth_verified and amount > 100") for r in RULES]
    + [("CUSTOM_WIRE", "transaction_context", 0, 15, "", "payment_type = 'WIRE'")])

VEL = f"least(1.0, tx_count_5m / {D(5)} * {D('0.6')} + tx_count_1h / {D(15)} * {D('0.4')})"
BEH = (f"least(1.0, abs(amount_zscore) / {D(4)} * {D('0.5')} + is_new_device * {D('0.3')}"
       f" + is_new_location * {D('0.2')})")
SQL["s_velocity"] = with_(*FEAT) + f"select transaction_id, {rnd(VEL, 6)} as velocity_signal from feat"
SQL["s_behavioral"] = with_(*FEAT) + f"select transaction_id, {rnd(BEH, 6)} as behavioral_signal from feat"
RAW = f"""raw as (select transaction_id, case when k % 11 = 0 then 'nan'::double when k % 13 = 0 then null
  when k % 7 = 0 then {D('1.5')} when k % 5 = 0 then {D('-0.25')} else k / {D(100)} end as raw from tx)"""
for _n, _f in {"rules_signal": "0.0", "anomaly_signal": "0.25"}.items():
    SQL["s_" + _n.split("_")[0]] = with_(tx_cte(), RAW) + (
        f"select transaction_id, case when raw is null or isnan(raw) then {D(_f)} else least(1.0, greatest(0.0, raw)) end as {_n} from raw")
SQL["s_contract"] = with_(tx_cte(), RAW) + """
select transaction_id, concat_ws(',',
  case when raw is null or isnan(raw) or raw < 0 or raw > 1 then 'calibrated_probability' end,
  case when raw > 1 then 'behavioral_signal' end,
  case when raw is null or isnan(raw) or raw + 0.5 < 0 or raw + 0.5 > 1 then 'anomaly_signal' end) as violations,
  case when faults = '' then 'accepted' else 'rejected' end as route, faults, case when faults = '' then cast(0.25 as double) end as anomaly
from raw join (select transaction_id, concat_ws('|',
    case when k % 11 = 0 then 'calibrated_probability: not finite' when k % 7 = 0 or k % 5 = 0 then 'calibrated_probability: out of range'
      when k % 17 = 0 then 'calibrated_probability: boolean' when k % 19 = 0 then 'calibrated_probability: not numeric' end,
    case when k % 23 = 0 then 'behavioral_signal: not finite' end,
    case when k % 3 = 0 then 'anomaly_signal: missing' end) as faults from tx) using (transaction_id)"""

P4 = "least(9900, 200 + 5000 * is_fraud + k * 40 + cast(floor(least(v, 100) * 10) as int))"
SIG = f"""sig as (select *, {P4} / {D(10000)} as ml, {VEL} as vel, {BEH} as beh,
  least(points, 100) / {D(100)} as rul, (k % 10) / {D(10)} as ano from ruled)"""
W = (f"({D('0.45')} * ml + {D('0.15')} * vel + {D('0.15')} * beh + {D('0.15')} * rul + {D('0.10')} * ano)")
TRIG = [("ml", "ml", "0.40"), ("velocity", "vel", "0.30"), ("behavioral", "beh", "0.30"), ("rules", "rul", "0.40")]
NTRIG = " + ".join(f"case when {c} > {D(t)} then 1 else 0 end" for _, c, t in TRIG)
ATTR = [("tx_count_5m", f"greatest(0.0, {D('tx_count_5m')} * {D('0.1')})"), ("amount_zscore", f"greatest(0.0, amount_zscore * {D('0.1')})"),
        ("speed_kmh_from_prev_tx", f"greatest(0.0, speed_kmh_from_prev_tx * {D('0.1')})"),
        ("is_new_device", f"case when is_new_device = 1 then {D('0.25')} else {D(0)} end"),
        ("is_new_location", f"case when is_new_location = 1 then {D('0.25')} else {D(0)} end"),
        ("auth_factor_verified", f"case when auth_factor_verified = 0 then {D('0.35')} else {D(0)} end"),
        ("isolation_forest_score", f"greatest(0.0, isolation_forest_score * {D('0.1')})")]
TEXT = {
    "amount_zscore": "Transaction amount significantly exceeds user historical 30-day average",
    "tx_count_5m": "Elevated transaction velocity detected (multiple transactions within 5 minutes)",
    "is_new_device": "Transaction initiated from an unrecognized hardware device",
    "is_new_location": "Transaction originated from an unrecognized geographic location",
    "speed_kmh_from_prev_tx": "Impossible travel speed detected between consecutive transactions",
    "isolation_forest_score": "Unsupervised anomaly detector flagged abnormal multivariate pattern",
    "auth_factor_verified": "Second-factor biometric or OTP authentication missing"}
LIST = "[" + ", ".join(f"{{'neg': -({x}), 'i': {i}, 'msg': '{TEXT[f]}'}}" for i, (f, x) in enumerate(ATTR)) + "]"
TOPS = f"list_transform(list_filter(list_sort({LIST})[1:3], lambda a: -a.neg > 0.01), lambda a: a.msg)"
DEFAULT = "Standard behavioral consistency verified; low risk indicators."
SAID = f"case when len({TOPS}) = 0 then ['{DEFAULT}'] else {TOPS} end"
FUSED = f"""fused as (
  select *, {rnd(f'{W} * {D(100)}', 2)} as weighted_score, {NTRIG} as trigger_count,
    {rnd(f"least(1.0, {W} + case when {NTRIG} >= 2 then ({NTRIG}) * 12 / {D(100)} else 0.0 end) * {D(100)}", 1)} as raw_score,
    {SAID} as said from sig)"""
DECIDED = """decided as (
  select *, case when hard_block then greatest(raw_score, 85.0) else raw_score end as risk_score,
    case when hard_block or raw_score >= 70 then 'BLOCK' when raw_score >= 30 then 'REVIEW' else 'APPROVE' end as decision,
    case when hard_block or raw_score >= 70 then 'HIGH' when raw_score >= 30 then 'MEDIUM' else 'LOW' end as risk_level,
    case when ml < 0.1580 then 'APPROVE' when ml < 0.5516 then 'REVIEW' else 'BLOCK' end as ml_decision
  from fused)"""
ALL = with_(*FEAT, RULED, SIG, FUSED, DECIDED)
DECIDED_CTES = [*FEAT, RULED, SIG, FUSED, DECIDED]

_parts = {"ml": ("ml", "0.45"), "velocity": ("vel", "0.15"), "behavioral": ("beh", "0.15"), "rules": ("rul", "0.15"), "anomaly": ("ano", "0.10")}
_p = {s: rnd(f"{c} * {D(w)} * {D(100)}", 2) for s, (c, w) in _parts.items()}
SQL["fuse_weighted"] = with_(*DECIDED_CTES, "parts as (select *, " + ", ".join(f"{x} as part_{s}" for s, x in _p.items()) + " from decided)") + (
    "select transaction_id, weighted_score, " + ", ".join(f"part_{s}" for s in _p) + ", " + ", ".join(
        f"case when weighted_score > 0 then {rnd(f'part_{s} / weighted_score * {D(100)}', 2)} else 0.0 end as share_{s}" for s in _p) + " from parts")
SQL["fuse_escalate"] = ALL + "select transaction_id, concat_ws(',', " + ", ".join(
    f"case when {c} > {D(t)} then '{s}' end" for s, c, t in TRIG) + (
    f") as triggers, trigger_count, case when trigger_count >= 2 then trigger_count * 12 / {D(100)} else 0.0 end as escalation_boost from decided")
SQL["fuse_decide"] = ALL + "select transaction_id, risk_score, decision, risk_level from decided"
MERGED = "array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i)[1:3], '|')"
SQL["fuse_full_batch"] = with_(*DECIDED_CTES, """merged as (select *, list_concat(case when rule_reasons = '' then []
  else string_split(rule_reasons, '|') end, said) as u from decided)""") + f"""
select transaction_id, customer_id, risk_score, risk_level, decision, ml_decision, hard_block, trigger_count, weighted_score,
  {MERGED} as reasons from merged"""
SQL["ml_policy"] = with_(tx_cte()) + f"""
select transaction_id, p, case when p < 0.1580 then 'APPROVE' when p < 0.5516 then 'REVIEW' else 'BLOCK' end as ml_decision
from (select transaction_id, {P4} / {D(10000)} as p from tx)"""
SEC = "concat(cast((us + 50) // 100 // 10000 as varchar), '.', lpad(cast((us + 50) // 100 % 10000 as varchar), 4, '0'))"
SQL["decision_event"] = with_(*DECIDED_CTES, f"""hashed as (select *, {SEC} as sec, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8')
  || encode(concat(transaction_id, ':model-v1:', {SEC}))) as h from decided)""") + """
select concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', case h[17:17] when '0' then '8' when '4' then '8' when '8' then '8'
  when 'c' then '8' when '1' then '9' when '5' then '9' when '9' then '9' when 'd' then '9' when '2' then 'a' when '6' then 'a'
  when 'a' then 'a' when 'e' then 'a' else 'b' end, h[18:20], '-', h[21:32]) as event_id,
  transaction_id, cast(sec as double) as timestamp, decision, risk_score, 'model-v1' as model_version, '' as faults from hashed"""
SQL["reasons_topk"] = with_(*FEAT) + f"select transaction_id, array_to_string({SAID}, '|') as reasons from feat"
LEGACY = """leg as (
  select transaction_id, cast(event_id % 720 as int) as step, payment_type as type, cast(amount as double) as amount,
    origin_balance as bal, case when auth_verified then 1 else 0 end as auth, k % 4 = 0 as nodev, k % 6 = 0 as nogeo, k % 8 as hourly,
    k % 30 as daily, case when k % 9 <> 1 then k / cast(100 as double) end as recv, k % 3 = 0 as third from tx)"""
ON = lambda c, w: f"case when {c} then {D(w)} else {D(0)} end"
SQL["heuristic_risk_v0"] = with_(tx_cte(), LEGACY) + f"""
select transaction_id, {rnd(f'''least({D(1)}, case when bal > 0 then case when amount / (bal + {D('0.00001')}) > 1 then least({D('0.4')}, amount / (bal + {D('0.00001')}) * {D('0.1')}) else {D(0)} end
   else {ON('amount > 0', '0.3')} end + {ON("type in ('CASH_OUT', 'TRANSFER')", '0.2')} + {ON('auth = 0', '0.2')} + {ON('nodev', '0.1')} + {ON('nogeo', '0.1')}
   + {ON('hourly > 5', '0.1')} + {ON('daily > 20', '0.1')} + {ON('recv > 0.7', '0.1')})''', 6)} as score,
  case when not (auth = 0 or nodev or nogeo or coalesce(recv > 0.7, false) or hourly > 5 or daily > 20 or (bal = 0 and amount > 0))
  then 'No suspicious behavior detected' else concat_ws('|',
  case when auth = 0 then 'Auth not verified (OTP/biometric missing)' end, case when nodev then 'Unknown device for sender' end,
  case when nogeo then 'Unknown geo location for sender' end, case when recv > 0.7 then 'Receiver has high risk score' end,
  case when hourly > 5 then 'Sender exceeded hourly transaction count' end, case when daily > 20 then 'Sender exceeded daily transaction count' end,
  case when bal = 0 and amount > 0 then 'Large amount sent from zero balance account' end) end as explanations from leg"""
SQL["legacy_features_v0"] = with_(tx_cte(), LEGACY) + f"""
select transaction_id, step, type, amount, bal as "oldbalanceOrg", 0 as "newbalanceOrig", 0 as "oldbalanceDest", 0 as "newbalanceDest",
  {rnd(f"amount / (bal + {D('0.000001')})", 4)} as amount_balance_ratio, cast(nodev as int) as unusual_device, cast(nogeo as int) as unusual_location,
  hourly as sender_hourly_tx_count, daily as sender_daily_tx_count, coalesce(recv, 0) as receiver_risk_score,
  cast(third as int) as initiated_by_third, auth as auth_verified from leg"""
SQL["decision_mix"] = ALL + f"""
select kind, label, count(*) as n, {rnd(f'count(*) * {D(100)} / (select count(*) from decided)', 2)} as percent from (
  select 'decision' as kind, decision as label from decided union all select 'risk_level', risk_level from decided
  union all select 'hard_block', cast(hard_block as varchar) from decided
""" + "".join(f" union all select 'trigger', '{s}' from decided where {c} > {D(t)}" for s, c, t in TRIG) + ") group by 1, 2"
SQL["challenger_udf"] = with_(tx_cte(squeeze=300)) + f"""
select transaction_id, {rnd(f"1.0 / (1.0 + cast(amount as double) / (greatest(origin_balance, 0.0) + {D('0.00001')}))", 6)} as p, cast(null as varchar) as error from tx"""
