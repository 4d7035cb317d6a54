"""DuckDB SQL for as-of state, joins and the workflow."""

from verify.o_features import MONTH, rnd
from verify.o_sources import DEC, LIGHT
from verify.sql_views import CHALLENGER, SCORED, tx_cte, with_

SQL: dict[str, str] = {}
D = lambda x: f"cast({x} as double)"
PROBE = "probe as (select customer_id as pc, us + 1000000 as pt, event_id as probe_id from tx where event_id % 5 = 0)"
_c = lambda n: f"count(*) filter (us >= pt - {n}000000)"
_s = lambda n: f"coalesce(sum(cents) filter (us >= pt - {n}000000), 0) / {D(100)}"
SQL["state_velocity_asof"] = with_(tx_cte(squeeze=300), PROBE) + f"""
select probe_id, {_c(60)} as tx_count_1m, {_c(300)} as tx_count_5m, {_c(900)} as tx_count_15m, {_c(3600)} as tx_count_1h,
  {_s(300)} as amount_sum_5m, {_s(900)} as amount_sum_15m, {_s(3600)} as amount_sum_1h
from probe left join tx on customer_id = pc and us < pt and us >= pt - 3600000000 group by 1"""
_std = f"sqrt(greatest(cast(cast(n as hugeint) * s2 - cast(s as hugeint) * s as double) / cast(n * (n - 1) as double), 0.0)) / {D(100)}"
SQL["state_behavior_asof"] = with_(tx_cte(), PROBE, f"""agg as (select probe_id, count(us) as n, coalesce(sum(cents), 0) as s,
  sum(cast(cents as hugeint) * cents) as s2, max(us) as last_us from probe left join tx on customer_id = pc and us < pt and us >= pt - {MONTH} group by 1)""") + f"""
select probe_id, n, last_us, s / {D(100)} as total, case when n > 0 then (2 * s + n) // (2 * n) / {D(100)} else 0.0 end as mean,
  case when n < 2 then 0.0 else {rnd(_std, 2)} end as std from agg"""
SQL["state_last_location"] = with_(tx_cte()) + """
select customer_id, latitude, longitude, us from (select *, row_number() over (partition by customer_id order by us desc, transaction_id desc) as r
from tx where latitude <> 0 or longitude <> 0) where r = 1"""
EDGES = """edges as (select customer_id, device_id, min(us) as first_us, max(us) as last_us, count(*) as uses from tx
  where device_id <> 'unknown_device' group by 1, 2)"""
SQL["state_customer_devices"] = with_(tx_cte(), EDGES) + "select * from edges"
SQL["state_device_customers"] = with_(tx_cte(), EDGES) + """
select *, row_number() over (partition by device_id order by customer_id) as place from edges"""
LASTP = "lastp as (select customer_id as pc, max(us) as probe_us from tx group by 1)"
SQL["state_recent_history"] = with_(tx_cte(), LASTP) + """
select customer_id, probe_us, us, transaction_id, cast(amount as double) as amount from lastp join tx on customer_id = pc
  and us < probe_us and us >= probe_us - 7 * 86400000000"""
SQL["j_interval_history"] = with_(tx_cte(squeeze=300), LASTP) + """
select customer_id, probe_us, count(*) as n, sum(cents) as cents from lastp join tx on customer_id = pc
  and us <= probe_us and us >= probe_us - 3600000000 group by 1, 2"""
SQL["j_ledger_decision"] = with_(*LIGHT) + """
select transaction_id, cast(amount as double) as amount, coalesce(d.decision, 'APPROVE') as decision, coalesce(d.risk_score, 0.0) as risk_score
from tx left join (select * from dec where event_id % 7 <> 0) d using (transaction_id)"""
SQL["j_label_attach"] = with_(*LIGHT, """lab as (select transaction_id, us + 14 * 86400000000 as reported_us, is_fraud as fraud_label from tx
  where event_id % 3 = 0 union all select concat('lost_', event_id), us + 14 * 86400000000, 1 from tx where event_id % 97 = 5)""") + """
select coalesce(d.transaction_id, l.transaction_id) as transaction_id,
  case when d.transaction_id is not null then d.customer_id else coalesce(t.customer_id, 'unknown') end as customer_id,
  coalesce(d.decision, 'APPROVE') as decision, coalesce(d.risk_score, 15.0) as risk_score,
  case when d.transaction_id is not null then 'MEDIUM' else 'LOW' end as risk_level,
  case when d.transaction_id is not null then 'FINAL' else 'CONFIRMED_FRAUD' end as workflow_status,
  coalesce(d.created_us, t.us, l.reported_us) as created_us, l.fraud_label, l.reported_us as label_us
from (select * from dec where event_id % 2 = 0) d full join lab l on d.transaction_id = l.transaction_id
left join tx t on t.transaction_id = coalesce(d.transaction_id, l.transaction_id)"""
SEC = """sec as (select customer_id, us, device_id, event_id as source_id, k, case when k % 17 = 0 then 'mfa_reset'
  when k % 19 = 0 then 'credential_stuffing_attempt' when category = 'click' then 'device_change' when category = 'view' then 'profile_update'
  when category = 'error' then 'login_anomaly' when category = 'signup' then 'new_device_registration' else 'password_change' end as event_type,
  concat('10.0.', k % 7, '.', k) as ip_address from tx)"""
TYPES = {"mfa_reset": 50, "password_change": 40, "new_device_registration": 35, "login_anomaly": 30, "profile_update": 25,
         "device_change": 20, "credential_stuffing_attempt": 60}
STATE = "state as (select t.transaction_id, any_value(t.amount) as amount, count(s.us) as events_24h, " + ", ".join(
    f"count(*) filter (s.event_type = '{k}') as n_{k}" for k in TYPES) + """
  from tx t left join sec s on s.customer_id = t.customer_id and s.us <= t.us and s.us >= t.us - 86400000000 group by 1)"""
PAIRS = """pairs as (select t.transaction_id as ptx, count(*) as followed from tx t join sec p on p.customer_id = t.customer_id
  and p.us <= t.us and p.us >= t.us - 86400000000 and p.event_type = 'password_change'
  where exists (select 1 from sec d where d.customer_id = t.customer_id and d.event_type in ('new_device_registration', 'device_change')
    and d.us between p.us and p.us + 3600000000 and d.us <= t.us) group by 1)"""
SQL["j_asof_security_state"] = with_(tx_cte(), SEC, STATE) + "select transaction_id, " + ", ".join(f"n_{k}" for k in TYPES) + " from state"
_base = "greatest(" + ", ".join(f"case when n_{k} > 0 then {v} else 0 end" for k, v in TYPES.items()) + ")"
ATO = f"""ato as (select *, least(100, {_base} + case when events_24h >= 3 then 25 else 0 end + coalesce(followed, 0) * 35
  + case when n_mfa_reset > 0 and n_profile_update > 0 then 30 else 0 end + case when n_credential_stuffing_attempt > 0 then 40 else 0 end) as pts
  from state left join pairs on ptx = transaction_id)"""
ATO2 = """ato2 as (select *, pts / cast(100 as double) as ato_score, case when pts >= 80 then 'SUSPEND_ACCOUNT' when pts >= 50 then 'TRIGGER_HOLD'
  when pts >= 25 then 'CHALLENGE_MFA' else 'ALLOW' end as ato_action, case when pts >= 80 then 'CRITICAL' when pts >= 50 then 'HIGH'
  when pts >= 25 then 'MEDIUM' else 'LOW' end as ato_level, pts >= 50 as requires_hold from ato)"""
ATOS = [SEC, STATE, PAIRS, ATO, ATO2]
SQL["ato_event_id"] = with_(tx_cte(), SEC) + """
select concat('ato_evt_', substr(sha256(concat_ws(':', customer_id, event_type, us, ip_address, device_id)), 1, 16)) as event_id,
  customer_id, event_type, us from sec"""
SQL["ato_score"] = with_(tx_cte(), *ATOS) + "select transaction_id, events_24h, coalesce(followed, 0) as password_then_device, ato_score from ato2"
SQL["ato_action"] = with_(tx_cte(), *ATOS) + """
select transaction_id, ato_action, ato_level, requires_hold, concat_ws('|',
  case when events_24h >= 3 then concat('Rapid security event cluster (', events_24h, ' events in 24h)') end,
  case when followed > 0 then rtrim(repeat('Password reset immediately followed by new device registration (<1h)|', cast(followed as bigint)), '|') end,
  case when n_mfa_reset > 0 and n_profile_update > 0 then 'MFA reset accompanied by contact profile modification' end,
  case when n_credential_stuffing_attempt > 0 then 'Prior credential stuffing / automated brute force detected' end) as indicators from ato2"""
_g = """case when ato_action = 'SUSPEND_ACCOUNT' then concat('Account suspended due to critical ATO risk (', pts // 100, '.', lpad(cast(pts % 100 as varchar), 2, '0'), ')')
  when requires_hold and amount > 500 then concat('Transaction held: High ATO risk score (', pts // 100, '.', lpad(cast(pts % 100 as varchar), 2, '0'), ') on amount $', amount) end"""
SQL["ato_guardrail"] = with_(tx_cte(), *ATOS) + f"select transaction_id, {_g} is null as allowed, {_g} as guardrail_reason from ato2"
SH = """sh as (select a.transaction_id, a.p4 / cast(100 as double) as production_score, case when a.p4 >= 7000 then 'BLOCK' when a.p4 >= 3000 then 'REVIEW' else 'APPROVE' end as production_decision,
  b.p4 / cast(100 as double) as challenger_score, case when b.p4 >= 7000 then 'BLOCK' when b.p4 >= 3000 then 'REVIEW' else 'APPROVE' end as challenger_decision,
  b.p4 - a.p4 as d4 from scored a join challenger b using (transaction_id))"""
SQL["j_shadow_compare"] = with_(tx_cte(), SCORED, CHALLENGER, SH) + """
select transaction_id, production_score, production_decision, challenger_score, challenger_decision,
  production_decision <> challenger_decision as divergent, d4 / cast(100 as double) as score_delta from sh"""
SQL["shadow_divergence"] = with_(tx_cte(), SCORED, CHALLENGER, SH) + f"""
select count(*) as total_evaluated, count(*) filter (production_decision <> challenger_decision) as divergent_decisions,
  {rnd(f"count(*) filter (production_decision <> challenger_decision) / {D('count(*)')}", 4)} as divergence_rate,
  {rnd(f"sum(abs(d4)) / {D('count(*)')} / {D(100)}", 2)} as mean_absolute_score_delta from sh"""
HOLD = "hold as (select concat('hold_', event_id) as hold_id, transaction_id, customer_id, amount, us as created_us, k, event_id from tx where event_id % 20 = 0)"
ACT = """act1 as (select hold_id, 1 as seq, case when k % 2 = 0 then 'CONFIRM' else 'DENY' end as action, k % 13 <> 0 as token_ok,
  created_us + k * 7 * 1000000::bigint as us, k from hold),
act as (select hold_id, seq, action, token_ok, us from act1 union all select hold_id, 2, case when action = 'CONFIRM' then 'DENY' else 'CONFIRM' end, true,
  us + 60000000, from act1 where k % 5 = 0)"""
SQL["j_hold_actions"] = with_(tx_cte(), HOLD, ACT) + """
select hold_id, transaction_id, seq, action, (us - created_us) // 1000000 as after_s, us <= created_us + 300000000 as in_window from act join hold using (hold_id)"""
SQL["j_anti_replay"] = """select event_id, 2 as copies, 1 as duplicates, case event_id % 50 when 0 then 'failed' when 1 then 'dlq' when 2 then 'pending'
  when 3 then 'missing' else 'processed' end as first_status from events where value > 0 and event_id % 40 = 0"""
SQL["j_lookup_points"] = with_(tx_cte(), HOLD) + """
select * from (select 'customer' as kind, transaction_id, us as at from tx where customer_id = 'c8' order by us desc, transaction_id limit 20)
union all select * from (select 'hold', transaction_id, created_us from hold order by created_us desc, transaction_id limit 50)
union all select 'id', transaction_id, us from tx where transaction_id = 'tx_10'"""
EFF = """eff as (select a.*, h.created_us, h.transaction_id, a.us > h.created_us + 300000000 as late from act a join hold h using (hold_id)),
win as (select * from (select *, case when late then 'EXPIRED' when action = 'CONFIRM' then 'RELEASED' else 'DENIED' end as status,
  row_number() over (partition by hold_id order by us, seq) as r from eff where late or token_ok) where r = 1)"""
SQL["hold_resolve"] = with_(tx_cte(), HOLD, ACT, EFF) + """
select h.hold_id, h.transaction_id, coalesce(w.status, 'HOLD') as status, w.us as resolved_us from hold h left join win w using (hold_id)"""
SQL["hold_action_verdicts"] = with_(tx_cte(), HOLD, ACT, EFF) + """
select e.hold_id, e.seq, e.action, e.us, case when w.hold_id is null or (e.us, e.seq) < (w.us, w.seq) then 'INVALID_TOKEN'
  when e.seq = w.seq then case when w.status = 'EXPIRED' then 'ERROR_EXPIRED' else 'APPLIED' end
  when w.status = case when e.action = 'CONFIRM' then 'RELEASED' else 'DENIED' end then 'IDEMPOTENT' else 'ERROR_TERMINAL' end as verdict
from eff e left join win w using (hold_id)"""
SQL["hold_expire_sweep"] = with_(tx_cte(), HOLD, ACT, """eff as (select a.*, h.created_us, a.us > h.created_us + 300000000 as late from act a join hold h using (hold_id)
  where a.us <= 1705500000000000)""") + """
select hold_id, 'EXPIRED' as status, 1705500000000000 as resolved_us, 'Review window timeout exceeded' as resolution_reason from hold
where created_us + 300000000 < 1705500000000000 and hold_id not in (select hold_id from eff where late or token_ok)"""
SQL["hold_notifications"] = with_(tx_cte(), HOLD) + """
select concat_ws('_', 'notif', customer_id, created_us // 1000) as notification_id, customer_id, 'PUSH' as channel,
  concat('Was this you? Transaction #', transaction_id, ' for $', amount, ' is pending your approval.') as message,
  concat('https://security.example/hold/', hold_id) as action_url from hold"""
_KEY = b"fixture-secret".ljust(64, b"\0")
INNER, OUTER = (bytes(b ^ pad for b in _KEY).hex() for pad in (0x36, 0x5C))
SQL["hold_create"] = with_(tx_cte(), HOLD) + f"""
select hold_id, transaction_id, customer_id, created_us, created_us + 300000000 as expires_us, 'HOLD' as status,
  sha256(substr(sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode(concat(hold_id, ':', transaction_id))))), 1, 32)) as token_hash from hold"""
MAN = """man as (select concat('man', c_custkey) as mandate_id, cast(500 + c_custkey % 1500 as decimal(18,2)) as max_amount,
  case c_custkey % 4 when 0 then 'DAILY' when 1 then 'WEEKLY' when 2 then 'MONTHLY' else 'ONCE' end as frequency,
  case c_custkey % 4 when 0 then 82080000000 when 1 then 574560000000 when 2 then 2462400000000 else 0 end as gap,
  case when c_custkey % 11 = 3 then 'PAUSED' else 'ACTIVE' end as status,
  694224000000000 + (365 + c_custkey % 5 * 400) * 86400000000 as expires_us from customer)"""
ATT = """att as (select concat('man', o_custkey) as mandate_id, o_orderkey as attempt_id, epoch_us(o_orderdate) as us,
  cast(cast(o_totalprice as decimal(18,2)) / 100 as decimal(18,2)) as amount from orders)"""
SQL["mandate_execute"] = f"""with recursive {MAN}, {ATT},
num as (select *, row_number() over (partition by mandate_id order by us, attempt_id) as r from att join man using (mandate_id)),
fold as (
  select mandate_id, attempt_id, us, r, v.reason, case when v.reason is null then us end as last
  from (select *, {{'reason': case when us > expires_us then 'EXPIRED' when status <> 'ACTIVE' then 'NOT_ACTIVE' when amount > max_amount then 'OVER_CEILING' end}} as v
    from num where r = 1)
  union all
  select mandate_id, attempt_id, us, r, reason, case when reason is null then us else prev end from (
    select n.mandate_id, n.attempt_id, n.us, n.r, f.last as prev, case when n.us > n.expires_us then 'EXPIRED'
      when n.status <> 'ACTIVE' or (n.frequency = 'ONCE' and f.last is not null) then 'NOT_ACTIVE'
      when n.amount > n.max_amount then 'OVER_CEILING' when f.last is not null and n.us - f.last < n.gap then 'TOO_EARLY' end as reason
    from num n join fold f on n.mandate_id = f.mandate_id and n.r = f.r + 1))
select mandate_id, attempt_id, us, reason is null as accepted, reason as reject_reason from fold"""
SQL["mandate_lifecycle"] = """with recursive cmd as (select concat('man', o_custkey) as mandate_id, o_orderkey as seq,
  case o_orderkey % 13 when 0 then 'cancel' when 1 then 'limit' when 2 then 'limit' when 3 then 'pause' when 4 then 'pause' when 5 then 'pause' else 'activate' end as command,
  o_orderkey % 5 <> 0 as good, row_number() over (partition by o_custkey order by o_orderkey) as r from orders),
fold as (
  select mandate_id, seq, command, r, 'PENDING' as b, command in ('activate', 'cancel') or (command = 'limit' and good) as ok,
    case command when 'activate' then 'ACTIVE' when 'cancel' then 'CANCELLED' else 'PENDING' end as a from cmd where r = 1
  union all
  select c.mandate_id, c.seq, c.command, c.r, f.a, case c.command when 'activate' then f.a in ('PENDING', 'PAUSED') when 'pause' then f.a = 'ACTIVE'
      when 'cancel' then true else f.a in ('PENDING', 'ACTIVE') and c.good end,
    case when c.command = 'activate' and f.a in ('PENDING', 'PAUSED') then 'ACTIVE' when c.command = 'pause' and f.a = 'ACTIVE' then 'PAUSED'
      when c.command = 'cancel' then 'CANCELLED' else f.a end
  from cmd c join fold f on c.mandate_id = f.mandate_id and c.r = f.r + 1)
select mandate_id, seq, command, b as status_before, ok as accepted, a as status_after from fold"""
AUTH = """auth as (select tx.*, dec.decision, dec.risk_score, ato2.ato_action, ato2.requires_hold,
  case when tx.amount <= 0 then 1 when origin_balance < cast(tx.amount as double) then 2 when ato_action = 'SUSPEND_ACCOUNT' then 3
    when dec.decision = 'BLOCK' then 4 when requires_hold or dec.decision = 'REVIEW' or (dec.risk_score >= 30 and dec.risk_score < 70) then 5 else 6 end as layer
  from tx join dec using (transaction_id) join ato2 using (transaction_id))"""
AUTHS = [tx_cte(), SCORED, DEC, *ATOS, AUTH]
FINAL = "case when layer <= 2 then 'REJECTED' when layer <= 4 then 'BLOCK' when layer = 5 then 'HOLD' else 'APPROVE' end"
SQL["auth_final"] = with_(*AUTHS) + f"""
select transaction_id, {FINAL} as final_decision, case layer when 1 then 'DECLINED' when 2 then 'INSUFFICIENT_FUNDS' when 3 then 'DECLINED'
  when 4 then 'DECLINED' when 5 then 'HELD' else 'APPROVED' end as gateway_status, case when layer <= 2 then 'REJECTED' when layer = 3 then 'DECLINED_ATO_SUSPENDED'
  when layer = 4 then 'DECLINED_BLOCK' when layer = 5 then 'HELD_PENDING_VERIFICATION' else 'APPROVED' end as workflow_status, layer = 6 as money_moves from auth"""
SQL["settle_balances"] = with_(*AUTHS) + """
select account, cast(sum(delta) as double) as net, count(*) as legs from (select customer_id as account, -amount as delta from auth where layer = 6
  union all select merchant_id, amount from auth where layer = 6) group by 1"""
SQL["case_from_report"] = with_(*LIGHT) + """
select concat('CASE-', substr(sha256(t.transaction_id), 1, 12)) as case_id, t.transaction_id, t.customer_id, coalesce(d.decision, 'APPROVE') as gateway_decision,
  atk as attack_type, 'FRAUD' as confirmed_label, 'CONFIRMED_FRAUD' as status, t.us + 3600000000 as created_us, concat('alt_case_', t.transaction_id) as alert_id,
  'CRITICAL' as severity, concat('Customer confirmed unauthorized transfer. Case CASE-', substr(sha256(t.transaction_id), 1, 12), ' recorded. Attack type: ', atk) as alert_reason,
  1 as fraud_label from (select *, case when k % 2 = 0 then 'PHISHING' else 'UNKNOWN' end as atk from tx where is_fraud = 1 and event_id % 2 = 0) t
left join (select * from dec where event_id % 3 <> 0) d on d.transaction_id = t.transaction_id"""
SQL["event_timeline"] = with_(*AUTHS) + f"""
select customer_id, us, 0 as stage, cast(source_id as varchar) as ref, concat('Security Alarm: ', case event_type when 'mfa_reset' then 'Mfa Reset'
  when 'password_change' then 'Password Change' when 'new_device_registration' then 'New Device Registration' when 'login_anomaly' then 'Login Anomaly'
  when 'profile_update' then 'Profile Update' when 'device_change' then 'Device Change' else 'Credential Stuffing Attempt' end) as event, 'DETECTED' as status,
  case when event_type in ('password_change', 'login_anomaly') then 'CRITICAL' else 'HIGH' end as severity from sec
union all select customer_id, us, 1, transaction_id, 'Transfer Initiated', 'INGRESS', 'INFO' from auth
union all select customer_id, us, 2, transaction_id, 'Gateway Pre-Flight', 'AUTHORIZING', 'INFO' from auth
union all select customer_id, us, 3, transaction_id, 'Layered Evaluation', 'EVALUATED', case when ato_action = 'SUSPEND_ACCOUNT' then 'CRITICAL'
  when {FINAL} = 'BLOCK' then 'HIGH' else 'MEDIUM' end from auth
union all select customer_id, us, 4, transaction_id, concat('Authorization Verdict: ', {FINAL}), {FINAL}, case {FINAL} when 'BLOCK' then 'CRITICAL' when 'HOLD' then 'HIGH' else 'LOW' end from auth
union all select customer_id, us, 5, transaction_id, case when layer = 6 then 'Money Transferred' else 'Money Protected' end,
  case when layer = 6 then 'TRANSFERRED' else 'PROTECTED' end, case when layer = 6 then 'INFO' else 'LOW' end from auth"""
SQL["hold_outcome_apply"] = with_(tx_cte(), SCORED, DEC, HOLD, ACT, EFF) + """
select d.transaction_id, case w.status when 'RELEASED' then 'APPROVE' when 'DENIED' then 'BLOCK' else d.decision end as decision,
  case w.status when 'RELEASED' then 'RELEASED_AND_EXECUTED' when 'DENIED' then 'DENIED_AND_BLOCKED' when 'EXPIRED' then 'EXPIRED'
    else case when d.event_id % 20 = 0 then 'HOLD' else 'FINAL' end end as workflow_status,
  coalesce(w.status = 'RELEASED', false) as money_moves, case when w.status = 'DENIED' then 'CRITICAL' end as alert_severity
from dec d left join win w on w.transaction_id = d.transaction_id"""
SQL["alerts_build"] = with_(*LIGHT) + """
select concat('alt_', substr(sha256(transaction_id), 1, 16)) as alert_id, transaction_id, customer_id, case when hard_block then 'CRITICAL' else 'HIGH' end as severity,
  'BLOCK' as decision, 'OPEN' as status, created_us from dec where decision = 'BLOCK' or hard_block"""
