"""DuckDB SQL for splits, metrics, thresholds, drift, accounting and telemetry."""

from verify.o_features import FEATURE_LIST, feature_ctes, rnd
from verify.o_sources import LIGHT
from verify.sql_views import CHALLENGER, SCORED, tx_cte, with_

SQL: dict[str, str] = {}
D = lambda x: f"cast({x} as double)"


def split_cte(src="tx", name="split_tx"):
    return f"""{name} as (select *, case when r <= floor(n * {D('0.7')}) then 'train' when r <= floor(n * {D('0.85')} + {D('0.000000001')}) then 'val' else 'test' end as split
  from (select *, row_number() over (order by us, transaction_id) as r, count(*) over () as n from {src}))"""


SQL["split_temporal"] = with_(tx_cte(squeeze=300), split_cte()) + "select transaction_id, split from split_tx"
SQL["split_summary"] = with_(tx_cte(), split_cte()) + """
select split, rows, fraud, first_us, last_us, 0 as bad_numbers, coalesce(first_us >= lag(last_us) over (order by case split when 'train' then 0 when 'val' then 1 else 2 end), true) as in_order
from (select split, count(*) as rows, sum(is_fraud) as fraud, min(us) as first_us, max(us) as last_us from split_tx group by 1)"""
SQL["split_stratified"] = with_(tx_cte()) + """
select transaction_id, case when r <= floor(n * cast(0.2 as double)) then 'test' else 'train' end as split, tc - 1 as type_code from (
  select transaction_id, row_number() over (partition by is_fraud order by md5(concat('42:', transaction_id)), transaction_id) as r,
    count(*) over (partition by is_fraud) as n, dense_rank() over (order by payment_type) as tc from tx)"""
_by_split = feature_ctes(source="split_tx", key="customer_id", train="train_tx")
_by_split[0] = _by_split[0].replace("customer_id as ck", "concat(split, '~', customer_id) as ck")
SQL["features_32_by_split"] = with_(tx_cte(), split_cte().replace("as n from", "as n_all from").replace("floor(n *", "floor(n_all *"),
                                    "train_tx as (select * from split_tx where split = 'train')", *_by_split) + (
    f"select transaction_id, split, cast(amount as double) as amount, {FEATURE_LIST} from feat")
PLAIN = with_(tx_cte(), *feature_ctes())
SQL["f_vector_32"] = PLAIN + """select transaction_id, 32 as dimension, payment_type_enc as x2, merchant_category_enc as x3, hour_of_day as x5, day_of_week as x6,
  is_weekend as x7, is_night as x8, tx_count_1m as x11, is_new_device as x26, device_user_count_24h as x28, auth_factor_verified as x29 from feat"""
SQL["f_vector_validate"] = with_(tx_cte()) + """
select transaction_id, concat_ws(',', case when k % 13 = 0 or k % 17 = 0 then 'log_amount' end, case when k % 11 = 0 then 'amount_zscore' end) as bad_features from tx"""
_audit = {"customer_id": "customer_id", "category": "category", "payment_type": "payment_type", "is_fraud": "is_fraud", "maybe": "case when k % 9 <> 0 then k end", "small": "k % 3"}
SQL["audit_profile"] = with_(tx_cte(), "a as (select " + ", ".join(f"{e} as {n}" for n, e in _audit.items()) + " from tx)") + """
select 'rows' as metric, 'all' as item, cast(count(*) as double) as value from a union all select 'columns', 'all', 6.0
""" + "".join(f"""union all select 'nulls', '{n}', cast(count(*) - count({n}) as double) from a
union all select 'null_percent', '{n}', {rnd(f"(count(*) - count({n})) * {D(100)} / count(*)", 2)} from a
""" for n in _audit) + """union all select 'duplicate_rows', 'all', cast(sum(c - 1) as double) from (select count(*) as c from a group by all)
union all select 'type_count', payment_type, cast(count(*) as double) from a group by 2
union all select 'class_count', cast(is_fraud as varchar), cast(count(*) as double) from a group by 2"""
SQL["audit_profile"] = SQL["audit_profile"].replace("select count(*) as c from a group by all", "select count(*) as c from a group by customer_id, category, payment_type, is_fraud, maybe, small")
_sets = {"Baseline": (.45, .15, .15, .15, .10), "ML-heavy": (.55, .125, .125, .125, .075), "ML-dominant": (.60, .10, .10, .10, .10),
         "Behavior-heavy": (.40, .15, .20, .15, .10), "Rule-heavy": (.40, .15, .15, .20, .10), "Anomaly-heavy": (.40, .15, .15, .15, .15), "Balanced": (.2, .2, .2, .2, .2)}
_base = dict(zip(("ml", "velocity", "behavioral", "rules", "anomaly"), _sets["Baseline"]))
for _g in _base:
    _rest = sum(v for k, v in _base.items() if k != _g)
    _sets[f"Ablate {_g}"] = tuple(0.0 if k == _g else v / _rest for k, v in _base.items())
_score = lambda w: rnd("(" + " + ".join(f"cast('{x!r}' as double) * {c}" for x, c in zip(w, ("p", "sv", "sb", "sr", "sa"))) + f") * {D(100)}", 2)
SQL["weights_grid"] = with_(tx_cte(), SCORED, f"""sig as (select label, p, k % 7 / {D(7)} as sv, k % 5 / {D(5)} as sb, k % 9 / {D(9)} as sr, k % 10 / {D(10)} as sa,
  k % 33 = 0 as hb from scored join (select transaction_id, k from tx) using (transaction_id))""",
    "cfg as (" + " union all ".join(f"select '{n}' as config, label, hb, {_score(w)} as s0 from sig" for n, w in _sets.items()) + ")",
    f"""agg as (select config, count(*) as n, min(s) as min_score, max(s) as max_score, {rnd(f"sum(cast(round(s * 100) as bigint)) / {D('count(*)')} / {D(100)}", 3)} as mean_score,
  count(*) filter (not b and s < 30) as approve, count(*) filter (not b and s >= 30) as review, count(*) filter (b) as block,
  count(*) filter (b and label = 1) as tp, count(*) filter (b and label = 0) as fp, count(*) filter (not b and label = 1) as fn
  from (select *, hb or s >= 70 as b from (select *, case when hb then greatest(s0, 85.0) else s0 end as s from cfg)) group by 1)""",
    f"""q as (select *, {rnd("case when tp + fp > 0 then tp / cast(tp + fp as double) else 0.0 end", 4)} as precision,
  {rnd("case when tp + fn > 0 then tp / cast(tp + fn as double) else 0.0 end", 4)} as recall from agg)""") + """
select q.*, q.block - b.block as block_delta, cast(round((q.recall - b.recall) * 10000) as int) as recall_delta from q, (select block, recall from q where config = 'Baseline') b"""
_vf = {"amount": "cast(amount as double)", "origin_balance": "origin_balance", "k": "cast(k as double)",
       "latitude": "case when k % 7 = 0 or k % 11 = 0 then null else latitude end"}
SQL["validate_features"] = with_(tx_cte()) + " union all ".join(
    f"""select '{n}' as feature, count({e}) as kept, count(*) - count({e}) as skipped, {rnd(f'avg({e})', 3)} as mean, {rnd(f'stddev_pop({e})', 3)} as std,
  min({e}) as min, max({e}) as max from tx""" for n, e in _vf.items())
_r = lambda a, b: rnd(f"case when {b} > 0 then ({a}) / cast({b} as double) else 0.0 end", 4)
SQL["m_confusion"] = with_(tx_cte(), SCORED, f"""c as (select count(*) filter (p >= {D('0.3')} and label = 1) as tp, count(*) filter (p >= {D('0.3')} and label = 0) as fp,
  count(*) filter (p < {D('0.3')} and label = 0) as tn, count(*) filter (p < {D('0.3')} and label = 1) as fn from scored)""") + f"""
select *, {_r('tp', '(tp + fp)')} as precision, {_r('tp', '(tp + fn)')} as recall, {_r('tp * 2', '(tp * 2 + fp + fn)')} as f1, {_r('fp', '(fp + tn)')} as fpr, {_r('fn', '(fn + tp)')} as fnr from c"""
SQL["m_brier"] = with_(tx_cte(), SCORED) + f"select {rnd('avg(pow(p - label, 2))', 6)} as brier_score from scored"
SQL["m_ece"] = with_(tx_cte(), SCORED) + f"""select {rnd('sum(abs(c - a) * n) / sum(n)', 5)} as ece from (
  select least(floor(p * 10), 9) as b, count(*) as n, avg(p) as c, avg(label) as a from scored group by 1)"""
SQL["m_tiers"] = with_(tx_cte(), SCORED, f"""t as (select case when p < {D('0.158')} then 'approved' when p < {D('0.5516')} then 'reviewed' else 'blocked' end as tier, label from scored)""") + f"""
select tier, count(*) as n, sum(label) as fraud, {rnd(f"count(*) * {D(100)} / (select count(*) from t)", 2)} as percent,
  {rnd(f"(select sum(label) from t where tier <> 'approved') * {D(100)} / greatest((select sum(label) from t), 1)", 2)} as detection_rate from t group by 1"""


def curve_ctes(src="scored", keys=""):
    k = f"{keys}, " if keys else ""
    part = f"partition by {keys}" if keys else ""
    return [f"cnt as (select {k}p, sum(label) as pos, sum(1 - label) as neg from {src} group by {k}p)",
            f"""crv as (select *, sum(pos) over w as tp, sum(neg) over w as fp, row_number() over w as i, count(*) over ({part}) as last, sum(pos) over ({part}) as pt,
  sum(neg) over ({part}) as nt, lead(pos) over w as np, lead(neg) over w as nn from cnt window w as ({part} order by p desc rows unbounded preceding))""",
            "cor as (select *, i = 1 or i = last or pos <> np or neg <> nn as corner, tp - pos + fp - neg as bf from crv)"]


METRICS = {
    "roc_auc": rnd(f"cast(sum(neg * (2 * tp - pos)) as double) / ({D('max(pt)')} * {D('max(nt)')} * 2)", 4),
    "pr_auc": rnd("sum(pos * (case when bf > 0 then (tp - pos) / cast(bf as double) else 1.0 end + tp / cast(tp + fp as double)) / 2.0) / max(pt)", 4),
    "avg_precision": rnd("sum(pos * (tp / cast(tp + fp as double))) / max(pt)", 4),
    "recall_at_fpr": rnd(f"coalesce(max(case when corner and fp / cast(nt as double) <= {D('0.01')} then tp end), 0) / {D('max(pt)')}", 4)}
for _m, _e in METRICS.items():
    SQL[f"m_{_m}"] = with_(tx_cte(), SCORED, *curve_ctes()) + f"select {_e} as {_m} from cor"
SQL["thr_optimize"] = with_(tx_cte(), SCORED, *curve_ctes(), f"""b as (select min(case when corner and fp / cast(nt as double) <= {D('0.01')} then p end) as r,
  min(case when tp >= (tp + fp) * {D('0.85')} then p end) as b from cor)""", """
  t as (select 'online' as policy, least(greatest(coalesce(r, 0.45), 0.05), 0.45)::double as tr, b from b
    union all select 'training', least(greatest(coalesce(r, 0.40), 0.01), 0.40)::double, b from b)""") + f"""
select policy, {rnd('tr', 4)} as tau_review, {rnd("case policy when 'online' then coalesce(least(greatest(b, tr + 0.1), 0.9), 0.7) else coalesce(least(greatest(b, tr + 0.15), 0.95), greatest(0.6, tr + 0.2)) end", 4)} as tau_block from t"""
SQL["thr_cost_curve"] = with_(tx_cte(), SCORED, """c as (select t as threshold, count(*) filter (p4 < t * 100 and label = 1) as fn, count(*) filter (p4 >= t * 100 and label = 0) as fp
  from scored, (select unnest(range(10, 95, 10)) as t) group by 1)""", f"d as (select *, fn * {D(2500)} + fp * {D(25)} as cost from c)") + """
select *, threshold = (select threshold from d order by cost, threshold limit 1) as optimal from d"""
SQL["imb_class_weight"] = with_(tx_cte(), SCORED, "c as (select sum(label) as pos, sum(1 - label) as neg from scored)") + f"""
select pos, neg, {rnd('neg / cast(pos as double)', 6)} as scale_pos_weight, {rnd('(pos + neg) / (pos * 2.0::double)', 6)} as weight_pos, {rnd('(pos + neg) / (neg * 2.0::double)', 6)} as weight_neg from c"""
_DRAW = lambda s: f"cast(concat('0x', substr(md5(concat('42:{s}:', id)), 1, 8)) as bigint)"
SQL["imb_oversample_pairs"] = with_(tx_cte(), f"""src as (select transaction_id, cast(amount as double) as amount, origin_balance, cast(k as double) as k, is_fraud as label from tx),
pos as (select *, row_number() over (order by transaction_id) as rn, count(*) over () as n from src where label = 1),
want as (select id, {_DRAW(1)} % n + 1 as i, {_DRAW(2)} % n + 1 as j, {D('0.1')} + {_DRAW(3)} % 1000000 / {D(1250000)} as lam
  from (select max(n) as n from pos), (select unnest(range(2 * (select count(*) from pos))) as id))""") + """
select amount, origin_balance, k, label from src
union all select a.amount + lam * (b.amount - a.amount), a.origin_balance + lam * (b.origin_balance - a.origin_balance), a.k + lam * (b.k - a.k), 1
from want join pos a on i = a.rn join pos b on j = b.rn"""
SQL["imb_undersample"] = with_(tx_cte(), SCORED) + """
select transaction_id, label from scored where label = 1 union all select transaction_id, 0 from (select transaction_id, row_number() over (
  order by md5(concat('42:', transaction_id)), transaction_id) as r from scored where label = 0) where r <= 3 * (select sum(label) from scored)"""
BOTH = """both_ as (select *, 'production' as model, concat('d', event_id % 3) as dataset from scored union all select *, 'candidate', concat('d', event_id % 3) from challenger)"""
MM = [tx_cte(), SCORED, CHALLENGER, BOTH, *curve_ctes("both_", "model, dataset"),
      "mm as (select model, dataset, " + ", ".join(f"{e} as {m}" for m, e in METRICS.items()) + " from cor group by 1, 2)"]
SQL["select_candidate"] = with_(*MM, "av as (select model, " + ", ".join(f"{rnd(f'avg({c})', 4)} as {c}" for c in ("pr_auc", "roc_auc", "recall_at_fpr")) + " from mm group by 1)") + """
select *, cast(row_number() over (order by pr_auc desc, recall_at_fpr desc, model) as int) as rank from av"""
SQL["bench_pivot"] = with_(*MM, "pv as (select model, " + ", ".join(f"max(pr_auc) filter (dataset = '{d}') as {d}" for d in ("d0", "d1", "d2")) + " from mm group by 1)") + f"""
select *, {rnd('(d0 + d1 + d2) / 3', 4)} as mean from pv"""
SQL["gate_promotion"] = with_(tx_cte(), SCORED, CHALLENGER, BOTH, *curve_ctes("both_", "model"),
    "mm as (select model, " + ", ".join(f"{e} as {m}" for m, e in METRICS.items()) + " from cor group by 1)",
    f"ot as (select model, {rnd('avg(pow(p - label, 2))', 6)} as br, {rnd(f'count(*) filter (p >= 0.5 and label = 0) / cast(count(*) filter (label = 0) as double)', 6)} as fpr from both_ group by 1)",
    "j as (select * from mm join ot using (model))",
    """g as (select a.pr_auc as production_pr_auc, b.pr_auc as candidate_pr_auc, a.roc_auc as production_roc_auc, b.roc_auc as candidate_roc_auc,
  b.pr_auc >= a.pr_auc - 0.005 as pr_auc_ok, b.roc_auc >= a.roc_auc - 0.005 as roc_auc_ok, b.br <= a.br + 0.010 as brier_ok, b.fpr <= a.fpr * 1.15 as fpr_ok
  from (select * from j where model = 'production') a, (select * from j where model = 'candidate') b)""") + """
select *, case when pr_auc_ok and roc_auc_ok and brier_ok and fpr_ok then 'APPROVED' else 'REJECTED' end as status from g"""
SQL["labeled_training_set"] = with_(*LIGHT) + """
select transaction_id, label as fraud_label, created_us + 14 * 86400000000 as label_order from dec where event_id % 3 = 0 and created_us >= 1705000000000000"""
PSI = [tx_cte(), "med as (select us as m from tx order by us limit 1 offset (select count(*) // 2 from tx))",
       """side as (select us < m as ref, amount, origin_balance, k, auth_verified from tx, med)""",
       """lng as (select 'amount' as feature, ref, cast(amount as double) * case when ref then 1.0 else 1.5 end as x from side
  union all select 'origin_balance', ref, origin_balance from side union all select 'k', ref, cast(k as double) from side
  union all select 'auth', ref, case when auth_verified then 1.0 else 0.0 end from side union all select 'constant', ref, 1.0 from side)""",
       """rk as (select feature, x, row_number() over (partition by feature order by x) - 1 as r, count(*) over (partition by feature) as n from lng where ref)""",
       """pr as (select feature, n, i / cast(10 as double) * (n - 1) as h from (select distinct feature, n from rk), (select unnest(range(0, 11)) as i))""",
       """qs as (select distinct pr.feature, a.x + (b.x - a.x) * (h - floor(h)) as e from pr join rk a on a.feature = pr.feature and a.r = floor(h)
  join rk b on b.feature = pr.feature and b.r = least(floor(h) + 1, pr.n - 1))""",
       """rng as (select feature, min(x) as lo, max(x) as hi, count(*) filter (ref) as n_ref, count(*) filter (not ref) as n_cur from lng group by 1)""",
       """ed as (select feature, e, row_number() over (partition by feature order by e) as j, count(*) over (partition by feature) as ne from qs)""",
       """ed2 as (select feature, e, j from ed where ne >= 3 union all select feature, case when i = 10 then hi else lo + i * ((hi - lo) / 10) end, i + 1
  from rng, (select unnest(range(0, 11)) as i) where feature in (select feature from ed where ne < 3) and lo < hi)""",
       """bins as (select a.feature, a.j, a.e as lo, b.e as hi, a.j = (select max(j) - 1 from ed2 z where z.feature = a.feature) as lastbin
  from ed2 a join ed2 b on a.feature = b.feature and b.j = a.j + 1)""",
       """cells as (select b.feature, b.j, count(*) filter (l.ref) as nr, count(*) filter (not l.ref) as nc from bins b
  left join lng l on l.feature = b.feature and l.x >= b.lo and (l.x < b.hi or (b.lastbin and l.x <= b.hi)) group by 1, 2)""",
       """parts as (select c.feature, nc / cast(n_cur as double) + cast(0.0001 as double) as a, nr / cast(n_ref as double) + cast(0.0001 as double) as b
  from cells c join rng using (feature))""",
       f"""psi as (select r.feature, r.n_ref, r.n_cur, {rnd('greatest(coalesce(sum((a - b) * ln(a / b)), 0.0), 0.0)', 4)} as psi, count(p.feature) as n_bins
  from rng r left join parts p on p.feature = r.feature group by 1, 2, 3)""",
       "sev as (select *, case when psi >= 0.25 then 'SIGNIFICANT_DRIFT' when psi >= 0.10 then 'MODERATE_DRIFT' else 'STABLE' end as severity from psi)"]
SQL["psi_feature"] = with_(*PSI) + "select feature, n_ref, n_cur, psi, severity, n_bins from sev"
SQL["psi_assess"] = with_(*PSI, f"""a as (select max(psi) as max_psi, {rnd('avg(psi)', 4)} as mean_psi, count(*) as features,
  count(*) filter (severity = 'SIGNIFICANT_DRIFT') as drifting from sev)""") + """
select *, case when max_psi >= 0.25 or (features >= 5 and mean_psi >= 0.15) then 'SIGNIFICANT_DRIFT' when max_psi >= 0.10 then 'MODERATE_DRIFT' else 'STABLE' end as status from a"""
SQL["label_mature"] = with_(tx_cte()) + """
select case when us + 14 * 86400000000 <= 1706200000000000 then 'matured' else 'pending' end as state, f as fraud_label, count(*) as n from (
  select us, is_fraud as f from tx where event_id % 3 = 0 union all select us, 1 from tx where event_id % 97 = 5) group by 1, 2"""
SQL["replay_ordered"] = with_(*LIGHT) + """
select concat('s', event_id % 4) as scenario, count(*) as n, sum(label) as fraud, count(*) filter (decision = 'BLOCK') as blocked,
  count(*) filter (decision = 'REVIEW') as reviewed, count(*) filter (decision = 'APPROVE') as approved
from dec group by 1"""
SQL["ledger_reconcile"] = f"""with l as (select event_id, case event_id % 50 when 0 then 'failed' when 1 then 'dlq' when 2 then 'pending' when 3 then 'lost' else 'processed' end as s,
  case when event_id % 40 = 0 then 2 else 1 end as c from events where value > 0)
select sum(c) as total_input, count(*) as unique_input, sum(c) - count(*) as duplicates, count(*) filter (s = 'processed') as processed, count(*) filter (s = 'failed') as failed,
  count(*) filter (s = 'dlq') as dlq, count(*) filter (s = 'pending') as pending, count(*) filter (s = 'lost') as lost, count(*) filter (s = 'lost') = 0 as is_balanced,
  {rnd(f"count(*) filter (s = 'lost') * {D(100)} / count(*)", 4)} as loss_percent from l"""
STG = """stg as (select case k % 7 when 0 then 'kafka_consume' when 1 then 'redis' when 2 then 'feature_engine' when 3 then 'model' when 4 then 'risk_engine'
  when 5 then 'serialization' else 'e2e' end as stage, v as latency from tx)"""
RANKS = """rk as (select stage, cast(latency as double) as x, row_number() over (partition by stage order by latency) - 1 as r,
  count(*) over (partition by stage) as n from stg),
hh as (select stage, n, p, p * (n - 1) as h from (select distinct stage, n from rk), (select unnest([0.5::double, 0.95::double, 0.99::double]) as p)),
qq as (select hh.stage, p, a.x + (b.x - a.x) * (h - floor(h)) as v from hh join rk a on a.stage = hh.stage and a.r = floor(h)
  join rk b on b.stage = hh.stage and b.r = least(floor(h) + 1, hh.n - 1))"""
SQL["latency_summary"] = with_(tx_cte(), STG, RANKS, f"""bs as (select stage, {rnd('cast(sum(latency) as double) / count(*)', 3)} as mean,
  cast(min(latency) as double) as min, cast(max(latency) as double) as max, count(*) as count from stg group by 1)""") + f"""
select bs.*, {rnd("max(v) filter (p = 0.5::double)", 3)} as p50, {rnd("max(v) filter (p = 0.95::double)", 3)} as p95,
  {rnd("max(v) filter (p = 0.99::double)", 3)} as p99 from bs join qq using (stage) group by bs.stage, bs.mean, bs.min, bs.max, bs.count"""
_b = [0.25, 0.5, 1.0, 2.5, 5.0, 7.5, 10.0, 15.0, 20.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0]
_f = [0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0]
_bucket = lambda bounds: "case " + " ".join(f"when latency <= {x} then '{x}'" for x in bounds) + " else '+Inf' end"
SQL["latency_histogram"] = with_(tx_cte(), STG) + (
    f"select stage, case when stage = 'e2e' then {_bucket(_b)} else {_bucket(_f)} end as bucket, count(*) as n from stg group by 1, 2")
SQL["lag_trend"] = with_(tx_cte(), """s as (select user_id % 20 as partition, arg_min(k % 40, us) as initial_lag, max(k % 40) as max_lag, arg_max(k % 40, us) as final_lag,
  count(*) as samples from tx group by 1)""") + """
select *, case when final_lag > initial_lag and final_lag > 10 then 'growing' when final_lag < max_lag and final_lag <= 2 then 'drained_to_baseline' else 'stable' end as trend from s"""
SQL["counters"] = with_(tx_cte()) + """
select case k % 4 when 0 then 'kafka' when 1 then 'model' when 2 then 'internal_error' else 'redis' end as component,
  case k % 3 when 0 then 'timeout' when 1 then 'runtime_error' else 'not_found' end as error_type, count(*) as n from tx group by 1, 2"""
