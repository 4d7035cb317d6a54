"""DuckDB SQL for sources, canonicalisation and sinks."""

from verify.o_features import rnd
from verify.sql_views import SCORED, tx_cte, with_

SQL: dict[str, str] = {}
D = lambda x: f"cast({x} as double)"
EV = """ev as (select event_id, user_id, event_type, epoch_us(ts) as us, ts, cast(cast(value as decimal(18,2)) as double) as v,
  cast(json_extract(props, '$.k') as int) as k from events)"""
MOBILE = """mob as (select event_id, cast(event_id % 720 as int) as step,
  case k % 3 when 0 then 'transfer' when 1 then 'CASH_OUT' else 'Payment' end as type, case when k % 31 <> 0 then v end as amount,
  concat('C', user_id) as "nameOrig", cast(k as double) * cast(100.5 as double) as "oldbalanceOrg", 0.0::double as "newbalanceOrig",
  concat(case when k % 3 = 2 then 'M' else 'C' end, event_id % 89) as "nameDest", 1.0::double as "oldbalanceDest",
  2.0::double as "newbalanceDest", case when k % 37 <> 0 then cast(k < 6 as int) end as "isFraud", 0 as "isFlaggedFraud" from ev)"""
CARD = """crd as (select event_id, strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S') as trans_date_trans_time, 4000 + user_id as cc_num,
  concat(case when k % 2 = 0 then 'fraud_' else '' end, 'Shop ', event_id % 97) as merchant, event_type as category,
  case when k % 31 <> 0 then v end as amt, cast(10 + user_id % 50 as double) as lat, cast(20 + user_id % 60 as double) as long,
  cast(10 + user_id % 50 as double) + (k % 9) * cast(0.05 as double) as merch_lat,
  cast(20 + user_id % 60 as double) - (k % 7) * cast(0.05 as double) as merch_long, us // 1000000 as unix_time,
  concat('t', event_id) as trans_num, cast(k < 6 as int) as is_fraud from ev)"""
ECOM = """eco as (select event_id as "TransactionID", case when k % 37 <> 0 then cast(k < 6 as int) end as "isFraud",
  us // 1000000 - 1704067200 as "TransactionDT", case when k % 31 <> 0 then v end as "TransactionAmt",
  upper(substr(event_type, 1, 1)) as "ProductCD", cast(1000 + user_id as int) as card1,
  case when k % 5 <> 0 then cast(100 + k as double) end as card2, case when k % 4 <> 0 then 'mastercard' end as card4,
  case when k % 6 <> 0 then 'debit' end as card6, case when k % 3 <> 0 then 'mail.example' end as "P_emaildomain",
  cast(null as varchar) as "R_emaildomain", cast(k as double) as dist1, cast(k as double) as "C1", cast(k % 3 as double) as "C2",
  cast(k % 5 as double) as "D1" from ev)"""
IDENT = """idn as (select event_id as iid, case when k % 2 = 0 then 'mobile' end as "DeviceType", concat('model ', k % 11) as "DeviceInfo"
  from ev where event_id % 3 = 0)"""
SQL["src_csv_mobile_money"] = with_(EV, MOBILE) + "select * exclude (event_id) from mob"
SQL["src_csv_card"] = with_(EV, CARD) + "select * exclude (event_id), 'test' as dataset_split from crd"
SQL["src_csv_ecommerce"] = with_(EV, ECOM) + "select * from eco"
MSG = """msg as (select event_id, case when event_id % 43 = 0 then '' else concat('tx_', event_id) end as transaction_id,
  concat('c', user_id) as customer_id, case when event_id % 41 = 0 then 0.0 else v + 1 end as amount,
  case when event_id % 37 = 0 then 'malformed' when event_id % 43 = 0 then 'empty transaction_id'
    when event_id % 41 = 0 then 'amount not positive' when event_id % 47 = 0 then 'negative balance' end as reject_reason from ev)"""
SQL["stream_parse_validate"] = with_(EV, MSG) + """
select event_id, case when bad then null else transaction_id end as transaction_id, case when bad then null else customer_id end as customer_id,
  case when bad then null else amount end as amount, reject_reason is null as valid, reject_reason
from (select *, coalesce(reject_reason = 'malformed', false) as bad from msg)"""
SQL["stream_dead_letter"] = with_(EV, MSG) + """
select reject_reason as reason, count(*) as n, count(*) as payloads from msg where reject_reason is not null group by 1"""
DEC = """dec as (select transaction_id, event_id, customer_id, us as created_us, p4 / cast(100 as double) as risk_score,
  case when p4 >= 7000 then 'BLOCK' when p4 >= 3000 then 'REVIEW' else 'APPROVE' end as decision, p4 >= 9000 as hard_block, label from scored)"""
LIGHT = [tx_cte(), SCORED, DEC]
SQL["sink_decision_topics"] = with_(*LIGHT) + """
select 'predictions' as topic, transaction_id as key, decision as value from dec
union all select 'fraud-alerts', transaction_id, decision from dec where decision = 'BLOCK' or hard_block"""
SQL["sink_upsert_decisions"] = with_(*LIGHT) + """
select transaction_id, decision, risk_score, case when event_id % 3 = 0 then 'CONFIRMED' else 'FINAL' end as workflow_status,
  coalesce(case when event_id % 15 = 0 then 1 end, case when event_id % 4 = 0 then label end) as fraud_label,
  case when event_id % 3 = 0 then created_us + 10 else created_us end as updated_us from dec"""
SQL["sink_insert_ignore"] = with_(*LIGHT) + """
select transaction_id, risk_score, case when event_id % 2 = 0 then 1 else 2 end as version from dec where event_id % 2 = 0 or event_id % 3 = 0"""
SQL["sink_upsert_hold"] = with_(tx_cte()) + """
select transaction_id, concat('hold_', event_id) as hold_id, cast(amount as double) as amount,
  case when k % 3 = 0 then 'RELEASED' else 'HOLD' end as status, case when k % 3 = 0 then us + 5 end as resolved_us,
  case when k % 3 = 0 then 'confirmed' end as resolution_reason from tx where event_id % 20 = 0"""
SQL["sink_upsert_mandate"] = """
select concat('man', c_custkey) as mandate_id, concat('c', c_custkey) as customer_id,
  case when c_custkey % 4 = 0 then 1.0 else cast(500 + c_custkey % 1500 as double) end as max_amount,
  case when c_custkey % 4 = 0 then 'CANCELLED' when c_custkey % 11 = 3 then 'PAUSED' else 'ACTIVE' end as status,
  case when c_custkey % 4 = 0 then 3 else 0 end as execution_count from customer"""
SQL["sink_upsert_case"] = with_(*LIGHT) + """
select concat('case_', transaction_id) as case_id, transaction_id, case when event_id % 2 = 0 then 'CLOSED' else 'OPEN' end as status,
  case when event_id % 2 = 0 then created_us + 1 else created_us end as updated_us from dec where label = 1"""
SQL["sink_feature_matrix"] = with_(tx_cte()) + """
select transaction_id, cast(amount as double) as amount, is_fraud, case event_id % 3 when 0 then 'train' when 1 then 'val' else 'test' end as split from tx"""
SQL["sink_reports"] = with_(*LIGHT) + "select decision, count(*) as n, sum(label) as fraud from dec group by 1"
HOME = "home_latitude, home_longitude"
CM = """cmob as (select concat('paysim_', event_id) as transaction_id, (1704067200 + step * 3600::bigint) * 1000000 as us,
  cast(cast(amount as decimal(18,2)) as double) as amount, "nameOrig" as customer_id, "nameDest" as merchant_id,
  case when "nameDest" like 'M%' then 'merchant' else 'p2p_transfer' end as category, upper(type) as payment_type,
  "oldbalanceOrg" as origin_balance, 0.0 as latitude, 0.0 as longitude, 0.0 as home_latitude, 0.0 as home_longitude,
  'unknown_device' as device_id, true as auth_verified, step % 24 as hour_of_day, step // 24 % 7 as day_of_week, "isFraud" as is_fraud,
  'paysim' as dataset_source from mob where "isFraud" is not null and amount is not null)"""
_a = ("(pow(sin((radians(merch_lat) - radians(lat)) / 2.0), 2) + cos(radians(lat)) * cos(radians(merch_lat))"
      " * pow(sin((radians(merch_long) - radians(long)) / 2.0), 2))")
CC = f"""ccrd as (select concat('sparkov_', event_id) as transaction_id, unix_time * 1000000 as us, cast(cast(amt as decimal(18,2)) as double) as amount,
  concat('cc_', cc_num) as customer_id, regexp_replace(merchant, '^fraud_', '') as merchant_id, category, 'CREDIT_CARD' as payment_type,
  5000.0::double as origin_balance, merch_lat as latitude, merch_long as longitude, lat as home_latitude, long as home_longitude,
  {rnd(f'{D(12742)} * asin(least(sqrt({_a}), 1.0))', 2)} as distance_from_home_km, concat('pos_card_', cc_num) as device_id,
  true as auth_verified, hour(strptime(trans_date_trans_time, '%Y-%m-%d %H:%M:%S')) as hour_of_day,
  isodow(strptime(trans_date_trans_time, '%Y-%m-%d %H:%M:%S')) - 1 as day_of_week, is_fraud, 'sparkov' as dataset_source
  from crd where amt is not null)"""
CE = """ceco as (select concat('ieee_', "TransactionID") as transaction_id, (1512086400 + "TransactionDT") * 1000000 as us,
  cast(cast("TransactionAmt" as decimal(18,2)) as double) as amount, concat('ieee_cust_', card1, '_', cast(coalesce(card2, 0) as int)) as customer_id,
  concat('prod_', "ProductCD") as merchant_id, "ProductCD" as category, upper(coalesce(card6, 'credit')) as payment_type,
  10000.0::double as origin_balance, 0.0 as latitude, 0.0 as longitude, 0.0 as home_latitude, 0.0 as home_longitude,
  concat(coalesce("DeviceType", 'desktop'), '_', coalesce("DeviceInfo", 'unknown')) as device_id, true as auth_verified,
  "TransactionDT" // 3600 % 24 as hour_of_day, "TransactionDT" // 86400 % 7 as day_of_week, "isFraud" as is_fraud, 'ieee_cis' as dataset_source
  from eco left join idn on iid = "TransactionID" where "isFraud" is not null and "TransactionAmt" is not null)"""
SQL["canon_mobile_money"] = with_(EV, MOBILE, CM) + "select * from cmob"
SQL["canon_card"] = with_(EV, CARD, CC) + "select * from ccrd"
SQL["canon_ecommerce"] = with_(EV, ECOM, IDENT, CE) + "select * from ceco"
SQL["leak_drop_columns"] = with_(EV, MOBILE) + 'select step, type, amount, "nameOrig", "oldbalanceOrg", "nameDest", "isFraud" from mob'
SQL["leak_strip_prefix"] = with_(EV, CARD) + "select regexp_replace(merchant, '^fraud_', '') as merchant, count(*) as n from crd group by 1"
SQL["drop_null_keys"] = with_(EV, MOBILE) + 'select event_id, "isFraud", amount from mob where "isFraud" is not null and amount is not null'
SQL["impute_defaults"] = with_(EV, ECOM, IDENT) + """
select "TransactionID", coalesce("DeviceType", 'desktop') as "DeviceType", coalesce("DeviceInfo", 'unknown') as "DeviceInfo",
  coalesce("P_emaildomain", 'anonymous.com') as "P_emaildomain", coalesce(card4, 'visa') as card4, coalesce(card6, 'credit') as card6
from eco left join idn on iid = "TransactionID" """
SQL["j_identity_left"] = with_(EV, ECOM, IDENT) + """
select "TransactionID", "DeviceType", "DeviceInfo", "TransactionAmt" from eco left join idn on iid = "TransactionID" """
SQL["row_id_from_order"] = "select event_id, concat('paysim_', row_number() over (order by event_id) - 1) as row_id from events"
SQL["normalize_location"] = with_(tx_cte()) + """
select transaction_id, case when event_id % 3 < 2 then latitude else 0.0 end as latitude, case when event_id % 3 < 2 then longitude else 0.0 end as longitude,
  case when event_id % 4 < 2 then home_latitude end as home_latitude, case when event_id % 4 < 2 then home_longitude end as home_longitude from tx"""
SQL["tx_contract_filter"] = with_(EV) + """
select r is null as valid, r as reject_reason, count(*) as n from (select case when k % 23 = 0 then 'empty transaction_id'
  when k % 29 = 0 then 'empty customer_id' when k % 31 = 0 or v <= 0 then 'amount not positive' when k % 19 = 0 then 'timestamp not positive'
  when k % 17 = 0 then 'negative balance' end as r from ev) group by 1, 2"""
SQL["union_sources"] = with_(EV, MOBILE, CARD, ECOM, IDENT, CM, CC, CE) + """
select dataset_source, count(*) as n, cast(sum(cast(amount as decimal(18,2))) as double) as amount, sum(is_fraud) as fraud, count(d) as with_distance
from (select dataset_source, amount, is_fraud, null as d from cmob union all select dataset_source, amount, is_fraud, distance_from_home_km from ccrd
  union all select dataset_source, amount, is_fraud, null from ceco) group by 1"""
SQL["redact_metadata"] = with_(tx_cte()) + """
select transaction_id, '[REDACTED]' as auth_token, category as channel, '[REDACTED]' as company, payment_type as note from tx"""
SQL["table_counts"] = with_(tx_cte()) + """
select 'transactions' as table_name, count(*) as n from tx union all select 'hold_cases', count(*) from tx where event_id % 20 = 0
union all select 'account_security_events', count(*) from tx union all select 'mandates', count(*) from customer
union all select 'hold_actions', sum(case when k % 5 = 0 then 2 else 1 end) from tx where event_id % 20 = 0"""
SQL["purge_customer"] = with_(tx_cte(), """kept as (select * from tx where customer_id not like 'c7%'
  and customer_id not in (select concat('c', c_custkey) from customer where c_custkey % 10 = 0))""") + """
select 'transactions' as table_name, count(*) as n from kept union all select 'hold_cases', count(*) from kept where event_id % 20 = 0
union all select 'account_security_events', count(*) from kept"""
