"""DuckDB SQL for the feature queries."""

from verify.sql_views import tx_cte, with_

SQL: dict[str, str] = {}
PI2 = "2.0 * 3.141592653589793"


def rnd(x: str, digits: int) -> str:
    scale = f"cast({10 ** digits} as double)"
    return f"floor(({x}) * {scale} + cast(0.5 as double)) / {scale}"


def km(lat1, lon1, lat2, lon2):
    a = (f"(pow(sin(radians({lat2} - {lat1}) / 2.0), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
         f" * pow(sin(radians({lon2} - {lon1}) / 2.0), 2))")
    return (f"case when ({lat1} <> 0 or {lon1} <> 0) and ({lat2} <> 0 or {lon2} <> 0) then"
            f" cast(12742.0 as double) * atan2(sqrt({a}), sqrt(1.0 - {a})) else 0.0 end")


def range_(n: int) -> str:
    return f"range between {n} preceding and 1 preceding"


MONTH = 30 * 86400 * 1_000_000


def feature_ctes(source: str = "tx", key: str = "customer_id", train: str | None = None,
                 dev_key: str = "dev") -> list[str]:
    """Common table expressions ending in ``feat``: every input column plus the features."""
    scope = f"{key} as ck"
    base = f"""fbase as (
  select *, {scope}, us % 86400000000 // 3600000000 as hour_of_day,
    (us // 86400000000 + 3) % 7 as day_of_week, lower(coalesce(category, '')) as cat,
    trim(coalesce(device_id, '')) as dev,
    trim(coalesce(device_id, '')) not in ('', 'unknown_device') as known
  from {source})"""
    win = f"""fwin as (
  select *,
    count(*) over (partition by ck order by us {range_(60_000_000)}) as tx_count_1m,
    count(*) over (partition by ck order by us {range_(300_000_000)}) as tx_count_5m,
    count(*) over (partition by ck order by us {range_(900_000_000)}) as tx_count_15m,
    count(*) over (partition by ck order by us {range_(3_600_000_000)}) as tx_count_1h,
    coalesce(sum(cents) over (partition by ck order by us {range_(300_000_000)}), 0) as c5,
    coalesce(sum(cents) over (partition by ck order by us {range_(900_000_000)}), 0) as c15,
    coalesce(sum(cents) over (partition by ck order by us {range_(3_600_000_000)}), 0) as c60,
    count(*) over w as n, sum(cents) over w as s, sum(cast(cents as hugeint) * cents) over w as s2,
    sum(hour_of_day) over w as hs,
    coalesce(sum(case when known then 1 else 0 end) over w, 0) as ndev,
    count(*) over (partition by ck, cat order by us {range_(MONTH)}) as ncat,
    count(*) over (partition by ck, dev order by us {range_(MONTH)}) as nsame,
    max({{'us': us, 'id': transaction_id, 'lat': latitude, 'lon': longitude}}) over w as last_any,
    max({{'us': us, 'id': transaction_id, 'lat': latitude, 'lon': longitude}})
      over (partition by ck, dev order by us {range_(MONTH)}) as last_dev
  from fbase
  window w as (partition by ck order by us {range_(MONTH)}))"""
    users = f"""fusers as (
  select a.transaction_id as uid, count(distinct b.{key}) as users
  from fbase a join fbase b on a.{dev_key} = b.{dev_key} and a.known and b.us < a.us
    and b.us >= a.us - 86400000000 {"and a.split = b.split" if source == "split_tx" else ""}
  group by 1)"""
    far = f"""ffar as (
  select a.transaction_id as fid, min({km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}) as nearest
  from fbase a join fbase b on a.ck = b.ck and b.us < a.us and b.us >= a.us - {MONTH}
    and (a.latitude <> 0 or a.longitude <> 0) and (b.latitude <> 0 or b.longitude <> 0)
  group by 1)"""
    freq = f"""ffreq as (
  select category as fc, count(*) as rows_, sum(count(*)) over () as all_ from {train or source}
  group by 1)"""
    mean = "(cast(s as double) / n / 100.0)"
    std = ("(sqrt(greatest(cast(cast(n as hugeint) * s2 - cast(s as hugeint) * s as double)"
           " / cast(n * (n - 1) as double), 0.0)) / 100.0)")
    amt = "cast(amount as double)"
    clip = lambda x: f"least(greatest({x}, -5.0), 10.0)"
    z = (f"case when n = 0 then 0.0 when n = 1 then {clip(f'({amt} - {mean}) / greatest({mean} * 0.5, 1.0)')}"
         f" else {clip(f'({amt} - {mean}) / greatest({std}, cast(0.0001 as double))')} end")
    gap = "abs(hour_of_day - cast(hs as double) / n)"
    feat0 = f"""feat0 as (
  select *, case when known and last_dev is not null then last_dev else last_any end as prev
  from fwin left join fusers on uid = transaction_id left join ffar on fid = transaction_id
  left join ffreq on fc = category)"""
    prev_km = km("latitude", "longitude", "prev.lat", "prev.lon")
    speed = ("case when pkm > 0 and prev.us < us then pkm / greatest((us - prev.us) / 1e6 / 3600.0,"
             " cast(1.0 as double) / 3600.0) else 0.0 end")
    feat1 = f"""feat1 as (
  select *, case when prev is null then 0.0 else {prev_km} end as pkm from feat0)"""
    feat2 = f"""feat2 as (
  select *, coalesce({rnd(speed, 2)}, 0.0) as speed_kmh_from_prev_tx from feat1)"""
    hlat, hlon = "coalesce(home_latitude, latitude)", "coalesce(home_longitude, longitude)"
    ratio = f"({amt} / (origin_balance + cast(0.00001 as double)))"
    feat = f"""feat as (
  select *,
    {rnd(f'ln(1 + greatest({amt}, 0.0))', 4)} as log_amount,
    case upper(payment_type) when 'TRANSFER' then 0 when 'CASH_OUT' then 1 when 'PAYMENT' then 2
      when 'DEBIT' then 3 when 'CASH_IN' then 4 when 'CREDIT_CARD' then 5 else 6 end as payment_type_enc,
    coalesce(cast(floor(cast(rows_ as double) / cast(all_ as double) * 1000) as int), 1) as merchant_category_enc,
    {rnd(f'{amt} / (greatest(origin_balance, 0.0) + cast(0.00001 as double))', 4)} as amount_to_balance_ratio,
    case when day_of_week >= 5 then 1 else 0 end as is_weekend,
    case when hour_of_day < 6 or hour_of_day > 22 then 1 else 0 end as is_night,
    {rnd(f'sin(hour_of_day * cast({PI2} as double) / 24.0)', 5)} as cyclic_hour_sin,
    {rnd(f'cos(hour_of_day * cast({PI2} as double) / 24.0)', 5)} as cyclic_hour_cos,
    c5 / 100.0 as amount_sum_5m, c15 / 100.0 as amount_sum_15m, c60 / 100.0 as amount_sum_1h,
    case when n > 0 then (s * 2 + n) // (n * 2) else cents end / 100.0 as user_avg_amount_30d,
    case when n < 2 then 0.0 else {rnd(std, 2)} end as user_std_amount_30d,
    {rnd(z, 4)} as amount_zscore,
    {rnd('case when n > 0 then cast(ncat as double) / n else 1.0 end', 4)} as user_category_frequency,
    {rnd(f'case when n = 0 then 0.0 else least({gap}, 24.0 - {gap}) end', 2)} as user_hourly_tx_deviation,
    {rnd(km('latitude', 'longitude', hlat, hlon), 2)} as distance_from_home_km,
    {rnd('pkm', 2)} as distance_from_prev_loc_km,
    case when known and ndev > 0 and nsame = 0 then 1 else 0 end as is_new_device,
    case when nearest > 50.0 then 1 else 0 end as is_new_location,
    case when known then greatest(1, coalesce(users, 0)) else 1 end as device_user_count_24h,
    case when auth_verified then 1 else 0 end as auth_factor_verified,
    (case when origin_balance = 0 and amount > 5000 and not auth_verified then 1 else 0 end
     + case when origin_balance > 0 and {ratio} > cast(0.90 as double) then 1 else 0 end
     + case when speed_kmh_from_prev_tx > 800 then 1 else 0 end
     + case when tx_count_1m >= 3 then 1 else 0 end
     + case when not auth_verified and amount > 2500 then 1 else 0 end) as deterministic_rule_count,
    cast(0.10 as double) as isolation_forest_score
  from feat2)"""
    return [base, win, users, far, freq, feat0, feat1, feat2, feat]


FEATURE_LIST = ("log_amount, payment_type_enc, merchant_category_enc, amount_to_balance_ratio, hour_of_day,"
                " day_of_week, is_weekend, is_night, cyclic_hour_sin, cyclic_hour_cos, tx_count_1m,"
                " tx_count_5m, tx_count_15m, tx_count_1h, amount_sum_5m, amount_sum_15m, amount_sum_1h,"
                " user_avg_amount_30d, user_std_amount_30d, amount_zscore, user_category_frequency,"
                " user_hourly_tx_deviation, distance_from_home_km, distance_from_prev_loc_km,"
                " speed_kmh_from_prev_tx, is_new_device, is_new_location, device_user_count_24h,"
                " auth_factor_verified, deterministic_rule_count, isolation_forest_score")

PLAIN = with_(tx_cte(), *feature_ctes())
DENSE = with_(tx_cte(squeeze=300), *feature_ctes())

SQL["f_log_amount"] = with_(tx_cte()) + f"select transaction_id, {rnd('ln(1 + cast(amount as double))', 6)} as log_amount from tx"
SQL["f_balance_ratio"] = PLAIN + "select transaction_id, amount_to_balance_ratio from feat"
SQL["f_time_parts"] = PLAIN + "select transaction_id, hour_of_day, day_of_week from feat"
SQL["f_weekend_night"] = PLAIN + "select transaction_id, is_weekend, is_night from feat"
SQL["f_cyclic_hour"] = PLAIN + "select transaction_id, cyclic_hour_sin, cyclic_hour_cos from feat"
SQL["f_payment_enc"] = PLAIN + "select transaction_id, payment_type_enc from feat"
SQL["f_category_freq_enc"] = with_(
    tx_cte(), "tr as (select * from tx where category <> 'signup' and event_id % 2 = 0)",
    *feature_ctes(train="tr")) + "select transaction_id, merchant_category_enc from feat"
SQL["f_haversine"] = PLAIN + "select transaction_id, distance_from_home_km from feat"
SQL["w_home_distance"] = with_(
    tx_cte("tx0"), "tx as (select * replace (case when event_id % 5 <> 0 then home_latitude end as"
    " home_latitude, case when event_id % 5 <> 0 then home_longitude end as home_longitude) from tx0)",
    *feature_ctes()) + "select transaction_id, distance_from_home_km from feat"
SQL["w_velocity_counts"] = DENSE + "select transaction_id, tx_count_1m, tx_count_5m, tx_count_15m, tx_count_1h from feat"
SQL["w_velocity_sums"] = DENSE + "select transaction_id, amount_sum_5m, amount_sum_15m, amount_sum_1h from feat"
for _name, _cols in {
    "w_behavior_30d": "user_avg_amount_30d, user_std_amount_30d", "f_zscore": "amount_zscore",
    "w_hour_mean_30d": f"case when n > 0 then {rnd('cast(hs as double) / n', 4)} end as user_mean_hour_30d, user_hourly_tx_deviation", "f_hour_deviation": "user_hourly_tx_deviation",
    "w_category_share_30d": "user_category_frequency",
    "w_prev_event": "distance_from_prev_loc_km, speed_kmh_from_prev_tx",
    "f_speed": "speed_kmh_from_prev_tx", "w_new_device": "is_new_device",
    "w_new_location": "is_new_location", "w_device_users_24h": "device_user_count_24h",
}.items():
    SQL[_name] = PLAIN + f"select transaction_id, {_cols} from feat"
SQL["features_32_batch"] = DENSE + f"select transaction_id, cast(amount as double) as amount, {FEATURE_LIST} from feat"
SQL["f_rule_count"] = DENSE + "select transaction_id, deterministic_rule_count from feat"
