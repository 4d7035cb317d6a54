"""The canonical views as DuckDB common table expressions."""

from riskspark.plans.views import TX_COLUMNS

_TX = TX_COLUMNS.replace(" as string)", " as varchar)")


def tx_cte(name: str = "tx", squeeze: int = 1) -> str:
    return f"""{name} as (
  select {_TX}, cast(cast(e.v * 25 as decimal(18,2)) * 100 as bigint) as cents
  from (select event_id, user_id, event_type, epoch_us(ts) // {squeeze} as us,
          cast(value as decimal(18,2)) as v, cast(json_extract(props, '$.k') as int) as k
        from events where value > 0) e
  left join customer c on e.user_id = c.c_custkey)"""


_P4 = "least(9900, 200 + 5000 * is_fraud + k * 40 + cast(floor(least(v, 100) * 10) as int))"
SCORED = f"""scored as (
  select transaction_id, event_id, us, customer_id, is_fraud as label, {_P4} as p4,
    {_P4} / cast(10000 as double) as p from tx)"""
_C4 = f"greatest(0, least(10000, {_P4} + cast((event_id % 11) - 5 as int) * 200))"
CHALLENGER = f"""challenger as (
  select transaction_id, event_id, us, customer_id, is_fraud as label, {_C4} as p4,
    {_C4} / cast(10000 as double) as p from tx)"""


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"
