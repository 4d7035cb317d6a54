"""Tiny transaction tables."""

from decimal import Decimal

from riskspark.schema import TRANSACTION

BASE = dict(merchant_id="m1", category="grocery", payment_type="TRANSFER", origin_balance=1000.0, latitude=10.0,
            longitude=20.0, home_latitude=10.0, home_longitude=20.0, device_id="d1", auth_verified=True, is_fraud=0)


def tx(spark, rows):
    """Rows are dicts with ``t`` in seconds, ``amount`` and overrides."""
    out = []
    for i, r in enumerate(rows):
        row = {**BASE, "transaction_id": f"t{i}", "customer_id": "c1", **r}
        row["us"] = int(row.pop("t") * 1_000_000)
        row["amount"] = Decimal(str(row["amount"]))
        out.append(tuple(row[f.name] for f in TRANSACTION))
    return spark.createDataFrame(out, TRANSACTION)


def by_id(df):
    return {r["transaction_id"]: r for r in df.collect()}
