"""Source-shaped frames derived from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskspark.plans.views import table
from riskspark.session import work_path


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("value").cast("decimal(18,2)").cast("double").alias("v"),
        F.get_json_object("props", "$.k").cast("int").alias("k"))


MOBILE = [
    "cast(event_id % 720 as int) as step",
    "case k % 3 when 0 then 'transfer' when 1 then 'CASH_OUT' else 'Payment' end as type",
    "case when k % 31 <> 0 then v end as amount", "concat('C', cast(user_id as string)) as nameOrig",
    "cast(k as double) * 100.5 as oldbalanceOrg", "cast(0 as double) as newbalanceOrig",
    "concat(case when k % 3 = 2 then 'M' else 'C' end, cast(event_id % 89 as string)) as nameDest",
    "cast(1 as double) as oldbalanceDest", "cast(2 as double) as newbalanceDest",
    "case when k % 37 <> 0 then cast(k < 6 as int) end as isFraud", "0 as isFlaggedFraud",
]
CARD = [
    "date_format(timestamp_micros(us), 'yyyy-MM-dd HH:mm:ss') as trans_date_trans_time",
    "4000 + user_id as cc_num",
    "concat(case when k % 2 = 0 then 'fraud_' else '' end, 'Shop ', cast(event_id % 97 as string)) as merchant",
    "event_type as category", "case when k % 31 <> 0 then v end as amt",
    "cast(10 + user_id % 50 as double) as lat", "cast(20 + user_id % 60 as double) as long",
    "cast(10 + user_id % 50 as double) + (k % 9) * cast(0.05 as double) as merch_lat",
    "cast(20 + user_id % 60 as double) - (k % 7) * cast(0.05 as double) as merch_long",
    "us div 1000000 as unix_time", "concat('t', cast(event_id as string)) as trans_num",
    "cast(k < 6 as int) as is_fraud",
]
ECOMMERCE = [
    "event_id as TransactionID", "case when k % 37 <> 0 then cast(k < 6 as int) end as isFraud",
    "us div 1000000 - 1704067200 as TransactionDT", "case when k % 31 <> 0 then v end as TransactionAmt",
    "upper(substr(event_type, 1, 1)) as ProductCD", "cast(1000 + user_id as int) as card1",
    "case when k % 5 <> 0 then cast(100 + k as double) end as card2",
    "case when k % 4 <> 0 then 'mastercard' end as card4", "case when k % 6 <> 0 then 'debit' end as card6",
    "case when k % 3 <> 0 then 'mail.example' end as P_emaildomain", "cast(null as string) as R_emaildomain",
    "cast(k as double) as dist1", "cast(k as double) as C1", "cast(k % 3 as double) as C2",
    "cast(k % 5 as double) as D1", "'x' as M1", "cast(1 as double) as V1",
]
IDENTITY = ["event_id as TransactionID", "case when k % 2 = 0 then 'mobile' end as DeviceType",
            "concat('model ', cast(k % 11 as string)) as DeviceInfo"]


def mobile(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(*MOBILE, *extra)


def card(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(*CARD, *extra)


def ecommerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(*ECOMMERCE)


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("event_id % 3 = 0").selectExpr(*IDENTITY)


def as_csv(df: DataFrame, label: str) -> str:
    path = work_path(df.sparkSession, label)
    df.write.option("header", True).csv(path)
    return path


MESSAGE_SQL = (
    "case when event_id % 37 = 0 then substr(body, 1, length(body) - 9) else body end")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON messages: every 37th is cut short, every 41st has amount 0, every 43rd a blank id."""
    body = F.to_json(F.struct(
        F.expr("case when event_id % 43 = 0 then '  ' else concat(' tx_', cast(event_id as string), ' ') end").alias("transaction_id"),
        F.expr("concat('c', cast(user_id as string))").alias("customer_id"),
        F.expr("concat('m', cast(event_id % 97 as string))").alias("merchant_id"),
        F.expr("us / 1e6").alias("timestamp"),
        F.expr("case when event_id % 41 = 0 then 0D else v + 1 end").alias("amount"),
        F.col("event_type").alias("category"), F.lit("TRANSFER").alias("payment_type"),
        F.expr("case when event_id % 47 = 0 then -5D else k * 10D end").alias("origin_balance"),
        F.lit(1.5).alias("latitude"), F.lit(2.5).alias("longitude"),
        F.expr("concat('d', cast(k as string))").alias("device_id"), F.expr("k % 8 <> 0").alias("auth_verified")))
    return (_events(spark, sf_dir).withColumn("body", body)
            .selectExpr("event_id", "us", f"{MESSAGE_SQL} as payload"))
