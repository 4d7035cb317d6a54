"""Queries: sources, canonicalisation and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskspark.plans import raw as X
from riskspark.plans.query import register
from riskspark.plans.views import hold_actions, holds, mandates, scored, security_events, table, transactions
from riskspark.session import work_path
from riskspark.sources import canon as C
from riskspark.sources import files as S
from riskspark.sources import sinks as K

QUERIES: dict = {}


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for comparison with SQL."""
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c)
                       for c, t in df.dtypes])


@register(QUERIES, "src_csv_mobile_money")
def src_csv_mobile_money(spark, sf_dir):
    return S.mobile_money_csv(spark, X.as_csv(X.mobile(spark, sf_dir), "mobile"))


@register(QUERIES, "src_csv_card")
def src_csv_card(spark, sf_dir):
    path = X.as_csv(X.card(spark, sf_dir), "card")
    return S.card_csv(spark, train=path, test=path, split="test")


@register(QUERIES, "src_csv_ecommerce")
def src_csv_ecommerce(spark, sf_dir):
    return S.ecommerce_csv(spark, X.as_csv(X.ecommerce(spark, sf_dir), "ecommerce"))


@register(QUERIES, "stream_parse_validate")
def stream_parse_validate(spark, sf_dir):
    out = S.parse_messages(X.messages(spark, sf_dir))
    malformed = F.coalesce(F.col("reject_reason") == "malformed", F.lit(False))
    shown = [F.when(~malformed, F.col(c)).alias(c) for c in ("transaction_id", "customer_id", "amount")]
    return out.select("event_id", *shown, "valid", "reject_reason")


@register(QUERIES, "stream_dead_letter")
def stream_dead_letter(spark, sf_dir):
    return K.dead_letters(S.parse_messages(X.messages(spark, sf_dir))).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("payload").alias("payloads"))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A light decision table: the score bands of the ``scored`` view."""
    return scored(spark, sf_dir).selectExpr(
        "transaction_id", "event_id", "customer_id", "us as created_us", "p4 / 100D as risk_score",
        "case when p4 >= 7000 then 'BLOCK' when p4 >= 3000 then 'REVIEW' else 'APPROVE' end as decision",
        "p4 >= 9000 as hard_block", "label")


@register(QUERIES, "sink_decision_topics")
def sink_decision_topics(spark, sf_dir):
    return K.topic_rows(_decisions(spark, sf_dir), value="decision")


def _upsert(spark, label, settings, batches):
    """Batches of unique keys, one after the other."""
    log = K.KeyedLog(spark, work_path(spark, label), **settings)
    for i, b in enumerate(batches):
        log.append(b.withColumn("_one", F.lit(0)), i, "_one")
    return log.snapshot()


@register(QUERIES, "sink_upsert_decisions")
def sink_upsert_decisions(spark, sf_dir):
    d = _decisions(spark, sf_dir)
    cols = ["transaction_id", "decision", "risk_score", "workflow_status", "fraud_label", "updated_us"]
    one = d.withColumns({"workflow_status": F.lit("FINAL"), "updated_us": F.col("created_us"),
                         "fraud_label": F.expr("case when event_id % 4 = 0 then label end")}).select(*cols)
    two = d.where("event_id % 3 = 0").withColumns({
        "workflow_status": F.lit("CONFIRMED"), "updated_us": F.col("created_us") + 10, "risk_score": F.lit(1.0),
        "fraud_label": F.expr("case when event_id % 5 = 0 then 1 end")}).select(*cols)
    return _upsert(spark, "decisions", K.DECISIONS, [one, two])


@register(QUERIES, "sink_insert_ignore")
def sink_insert_ignore(spark, sf_dir):
    d = _decisions(spark, sf_dir)
    one = d.where("event_id % 2 = 0").selectExpr("transaction_id", "risk_score", "1 as version")
    two = d.where("event_id % 3 = 0").selectExpr("transaction_id", "risk_score", "2 as version")
    return _upsert(spark, "insert", K.INSERT_ONLY, [one, two])


@register(QUERIES, "sink_upsert_hold")
def sink_upsert_hold(spark, sf_dir):
    h = holds(spark, sf_dir)
    one = h.selectExpr("transaction_id", "hold_id", "cast(amount as double) as amount", "'HOLD' as status",
                       "cast(null as bigint) as resolved_us", "cast(null as string) as resolution_reason")
    two = h.where("k % 3 = 0").selectExpr(
        "transaction_id", "'other' as hold_id", "0D as amount", "'RELEASED' as status",
        "created_us + 5 as resolved_us", "'confirmed' as resolution_reason")
    return _upsert(spark, "holds", K.HOLDS, [one, two])


@register(QUERIES, "sink_upsert_mandate")
def sink_upsert_mandate(spark, sf_dir):
    m = mandates(spark, sf_dir)
    one = m.selectExpr("mandate_id", "customer_id", "cast(max_amount as double) as max_amount", "status", "0 as execution_count")
    two = m.where("frequency = 'DAILY'").selectExpr(
        "mandate_id", "'x' as customer_id", "1D as max_amount", "'CANCELLED' as status", "3 as execution_count")
    return _upsert(spark, "mandates", K.MANDATES, [one, two])


@register(QUERIES, "sink_upsert_case")
def sink_upsert_case(spark, sf_dir):
    d = _decisions(spark, sf_dir).where("label = 1")
    one = d.selectExpr("concat('case_', transaction_id) as case_id", "transaction_id", "'OPEN' as status", "created_us as updated_us")
    two = d.where("event_id % 2 = 0").selectExpr(
        "concat('case_', transaction_id) as case_id", "'?' as transaction_id", "'CLOSED' as status", "created_us + 1 as updated_us")
    return _upsert(spark, "cases", K.CASES, [one, two])


@register(QUERIES, "sink_feature_matrix")
def sink_feature_matrix(spark, sf_dir):
    path = work_path(spark, "matrix")
    tx = transactions(spark, sf_dir).selectExpr(
        "transaction_id", "cast(amount as double) as amount", "is_fraud",
        "case event_id % 3 when 0 then 'train' when 1 then 'val' else 'test' end as split")
    K.write_feature_matrix(tx, path)
    return spark.read.schema("transaction_id string, amount double, is_fraud int, split string").parquet(path)


@register(QUERIES, "sink_reports")
def sink_reports(spark, sf_dir):
    path = work_path(spark, "report")
    report = _decisions(spark, sf_dir).groupBy("decision").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("fraud"))
    K.write_report(report, path)
    return spark.read.schema("decision string, n bigint, fraud bigint").json(path)


def _mobile_canon(spark, sf_dir):
    raw = C.with_row_id(_with_event_order(spark, sf_dir, X.MOBILE), "paysim_")
    return C.mobile_money(C.drop_null_keys(C.drop_leaks(raw, C.MOBILE_LEAKS), ["isFraud", "amount"]))


def _with_event_order(spark, sf_dir, columns):
    return X._events(spark, sf_dir).selectExpr(*columns)


def _card_canon(spark, sf_dir):
    raw = C.with_row_id(_with_event_order(spark, sf_dir, X.CARD), "sparkov_")
    clean = C.strip_prefix(C.drop_leaks(raw, C.CARD_LEAKS))
    return C.card(C.drop_null_keys(clean, ["is_fraud", "amt", "unix_time"]))


def _ecommerce_canon(spark, sf_dir):
    raw = C.attach_identity(X.ecommerce(spark, sf_dir), X.identity(spark, sf_dir))
    return C.ecommerce(C.impute(C.drop_null_keys(raw, ["isFraud", "TransactionAmt", "TransactionDT"])))


QUERIES["canon_mobile_money"] = lambda spark, sf_dir: plain(_mobile_canon(spark, sf_dir))
QUERIES["canon_card"] = lambda spark, sf_dir: plain(_card_canon(spark, sf_dir))
QUERIES["canon_ecommerce"] = lambda spark, sf_dir: plain(_ecommerce_canon(spark, sf_dir))
QUERIES["leak_drop_columns"] = lambda spark, sf_dir: C.drop_leaks(X.mobile(spark, sf_dir), C.MOBILE_LEAKS)
QUERIES["leak_strip_prefix"] = lambda spark, sf_dir: C.strip_prefix(X.card(spark, sf_dir)).groupBy("merchant").agg(
    F.count(F.lit(1)).alias("n"))
QUERIES["drop_null_keys"] = lambda spark, sf_dir: C.drop_null_keys(
    X.mobile(spark, sf_dir, "event_id"), ["isFraud", "amount"]).select("event_id", "isFraud", "amount")
QUERIES["impute_defaults"] = lambda spark, sf_dir: C.impute(
    C.attach_identity(X.ecommerce(spark, sf_dir), X.identity(spark, sf_dir))).select(
    "TransactionID", "DeviceType", "DeviceInfo", "P_emaildomain", "card4", "card6")
QUERIES["j_identity_left"] = lambda spark, sf_dir: C.attach_identity(
    X.ecommerce(spark, sf_dir), X.identity(spark, sf_dir)).select("TransactionID", "DeviceType", "DeviceInfo", "TransactionAmt")


@register(QUERIES, "row_id_from_order")
def row_id_from_order(spark, sf_dir):
    return C.with_row_id(table(spark, sf_dir, "events").select("event_id"), "paysim_")


@register(QUERIES, "normalize_location")
def normalize_location(spark, sf_dir):
    """Three shapes of the same place: nested, flat, and missing."""
    df = transactions(spark, sf_dir).selectExpr(
        "transaction_id",
        "case when event_id % 3 = 0 then named_struct('latitude', latitude, 'longitude', longitude) end as location",
        "case when event_id % 3 = 1 then latitude end as latitude",
        "case when event_id % 3 = 1 then longitude end as longitude",
        "case when event_id % 4 = 0 then named_struct('latitude', home_latitude, 'longitude', home_longitude) end as home_location",
        "case when event_id % 4 = 1 then home_latitude end as home_latitude",
        "case when event_id % 4 = 1 then home_longitude end as home_longitude")
    return C.normalize_location(df).select("transaction_id", "latitude", "longitude", "home_latitude", "home_longitude")


@register(QUERIES, "tx_contract_filter")
def tx_contract_filter(spark, sf_dir):
    df = X._events(spark, sf_dir).selectExpr(
        "event_id", "case when k % 23 = 0 then ' ' else concat('tx_', cast(event_id as string)) end as transaction_id",
        "case when k % 29 = 0 then null else concat('c', cast(user_id as string)) end as customer_id",
        "'m1' as merchant_id", "case when k % 31 = 0 then double('NaN') else v end as amount",
        "case when k % 19 = 0 then 0D else us / 1e6 end as timestamp",
        "case when k % 17 = 0 then -1D else 5D end as origin_balance")
    return S.with_reject_reason(df).groupBy("valid", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


@register(QUERIES, "union_sources")
def union_sources(spark, sf_dir):
    out = C.union_sources(_mobile_canon(spark, sf_dir), _card_canon(spark, sf_dir), _ecommerce_canon(spark, sf_dir))
    return out.groupBy("dataset_source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount"), F.sum("is_fraud").alias("fraud"),
        F.count("distance_from_home_km").alias("with_distance"))


@register(QUERIES, "redact_metadata")
def redact_metadata(spark, sf_dir):
    df = transactions(spark, sf_dir).withColumn("metadata", F.create_map(
        F.lit("Auth_Token"), F.col("device_id"), F.lit("channel"), F.col("category"),
        F.lit("company"), F.col("merchant_id"), F.lit("note"), F.col("payment_type")))
    return C.redact(df).select("transaction_id", *[F.col("metadata")[k].alias(k.lower()) for k in
                                                   ("Auth_Token", "channel", "company", "note")])


@register(QUERIES, "table_counts")
def table_counts(spark, sf_dir):
    return K.table_counts({"transactions": transactions(spark, sf_dir), "hold_cases": holds(spark, sf_dir),
                           "account_security_events": security_events(spark, sf_dir),
                           "mandates": mandates(spark, sf_dir), "hold_actions": hold_actions(spark, sf_dir)})


@register(QUERIES, "purge_customer")
def purge_customer(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").selectExpr(
        "concat('c', cast(c_custkey as string)) as customer_id")
    left = K.purge({"transactions": transactions(spark, sf_dir), "hold_cases": holds(spark, sf_dir),
                    "account_security_events": security_events(spark, sf_dir)}, gone, prefixes=["c7"])
    return K.table_counts(left)
