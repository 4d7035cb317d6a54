"""Table schemas; nothing is inferred."""

from pyspark.sql import types as T

TRANSACTION = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("us", T.LongType()),
    T.StructField("amount", T.DecimalType(18, 2)),
    T.StructField("customer_id", T.StringType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("payment_type", T.StringType()),
    T.StructField("origin_balance", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("home_latitude", T.DoubleType()),
    T.StructField("home_longitude", T.DoubleType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("auth_verified", T.BooleanType()),
    T.StructField("is_fraud", T.IntegerType()),
])

MOBILE_MONEY_CSV = T.StructType([
    T.StructField("step", T.IntegerType()), T.StructField("type", T.StringType()),
    T.StructField("amount", T.DoubleType()), T.StructField("nameOrig", T.StringType()),
    T.StructField("oldbalanceOrg", T.DoubleType()), T.StructField("newbalanceOrig", T.DoubleType()),
    T.StructField("nameDest", T.StringType()), T.StructField("oldbalanceDest", T.DoubleType()),
    T.StructField("newbalanceDest", T.DoubleType()), T.StructField("isFraud", T.IntegerType()),
    T.StructField("isFlaggedFraud", T.IntegerType()),
])

CARD_CSV = T.StructType([
    T.StructField("trans_date_trans_time", T.StringType()), T.StructField("cc_num", T.LongType()),
    T.StructField("merchant", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("amt", T.DoubleType()), T.StructField("lat", T.DoubleType()),
    T.StructField("long", T.DoubleType()), T.StructField("merch_lat", T.DoubleType()),
    T.StructField("merch_long", T.DoubleType()), T.StructField("unix_time", T.LongType()),
    T.StructField("trans_num", T.StringType()), T.StructField("is_fraud", T.IntegerType()),
])

IDENTITY_CSV = T.StructType([
    T.StructField("TransactionID", T.LongType()), T.StructField("DeviceType", T.StringType()),
    T.StructField("DeviceInfo", T.StringType()),
])
