"""Fixed input schemas."""

from pyspark.sql.types import (BooleanType, DoubleType, IntegerType, LongType, StringType,
                               StructField, StructType)

TRANSACTIONS = StructType([
    StructField("transaction_id", StringType(), True),
    StructField("transaction_timestamp", LongType(), True),  # epoch milliseconds
    StructField("account_id", StringType(), True),
    StructField("device_id", StringType(), True),
    StructField("distance_to_frequent_location", DoubleType(), True),
    StructField("device_age_days", IntegerType(), True),
    StructField("is_emulator", BooleanType(), True),
    StructField("has_fake_location", BooleanType(), True),
    StructField("has_root_permissions", BooleanType(), True),
    StructField("app_is_tampered", BooleanType(), True),
    StructField("transaction_value", DoubleType(), True),
    StructField("client_decision", StringType(), True),
])

TRANSACTION_COLUMNS = [f.name for f in TRANSACTIONS.fields]

# A feedback row means "this transaction was a fraud"; only the id is used.
FEEDBACK = StructType([StructField("transaction_id", StringType(), True)])

FLAG_COLUMNS = ["is_emulator", "has_fake_location", "has_root_permissions", "app_is_tampered"]
