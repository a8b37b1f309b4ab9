"""Named schemas of the records that operators take; ts is event time."""

from pyspark.sql import types as T

KV = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.LongType()), T.StructField("ts", T.TimestampType())])
K2V = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("v", T.LongType()), T.StructField("ts", T.TimestampType())])
TEXT = T.StructType([T.StructField("text", T.StringType()), T.StructField("ts", T.TimestampType())])
NETMON = T.StructType([T.StructField("sd_ip", T.StringType()), T.StructField("rtt", T.LongType()), T.StructField("ts", T.TimestampType())])
TV = T.StructType([T.StructField("t", T.TimestampType()), T.StructField("v", T.LongType())])
