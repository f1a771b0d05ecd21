"""Explicit schemas of the inputs and results."""

from __future__ import annotations

from pyspark.sql import types as T

from authsignal.config import TRAINING_FEATURES, REAL_FEATURES

PACKET = T.StructType(
    [
        T.StructField("capture", T.StringType()),
        T.StructField("frame_no", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("rel_us", T.LongType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("nas_msg_types", T.ArrayType(T.IntegerType())),
        T.StructField("ngap_procedures", T.ArrayType(T.IntegerType())),
        T.StructField("sctp_chunk_types", T.ArrayType(T.IntegerType())),
        T.StructField("prot_scheme_id", T.IntegerType()),
        T.StructField("rand", T.StringType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("info", T.StringType()),
        T.StructField("subscriber", T.LongType()),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("capture", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("pos", T.LongType()),
    ]
)

TRAINING = T.StructType(
    [T.StructField("label", T.StringType())]
    + [
        T.StructField(name, T.DoubleType() if name in REAL_FEATURES else T.LongType())
        for name in TRAINING_FEATURES
    ]
)

METRIC_SAMPLE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("value", T.DoubleType()),
        T.StructField("ts", T.TimestampType()),
    ]
)
