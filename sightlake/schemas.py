"""Row layouts shared by operators, sources and streams."""

from __future__ import annotations

from pyspark.sql import types as T

BBOX = T.ArrayType(T.DoubleType())

PREDICTION = T.StructType([
    T.StructField("class_id", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("probabilities", T.ArrayType(T.DoubleType())),
])

OBJECT = T.StructType([
    T.StructField("object_index", T.IntegerType()),
    T.StructField("object_id", T.IntegerType()),
    T.StructField("bbox", BBOX),
    T.StructField("source_bbox", BBOX),
    T.StructField("class_name", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("predictions", T.MapType(T.StringType(), PREDICTION)),
])

# Keys whose JSON type varies between producers are read as text and converted by
# functions.clock / functions.identity.
PACKET_METADATA = T.StructType([
    T.StructField("stage", T.StringType()),
    T.StructField("frame", T.StringType()),
    T.StructField("timestamp_ns", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("timestamp_source", T.StringType()),
    T.StructField("source_timestamp_ns", T.StringType()),
    T.StructField("source_timestamp", T.StringType()),
    T.StructField("source_timestamp_source", T.StringType()),
    T.StructField("timestamp_is_source", T.BooleanType()),
    T.StructField("timing", T.ArrayType(T.StringType())),
    T.StructField("rows", T.ArrayType(T.StringType())),
    T.StructField("objects", T.ArrayType(OBJECT)),
    T.StructField("object_count", T.IntegerType()),
    T.StructField("data_source_id", T.StringType()),
    T.StructField("log_text", T.StringType()),
    T.StructField("source_width", T.IntegerType()),
    T.StructField("source_height", T.IntegerType()),
    T.StructField("image_width", T.IntegerType()),
    T.StructField("image_height", T.IntegerType()),
    T.StructField("bbox_coordinate_space", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("bytes", T.LongType()),
])

PACKET = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("offset", T.LongType()),
    T.StructField("n_bytes", T.LongType()),
])

REGISTRY_ENTRY = T.StructType([
    T.StructField("requested_long_side", T.IntegerType()),
    T.StructField("source_width", T.IntegerType()),
    T.StructField("source_height", T.IntegerType()),
    T.StructField("model_width", T.IntegerType()),
    T.StructField("model_height", T.IntegerType()),
])
