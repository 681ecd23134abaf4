"""Explicit schemas of the engine's inputs and outputs; nothing is inferred."""

from pyspark.sql import types as T

FONT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("en_name", T.StringType()),
    T.StructField("license", T.StringType()),
    T.StructField("commercial_free", T.BooleanType()),
    T.StructField("style", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("is_system", T.BooleanType()),
    T.StructField("weights", T.ArrayType(T.StringType())),
    T.StructField("coverage", T.ArrayType(T.StringType())),
])

HISTORY = T.StructType([
    T.StructField("ts", T.StringType()),
    T.StructField("chars", T.ArrayType(T.StringType())),
    T.StructField("verdict", T.StringType()),
    T.StructField("top", T.StringType()),
    T.StructField("score", T.DoubleType()),
])

CROP = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("mark_id", T.LongType()),
    T.StructField("char", T.StringType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("px", T.BinaryType()),
])

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

OCR_LINE = T.StructType([
    T.StructField("image_id", T.LongType()),
    T.StructField("line_no", T.IntegerType()),
    T.StructField("box", T.ArrayType(POINT)),
    T.StructField("text", T.StringType()),
    T.StructField("score", T.DoubleType()),
])
