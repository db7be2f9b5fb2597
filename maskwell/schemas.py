"""The type of a detection."""

from __future__ import annotations

from pyspark.sql import types as T

DETECTION = T.StructType(
    [
        T.StructField("pii_type", T.StringType()),
        T.StructField("original_value", T.StringType()),
        T.StructField("masked_value", T.StringType()),
        T.StructField("detection_method", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)
DETECTIONS = T.ArrayType(DETECTION)
