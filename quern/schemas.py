"""Schemas of the vocabulary tables passed between the operators."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

VOCAB = StructType(
    [
        StructField("id", IntegerType(), False),
        StructField("token", StringType(), False),
        StructField("is_special", BooleanType(), False),
        StructField("is_continuation", BooleanType(), False),
    ]
)

#: Neighbours that become a token, in the order of their ranks.
MERGES = StructType([StructField(c, IntegerType(), False) for c in ("rank", "left_id", "right_id", "id")])
