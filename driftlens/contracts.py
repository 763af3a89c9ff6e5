"""Table shapes the operators agree on."""

from pyspark.sql import types as T

SPLITS = ("train", "validation", "test")

CLASSIFICATION = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("split", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("labels", T.IntegerType()),
    ]
)

GENERATION = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("split", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
    ]
)

# What a model run hands over; columns a scorer does not read may be absent.
MODEL_OUTPUTS = T.StructType(
    [
        T.StructField("sample_id", T.LongType()),
        T.StructField("seq_id", T.IntegerType()),
        T.StructField("features", T.ArrayType(T.DoubleType())),
        T.StructField("logits", T.ArrayType(T.DoubleType())),
        T.StructField("token_logits", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("token_scores", T.ArrayType(T.DoubleType())),
        T.StructField("hyp", T.StringType()),
        T.StructField("likelihood", T.DoubleType()),
    ]
)

# What every scorer returns.
SCORES = T.StructType(
    [
        T.StructField("sample_id", T.LongType()),
        T.StructField("seq_id", T.IntegerType()),
        T.StructField("detector", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)
