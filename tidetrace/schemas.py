"""Boundary schemas (fixed at read time; extra columns are kept)."""

from pyspark.sql import types as T

POST = T.StructType([
    T.StructField("post_id", T.StringType()),
    T.StructField("Tweet", T.StringType()),
    T.StructField("Datetime", T.TimestampNTZType()),
    T.StructField("ChannelName", T.StringType()),
    T.StructField("Platform", T.StringType()),
    T.StructField("PostUrl", T.StringType()),
    T.StructField("LikesCount", T.IntegerType()),
    T.StructField("SharesCount", T.IntegerType()),
    T.StructField("CommentsCount", T.IntegerType()),
    T.StructField("ViewsCount", T.IntegerType()),
    T.StructField("datasetName", T.StringType()),
    T.StructField("AuthorTweet", T.StringType()),
])

# Raw upload / CSV text: every column arrives as text and is typed afterwards.
POST_TEXT = T.StructType([T.StructField(f.name, T.StringType()) for f in POST.fields])

NARRATIVE = T.StructType([
    T.StructField("narrative_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

EMBEDDING = T.StructType([
    T.StructField("text_key", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

SIMILARITY = T.StructType([
    T.StructField("post_id", T.LongType()),
    T.StructField("narrative_id", T.LongType()),
    T.StructField("similarity", T.DoubleType()),
])

RUN = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("startDate", T.StringType()),
    T.StructField("endDate", T.StringType()),
    T.StructField("targetNarrative", T.StringType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("selectedDatasets", T.ArrayType(T.StringType())),
    T.StructField("generatedAt", T.TimestampNTZType()),
    T.StructField("totalRecords", T.LongType()),
])

STANCE = T.StructType([
    T.StructField("post_id", T.LongType()),
    T.StructField("support", T.IntegerType()),
    T.StructField("opposition", T.IntegerType()),
    T.StructField("neutral", T.IntegerType()),
    T.StructField("unsure", T.IntegerType()),
    T.StructField("response_obj", T.IntegerType()),
    T.StructField("polarity", T.StringType()),
])

EVAL_PAIR = T.StructType([
    T.StructField("pair_id", T.LongType()),
    T.StructField("sentence1", T.StringType()),
    T.StructField("sentence2", T.StringType()),
    T.StructField("gold_score", T.DoubleType()),
    T.StructField("predicted_score", T.DoubleType()),
    T.StructField("error", T.DoubleType()),
    T.StructField("signed_error", T.DoubleType()),
])
