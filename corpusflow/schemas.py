"""Schemas of stored tables.  Read with them, ids stay text whatever the folders are called."""

from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("document_id", T.StringType()),
    T.StructField("knowledge_base_id", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_type", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("uploaded_at", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("progress", T.IntegerType()),
    T.StructField("chunk_count", T.IntegerType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("processed_at", T.TimestampType()),
])

# One row per chunk of a processed document, see plans.processing.outcomes.
OUTCOME = T.StructType([
    T.StructField("document_id", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("content", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("ok", T.BooleanType()),
    T.StructField("knowledge_base_id", T.StringType()),
])

# A stage that a document has reached while it is processed.
STAGE = T.StructType([
    T.StructField("document_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("progress", T.IntegerType()),
    T.StructField("ts", T.TimestampType()),
])

REJECTED = T.StructType([
    T.StructField("upload_id", T.StringType()),
    T.StructField("knowledge_base_id", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_type", T.StringType()),
    T.StructField("reason", T.StringType()),
])
