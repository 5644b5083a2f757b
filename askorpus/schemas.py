"""Schemas of the tables the jobs read and write."""

from pyspark.sql import types as T

SOURCE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("score", T.DoubleType()),
])

RAW_DOC = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("fetched_at", T.StringType()),
])

DOC_STATE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("content_hash", T.StringType()),
])

CHUNK = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("document_id", T.LongType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("chunk_hash", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

THREAD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("archived", T.BooleanType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("n_messages", T.LongType()),
])

MESSAGE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("conversation_id", T.StringType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("sources", T.ArrayType(SOURCE)),
    T.StructField("created_at", T.TimestampType()),
])

EXTRACT = T.StructType([
    T.StructField("metadata", T.StructType([
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
    ])),
    T.StructField("content", T.StructType([
        T.StructField("markdown", T.StringType()),
    ])),
])

# Closed enumerations and request bounds.
ROUTES = ("direct", "structured", "rag")
MESSAGE_ROLES = ("user", "assistant")
QUESTION_CHARS = (1, 2000)
TITLE_CHARS = (1, 200)
TEMPERATURE = (0.0, 1.0)
TOP_K = (1, 10)
