"""Column layouts shared by all operators."""

from pyspark.sql import types as T

KEY = ["corpus_id", "relative_path"]

LISTING = T.StructType([
    T.StructField("corpus_id", T.StringType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("relative_path", T.StringType(), False),
    T.StructField("size", T.LongType()),
    T.StructField("modified_time", T.TimestampNTZType()),
])

FILES = T.StructType(
    LISTING.fields
    + [T.StructField("checksum", T.StringType()), T.StructField("content", T.BinaryType())]
)

# One digest entry as it moves through joins: date, checksum and content stay together.
ENTRY = T.StructType([
    T.StructField("summary_date", T.TimestampNTZType()),
    T.StructField("checksum", T.StringType()),
    T.StructField("content", T.StringType()),
])

STATE = T.StructType(
    [T.StructField(name, T.StringType(), False) for name in KEY] + ENTRY.fields
)

# A file that a run worked on, with its entry if there is one.
LOG = T.StructType(
    STATE.fields[:2] + [T.StructField(name, T.StringType()) for name in ("status", "route", "outcome")] + ENTRY.fields
)

# An entry that no longer holds, and the version that has it.
DROPPED = T.StructType(STATE.fields[:2] + [T.StructField("origin", T.LongType())])

CORPORA = T.StructType([T.StructField("corpus_id", T.StringType(), False)])

# What a chat endpoint answers, reduced to the part that is read.
CHAT_RESPONSE = T.StructType([
    T.StructField("choices", T.ArrayType(T.StructType([
        T.StructField("message", T.StructType([T.StructField("content", T.StringType())])),
    ]))),
])
