"""Schemas of the tables that the engine keeps."""

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "binary": T.BinaryType(),
    "timestamp": T.TimestampType(), "array<float>": T.ArrayType(T.FloatType()), "array<int>": T.ArrayType(T.IntegerType()),
}


def schema(text: str) -> T.StructType:
    """A schema from ``name type, ...``; unlike Spark's own parser it needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split() for c in text.split(","))])


CHUNKS = schema(
    "workspace_id string, chunk_id string, filepath string, content string, chunk_type string, "
    "start_line int, end_line int, language string, token_count int, name string, parent string"
)
FILES = schema("workspace_id string, filepath string, content binary, size bigint, mtime timestamp")
FILE_HASHES = schema("workspace_id string, filepath string, file_hash string")
VECTORS = schema("workspace_id string, chunk_id string, embedding array<float>")
POSTINGS = schema("workspace_id string, term string, chunk_id string, tf int, doc_len int, positions array<int>")
EVENTS = schema("workspace_id string, path string, event_type string, event_ts double, seq bigint")
