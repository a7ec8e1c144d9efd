"""Table schemas and the fixed status and type names."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values.
LINK_STATUSES = [
    "pending",
    "imported",
    "duplicate_removed",
    "filtered_internal",
    "filtered_similar",
    "dns_failed",
    "connection_refused",
    "timeout",
    "success",
    "error",
]
REMOVED_STATUSES = ["duplicate_removed", "filtered_internal", "filtered_similar"]
SOURCE_TYPES = ["TXT", "JSON"]
STRATEGIES = ["strict", "normalized", "smart"]
OPERATION_TYPES = [
    "import",
    "deduplicate",
    "filter_internal",
    "filter_similar",
    "test_dns",
    "test_head",
    "test_get",
    "manual_tag",
    "manual_delete",
    "rollback",
]

_S, _L, _B, _TS = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampType()

# ``seq`` is the total order of links: order of the import job, then order inside the file.
LINKS = T.StructType(
    [
        T.StructField("seq", _L),
        T.StructField("id", _S),
        T.StructField("original_url", _S),
        T.StructField("normalized_url", _S),
        T.StructField("domain", _S),
        T.StructField("url_path", _S),
        T.StructField("url_query", _S),
        T.StructField("url_hash", _S),
        T.StructField("title", _S),
        T.StructField("source", _S),
        T.StructField("source_file", _S),
        T.StructField("source_order", _L),
        T.StructField("status", _S),
        T.StructField("tags", T.ArrayType(_S)),
        T.StructField("is_internal", _B),
        T.StructField("similarity_group", _S),
        T.StructField("duplicate_of", _S),
        T.StructField("created_at", _TS),
        T.StructField("updated_at", _TS),
    ]
)

IMPORT_JOBS = T.StructType(
    [
        T.StructField("job_seq", _L),
        T.StructField("id", _S),
        T.StructField("type", _S),
        T.StructField("filename", _S),
        T.StructField("strategy", _S),
        T.StructField("status", _S),
        T.StructField("imported_count", _L),
        T.StructField("error_count", _L),
        T.StructField("file_mtime", _TS),
        T.StructField("is_reparse", _B),
        T.StructField("created_at", _TS),
        T.StructField("completed_at", _TS),
    ]
)

# One row per operation; what it changed is in CHANGES, one row per link and field, so that an
# operation on a billion links never becomes a single giant row.
OPERATIONS = T.StructType(
    [
        T.StructField("op_seq", _L),
        T.StructField("id", _S),
        T.StructField("type", _S),
        T.StructField("job_id", _S),
        T.StructField("timestamp", _TS),
        T.StructField("before_hash", _S),
        T.StructField("after_hash", _S),
        T.StructField("stats_input_count", _L),
        T.StructField("stats_output_count", _L),
        T.StructField("stats_duplicate_count", _L),
        T.StructField("stats_error_count", _L),
    ]
)

#: Errors and warnings of operations, one row each; ``link_id`` where one is to blame.
MESSAGES = T.StructType(
    [
        T.StructField("op_seq", _L),
        T.StructField("kind", _S),
        T.StructField("message", _S),
        T.StructField("link_id", _S),
    ]
)

CHANGES = T.StructType(
    [
        T.StructField("op_seq", _L),
        T.StructField("link_id", _S),
        T.StructField("kind", _S),
        T.StructField("field", _S),
        T.StructField("before", _S),
        T.StructField("after", _S),
    ]
)

SNAPSHOTS = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("created_at", _TS),
        T.StructField("link_count", _L),
        T.StructField("checksum", _S),
    ]
)

TEST_RESULTS = T.StructType(
    [
        T.StructField("id", _L),
        T.StructField("link_id", _S),
        T.StructField("method", _S),
        T.StructField("status", _S),
        T.StructField("error", _S),
        T.StructField("response_time", _L),
        T.StructField("completed_at", _TS),
    ]
)
