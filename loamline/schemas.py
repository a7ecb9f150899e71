"""Types of the index tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


EDGE = struct(subject=S, predicate=S, object=S)
RESOURCES = struct(source=S, scope=S, resource_id=S, title=S, text=S, url=S, last_updated=TS, metadata=T.MapType(S, S))
CHUNKS = struct(source=S, scope=S, resource_id=S, chunk_index=I, title=S, text=S, url=S, last_updated=TS, metadata=T.MapType(S, S), fingerprint=S, embedding=T.ArrayType(T.FloatType()), created_at=TS, updated_at=TS)
EDGES = struct(source=S, resource_identifier=S, source_resource_id=S, subject=S, predicate=S, object=S, extraction_method=S)
GRANTS = struct(user_id=S, source=S, scope=S, last_synced=TS)
RUN_LOG = struct(user_id=S, source=S, scope=S, mode=S, status=S, completed_at=TS, last_item=TS, n_resources=L, n_chunks=L, message=S)

#: The metadata key that holds each source's scope.
SCOPE_KEY = {"jira": "project_key", "confluence": "space_key", "sql": "db_name", "git": "git_scope", "email": "email_provider", "github_issue": "object_name"}
#: Metadata keys that become columns.
PROMOTED = ("project_key", "space_key", "db_name", "git_scope", "email_provider")
POPPED = ("title", "url", "object_name", "last_updated")
