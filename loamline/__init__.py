"""Loamline: incremental indexing, scoped retrieval, lineage and reporting operators over Spark tables."""
