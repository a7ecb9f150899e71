"""One read-only statement over the tables that a user may see."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Words that a read-only statement doesn't have, and how names of system procedures start.
FORBIDDEN = ("INSERT UPDATE DELETE MERGE UPSERT DROP CREATE ALTER TRUNCATE RENAME GRANT REVOKE DENY EXEC EXECUTE CALL BACKUP RESTORE SHUTDOWN BULK OPENROWSET OPENQUERY OPENDATASOURCE BEGIN COMMIT ROLLBACK SAVE USE GO DBCC").split()
PROCEDURES = re.compile(r"\b(?:sp_|xp_|fn_|sys\.sp_)\w+", re.I)


class Refused(ValueError):
    """The statement isn't one that may run."""


def check_select(query: str) -> str:
    """The statement without comments and a last semicolon, if it is a single SELECT or WITH."""
    text = re.sub(r"('(?:[^']|'')*')|--[^\n]*|/\*.*?\*/", lambda m: m[1] or " ", query or "", flags=re.S).strip().rstrip(";").strip()
    outside = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`", "''", text)
    if not text:
        raise Refused("the statement is empty")
    if PROCEDURES.search(text):
        raise Refused("system procedures may not be called")
    if ";" in outside:
        raise Refused("one statement at a time")
    words = re.findall(r"\w+", outside.upper())
    if words[0] not in ("SELECT", "WITH"):
        raise Refused("only SELECT and WITH may run")
    if bad := sorted(set(words) & set(FORBIDDEN)):
        raise Refused(f"{bad[0]} may not be used")
    return text


def run_select(spark: SparkSession, query: str, tables: dict[str, DataFrame], cap: int | None = None) -> DataFrame:
    """At most min(cap or 50, 100) rows of the statement over these tables (row_policy gives what a user may see).

    Spark's parser has to take it for a query before anything runs, and it may name these tables and its own CTEs only:
    no other table, view or file of the session. The session's views keep their names."""
    text = check_select(query)
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    if "Command" in plan.getClass().getName():
        raise Refused("only queries may run")
    known = {n.lower() for n in tables} | {n.lower() for n in re.findall(r"(\w+)\s*(?:\([^()]*\)\s*)?AS\s*\(", text, re.I)}
    for name in re.findall(r"UnresolvedRelation \[([^\]]*)\]", plan.toString()):
        if name.lower() not in known:
            raise Refused(f"{name} is not among the tables")
    views = {name: f"adhoc_{uuid.uuid4().hex}" for name in tables}
    for name, view in views.items():
        tables[name].createTempView(view)
    own = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in views.items())
    head = re.match(r"WITH(\s+RECURSIVE)?\s+", text, re.I)
    whole = f"WITH{head[1] or ''} {own}, {text[head.end() :]}" if head else f"WITH {own} {text}"
    try:
        return spark.sql(whole).limit(min(cap or 50, 100))
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
