"""Landed exports of trackers, wikis, catalogs, repositories and mail as resource rows.

Every function takes a DataFrame over landed files or tables and returns one; the scan stays the start of the job.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from email import policy
from email.parser import BytesParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamline.functions.text import html_to_text

RESOURCE = ["source", "scope", "resource_id", "title", "text", "url", "last_updated", "metadata"]
#: Nodes of rich text after which a line ends.
LINE_NODES = frozenset("paragraph heading bulletList orderedList listItem".split())


def bag(**columns: Column) -> Column:
    """A map of the columns that aren't null."""
    pairs = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(c.cast("string") for c in columns.values())))
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def at(column: str, path: str) -> Column:
    return F.get_json_object(F.col(column), f"$.{path}")


def flatten_rich_text(column: Column) -> Column:
    """The text leaves of a recursive JSON tree in order; lines end after paragraphs, headings and lists."""

    @F.pandas_udf("string")
    def flat(values: pd.Series) -> pd.Series:
        def walk(node: object, out: list[str]) -> None:
            if isinstance(node, list):
                for x in node:
                    walk(x, out)
            elif isinstance(node, dict):
                if isinstance(node.get("text"), str):
                    out.append(node["text"])
                walk(node.get("content"), out)
                if node.get("type") in LINE_NODES:
                    out.append("\n")

        def one(value: str | None) -> str:
            if not value:
                return ""
            try:
                tree = json.loads(value)
            except ValueError:
                return value
            if isinstance(tree, str):
                return tree
            out: list[str] = []
            walk(tree, out)
            return "".join(out).strip()

        return values.map(one)

    return flat(column)


def comments_block(raw: DataFrame, key: str = "key", most: int = 200) -> DataFrame:
    """(key, comments): "n. author: text" lines; blank bodies are skipped and keep their numbers; 200 of an issue at most."""
    items = F.from_json(at("value", "fields.comment.comments"), "array<struct<author: struct<displayName: string>, body: string>>")
    each = raw.select(F.get_json_object("value", f"$.{key}").alias("key"), F.posexplode(F.slice(F.coalesce(items, F.array()), 1, most)).alias("i", "c"))
    text = each.withColumn("body", F.trim(flatten_rich_text(F.col("c.body")))).where("body <> ''")
    line = F.concat((F.col("i") + 1).cast("string"), F.lit(". "), F.coalesce("c.author.displayName", F.lit("Unknown")), F.lit(": "), "body")
    return text.select("key", "i", line.alias("line")).groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("comments"))


def issues_to_resources(raw: DataFrame) -> DataFrame:
    """Issues (value: JSON) as resources of source jira; a missing project is the key's prefix."""
    key, project = at("value", "key"), F.coalesce(at("value", "fields.project.key"), F.split(at("value", "key"), "-")[0])
    rows = raw.withColumn("key", key).join(comments_block(raw), "key", "left")
    labels = F.array_join(F.coalesce(F.from_json(at("value", "fields.labels"), "array<string>"), F.array()), ", ")
    name = lambda path, other: F.coalesce(at("value", path), F.lit(other))
    text = F.concat_ws("\n", F.concat(F.lit("# "), "key", F.lit(": "), name("fields.summary", "")), F.concat(F.lit("Status: "), name("fields.status.name", "Unknown")), F.concat(F.lit("Type: "), name("fields.issuetype.name", "Unknown")), F.concat(F.lit("Assignee: "), name("fields.assignee.displayName", "Unassigned")), F.concat(F.lit("Reporter: "), name("fields.reporter.displayName", "Unknown")), F.concat(F.lit("Labels: "), labels), F.lit(""), flatten_rich_text(at("value", "fields.description")), F.concat(F.lit("\nComments:\n"), "comments"))
    return rows.select(F.lit("jira").alias("source"), project.alias("scope"), F.concat(F.lit("jira:"), "key").alias("resource_id"), name("fields.summary", "").alias("title"), text.alias("text"), at("value", "self").alias("url"), F.try_to_timestamp(at("value", "fields.updated")).alias("last_updated"), bag(project_key=project, object_name=F.col("key"), status=at("value", "fields.status.name")).alias("metadata"))


def issue_edges(raw: DataFrame) -> DataFrame:
    """assigned_to and reported_by, by account before name."""
    who = lambda role: F.coalesce(at("value", f"fields.{role}.accountId"), at("value", f"fields.{role}.displayName"))
    pairs = F.array(F.struct(F.lit("assigned_to").alias("predicate"), who("assignee").alias("object")), F.struct(F.lit("reported_by").alias("predicate"), who("reporter").alias("object")))
    return raw.select(at("value", "key").alias("subject"), F.explode(pairs).alias("e")).select("subject", "e.*").where("object IS NOT NULL")


def dedupe_pages(pages: DataFrame) -> DataFrame:
    """One row for each (base_url, page_id): the newest version."""
    newest = F.row_number().over(Window.partitionBy("base_url", "page_id").orderBy(F.desc_nulls_last("version_when")))
    return pages.withColumn("_rn", newest).where("_rn = 1").drop("_rn")


def pages_to_resources(pages: DataFrame, since: str | None = None) -> DataFrame:
    """Wiki pages as resources; those that are empty as text, or older than since, are left out."""
    text = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.col("body"))
    rows = dedupe_pages(pages).withColumn("body", html_to_text(F.coalesce("html", F.lit("")))).where("body <> ''")
    if since is not None:
        rows = rows.where(F.col("version_when") >= F.to_timestamp(F.lit(since)))
    return rows.select(F.lit("confluence").alias("source"), F.col("space_key").alias("scope"), F.concat(F.lit("confluence:"), F.col("page_id").cast("string")).alias("resource_id"), "title", text.alias("text"), "url", F.col("version_when").alias("last_updated"), bag(space_key=F.col("space_key")).alias("metadata"))


def table_ddl(columns: DataFrame) -> DataFrame:
    """(name, ddl): CREATE TABLE text of (schema, table, ordinal, column, type, nullable) rows, in ordinal order."""
    line = F.concat(F.lit("    "), F.col("column"), F.lit(" "), F.col("type"), F.when(F.col("nullable"), " NULL").otherwise(" NOT NULL"))
    by = columns.withColumn("line", line).groupBy(F.concat_ws(".", "schema", "table").alias("name"))
    return by.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]), ",\n").alias("lines")).select("name", F.concat(F.lit("CREATE TABLE "), "name", F.lit(" (\n"), "lines", F.lit("\n);")).alias("ddl"))


def catalog_to_resources(db: str, routines: DataFrame, views: DataFrame, triggers: DataFrame, columns: DataFrame) -> DataFrame:
    """Objects of one database as resources; those without a definition are left out, tables get theirs from columns.

    routines: name, object_type, definition, modified; views: name, definition, modified; triggers: name, table, event,
    status, definition, modified, a row for each event."""
    keys = ["name", "object_type", "definition", "modified"]
    events = triggers.groupBy("name", "table", "status", "definition", "modified").agg(F.array_join(F.array_sort(F.collect_set("event")), ", ").alias("events"))
    head = F.concat(F.lit("-- trigger on "), "table", F.lit(" for "), "events", F.lit(" ("), "status", F.lit(")\n"), "definition")
    parts = [routines.select(*keys), views.withColumn("object_type", F.lit("view")).select(*keys), events.withColumn("object_type", F.lit("trigger")).withColumn("definition", head).select(*keys), table_ddl(columns).select("name", F.lit("table").alias("object_type"), F.col("ddl").alias("definition"), F.lit(None).cast("timestamp").alias("modified"))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.where("definition IS NOT NULL").select(F.lit("sql").alias("source"), F.lit(db).alias("scope"), F.concat(F.lit(f"sql:{db}."), "name").alias("resource_id"), F.col("name").alias("title"), F.col("definition").alias("text"), F.lit("").alias("url"), F.col("modified").alias("last_updated"), bag(db_name=F.lit(db), object_name=F.col("name"), object_type=F.col("object_type")).alias("metadata"))


def object_catalog(routines: DataFrame, views: DataFrame, tables: DataFrame, triggers: DataFrame) -> DataFrame:
    """(key, name, object_type): by lower-case qualified name; of several the last kind counts."""
    kinds = ((0, routines, None), (1, views, "view"), (2, tables, "table"), (3, triggers, "trigger"))
    rows = None
    for k, df, kind in kinds:
        part = df.select("name", (F.lit(kind) if kind else F.col("object_type")).alias("object_type"), F.lit(k).alias("k"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(F.lower("name").alias("key")).agg(F.max_by(F.struct("name", "object_type"), F.struct("k", "name")).alias("x")).select("key", "x.*")


def commits_to_resources(raw: DataFrame, most: int = 200) -> DataFrame:
    """The newest commits of each branch as resources: short hash, first line as title, the first 30 files."""
    rank = F.row_number().over(Window.partitionBy("repo", "branch").orderBy(F.desc("committed_at"), F.asc("sha")))
    rows = raw.withColumn("_rn", rank).where(F.col("_rn") <= most)
    scope = F.concat("repo", F.lit("@"), "branch")
    title = F.substring(F.split("message", "\n")[0], 1, 200)
    text = F.concat_ws("\n", F.concat(F.lit("Commit "), F.substring("sha", 1, 8)), F.concat(F.lit("Author: "), F.coalesce("author_name", "author_email", F.lit("Unknown"))), "message", F.lit("Files:"), F.array_join(F.slice("files", 1, 30), "\n"))
    return rows.select(F.lit("git").alias("source"), scope.alias("scope"), F.concat(F.lit("git:"), scope, F.lit(":commit:"), "sha").alias("resource_id"), title.alias("title"), text.alias("text"), "url", F.col("committed_at").alias("last_updated"), bag(git_scope=scope, git_type=F.lit("commit")).alias("metadata"))


def commit_edges(raw: DataFrame) -> DataFrame:
    return raw.select(F.concat("repo", F.lit("@"), "branch").alias("subject"), F.lit("modified_by").alias("predicate"), F.coalesce("author_email", "author_name").alias("object")).where("object IS NOT NULL").distinct()


def read_files(spark: SparkSession, path: str, extensions: list[str], max_bytes: int = 150_000) -> DataFrame:
    """(path, content, modified) of the files with these extensions that aren't too large; others are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(path)
    return files.where(F.col("length") <= max_bytes).select("path", F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified"))


def files_to_resources(files: DataFrame, scope: str) -> DataFrame:
    rid = F.concat(F.lit(f"git:{scope}:file:"), "path")
    return files.select(F.lit("git").alias("source"), F.lit(scope).alias("scope"), rid.alias("resource_id"), F.col("path").alias("title"), F.concat(F.lit("# File: "), "path", F.lit("\n\n"), "content").alias("text"), F.lit("").alias("url"), F.col("modified").alias("last_updated"), bag(git_scope=F.lit(scope), git_type=F.lit("file"), file_path=F.col("path")).alias("metadata"))


def address(person: Column) -> Column:
    """"Name <address>" of a struct with name and address."""
    return F.when(F.coalesce(person["name"], F.lit("")) != "", F.concat(person["name"], F.lit(" <"), person["address"], F.lit(">"))).otherwise(person["address"])


def mail_text(subject: Column, sender: Column, to: Column, cc: Column, sent: Column, attachments: Column, body: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Subject: "), F.coalesce(subject, F.lit("(no subject)"))), F.concat(F.lit("From: "), F.coalesce(sender, F.lit(""))), F.concat(F.lit("To: "), F.coalesce(to, F.lit(""))), F.when(cc != "", F.concat(F.lit("Cc: "), cc)), F.concat(F.lit("Date: "), sent.cast("string")), F.when(attachments, F.lit("[has attachments]")), F.lit(""), body)


def mail_to_resources(raw: DataFrame, shape: str = "graph") -> DataFrame:
    """Mail (value: JSON) of two shapes as resources. Attachments are told of and never loaded."""
    if shape == "graph":
        person = "struct<emailAddress: struct<name: string, address: string>>"
        people = lambda path: F.array_join(F.transform(F.coalesce(F.from_json(at("value", path), f"array<{person}>"), F.array()), lambda p: address(p["emailAddress"])), "; ")
        body = F.when(F.lower(at("value", "body.contentType")) == "html", html_to_text(at("value", "body.content"))).otherwise(at("value", "body.content"))
        sent = F.try_to_timestamp(at("value", "receivedDateTime"))
        sender = address(F.from_json(at("value", "from"), person)["emailAddress"])
        return _mail(raw, "outlook", at("value", "id"), at("value", "subject"), sender, people("toRecipients"), people("ccRecipients"), sent, at("value", "hasAttachments") == "true", body, at("value", "webLink"))
    header = lambda name: F.get(F.transform(F.filter(F.from_json(at("value", "payload.headers"), "array<struct<name: string, value: string>>"), lambda h: F.lower(h["name"]) == name), lambda h: h["value"]), F.lit(0))
    sent = F.timestamp_millis(at("value", "internalDate").cast("bigint"))
    parts = gmail_parts(at("value", "payload"))
    return _mail(raw.withColumn("_p", parts), "gmail", at("value", "id"), header("subject"), header("from"), header("to"), F.coalesce(header("cc"), F.lit("")), sent, F.col("_p.attachments") > 0, F.col("_p.body"), F.concat(F.lit("https://mail.google.com/mail/u/0/#all/"), at("value", "threadId")))


def _mail(rows: DataFrame, provider: str, id_: Column, subject: Column, sender: Column, to: Column, cc: Column, sent: Column, attached: Column, body: Column, url: Column) -> DataFrame:
    return rows.select(F.lit("email").alias("source"), F.lit(provider).alias("scope"), F.concat(F.lit(f"email:{provider}:"), id_).alias("resource_id"), F.coalesce(subject, F.lit("(no subject)")).alias("title"), mail_text(subject, sender, to, cc, sent, F.coalesce(attached, F.lit(False)), F.coalesce(body, F.lit(""))).alias("text"), url.alias("url"), sent.alias("last_updated"), bag(email_provider=F.lit(provider), sender=sender).alias("metadata"))


def gmail_parts(payload: Column) -> Column:
    """(body, attachments) of a recursive tree of parts: plain text before HTML."""
    import base64

    @F.pandas_udf("body string, attachments int")
    def read(values: pd.Series) -> pd.DataFrame:
        def walk(part: dict, found: dict[str, list[str]]) -> int:
            n = 1 if part.get("filename") else 0
            data = (part.get("body") or {}).get("data")
            if data and not part.get("filename"):
                found.setdefault(part.get("mimeType", ""), []).append(base64.urlsafe_b64decode(data + "===").decode("utf-8", "replace"))
            return n + sum(walk(p, found) for p in part.get("parts") or [])

        rows = []
        for v in values:
            found: dict[str, list[str]] = {}
            n = walk(json.loads(v), found) if v else 0
            text = "\n".join(found.get("text/plain", [])) or re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", "\n".join(found.get("text/html", [])))).strip()
            rows.append((text, n))
        return pd.DataFrame(rows, columns=["body", "attachments"])

    return read(payload)


def mail_bytes_to_resources(binary: DataFrame, provider: str = "imap") -> DataFrame:
    """RFC 822 bytes (folder, uid, content) as resources. The id is the Message-ID, else a hash of folder, uid and date.

    Messages are dealt by their size first, about a MB to a task: parsing takes far longer than reading, and a file of some
    hundred thousand small ones is read by one task."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.itertuples():
                m = BytesParser(policy=policy.default).parsebytes(bytes(row.content))
                part = m.get_body(("plain", "html"))
                text = part.get_content() if part else ""
                kind = part.get_content_type() if part else "text/plain"
                out.append((row.folder, row.uid, m["Message-ID"], m["Subject"], m["From"], m["To"], m["Cc"] or "", m["Date"].datetime.astimezone(None).timestamp() if m["Date"] and m["Date"].datetime else None, any(True for _ in m.iter_attachments()), text, kind))
            yield pd.DataFrame(out, columns=["folder", "uid", "mid", "subject", "sender", "to", "cc", "sent", "attached", "body", "kind"])

    size = binary.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    dealt = binary.select("folder", "uid", "content").repartition(size // (1 << 20) + 1, "folder", "uid")
    rows = dealt.mapInPandas(parse, "folder string, uid string, mid string, subject string, sender string, to string, cc string, sent double, attached boolean, body string, kind string")
    sent = F.timestamp_seconds("sent")
    own = F.coalesce(F.regexp_replace("mid", "^<|>$", ""), F.sha1(F.concat_ws("|", "folder", "uid", sent.cast("string"))))
    body = F.when(F.col("kind") == "text/html", html_to_text(F.col("body"))).otherwise(F.col("body"))
    return _mail(rows, provider, own, F.col("subject"), F.col("sender"), F.col("to"), F.col("cc"), sent, F.col("attached"), body, mail_search_url(F.col("subject"), F.col("sender"), sent))


def mail_search_url(subject: Column, sender: Column, sent: Column, base: str = "https://mail.yahoo.com/d/search/keyword=") -> Column:
    """A search for the quoted subject (cut at 80 on a word), the sender and the days around; encoded twice."""
    cut = F.when(F.char_length(subject) > 80, F.regexp_replace(F.substring(subject, 1, 80), r"\s+\S*$", "")).otherwise(subject)
    who = F.coalesce(F.nullif(F.regexp_extract(sender, r"<([^>]+)>", 1), F.lit("")), sender)
    query = F.concat_ws(" ", F.concat(F.lit('"'), cut, F.lit('"')), F.concat(F.lit("from:"), who), F.concat(F.lit("after:"), F.date_sub(F.to_date(sent), 1).cast("string")), F.concat(F.lit("before:"), F.date_add(F.to_date(sent), 1).cast("string")))
    coded = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit(base), coded(coded(query)))


def time_window(df: DataFrame, mode: str, column: str = "last_updated", since: str | None = None, month: str | None = None, as_of: str | None = None) -> DataFrame:
    """full: all; month: that month; incremental: since, or else the calendar month before as_of."""
    if mode == "full":
        return df
    time = F.col(column)
    if mode == "month":
        first = F.trunc(F.to_date(F.lit(month)), "month")
        return df.where((time >= first) & (time < F.add_months(first, 1)))
    if since is not None:
        return df.where(time >= F.to_timestamp(F.lit(since)))
    first = F.add_months(F.trunc(F.to_date(F.lit(as_of)), "month"), -1)
    return df.where((time >= first) & (time < F.add_months(first, 1)))


def template(text: str, column: str) -> Column:
    """"{a.b}" by the value at that path, nothing where it is missing; "{{" is a brace."""
    parts = re.split(r"(\{\{|\}\}|\{[^{}]*\})", text)
    out = [F.lit({"{{": "{", "}}": "}"}.get(p, p)) if p in ("{{", "}}") or not p.startswith("{") else F.coalesce(at(column, p[1:-1]), F.lit("")) for p in parts if p]
    return F.concat(*out) if out else F.lit("")


def explode_items(raw: DataFrame, items_path: str = "") -> DataFrame:
    """One row (value: JSON) for each item of the list at a path; an empty path is a bare array."""
    return raw.select(F.explode(F.from_json(at("value", items_path) if items_path else F.col("value"), "array<string>")).alias("value"))


def recipe_to_resources(raw: DataFrame, recipe: dict) -> DataFrame:
    """Items (value: JSON) as resources by a declarative recipe: source, id, title, text, url and scope templates, the path of
    last_updated, and paths of metadata. Ids get the source's name in front unless they have it."""
    source = recipe["source"]
    rid = template(recipe["id"], "value")
    scope = template(recipe.get("scope", "all"), "value")
    meta = {k: at("value", path) for k, path in recipe.get("metadata", {}).items()}
    return raw.select(F.lit(source).alias("source"), scope.alias("scope"), F.when(F.contains(rid, F.lit(f"{source}:")), rid).otherwise(F.concat(F.lit(f"{source}:"), rid)).alias("resource_id"), template(recipe.get("title", ""), "value").alias("title"), template(recipe["text"], "value").alias("text"), template(recipe.get("url", ""), "value").alias("url"), F.try_to_timestamp(at("value", recipe["last_updated"]) if "last_updated" in recipe else F.lit(None).cast("string")).alias("last_updated"), bag(object_name=scope, **meta).alias("metadata"))


def scope_rows(resources: DataFrame, source: str, scope: str = "all") -> DataFrame:
    """The (source, scope) rows that a run covers."""
    rows = resources.where(F.col("source") == source)
    return (rows if scope == "all" else rows.where(F.col("scope") == scope)).select("source", "scope").distinct()


def caption_rows(images: DataFrame, model, per_resource: int = 5, max_bytes: int = 5_000_000, per_run: int = 200) -> DataFrame:
    """A chunk for each captioned image (resource_id, image_no, content, next_index), behind the text's own, without gaps.
    Images for which the model gives nothing are skipped. The caps are the feature's."""
    order = Window.partitionBy("resource_id").orderBy("image_no")
    few = images.where(F.octet_length("content") <= max_bytes).withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= per_resource).orderBy("resource_id", "image_no").limit(per_run)
    told = few.withColumn("text", model(F.col("content"))).where("text IS NOT NULL AND text <> ''")
    return told.select("resource_id", (F.col("next_index") + F.row_number().over(order) - 1).alias("chunk_index"), "text")
