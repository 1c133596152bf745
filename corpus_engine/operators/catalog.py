"""Workspaces, contexts, files and reports: visibility, membership, listings and roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The accepted request domains and upload extensions.
REPORT_TYPES = ["institutional", "descriptive", "summary", "evaluation", "presentation"]
OUTPUT_FORMATS = ["markdown", "plain_text"]
FILE_FORMATS = ["pdf", "word", "csv", "pptx", "txt"]
UPLOAD_EXTENSIONS = ["pdf", "txt", "xls", "xlsx"]
JSON_MEDIA_TYPE = "application/json"


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def visible(df: DataFrame, user: str) -> DataFrame:
    """Active rows the user owns or everybody may see."""
    return df.filter(((F.col("user_id") == user) | F.col("public")) & F.col("active"))


def owned(df: DataFrame, user: str) -> DataFrame:
    return df.filter(F.col("user_id") == user)


def visible_contexts(contexts: DataFrame, user: str, workspaces: DataFrame) -> DataFrame:
    """Visible contexts inside the given workspaces."""
    return visible(contexts, user).join(workspaces.select("workspace_id"), "workspace_id", "left_semi")


def workspace_files(files: DataFrame, workspaces: DataFrame) -> DataFrame:
    return files.join(workspaces.select("workspace_id"), "workspace_id", "left_semi").select(
        "file_id", "workspace_id", "document_type", "filename"
    )


def select_files(
    files: DataFrame,
    context_files: DataFrame | None = None,
    file_ids: DataFrame | None = None,
) -> DataFrame:
    """Files of the contexts in the bridge, of an id list, or of both; one of them is required."""
    if context_files is None and file_ids is None:
        raise ValueError("context files or file ids are required")
    out = files
    if file_ids is not None:
        out = out.join(file_ids.select("file_id").distinct(), "file_id", "left_semi")
    if context_files is not None:
        out = out.join(context_files.select("context_id", "file_id"), "file_id")
    return out


def is_structured() -> Column:
    return F.col("document_type") == JSON_MEDIA_TYPE


def list_reports(reports: DataFrame, user: str | None = None, **filters) -> DataFrame:
    """Reports that meet every given filter, newest first.

    ``date_from`` and ``date_to`` are days; they become a half-open range on the timestamp itself,
    so that the comparison reaches the Parquet scan.
    """
    conditions = [] if user is None else [F.col("user_id") == user]
    for name in ("context_id", "report_type", "file_format", "output_format", "status"):
        if filters.get(name) is not None:
            conditions.append(F.col(name) == filters[name])
    created = F.col("created")
    kind = reports.schema["created"].dataType.simpleString()
    if filters.get("date_from"):
        conditions.append(created >= F.lit(filters["date_from"]).cast("date").cast(kind))
    if filters.get("date_to"):
        conditions.append(created < F.date_add(F.lit(filters["date_to"]).cast("date"), 1).cast(kind))
    return newest_first(reports.filter(all_of(conditions)), "created", "report_id")


def newest_first(df: DataFrame, when: str, key: str) -> DataFrame:
    return df.orderBy(F.col(when).desc(), F.col(key).desc())


def may_read(owner: Column, viewer: Column) -> Column:
    """False only if both ids are known and differ."""
    return ~(owner.isNotNull() & viewer.isNotNull() & (owner != viewer))


def download_url(external: Column, path: Column, base: str) -> Column:
    return F.coalesce(external, F.concat(F.lit(base), path))


def request_violations() -> Column:
    """Names of the rules a report request breaks."""
    rules = {
        "report_type": F.col("report_type").isin(REPORT_TYPES),
        "output_format": F.col("output_format").isin(OUTPUT_FORMATS),
        "file_format": F.col("file_format").isin(FILE_FORMATS),
        "report_name": F.length("report_name").between(1, 255),
        "file_ids": F.col("n_file_ids") > 0,
    }
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return F.filter(F.array(*broken), lambda v: v.isNotNull())


def upload_allowed(filename: Column) -> Column:
    return F.lower(F.element_at(F.split(filename, r"\."), -1)).isin(UPLOAD_EXTENSIONS)


def media_type(filename: Column, types: dict[str, str]) -> Column:
    """Media type by extension, ``application/octet-stream`` when it is not known."""
    pairs = [F.lit(x) for pair in types.items() for x in pair]
    ext = F.lower(F.regexp_extract(filename, r"\.([^./\\]+)$", 1))
    return F.coalesce(F.element_at(F.create_map(*pairs), ext), F.lit("application/octet-stream"))


def chunks_of_contexts(chunks: DataFrame, context_files: DataFrame) -> DataFrame:
    """Every chunk once per context that holds its file."""
    return chunks.join(context_files, "file_id")


def with_filename(chunks: DataFrame, files: DataFrame) -> DataFrame:
    return chunks.join(files.select("file_id", "filename"), "file_id")


def workspace_rollup(workspaces: DataFrame, files: DataFrame, contexts: DataFrame) -> DataFrame:
    """Distinct files and distinct active contexts per workspace.

    Each side is counted before it is joined, so files and contexts never multiply each other.
    """
    n_files = files.groupBy("workspace_id").agg(F.countDistinct("file_id").alias("n_files"))
    n_contexts = contexts.groupBy("workspace_id").agg(
        F.countDistinct(F.when(F.col("active"), F.col("context_id"))).alias("n_contexts")
    )
    return (
        workspaces.join(n_files, "workspace_id", "left")
        .join(n_contexts, "workspace_id", "left")
        .fillna(0, ["n_files", "n_contexts"])
    )


def files_per_context(contexts: DataFrame, context_files: DataFrame) -> DataFrame:
    counts = context_files.groupBy("context_id").agg(F.count("file_id").alias("n_files"))
    return contexts.join(counts, "context_id", "left").fillna(0, ["n_files"])


def file_kind_counts(contexts: DataFrame, context_files: DataFrame, files: DataFrame) -> DataFrame:
    """Files, structured files and text files per context, and the searches they call for.

    A context without files has none of either and is searched as text.
    """
    kinds = context_files.join(files.select("file_id", "document_type"), "file_id")
    out = kinds.groupBy("context_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_structured()).alias("n_json")
    )
    out = contexts.select("context_id").join(out, "context_id", "left").fillna(0, ["total", "n_json"])
    return out.withColumn("n_text", F.col("total") - F.col("n_json")).select(
        "*",
        ((F.col("n_text") > 0) | (F.col("n_json") == 0)).alias("search_text"),
        (F.col("n_json") > 0).alias("search_json"),
    )


def foreign_ids(requested: DataFrame, owners: DataFrame, members: DataFrame) -> DataFrame:
    """Requested files that do not belong to the context of their report."""
    asked = requested.join(owners.select("report_id", "context_id"), "report_id")
    return asked.join(members.select("context_id", "file_id"), ["context_id", "file_id"], "left_anti")


def delete_files(files: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and chunks that stay once the files in ``gone`` are removed."""
    ids = gone.select("file_id").distinct()
    return files.join(ids, "file_id", "left_anti"), chunks.join(ids, "file_id", "left_anti")


def files_to_ingest(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files that are neither marked as processed nor already have chunks."""
    pending = files.filter(~F.col("processed"))
    return pending.join(chunks.select("file_id").distinct(), "file_id", "left_anti")


def get_or_create(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted (workspace, filename) pairs that do not exist yet, each once."""
    keys = ["workspace_id", "filename"]
    return wanted.dropDuplicates(keys).join(files.select(*keys), keys, "left_anti")


def edit_membership(context_files: DataFrame, add: DataFrame, remove: DataFrame, files: DataFrame) -> DataFrame:
    """Membership after adding and then removing pairs; only files that exist are added."""
    known = add.join(files.select("file_id"), "file_id", "left_semi").select("context_id", "file_id")
    grown = context_files.select("context_id", "file_id").union(known).distinct()
    gone = remove.select("context_id", "file_id").distinct()
    return grown.join(gone, ["context_id", "file_id"], "left_anti")
