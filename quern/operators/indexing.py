"""Incremental indexing: what changed since the last pass, and its effect on the stored chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPSERT, DELETE = "changed", "deleted"


def manifest_of(files: DataFrame) -> DataFrame:
    """path and sha256 of every file (path, content)."""
    return files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))


def changed_files(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, sha256) that are new, or whose digest is not the manifest's."""
    old = manifest.select("path", F.col("sha256").alias("old_sha256"))
    return current.join(old, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("old_sha256"))).drop("old_sha256")


def deleted_files(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Paths of the manifest that are gone."""
    return manifest.select("path").join(current.select("path"), "path", "left_anti")


def diff(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, status (new, changed, deleted, unchanged) of every path of either side, in one join."""
    both = current.select("path", "sha256").join(manifest.select("path", F.col("sha256").alias("old_sha256")), "path", "full_outer")
    status = F.when(F.col("old_sha256").isNull(), "new").when(F.col("sha256").isNull(), "deleted").when(F.col("sha256") != F.col("old_sha256"), "changed").otherwise("unchanged")
    return both.select("path", status.alias("status"))


def listing_changes(current: DataFrame, known: DataFrame) -> DataFrame:
    """path and status, as :func:`diff`, of two listings (path, length, modified)."""
    mark = lambda t: t.select("path", F.concat_ws(" ", F.col("length").cast("string"), F.unix_micros("modified").cast("string")).alias("sha256"))
    return diff(mark(current), mark(known))


def chunk_id(source: Column, ordinal: Column, content: Column) -> Column:
    """An id that a chunk gets in every pass, so a repeated write adds nothing."""
    return F.sha2(F.concat_ws("\u0001", source, ordinal.cast("string"), content), 256)


def without_sources(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks but those of ``sources`` (path)."""
    return chunks.join(sources.select(F.col("path").alias("source")), "source", "left_anti").select(*chunks.columns)


def apply_changes(chunks: DataFrame, new_chunks: DataFrame, deleted: DataFrame) -> DataFrame:
    """The chunks after a pass.

    Sources that were deleted, or that have new chunks, lose their old ones; a changed file that could not be parsed
    has no new chunks and so keeps what it had.
    """
    replaced = new_chunks.select(F.col("source").alias("path")).distinct()
    return without_sources(chunks, deleted.select("path").unionByName(replaced)).unionByName(new_chunks, allowMissingColumns=True)


def next_manifest(manifest: DataFrame, current: DataFrame, parsed: DataFrame, deleted: DataFrame) -> DataFrame:
    """The manifest after a pass: files that were parsed (path) get their new digest, deleted ones go, others stay."""
    fresh = current.join(parsed.select("path"), "path", "left_semi")
    old = manifest.join(fresh.select("path").unionByName(deleted.select("path")), "path", "left_anti")
    return old.unionByName(fresh)


def file_counts(changes: DataFrame) -> DataFrame:
    """total_files, new_or_changed and deleted of files (path, status) in one row."""
    status = F.col("status")
    return changes.agg(F.count_if(status != "deleted").alias("total_files"), F.count_if(status.isin("new", "changed")).alias("new_or_changed"), F.count_if(status == "deleted").alias("deleted"))


def index_summary(changes: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """total_files, new_or_changed, deleted and chunks_added in one row."""
    files = file_counts(changes)
    return files.crossJoin(new_chunks.agg(F.count("*").alias("chunks_added")))  # two single rows
