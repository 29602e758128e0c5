"""Change lists, snapshots, index modes and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import VersionedTable
from .selection import select_source_files


def parse_name_status(lines: DataFrame) -> DataFrame:
    """(repo, seq, line) with tab-separated status and paths -> (repo, seq, ord, status, relative_path, previous_path).

    A rename is two rows, the old path deleted and the new one added; a copy is its new path added. Unknown letters and
    lines with fewer than two fields are left out.
    """
    f = F.split("line", "\t")
    clean = lambda i: F.replace(F.get(f, F.lit(i)), F.lit("\\"), F.lit("/"))
    none = F.lit(None).cast("string")

    def row(k: int, status: str, path: Column, previous: Column = none) -> Column:
        return F.struct(F.lit(k).alias("ord"), F.lit(status).alias("status"), path.alias("relative_path"), previous.alias("previous_path"))

    letter, n = F.substring(F.col("line"), 1, 1), F.size(f)
    rows = (
        F.when(n < 2, F.array().cast("array<struct<ord:int,status:string,relative_path:string,previous_path:string>>"))
        .when(letter == "A", F.array(row(0, "added", clean(1))))
        .when(letter.isin("M", "T"), F.array(row(0, "modified", clean(1))))
        .when(letter == "D", F.array(row(0, "deleted", clean(1))))
        .when((letter == "R") & (n >= 3), F.array(row(0, "deleted", clean(1)), row(1, "added", clean(2), clean(1))))
        .when((letter == "C") & (n >= 3), F.array(row(0, "added", clean(2))))
    )
    return lines.select("repo", "seq", F.explode(rows).alias("r")).select("repo", "seq", "r.*")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo, file_path, status) of the files that differ between two snapshots, by content hash."""
    a = old.select("repo", "file_path", F.sha2("content", 256).alias("old_hash"))
    b = new.select("repo", "file_path", F.sha2("content", 256).alias("new_hash"))
    status = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return a.join(b, ["repo", "file_path"], "full").select("repo", "file_path", status.alias("status")).where("status is not null")


def index_mode(heads: DataFrame, force_full: bool = False) -> DataFrame:
    """(repo, old_sha, new_sha, has_changes) -> mode: full, noop or incremental."""
    mode = (
        F.when(F.lit(force_full) | F.col("old_sha").isNull(), "full")
        .when(F.col("new_sha").isNull(), "full")
        .when(F.col("old_sha") == F.col("new_sha"), "noop")
        .when(F.col("has_changes"), "incremental")
        .otherwise("full")
    )
    return heads.withColumn("mode", mode)


def merge_files(index: DataFrame, changes: DataFrame, new_files: DataFrame) -> DataFrame:
    """The rows after an incremental run: changed files leave, those that can be indexed come in (without the size cap)."""
    rest = index.join(changes.select("repo", "file_path").distinct(), ["repo", "file_path"], "left_anti")
    fresh = select_source_files(new_files, max_file_size=None).join(changes.where("status <> 'deleted'").select("repo", "file_path").distinct(), ["repo", "file_path"], "left_semi")
    return rest.unionByName(fresh.select(*rest.columns))


def merge_edges(edges: DataFrame, changes: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Outgoing edges of changed files are replaced; edges to deleted files stay as they are."""
    touched = changes.select("repo", F.col("file_path").alias("src_file")).distinct()
    fresh = new_edges.join(changes.where("status <> 'deleted'").select("repo", F.col("file_path").alias("src_file")).distinct(), ["repo", "src_file"], "left_semi")
    return edges.join(touched, ["repo", "src_file"], "left_anti").unionByName(fresh.select(*edges.columns))


def rebuild(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """All rows of the repositories in `fresh` are replaced."""
    return index.join(fresh.select("repo").distinct(), "repo", "left_anti").unionByName(fresh)


def merge_stored(index: VersionedTable, changes: DataFrame, new_files: DataFrame, batch: tuple[str, int] | None = None) -> int | None:
    """merge_files on a stored index; only the buckets of changed repositories are read and written. The new version, or null for a batch that it holds already."""
    return index.rewrite(changes.select("repo"), lambda rows: merge_files(rows, changes, new_files), batch)


def rebuild_stored(index: VersionedTable, fresh: DataFrame) -> int | None:
    """rebuild on a stored index; the files of other buckets stay as they are."""
    return index.rewrite(fresh.select("repo"), lambda rows: rebuild(rows, fresh.select(*rows.columns)))


def upsert_repos(repos: DataFrame, incoming: DataFrame) -> DataFrame:
    """root_path is overwritten, github_full_name only filled, default_branch overwritten where given (else main for a new row)."""
    a, b = repos.alias("a"), incoming.alias("b")
    return a.join(b, F.col("a.repo") == F.col("b.repo"), "full").select(
        F.coalesce("a.repo", "b.repo").alias("repo"),
        F.coalesce("b.root_path", "a.root_path").alias("root_path"),
        F.coalesce("a.github_full_name", "b.github_full_name").alias("github_full_name"),
        F.coalesce("b.default_branch", "a.default_branch", F.lit("main")).alias("default_branch"),
        F.coalesce("a.auto_test_generation", F.lit(False)).alias("auto_test_generation"),
    )
