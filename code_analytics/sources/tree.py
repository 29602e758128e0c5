"""Source trees as tables: folders and the archives in them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: an entry of an archive that would unpack to more is a reject
LARGEST_ENTRY = 64 << 20
SCANNED = "repo string, file_path string, size long, content binary, reason string"


def unpacked(archives: DataFrame) -> DataFrame:
    """The entries of zip archives (repo, file_path, size, content), each below the path of its archive; one that can't be read has a reason.

    An archive is opened in the task that holds it, and its entries leave it one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(repo: str, path: str, size: int, content: bytes | None, reason: str | None) -> pa.RecordBatch:
            return pa.record_batch([pa.array([repo], pa.string()), pa.array([path], pa.string()), pa.array([size], pa.int64()), pa.array([content], pa.binary()), pa.array([reason], pa.string())], ["repo", "file_path", "size", "content", "reason"])

        for b in batches:
            for i in range(b.num_rows):
                repo, path, size, content = (b.column(c)[i].as_py() for c in range(4))
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for entry in z.infolist():
                            if entry.is_dir():
                                continue
                            at = f"{path}/{entry.filename}"
                            if entry.file_size > LARGEST_ENTRY:
                                yield row(repo, at, entry.file_size, None, "entry too large")
                                continue
                            try:
                                yield row(repo, at, entry.file_size, z.read(entry), None)
                            except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError, EOFError, ValueError) as e:
                                yield row(repo, at, entry.file_size, None, f"entry not read: {type(e).__name__}")
                except zipfile.BadZipFile:
                    yield row(repo, path, size, None, "no archive")

    return archives.select("repo", "file_path", "size", "content").mapInArrow(run, SCANNED)


def scanned(spark: SparkSession, root: str, repo: str, archives: bool = True) -> DataFrame:
    """(repo, file_path, size, content, reason) of what lies under `root`, listed and read once where no archive is in it; a reject has a reason."""
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/+", "")

    def read(glob: str | None = None) -> DataFrame:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        raw = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
        return raw.select(F.lit(repo).alias("repo"), F.substring(path, F.lit(len(base) + 2), F.length(path)).alias("file_path"), F.col("length").alias("size"), "content")

    every = read()
    rows, is_zip = every.withColumn("reason", F.lit(None).cast("string")), F.col("file_path").endswith(".zip")
    # the tree is listed and read a second time only where it holds an archive
    if archives and not every.select("file_path").where(is_zip).isEmpty():
        rows = rows.where(~is_zip).unionByName(unpacked(read("*.zip")))
    good = F.is_valid_utf8(F.col("content").cast("string"))
    return rows.withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason")).when(~good, "not UTF-8"))


def scan_files(spark: SparkSession, root: str, repo: str, archives: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files, rejects) under `root`, read by Spark wherever it lies; with `archives` the entries of .zip files are files, too.

    A file that isn't UTF-8 and an archive or entry that can't be read is a reject (repo, file_path, size, reason).
    """
    rows = scanned(spark, root, repo, archives)
    files = rows.where("reason is null").select("repo", "file_path", "size", F.col("content").cast("string").alias("content"))
    return files, rows.where("reason is not null").select("repo", "file_path", "size", "reason")
