"""Corpus selection and index rows. All functions take tables of all repositories at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import language, line_count, parts, strings

# fixed values: directories and suffixes that are not indexed, directories of tests, largest file
SKIP_DIRS = (
    "node_modules", ".venv", "venv", "env", "__pycache__", ".git", ".hg", ".svn", "dist", "build", "out", "target", ".next", ".nuxt", ".cache",
    "coverage", ".coverage", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", "vendor", ".idea", ".vscode",
)
TEST_DIRS = ("tests", "test", "spec", "__tests__")
SKIP_SUFFIXES = (".min.js", ".min.css", ".d.ts", ".pyi", "_pb2.py", "_pb2_grpc.py", ".lock")
MAX_FILE_SIZE = 200_000


def in_dirs(path: Column, dirs: tuple[str, ...]) -> Column:
    return F.arrays_overlap(parts(path), strings(dirs))


def select_source_files(files: DataFrame, include_tests: bool = False, max_file_size: int | None = MAX_FILE_SIZE) -> DataFrame:
    """`files` (repo, file_path, content, ..) that are source, with `language` and `size`."""
    path = F.col("file_path")
    out = files.withColumn("language", language(path)).withColumn("size", F.octet_length("content").cast("long"))
    keep = F.col("language").isNotNull() & ~in_dirs(path, SKIP_DIRS)
    if not include_tests:
        keep = keep & ~in_dirs(path, TEST_DIRS)
    for s in SKIP_SUFFIXES:
        keep = keep & ~path.endswith(s)
    if max_file_size is not None:
        keep = keep & (F.col("size") <= max_file_size)
    return out.where(keep)


def build_code_index(files: DataFrame, symbols: DataFrame, imports: DataFrame, heads: DataFrame) -> DataFrame:
    """One row a file: language, line_count, head_sha and the structure (functions, classes, imports in line order)."""
    s = F.struct("start_line", "name", "kind", "end_line", "parent_class")
    is_class = F.col("kind").isin("class", "interface")
    by_file = symbols.groupBy("repo", "file_path").agg(
        F.sort_array(F.collect_list(F.when(~is_class, s))).alias("functions"), F.sort_array(F.collect_list(F.when(is_class, s))).alias("classes")
    )
    imported = imports.groupBy("repo", "file_path").agg(F.sort_array(F.collect_list(F.struct("start_line", "raw"))).alias("imports"))
    out = files.withColumn("line_count", line_count(F.col("content"))).join(by_file, ["repo", "file_path"], "left").join(imported, ["repo", "file_path"], "left")
    out = out.join(heads, "repo", "left")
    kinds = dict(out.dtypes)
    structure = F.struct(*[F.coalesce(F.col(c), F.array().cast(kinds[c])).alias(c) for c in ("functions", "classes", "imports")])
    return out.withColumn("structure", structure).drop("functions", "classes", "imports")


def index_summary(index: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Per repository: files, lines, functions, classes (with interfaces), edges and resolved edges."""
    is_class = F.col("kind").isin("class", "interface")
    files = index.groupBy("repo").agg(F.count("*").alias("files"), F.sum("line_count").cast("long").alias("lines"))
    found = symbols.groupBy("repo").agg(F.count_if(~is_class).alias("functions"), F.count_if(is_class).alias("classes"))
    linked = edges.groupBy("repo").agg(F.count("*").alias("edges_total"), F.count("dst_file").alias("edges_resolved"))
    return files.join(found, "repo", "left").join(linked, "repo", "left").na.fill(0)
