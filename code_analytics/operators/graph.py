"""Queries on the import graph, for all repositories at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parent, strip


def load_bearing(index: DataFrame, edges: DataFrame, limit: int = 10, symbols: DataFrame | None = None) -> DataFrame:
    """(repo, rank, file_path, in_degree, total_files): files by the edges that point to them, `limit` (at most 100) a repository.

    With `symbols` each file has its symbols (start_line, kind, name) in the order of lines, too.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    degree = edges.where("dst_file is not null").groupBy("repo", F.col("dst_file").alias("file_path")).agg(F.count("*").alias("in_degree"))
    rows = index.select("repo", "file_path").join(degree, ["repo", "file_path"], "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)).cast("long"))
    w = Window.partitionBy("repo").orderBy(F.desc("in_degree"), "file_path")
    total = index.groupBy("repo").agg(F.count("*").alias("total_files"))
    top = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= min(limit, 100))
    out = top.join(total, "repo").select("repo", "rank", "file_path", "in_degree", "total_files")
    if symbols is None:
        return out
    entry = F.struct("start_line", "kind", "name")
    # only the symbols of the files at the top are gathered
    held = symbols.join(out.select("repo", "file_path"), ["repo", "file_path"], "left_semi").groupBy("repo", "file_path").agg(F.sort_array(F.collect_list(entry)).alias("symbols"))
    kind = dict(held.dtypes)["symbols"]
    return out.join(held, ["repo", "file_path"], "left").withColumn("symbols", F.coalesce("symbols", F.array().cast(kind)))


def neighborhood(index: DataFrame, edges: DataFrame, targets: DataFrame, n_edges: int = 20, n_siblings: int = 10, strict: bool = False) -> DataFrame:
    """(repo, file_path, relation, ordinal, other) for each target (repo, file_path) that is indexed; with `strict` another one is an error.

    imports and imported_by look at the first n_edges edges and then leave out repeats and files that aren't indexed.
    """
    targets = targets.select("repo", F.replace("file_path", F.lit("\\"), F.lit("/")).alias("file_path")).distinct()
    known = index.select("repo", "file_path", F.lit(True).alias("known")).distinct()
    if strict:
        there = F.coalesce("known", F.raise_error(F.concat(F.lit("no such file in the index: "), F.col("repo"), F.lit(" "), F.col("file_path"))).cast("boolean"))
        targets = targets.join(known, ["repo", "file_path"], "left").where(there).select("repo", "file_path")
    else:
        targets = targets.join(known, ["repo", "file_path"], "left_semi")
    indexed = index.select("repo", F.col("file_path").alias("other"))

    def capped(rows: DataFrame, relation: str, *order: str) -> DataFrame:
        w = Window.partitionBy("repo", "file_path").orderBy(*order)
        some = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n_edges)
        first = some.groupBy("repo", "file_path", "other").agg(F.min("n").alias("n")).join(indexed, ["repo", "other"], "left_semi")
        return first.select("repo", "file_path", F.lit(relation).alias("relation"), F.row_number().over(Window.partitionBy("repo", "file_path").orderBy("n")).alias("ordinal"), "other")

    out_edges = targets.join(edges.withColumnRenamed("src_file", "file_path"), ["repo", "file_path"])
    resolved = out_edges.where("dst_file is not null").withColumn("other", F.col("dst_file"))
    incoming = targets.join(edges.where("dst_file is not null").withColumnRenamed("dst_file", "file_path"), ["repo", "file_path"]).withColumn("other", F.col("src_file"))
    # of a directory the first n_siblings + 1 files are all that any of its files can have as siblings
    heads = index.select("repo", F.col("file_path").alias("other"), parent(F.col("file_path")).alias("dir"))
    heads = heads.withColumn("n", F.row_number().over(Window.partitionBy("repo", "dir").orderBy("other"))).where(F.col("n") <= n_siblings + 1)
    # a row for each directory, so a large one can be split in the join, and siblings come from a file's own row
    heads = heads.groupBy("repo", "dir").agg(F.sort_array(F.collect_list("other")).alias("heads"))
    sib = targets.withColumn("dir", parent(F.col("file_path"))).join(heads, ["repo", "dir"])
    others = F.slice(F.filter("heads", lambda x: x != F.col("file_path")), 1, max(n_siblings, 0))
    sib = sib.select("repo", "file_path", F.posexplode(others).alias("ordinal", "other")).withColumn("ordinal", F.col("ordinal") + 1)
    per_file = Window.partitionBy("repo", "file_path")
    missing = out_edges.where("dst_file is null").withColumn("ordinal", F.row_number().over(per_file.orderBy("raw_import")))
    return (
        capped(resolved, "imports", "raw_import", "other")
        .unionByName(capped(incoming, "imported_by", "other", "raw_import"))
        .unionByName(sib.select("repo", "file_path", F.lit("sibling").alias("relation"), "ordinal", "other"))
        .unionByName(missing.select("repo", "file_path", F.lit("unresolved").alias("relation"), "ordinal", F.col("raw_import").alias("other")))
    )


def repo_summary(repos: DataFrame, index: DataFrame) -> DataFrame:
    """Files and lines of each repository, also of empty ones."""
    sums = index.groupBy("repo").agg(F.count("*").alias("files"), F.sum("line_count").cast("long").alias("lines"))
    return repos.select("repo").join(sums, "repo", "left").na.fill(0)


def repo_stats(index: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Per repository: files by language, functions, classes, interfaces, edges in all, resolved, unresolved and in percent."""
    langs = index.groupBy("repo").agg(*[F.count_if(F.col("language") == x).alias(f"{x}_files") for x in ("python", "javascript", "typescript")])
    kinds = symbols.groupBy("repo").agg(
        F.count_if(~F.col("kind").isin("class", "interface")).alias("functions"), F.count_if(F.col("kind") == "class").alias("classes"), F.count_if(F.col("kind") == "interface").alias("interfaces")
    )
    e = edges.groupBy("repo").agg(F.count("*").alias("edges_total"), F.count("dst_file").alias("edges_resolved"))
    out = langs.join(kinds, "repo", "left").join(e, "repo", "left").na.fill(0)
    out = out.withColumn("edges_unresolved", F.col("edges_total") - F.col("edges_resolved"))
    return out.withColumn("resolved_percent", F.when(F.col("edges_total") > 0, F.round(100.0 * F.col("edges_resolved") / F.col("edges_total"), 1)).otherwise(0.0))


def resolve_repos(requests: DataFrame, repos: DataFrame) -> DataFrame:
    """(request, repo): the exact short name, else the full name without case and outer spaces; repo is null for unknown ones."""
    short = repos.select(F.col("repo").alias("request"), F.col("repo").alias("by_name"))
    full = repos.where("github_full_name is not null").select(F.lower("github_full_name").alias("_full"), F.col("repo").alias("by_full"))
    out = requests.join(short, "request", "left").withColumn("_full", F.lower(strip(F.col("request")))).join(full, "_full", "left")
    return out.select("request", F.coalesce("by_name", "by_full").alias("repo"))
