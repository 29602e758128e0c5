"""Pull-request files, changed ranges, and what they touch in the index; commit logs and blame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PR_FILES = "array<struct<filename:string,status:string,additions:int,deletions:int,patch:string,previous_filename:string>>"


def parse_pr_files(rows: DataFrame) -> DataFrame:
    """(repo, pr_number, raw JSON) -> one row a file, in order; status, additions and deletions have defaults."""
    out = rows.select("repo", "pr_number", F.posexplode(F.from_json("raw", PR_FILES)).alias("seq", "f"))
    return out.select(
        "repo", "pr_number", (F.col("seq") + 1).alias("seq"), F.col("f.filename").alias("file_path"), F.coalesce("f.status", F.lit("modified")).alias("status"),
        F.coalesce("f.additions", F.lit(0)).alias("additions"), F.coalesce("f.deletions", F.lit(0)).alias("deletions"), F.col("f.patch").alias("patch"), F.col("f.previous_filename").alias("previous_filename"),
    )


def changed_ranges(patch: Column) -> Column:
    """array<struct<start, stop>> from the hunk heads; a missing count is 1, a count of 0 still touches its start."""
    head = r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    starts, counts = F.regexp_extract_all(patch, F.lit(head), F.lit(1)), F.regexp_extract_all(patch, F.lit(head), F.lit(2))

    def span(s: Column, c: Column) -> Column:
        n = F.when(c == "", F.lit(1)).otherwise(c.cast("int"))
        return F.struct(s.cast("int").alias("start"), (s.cast("int") + F.greatest(n - 1, F.lit(0))).alias("stop"))

    return F.coalesce(F.zip_with(starts, counts, span), F.array().cast("array<struct<start:int,stop:int>>"))


def cap_pr_files(hunks: DataFrame, n: int = 20) -> DataFrame:
    """Of a pull request with more than n files the n with most additions, with their order; others whole."""
    w = Window.partitionBy("repo", "pr_number")
    out = hunks.withColumn("_all", F.count("*").over(w)).withColumn("_rank", F.row_number().over(w.orderBy(F.desc("additions"), "seq")))
    place = F.when(F.col("_all") > n, F.col("_rank")).otherwise(F.row_number().over(w.orderBy("seq")))
    return out.where((F.col("_all") <= n) | (F.col("_rank") <= n)).withColumn("position", place.cast("int")).drop("_all", "_rank")


BIN_LINES = 64


def merged_ranges(ranges: DataFrame, *keys: str) -> DataFrame:
    """(keys, start, stop): overlapping and adjacent ranges of a key as one, so that those of a key are disjoint."""
    # the hash leads the order: names of repositories and paths begin alike, so sorting by them compares them whole each time
    w = Window.partitionBy("_hash", *keys).orderBy("start", "stop")
    ranges = ranges.select(*keys, "start", "stop", F.xxhash64(*keys).alias("_hash"))
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = ranges.select("_hash", *keys, "start", "stop", F.when(F.col("start") <= reach + 1, 0).otherwise(1).alias("new"))
    islands = islands.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("_hash", *keys, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_hash", "island")


def in_bins(df: DataFrame, start: str, stop: str) -> DataFrame:
    """A row for each bin of lines that start to stop touches: what overlaps shares a bin."""
    first, last = (F.floor(F.col(c) / BIN_LINES) for c in (start, stop))
    return df.where(F.col(start) <= F.col(stop)).withColumn("bin", F.explode(F.sequence(first, last)))


def diff_symbols(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, pr_number, file_path, name, kind, start_line): the symbols that a changed range overlaps, once each."""
    ranges = hunks.select("repo", "pr_number", "file_path", F.explode(changed_ranges(F.col("patch"))).alias("r")).select("repo", "pr_number", "file_path", "r.*")
    place = F.xxhash64("repo", "file_path", "bin").alias("_hash")
    ranges = in_bins(merged_ranges(ranges, "repo", "pr_number", "file_path"), "start", "stop").select("*", place)
    hit = ranges.join(in_bins(symbols, "start_line", "end_line").select("*", place), ["_hash", "repo", "file_path", "bin"]).where("start_line <= stop and end_line >= start")
    return hit.select("repo", "pr_number", "file_path", "name", "kind", "start_line").distinct()


def diff_context(hunks: DataFrame, index: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per file of a pull request: indexed or not, its symbols and those that changed; per request the counts."""
    touched = diff_symbols(hunks, symbols).groupBy("repo", "pr_number", "file_path").agg(F.count("*").alias("n_changed"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_line", "name"))), lambda x: x["name"]), ",").alias("changed"))
    every = symbols.groupBy("repo", "file_path").agg(F.count("*").alias("n_symbols"))
    files = hunks.select("repo", "pr_number", "file_path").distinct()
    known = index.select("repo", "file_path", F.lit(True).alias("indexed"))
    out = files.join(known, ["repo", "file_path"], "left").join(every, ["repo", "file_path"], "left").join(touched, ["repo", "pr_number", "file_path"], "left")
    out = out.withColumn("indexed", F.coalesce("indexed", F.lit(False))).na.fill(0, ["n_symbols", "n_changed"]).na.fill("", ["changed"])
    w = Window.partitionBy("repo", "pr_number")
    return out.withColumn("indexed_files", F.count_if("indexed").over(w)).withColumn("total_files", F.count("*").over(w))


def reverse_dependencies(hunks: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, pr_number, file_path, src_file, n): who imports the changed files, with the number of edges."""
    files = hunks.select("repo", "pr_number", "file_path").distinct()
    e = edges.where("dst_file is not null").groupBy("repo", F.col("dst_file").alias("file_path"), "src_file").agg(F.count("*").alias("n"))
    return files.join(e, ["repo", "file_path"]).select("repo", "pr_number", "file_path", "src_file", "n")


def pack_context(context: DataFrame, index: DataFrame, importers: DataFrame, cap: int = 8000, n_importers: int = 5) -> DataFrame:
    """(repo, pr_number, file_path, prompt): head, changed symbols, first importers, and numbered content up to `cap` characters.

    importers: (repo, file_path, src_file), or with pr_number where they differ between requests.
    """
    keys = [c for c in ("repo", "pr_number", "file_path") if c in importers.columns]
    # of all importers only their number, and of the first ones their names
    each = importers.select(*keys, "src_file").distinct()
    number = each.groupBy(*keys).agg(F.count("src_file").alias("n_who"))
    first = each.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("src_file"))).where(F.col("_n") <= n_importers)
    by = number.join(first.groupBy(*keys).agg(F.sort_array(F.collect_list("src_file")).alias("who")), keys)
    # a file is numbered once, not for every request that changes it
    numbered = F.array_join(F.transform(F.split("content", "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x)), "\n")
    files = index.select("repo", "file_path", F.substring(numbered, 1, cap).alias("numbered"))
    rows = context.join(by, keys, "left").join(files, ["repo", "file_path"], "left")
    who = F.coalesce("who", F.array().cast("array<string>"))
    more = F.when(F.col("n_who") > n_importers, F.concat(F.lit(" (+"), (F.col("n_who") - n_importers).cast("string"), F.lit(" more)"))).otherwise("")
    prompt = F.concat_ws(
        "\n", F.concat(F.lit("file "), F.col("file_path")), F.concat(F.lit("changed "), F.col("changed")), F.concat(F.lit("imported by "), F.array_join(who, ","), more), "numbered"
    )
    return rows.select("repo", "pr_number", "file_path", prompt.alias("prompt"))


def parse_commit_log(raw: DataFrame) -> DataFrame:
    """(repo, file_path, raw) -> (.., ord, sha, short_sha, author, date, message); records end with 0x1e, fields with 0x1f."""
    rows = raw.select("repo", "file_path", F.posexplode(F.split("raw", "\x1e")).alias("ord", "r"))
    f = F.split(F.regexp_replace("r", r"^\s+|\s+$", ""), "\x1f")
    return rows.withColumn("f", f).where("size(f) = 5").select("repo", "file_path", "ord", *[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(("sha", "short_sha", "author", "date", "message"))])


def recent_commits(commits: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy("repo", "file_path").orderBy(F.desc(F.to_timestamp("date")), "sha")
    return commits.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def blame_summary(lines: DataFrame) -> DataFrame:
    """(repo, file_path, author, lines) from the `author ` lines of porcelain blame."""
    return lines.where(F.col("line").startswith("author ")).groupBy("repo", "file_path", F.substring("line", 8, 100000).alias("author")).agg(F.count("*").alias("lines"))
