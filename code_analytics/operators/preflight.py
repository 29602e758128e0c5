"""Which source files could get generated tests: existing tests, feasibility, preview, and the selection of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ancestors, below, first_reason, parent
from .selection import SKIP_DIRS, TEST_DIRS, in_dirs

MAX_LINES = 500


def _stem(path: str = "file_path"):
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?$", 1)


def importable_names(targets: DataFrame, roots: DataFrame) -> DataFrame:
    """(repo, file_path, name): the dotted names of a file under every package root; __init__ is left out."""
    under = targets.select("repo", "file_path", F.explode(ancestors(F.col("file_path"))).alias("root")).join(roots, ["repo", "root"])
    rest = below(F.col("file_path"), F.col("root"))
    name = F.regexp_replace(F.replace(F.regexp_replace(rest, r"\.py$", ""), F.lit("/"), F.lit(".")), r"\.?__init__$", "")
    return under.select("repo", "file_path", name.alias("name")).where("name <> ''").distinct()


def test_like(files: DataFrame) -> DataFrame:
    path = F.col("file_path")
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return files.where(path.endswith(".py") & ~in_dirs(path, SKIP_DIRS) & (in_dirs(path, TEST_DIRS) | name.startswith("test_") | name.endswith("_test.py")))


def imported_names(tests: DataFrame) -> DataFrame:
    """(repo, test_path, name): every dotted name that a test file imports, once, wherever in a line the statement stands.

    `import a.b` imports a and a.b; `from a import b, c` the names a, a.b and a.c, and b on its own.
    """
    every = lambda p, group: F.regexp_extract_all("content", F.lit(p), F.lit(group))
    dotted = every(r"\bimport\s+([\w.]+)", 1)
    prefixes = F.flatten(F.transform(dotted, lambda x: F.transform(F.sequence(F.lit(1), F.size(F.split(x, r"\."))), lambda n: F.array_join(F.slice(F.split(x, r"\."), F.lit(1), n), "."))))
    # the names behind `import` are looked at ahead, so that a second statement in the line is found, too
    source, what = (every(r"\bfrom\s+([\w.]+)\s+import\b(?=\s*([^\n]*))", g) for g in (1, 2))
    pairs = F.flatten(F.zip_with(source, what, lambda m, w: F.transform(F.regexp_extract_all(w, F.lit(r"(\w+)"), F.lit(1)), lambda x: F.concat(m, F.lit("."), x))))
    names = F.array_distinct(F.concat(prefixes, source, pairs))
    return tests.select("repo", F.col("file_path").alias("test_path"), F.explode(names).alias("name"))


def has_existing_tests(targets: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """(repo, file_path, reason): why a target counts as tested, or null. Beside it, in a test directory, or imported by a test."""
    t = targets.select("repo", "file_path", parent(F.col("file_path")).alias("dir"), _stem().alias("stem"))
    wanted = t.select("*", F.posexplode(F.array(F.concat(F.lit("test_"), F.col("stem"), F.lit(".py")), F.concat(F.col("stem"), F.lit("_test.py")))).alias("k", "test_name"))
    f = files.select("repo", F.col("file_path").alias("test_path"), parent(F.col("file_path")).alias("test_dir"), F.regexp_extract("file_path", r"([^/]+)$", 1).alias("test_name"))
    near = wanted.join(f, ["repo", "test_name"])
    sibling = near.where("dir = test_dir").select("repo", "file_path", F.struct(F.col("k").alias("rank"), "test_path").alias("o"), F.concat(F.lit("tests_exist:sibling:"), "test_path").alias("reason"))
    inside = near.where(in_dirs(F.col("test_path"), TEST_DIRS) & ~in_dirs(F.col("test_path"), SKIP_DIRS))
    inside = inside.select("repo", "file_path", F.struct(F.lit(10).alias("rank"), "test_path").alias("o"), F.concat(F.lit("tests_exist:in_test_dir:"), "test_path").alias("reason"))
    # imports are taken from the tests once and met by equal names, not by patterns for each target
    used = importable_names(targets, roots).join(imported_names(test_like(files)), ["repo", "name"])
    used = used.select("repo", "file_path", F.struct(F.lit(20).alias("rank"), "test_path").alias("o"), F.concat(F.lit("tests_exist:imports_target:"), "test_path").alias("reason"))
    best = sibling.unionByName(inside).unionByName(used).groupBy("repo", "file_path").agg(F.min_by("reason", "o").alias("reason"))
    return targets.select("repo", "file_path").join(best, ["repo", "file_path"], "left")


def prior_attempts(log: DataFrame) -> DataFrame:
    """(repo_key, target) of the files that the test generator tried."""
    rows = log.where("agent = 'test_generator'").select(F.lower("repo").alias("repo_key"), F.explode("evidence").alias("e"))
    return rows.where("e like 'target_file:%'").select("repo_key", F.substring("e", 13, 100000).alias("target")).distinct()


def is_feasible(targets: DataFrame, index: DataFrame, symbols: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """(repo, file_path, reason): the first thing that speaks against a target, or null."""
    is_class = F.col("kind").isin("class", "interface")
    public = ~F.col("name").startswith("_") & F.col("parent_class").isNull()
    counts = symbols.groupBy("repo", "file_path").agg(
        F.count("*").alias("n"),
        F.count_if(public).alias("n_public"),
        F.count_if(public & is_class).alias("n_public_classes"),
        F.count_if(public & ~is_class & (F.col("name") != "main")).alias("n_other"),
    )
    rows = targets.select("repo", "file_path").join(index.select("repo", "file_path", "language", "line_count", F.regexp_like("content", F.lit(r"""if\s+__name__\s*==\s*['"]__main__['"]""")).alias("guard")), ["repo", "file_path"], "left")
    rows = rows.join(counts, ["repo", "file_path"], "left").na.fill(0, ["n", "n_public", "n_public_classes", "n_other"])
    if log is not None:
        rows = rows.join(prior_attempts(log).withColumn("tried", F.lit(True)), (F.lower("repo") == F.col("repo_key")) & (F.col("file_path") == F.col("target")), "left")
    else:
        rows = rows.withColumn("tried", F.lit(False))
    reason = first_reason(
        (F.col("language").isNull(), "not_indexed"),
        (F.col("language") != "python", "non_python"),
        (F.col("line_count") > MAX_LINES, "too_large"),
        (F.col("n") == 0, "no_symbols"),
        (F.col("n_public") == 0, "no_public_symbols"),
        (F.regexp_extract("file_path", r"([^/]+)$", 1) == "__main__.py", "entry_point"),
        ((F.col("n_public_classes") == 0) & (F.col("n_other") == 0) & F.col("guard"), "script_main"),
        (F.coalesce("tried", F.lit(False)), "prior_attempt"),
    )
    return rows.select("repo", "file_path", reason.alias("reason"))


def preview(index: DataFrame, files: DataFrame, symbols: DataFrame, roots: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Per repository: Python files, candidates, and those that either stage rejects; the second looks at what the first left."""
    targets = index.where("language = 'python'").select("repo", "file_path")
    a = has_existing_tests(targets, files, roots).withColumnRenamed("reason", "reason_a")
    b = is_feasible(targets, index, symbols, log).withColumnRenamed("reason", "reason_b")
    rows = a.join(b, ["repo", "file_path"])
    return rows.groupBy("repo").agg(
        F.count("*").alias("files"),
        F.count_if(F.col("reason_a").isNull() & F.col("reason_b").isNull()).alias("candidates"),
        F.count_if(F.col("reason_a").isNotNull()).alias("rejected_a"),
        F.count_if(F.col("reason_a").isNull() & F.col("reason_b").isNotNull()).alias("rejected_b"),
    )


def select_jobs(summaries: DataFrame, added: DataFrame, reasons: DataFrame, enabled: bool = True, cap: int = 1) -> DataFrame:
    """(repo, skip, file_path, job_id, dropped_over_cap) from (repo, opted_in, mode, head_sha), added files and their reasons (null: good)."""
    n_added = added.groupBy("repo").agg(F.count("*").alias("n_added"))
    s = summaries.join(n_added, "repo", "left").na.fill(0, ["n_added"])
    skip = first_reason((F.lit(not enabled), "disabled"), (~F.col("opted_in"), "not_opted_in"), (F.col("mode") != "incremental", "not_incremental"), (F.col("n_added") == 0, "no_added_files"))
    s = s.withColumn("skip", skip)
    good = added.join(reasons.where("reason is null").select("repo", "file_path"), ["repo", "file_path"], "left_semi")
    w = Window.partitionBy("repo").orderBy("file_path")
    ranked = good.withColumn("n", F.row_number().over(w)).withColumn("all", F.count("*").over(Window.partitionBy("repo")))
    picked = ranked.where(F.col("n") <= cap).withColumn("dropped_over_cap", F.greatest(F.col("all") - cap, F.lit(0)))
    picked = picked.select(F.col("repo").alias("_repo"), "file_path", "dropped_over_cap")
    out = s.join(picked, (F.col("repo") == F.col("_repo")) & F.col("skip").isNull(), "left")
    job = F.concat(F.lit("generate-tests:"), F.lower("repo"), F.lit(":"), F.col("file_path"), F.lit(":"), F.substring("head_sha", 1, 7))
    return out.select("repo", "skip", "file_path", job.alias("job_id"), F.coalesce("dropped_over_cap", F.lit(0)).cast("long").alias("dropped_over_cap"))
