"""Decisions: signatures, thresholds, the gate, and the append-only action log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.tables import VersionedTable

# fixed values: least confidence of each action, and the characters of a body that count
THRESHOLDS = {
    "comment": 0.3,
    "label": 0.5,
    "edit_issue": 0.75,
    "create_issue": 0.7,
    "close_issue": 0.8,
    "create_branch": 0.9,
    "update_file": 0.9,
    "open_pr": 0.9,
}
BODY_CHARS = 200
KEY = ("repo_key", "agent", "action", "signature")


def _field(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def decision_signature(df: DataFrame) -> DataFrame:
    """`df` with repo_key and signature. Optional columns: issue, title, body, keys, labels, label, ref, base_sha, branch, path, content, head, base."""
    f = lambda c: F.coalesce(_field(df, c), F.lit(""))
    issue = F.coalesce(_field(df, "issue").cast("string"), F.lit("None"))
    body = F.substring(strip(f("body")), 1, BODY_CHARS)
    keys, labels = _field(df, "keys", "array<string>"), _field(df, "labels", "array<string>")
    title = F.when(F.size(keys) > 0, F.array_join(F.sort_array(keys), "\n")).otherwise(F.lower(strip(f("title"))))
    some_labels = F.array_join(F.sort_array(F.filter(F.coalesce(labels, F.array().cast("array<string>")), lambda x: x != "")), ",")
    shapes = {
        "create_issue": (title,),
        "comment": (issue, body),
        "close_issue": (issue,),
        "edit_issue": (issue, strip(f("title")), body),
        "add_label": (issue, some_labels),
        "remove_label": (issue, f("label")),
        "create_branch": (f("ref"), f("base_sha")),
        "update_file": (f("branch"), f("path"), F.sha2(f("content"), 256)),
        "open_pr": (f("head"), f("base")),
    }
    repo = F.lower(strip(F.col("repo")))
    text = F.raise_error(F.concat(F.lit("no signature for action "), F.coalesce("action", F.lit("null")))).cast("string")
    for action, fields in shapes.items():
        text = F.when(F.col("action") == action, F.concat_ws("\n", repo, F.lit(action), *fields)).otherwise(text)
    text = F.when(F.coalesce(repo, F.lit("")) == "", F.raise_error(F.lit("a decision needs a repo")).cast("string")).otherwise(text)
    return df.withColumn("repo_key", repo).withColumn("signature", F.sha2(text, 256))


def with_threshold(df: DataFrame, table: dict[str, float] | None = None) -> DataFrame:
    """`df` with the threshold of its action; an action without one is an error."""
    m = F.create_map(*[F.lit(x) for kv in (table or THRESHOLDS).items() for x in kv])
    found = F.element_at(m, F.col("action"))
    return df.withColumn("threshold", F.coalesce(found, F.raise_error(F.concat(F.lit("no threshold for action "), F.coalesce("action", F.lit("null")))).cast("double")))


def gate_decisions(decisions: DataFrame, mode: str, log: DataFrame | None = None, table: dict[str, float] | None = None) -> DataFrame:
    """`decisions` (seq, repo, agent, action, confidence, client_ok, ..) with outcome, recorded and final_action.

    client_ok is null without a client and false where the client failed. What happens to a row by itself is decided first;
    then a row after the first recorded one with its key, in the log or in the batch, is deduped.
    """
    df = with_threshold(decision_signature(decisions), table)
    low = F.col("confidence") < F.col("threshold")
    comment_only = F.lit(mode == "comment") & (F.col("action") != "comment")
    ran = F.when(F.lit(mode == "shadow"), "shadow_logged").when(F.col("client_ok").isNull(), "rejected_no_client").when(F.col("client_ok"), "executed").otherwise("error")
    outcome = F.when(low, "downgraded_low_confidence").when(comment_only, "downgraded_write_mode").otherwise(ran)
    df = df.withColumn("final_action", F.when(low | comment_only, "comment").otherwise(F.col("action")))
    df = df.withColumn("ran", ran).withColumn("outcome", outcome)
    record = ~F.col("ran").isin("error", "rejected_no_client") & (F.lit(mode == "shadow") | (F.col("ran") == "executed"))
    df = df.withColumn("record", record)
    first = F.min(F.when(F.col("record"), F.col("seq"))).over(Window.partitionBy(*KEY))
    df = df.withColumn("first", first)
    if log is not None:
        df = df.join(log.select(*KEY, F.lit(True).alias("logged")).distinct(), list(KEY), "left")
    else:
        df = df.withColumn("logged", F.lit(False))
    dup = F.coalesce("logged", F.lit(False)) | F.coalesce(F.col("seq") > F.col("first"), F.lit(False))
    # a downgraded row that could not be posted keeps the client's outcome
    failed = F.col("ran").isin("error", "rejected_no_client")
    out = df.withColumn("outcome", F.when(dup, "deduped").when(failed, F.col("ran")).otherwise(F.col("outcome")))
    return out.withColumn("recorded", ~dup & F.col("record")).drop("ran", "record", "first", "logged")


def dedupe_decisions(decisions: DataFrame, log: DataFrame) -> DataFrame:
    """`decisions` (with key columns, seq and ok) that are new: not in the log, not after the first good one of their key."""
    fresh = decisions.join(log.select(*KEY).distinct(), list(KEY), "left_anti")
    first = F.min(F.when(F.col("ok"), F.col("seq"))).over(Window.partitionBy(*KEY))
    return fresh.withColumn("_f", first).where("_f is null or seq <= _f").drop("_f")


def execute_chain(rows: DataFrame) -> DataFrame:
    """Of (chain, step, outcome) the steps up to and with the first that makes no progress."""
    stop = F.when(F.col("outcome").isin("executed", "shadow_logged", "deduped"), 0).otherwise(1)
    before = F.coalesce(F.sum(stop).over(Window.partitionBy("chain").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_b", before).where("_b = 0").drop("_b")


def skip_reviewed(prs: DataFrame, log: DataFrame) -> DataFrame:
    """`prs` (repo, pr_number, head_sha) whose head was not reviewed: no pr_reviewer row of the repo has it as evidence."""
    seen = log.where("agent = 'pr_reviewer'").select(F.lower("repo").alias("_r"), F.explode("evidence").alias("_e")).distinct()
    return prs.join(seen, (F.lower("repo") == F.col("_r")) & (F.concat(F.lit("head_sha:"), F.col("head_sha")) == F.col("_e")), "left_anti")


def summarise_outcomes(rows: DataFrame, *keys: str) -> DataFrame:
    by = lambda *x: F.count_if(F.col("outcome").isin(*x))
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), by("executed", "shadow_logged").alias("executed"), by("deduped").alias("deduped"), by("downgraded_low_confidence", "downgraded_write_mode").alias("downgraded"), by("error", "rejected_no_client").alias("errors"))


LOG_SCHEMA = "repo_key string, agent string, action string, signature string, seq long, outcome string, confidence double"


def append_actions(log: VersionedTable, gated: DataFrame) -> int:
    """Adds the recorded rows to the log. Any number of writers may append at once: each stages its rows and publishes them whole."""
    return log.append(gated.where("recorded"))


def recorded_actions(log: VersionedTable) -> DataFrame:
    """The rows of the log, of each key only the one recorded first: writers that didn't see each other may both have recorded it."""
    w = Window.partitionBy(*KEY).orderBy("published", "seq")
    return log.read().withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def build_review_decisions(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """One comment a review (run_id, repo, issue, verdict, confidence): its body and evidence name the verdict, the count and the first three findings."""
    first = findings.withColumn("_n", F.row_number().over(Window.partitionBy("run_id").orderBy("seq", "file", "line"))).where("_n <= 3")
    items = findings.groupBy("run_id").agg(F.count("*").alias("n")).join(first.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("seq", "file", "line"))).alias("f")), "run_id")
    cited = F.transform("f", lambda x: F.concat(x["file"], F.lit(":"), x["line"].cast("string")))
    out = runs.join(items, "run_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    evidence = F.concat(F.array(F.concat(F.lit("verdict:"), "verdict"), F.concat(F.lit("findings:"), F.col("n").cast("string"))), F.coalesce(cited, F.array().cast("array<string>")))
    return out.select("run_id", "repo", "issue", F.lit("comment").alias("action"), F.array_join(evidence, "\n").alias("body"), evidence.alias("evidence"), "confidence")


def build_issue_decisions(milestones: DataFrame, findings: DataFrame) -> DataFrame:
    """One create_issue a milestone (run_id, milestone, repo, title, finding_indices, confidence), with its sorted file:line keys."""
    picked = milestones.select("run_id", "milestone", F.explode("finding_indices").alias("idx")).distinct()
    keys = picked.join(findings.select("run_id", "idx", F.concat("file", F.lit(":"), F.col("line").cast("string")).alias("key")), ["run_id", "idx"])
    keys = keys.groupBy("run_id", "milestone").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    return milestones.join(keys, ["run_id", "milestone"], "left").select("run_id", "milestone", "repo", F.lit("create_issue").alias("action"), "title", "keys", "confidence")


def build_test_decisions(tests: DataFrame) -> DataFrame:
    """Three chained actions for each generated test (repo, target, base_sha, content, confidence): branch, file, pull request."""
    slug = F.regexp_replace(F.regexp_replace(F.lower("target"), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    branch = F.concat(F.lit("tests/"), slug)
    path = F.concat(F.lit("tests/test_"), F.regexp_extract("target", r"([^/]+?)(?:\.[^./]+)?$", 1), F.lit(".py"))
    steps = F.explode(F.array(F.struct(F.lit(1).alias("step"), F.lit("create_branch").alias("action")), F.struct(F.lit(2).alias("step"), F.lit("update_file").alias("action")), F.struct(F.lit(3).alias("step"), F.lit("open_pr").alias("action"))))
    return tests.select("repo", "target", branch.alias("branch"), path.alias("path"), "base_sha", "content", "confidence", steps.alias("s")).select("*", "s.step", "s.action", F.col("branch").alias("ref"), F.col("branch").alias("head"), F.lit("main").alias("base")).drop("s")
