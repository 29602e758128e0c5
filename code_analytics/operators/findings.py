"""Findings of reviews: validated, converted, verified against the index, scored and reported."""

from __future__ import annotations

import ast
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions.text import clamp, first_reason
from .diffs import BIN_LINES, changed_ranges, in_bins, merged_ranges

# fixed values: what a finding may not say, and how a claimed syntax error is told
BANNED = (
    r"add unit tests",
    r"add (?:more )?tests",
    r"improve (?:test )?coverage",
    r"set up (?:ci|cd)",
    r"add (?:ci|cd)",
    r"configure github actions",
    r"add (?:more )?documentation",
    r"improve docs",
    r"improve code quality",
    r"follow best practices",
)
SYNTAX = (
    r"syntax\s*error",
    r"unclosed\s*paren",
    r"unparseable",
    r"cannot\s*parse",
    r"won'?t\s*parse",
    r"will\s*not\s*(?:parse|run)",
    r"missing\s*closing\s*(?:paren|bracket|brace)",
)


def parse_responses(rows: DataFrame, schema: str, required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(accepted with the struct r, rejected with the raw text): a response lacks none of the required fields."""
    parsed = rows.withColumn("r", F.from_json("raw", schema))
    good = reduce(lambda a, b: a & b, [F.col(f"r.{c}").isNotNull() for c in required])
    good = F.coalesce(good, F.lit(False))
    return parsed.where(good), parsed.where(~good).drop("r")


def convert_findings(rows: DataFrame) -> DataFrame:
    """Without rows that name no file or line; severity and kind have defaults."""
    out = rows.where("coalesce(file, '') <> '' and line > 0")
    return out.withColumn("severity", F.when(F.coalesce("severity", F.lit("")) == "", "medium").otherwise(F.col("severity"))).withColumn("kind", F.when(F.coalesce("kind", F.lit("")) == "", "quality").otherwise(F.col("kind")))


@F.pandas_udf(BooleanType())
def parses(content: pd.Series) -> pd.Series:
    """Whether a Python text parses."""

    def one(text: str | None) -> bool:
        try:
            ast.parse(text or "")
        except (SyntaxError, ValueError, RecursionError):
            return False
        return True

    return content.map(one)


def verify_findings(findings: DataFrame, index: DataFrame, hunks: DataFrame | None = None, check_syntax: bool = True) -> DataFrame:
    """`findings` with `reason`: why the first failing check drops it, or null for a verified one.

    The parser runs once for each file that a finding calls broken.
    """
    files = index.select("repo", F.col("file_path").alias("file"), "line_count", "language", F.lit(True).alias("known"))
    out = findings.join(files, ["repo", "file"], "left")
    if hunks is not None:
        spans = hunks.select("repo", F.col("file_path").alias("file"), F.explode(changed_ranges(F.col("patch"))).alias("s")).select("repo", "file", "s.*").distinct()
        # disjoint ranges: a line lies in one of them at most
        spans = in_bins(merged_ranges(spans, "repo", "file"), "start", "stop")
        spans = spans.select(F.col("repo").alias("_repo"), F.col("file").alias("_file"), F.col("bin").alias("_bin"), "start", "stop")
        here = (F.floor(F.col("line") / BIN_LINES) == F.col("_bin")) & (F.col("repo") == F.col("_repo")) & (F.col("file") == F.col("_file"))
        out = out.join(spans, here & F.col("line").between(F.col("start"), F.col("stop")), "left").withColumn("in_range", F.col("start").isNotNull()).drop("_repo", "_file", "_bin", "start", "stop")
    else:
        out = out.withColumn("in_range", F.lit(False))
    claims = reduce(lambda a, b: a | b, [F.col("description").rlike("(?i)" + p) for p in SYNTAX])
    claims = F.coalesce(claims, F.lit(False))
    out = out.withColumn("claims", claims)
    if check_syntax:
        python = index.where("language = 'python'").select("repo", F.col("file_path").alias("file"), "content")
        asked = findings.where(claims).select("repo", "file").distinct().join(python, ["repo", "file"])
        out = out.join(asked.select("repo", "file", parses("content").alias("parses")), ["repo", "file"], "left")
    else:
        out = out.withColumn("parses", F.lit(True))
    text = F.concat_ws(" ", "description", "fix_sketch")
    banned = first_reason(*[(text.rlike("(?i)" + p), f"banned phrase: {p}") for p in BANNED])
    reason = first_reason(
        (F.col("known").isNull(), "file not in index"),
        ((F.col("line") > F.col("line_count")) & ~F.coalesce("in_range", F.lit(False)), "line beyond end of file"),
        (F.col("claims") & F.coalesce("parses", F.lit(True)), "claims a syntax error but parses"),
        (banned.isNotNull(), banned),
    )
    return out.withColumn("reason", reason).drop("line_count", "language", "known", "in_range", "claims", "parses")


def structural_confidence(runs: DataFrame) -> DataFrame:
    """(.., llm_confidence, verified, original) with `confidence`."""
    scaled = clamp(F.col("llm_confidence") * F.col("verified") / F.col("original"), 0.1, 1.0)
    return runs.withColumn("confidence", F.when(F.col("original") == 0, F.col("llm_confidence")).otherwise(scaled))


def convert_milestones(rows: DataFrame, n_findings: str = "n") -> DataFrame:
    """(.., finding_indices, confidence): indices in range stay, a milestone without any goes, confidence is clamped."""
    kept = F.filter("finding_indices", lambda i: (i >= 0) & (i < F.col(n_findings)))
    return rows.withColumn("finding_indices", kept).where("size(finding_indices) > 0").withColumn("confidence", clamp(F.col("confidence"), 0.0, 1.0))


def overall_confidence(runs: DataFrame, milestones: DataFrame) -> DataFrame:
    """The mean of a run's milestones; 0.5 with findings and 0.3 without where there is none."""
    mean = milestones.groupBy("run_id").agg(F.avg("confidence").alias("mean"))
    return runs.join(mean, "run_id", "left").withColumn("overall", F.coalesce("mean", F.when(F.col("n") > 0, 0.5).otherwise(0.3))).drop("mean")


def validate_picks(picks: Column, n: Column, k: int = 5) -> Column:
    """The first k different picks in [0, n), or the first three items where none is left."""
    good = F.slice(F.array_distinct(F.filter(picks, lambda x: (x >= 0) & (x < n))), 1, k)
    first = F.when(n > 0, F.sequence(F.lit(0), F.least(F.lit(3), n) - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(good) > 0, good).otherwise(first)


def normalise_verdict(verdict: Column) -> Column:
    v = F.lower(F.regexp_replace(F.coalesce(verdict, F.lit("")), r"^\s+|\s+$", ""))
    return F.when(v.isin("approve", "comment", "request_changes"), v).otherwise("comment")


def blend_confidence(confidence: Column, verified: Column) -> Column:
    return F.when(verified, F.least(F.lit(1.0), confidence + 0.05)).otherwise(F.least(confidence, F.lit(0.4)))


def check_outputs(findings: DataFrame, rules: DataFrame, milestones: DataFrame | None = None) -> DataFrame:
    """(run_id, rule, violations) of a configured table of rules: rule, kind, pattern and n.

    Kinds: must and must_not (a pattern in the findings), min_findings (n), file_line (a finding without a file or line is a
    violation), and of milestones, where they are given (run_id, title, summary): max_milestones (n), banned_title (one
    violation for each title with the pattern) and summary (no summary of the run holds the pattern). Each rule is a
    condition of its own in one aggregate, so its pattern is compiled once.
    """
    configured = rules.collect()  # a table of configuration
    text = F.lower(F.concat_ws(" ", "file", "description", "fix_sketch"))
    rows = findings.select("run_id", text.alias("text"), (F.col("file").isNull() | (F.col("file") == "") | F.coalesce(F.col("line") <= 0, F.lit(True))).alias("bare"))

    def violations(r) -> Column | None:
        if r["kind"] in ("must", "must_not"):
            hits = F.count_if(F.col("text").rlike(r["pattern"]))
            return hits if r["kind"] == "must_not" else F.when(hits == 0, 1).otherwise(0)
        if r["kind"] == "min_findings":
            return F.when(F.count("*") < r["n"], 1).otherwise(0)
        return F.count_if("bare") if r["kind"] == "file_line" else None

    def of_milestones(r) -> Column | None:
        if r["kind"] == "max_milestones":
            return F.when(F.count("*") > r["n"], 1).otherwise(0)
        if r["kind"] == "banned_title":
            return F.count_if(F.lower("title").rlike(r["pattern"]))
        return F.when(F.count_if(F.lower("summary").rlike(r["pattern"])) == 0, 1).otherwise(0) if r["kind"] == "summary" else None

    found = []
    for frame, rule in ((rows, violations), (milestones, of_milestones)):
        counts = [c.cast("long").alias(r["rule"]) for r in configured if frame is not None and (c := rule(r)) is not None]
        if counts:
            names = [r["rule"] for r in configured if rule(r) is not None]
            each = F.explode(F.array(*[F.struct(F.lit(x).alias("rule"), F.col(f"`{x}`").alias("violations")) for x in names]))
            found.append(frame.groupBy("run_id").agg(*counts).select("run_id", each.alias("v")).select("run_id", "v.*"))
    none = findings.select("run_id", F.lit("").alias("rule"), F.lit(0).cast("long").alias("violations")).limit(0)
    return reduce(DataFrame.unionByName, found, none).where("violations > 0")


def render_reports(findings: DataFrame, collapse_at: int = 6) -> DataFrame:
    """(run_id, n_findings, n_files, collapsed, body): findings by file in first-seen order."""
    by_file = findings.groupBy("run_id", "file").agg(F.min("seq").alias("first"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("seq", "line", "severity", "description"))).alias("items"))
    block = F.concat(F.lit("### "), F.col("file"), F.lit("\n"), F.array_join(F.transform("items", lambda x: F.concat(F.lit("- L"), x["line"].cast("string"), F.lit(" ["), x["severity"], F.lit("] "), x["description"])), "\n"))
    rows = by_file.select("run_id", "first", "n", block.alias("block"))
    out = rows.groupBy("run_id").agg(F.sum("n").alias("n_findings"), F.count("*").alias("n_files"), F.sort_array(F.collect_list(F.struct("first", "block"))).alias("b"))
    return out.select("run_id", "n_findings", "n_files", (F.col("n_findings") >= collapse_at).alias("collapsed"), F.array_join(F.transform("b", lambda x: x["block"]), "\n").alias("body"))


def render_milestones(milestones: DataFrame, findings: DataFrame, collapse_at: int = 6) -> DataFrame:
    """(run_id, milestone, n_cited, collapsed, body): the issue body of each milestone (run_id, milestone, summary, finding_indices, confidence).

    Cited are the findings (run_id, idx, ...) of the run at the indices, in the order of the indices; others are left out.
    A milestone that cites none has its summary and confidence only.
    """
    item = F.concat(F.lit("- [ ] **"), F.upper("severity"), F.lit("** _"), F.col("kind"), F.lit("_ at `"), F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit("`\n  "), F.coalesce("description", F.lit("")))
    item = F.concat(item, F.when(F.col("fix_sketch") != "", F.concat(F.lit("\n  fix: "), F.col("fix_sketch"))).otherwise(""))
    items = findings.select("run_id", F.col("idx").cast("int").alias("idx"), item.alias("item"))
    places = milestones.select("run_id", "milestone", F.posexplode("finding_indices").alias("place", "idx")).withColumn("idx", F.col("idx").cast("int"))
    cited = places.join(items, ["run_id", "idx"]).groupBy("run_id", "milestone").agg(F.sort_array(F.collect_list(F.struct("place", "item"))).alias("cited"))
    out = milestones.join(cited, ["run_id", "milestone"], "left").withColumn("n_cited", F.when(F.col("cited").isNull(), 0).otherwise(F.size("cited")))
    head = F.concat(F.lit("> "), F.trim(F.coalesce("summary", F.lit(""))), F.lit("\n\n_Confidence: "), F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%_"))
    tail = F.concat(F.lit("\n\n## Findings ("), F.col("n_cited").cast("string"), F.lit(")\n\n"), F.array_join(F.transform("cited", lambda x: x["item"]), "\n"))
    body = F.concat(head, F.when(F.col("n_cited") > 0, tail).otherwise(""))
    return out.select("run_id", "milestone", "n_cited", (F.col("n_cited") >= collapse_at).alias("collapsed"), body.alias("body"))
