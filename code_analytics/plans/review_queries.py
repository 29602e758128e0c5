"""Registered queries on diffs, findings, decisions, and deliveries. Each has the SQL it must equal where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import decisions as A
from ..operators import diffs as D
from ..operators import events as E
from ..operators import findings as R
from ..sources.corpus import cte, derived, table
from ..sources.shared import shared_folder
from ..sources.tables import VersionedTable
from ..streaming import reindex
from . import code_queries
from .code_queries import _LINES, _SEL, _SYMBOLS, _index, _stored_index, _stored_symbols, _symbols, _with


def _hunks(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "hunks")


def d1_parse_pr_files(spark: SparkSession, d: str) -> DataFrame:
    """The hunks as JSON lists, one for each pull request, and parsed again."""
    h = _hunks(spark, d)
    f = F.struct(F.col("file_path").alias("filename"), F.when(F.col("seq") % 3 > 0, F.col("status")).alias("status"), F.when(F.col("seq") % 5 > 0, F.col("additions")).alias("additions"), F.col("deletions").alias("deletions"), "patch")
    raw = h.groupBy("repo", "pr_number").agg(F.sort_array(F.collect_list(F.struct("seq", f.alias("f")))).alias("l")).select("repo", "pr_number", F.to_json(F.transform("l", lambda x: x["f"])).alias("raw"))
    return D.parse_pr_files(raw).select("repo", "pr_number", "seq", "file_path", "status", "additions", "deletions", "patch")


def d2_changed_ranges(spark: SparkSession, d: str) -> DataFrame:
    return _hunks(spark, d).select("repo", "pr_number", F.col("seq").cast("long").alias("seq"), F.posexplode(D.changed_ranges(F.col("patch"))).alias("k", "r")).select("repo", "pr_number", "seq", "k", F.col("r.start").alias("start"), F.col("r.stop").alias("stop"))


def d3_cap_pr_files(spark: SparkSession, d: str) -> DataFrame:
    return D.cap_pr_files(_hunks(spark, d), 2).select("repo", "pr_number", F.col("seq").cast("long").alias("seq"), "additions", "position")


def d4_diff_context(spark: SparkSession, d: str) -> DataFrame:
    return D.diff_context(_hunks(spark, d), _index(spark, d), _stored_symbols(spark, d))


def d5_reverse_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return D.reverse_dependencies(_hunks(spark, d), _part_edges(spark, d))


def _part_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each order's parts depend on the part before them."""
    k = F.col("l_partkey")
    name = lambda x: F.concat(F.lit("src/pkg"), (F.floor(x / 5.0) % 8).cast("string"), F.lit("/m"), F.floor(x / 5.0).cast("string"), F.lit(".py"))
    return table(spark, d, "lineitem").select(F.concat(F.lit("org/repo"), (k % 5).cast("string")).alias("repo"), name(k + 10).alias("src_file"), name(k).alias("dst_file"))


def d6_pack_context(spark: SparkSession, d: str) -> DataFrame:
    h, index = _hunks(spark, d), _index(spark, d)
    context = D.diff_context(h, index, _stored_symbols(spark, d))
    # who imports a file is the same for every request
    importers = _part_edges(spark, d).withColumnRenamed("dst_file", "file_path")
    out = D.pack_context(context, index, importers, cap=400)
    return out.select("repo", "pr_number", "file_path", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("hash"))


def _log_rows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    rec = F.concat_ws("\x1f", F.concat(F.lit("sha"), F.col("o_orderkey").cast("string")), F.lit("s"), F.concat(F.lit("a"), (F.col("o_custkey") % 7).cast("string")), date, F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderpriority")))
    path = F.concat(F.lit("f"), F.col("o_custkey").cast("string"))
    return o.select(path.alias("file_path"), F.col("o_orderkey").alias("k"), rec.alias("rec"))


def h1_parse_commit_log(spark: SparkSession, d: str) -> DataFrame:
    raw = _log_rows(spark, d).groupBy("file_path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "rec"))), lambda x: x["rec"]), "\x1e\n").alias("raw")).withColumn("repo", F.lit("r"))
    return D.parse_commit_log(raw).select("file_path", "sha", "author", "date", "message")


def h2_recent_commits(spark: SparkSession, d: str) -> DataFrame:
    return D.recent_commits(h1_parse_commit_log(spark, d).withColumn("repo", F.lit("r"))).select("file_path", "sha", "position")


def h3_blame_summary(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    line = F.when(k % 3 == 0, F.concat(F.lit("author a"), (F.col("l_suppkey") % 9).cast("string"))).otherwise("author-mail x")
    rows = table(spark, d, "lineitem").select(F.lit("r").alias("repo"), F.concat(F.lit("f"), (F.col("l_partkey") % 100).cast("string")).alias("file_path"), line.alias("line"))
    return D.blame_summary(rows)


def f1_parse_responses(spark: SparkSession, d: str) -> DataFrame:
    """Answers in JSON: some lack a field, some have a wrong type, some are no JSON."""
    k = F.col("o_orderkey")
    text = (
        F.when(k % 7 == 0, F.lit("no json"))
        .when(k % 5 == 0, F.concat(F.lit('{"verdict":"ok"'), F.lit("}")))
        .when(k % 11 == 0, F.concat(F.lit('{"verdict":"ok","score":"x'), k.cast("string"), F.lit('"}')))
        .otherwise(F.concat(F.lit('{"verdict":"ok","score":'), (k % 100).cast("string"), F.lit("}")))
    )
    ok, bad = R.parse_responses(table(spark, d, "orders").select(k.alias("id"), text.alias("raw")), "verdict string, score int", ("verdict", "score"))
    return ok.select("id", F.col("r.score").cast("double").alias("score"), F.lit(None).cast("string").alias("rejected")).unionByName(bad.select("id", F.lit(None).cast("double").alias("score"), F.col("raw").alias("rejected")))


def f2_convert_findings(spark: SparkSession, d: str) -> DataFrame:
    return R.convert_findings(derived(spark, d, "findings")).select("run_id", "seq", "file", "line", "severity", "kind")


def f3_verify_findings(spark: SparkSession, d: str) -> DataFrame:
    f = R.convert_findings(derived(spark, d, "findings"))
    return R.verify_findings(f, _index(spark, d), _hunks(spark, d)).select("run_id", "seq", "reason")


def f4_structural_confidence(spark: SparkSession, d: str) -> DataFrame:
    f = R.verify_findings(R.convert_findings(derived(spark, d, "findings")), _index(spark, d))
    runs = f.groupBy("run_id").agg(F.count("*").alias("original"), F.count_if(F.col("reason").isNull()).alias("verified")).withColumn("llm_confidence", (F.col("run_id") % 10) / 10.0)
    return R.structural_confidence(runs).select("run_id", "original", "verified", F.round("confidence", 6).alias("confidence"))


def _milestones(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    i = lambda x: (x % 12 - 2).cast("int")
    return table(spark, d, "orders").select((k % 40).alias("run_id"), k.alias("seq"), F.array(i(k), i(k + 5), i(k * 3)).alias("finding_indices"), ((k % 15) / 10.0 - 0.2).alias("confidence"), (k % 6).cast("int").alias("n"))


def f5_overall_confidence(spark: SparkSession, d: str) -> DataFrame:
    m = _milestones(spark, d)
    runs = m.select("run_id").distinct().withColumn("n", (F.col("run_id") % 3).cast("int"))
    return R.overall_confidence(runs, R.convert_milestones(m).where("run_id % 4 > 0")).select("run_id", F.round("overall", 6).alias("overall"))


def f6_validate_picks(spark: SparkSession, d: str) -> DataFrame:
    p = R.validate_picks(F.col("finding_indices"), F.col("n"), 2)
    return _milestones(spark, d).select("seq", F.array_join(F.transform(p, lambda x: x.cast("string")), ",").alias("picks"))


def f7_normalise_verdict(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    v = F.element_at(F.array(*[F.lit(x) for x in (" Approve ", "comment", "REQUEST_CHANGES", "maybe", "")]), (k % 5 + 1).cast("int"))
    c = (k % 15) / 10.0 - 0.2
    return table(spark, d, "orders").select(k.alias("id"), R.normalise_verdict(v).alias("verdict"), F.round(R.clamp(c, 0.0, 1.0), 6).alias("confidence"))


def f8_blend_confidence(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), F.round(R.blend_confidence((k % 101) / 100.0, k % 2 == 0), 6).alias("confidence"))


def f9_check_outputs(spark: SparkSession, d: str) -> DataFrame:
    rules = table(spark, d, "region").where("r_regionkey < 3").select(
        F.concat(F.lit("rule"), F.col("r_regionkey").cast("string")).alias("rule"),
        F.element_at(F.array(F.lit("must"), F.lit("must_not"), F.lit("min_findings")), (F.col("r_regionkey") + 1).cast("int")).alias("kind"),
        F.element_at(F.array(F.lit("unclosed"), F.lit("improve docs"), F.lit("")), (F.col("r_regionkey") + 1).cast("int")).alias("pattern"),
        F.lit(31).cast("long").alias("n"),
    )
    return R.check_outputs(derived(spark, d, "findings"), rules)


def f10_render_reports(spark: SparkSession, d: str) -> DataFrame:
    f = derived(spark, d, "findings").withColumn("run_id", F.col("seq") % 1000)
    return R.render_reports(f).select("run_id", "n_findings", "n_files", "collapsed", "body")


def f10_milestone_bodies(spark: SparkSession, d: str) -> DataFrame:
    f = R.convert_findings(derived(spark, d, "findings")).withColumn("idx", F.row_number().over(Window.partitionBy("run_id").orderBy("seq")) - 1)
    m = _milestones(spark, d).select("run_id", F.col("seq").alias("milestone"), F.concat(F.lit(" milestone "), F.col("seq").cast("string")).alias("summary"), "finding_indices", ((F.col("seq") % 100) / 100).alias("confidence"))
    return R.render_milestones(m, f).select("run_id", "milestone", "n_cited", "collapsed", "body")


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "decisions")


def a1_review_decisions(spark: SparkSession, d: str) -> DataFrame:
    f = R.convert_findings(derived(spark, d, "findings"))
    runs = f.groupBy("run_id").agg(F.min("repo").alias("repo")).select("run_id", "repo", F.col("run_id").alias("issue"), F.when(F.col("run_id") % 2 == 0, "approve").otherwise("comment").alias("verdict"), F.lit(0.9).alias("confidence"))
    return A.build_review_decisions(runs, f).select("run_id", "repo", "action", "body", F.size("evidence").alias("n_evidence"))


def a1_issue_decisions(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("seq")) - 1
    f = R.convert_findings(derived(spark, d, "findings")).withColumn("idx", place)
    m = _milestones(spark, d).select("run_id", F.col("seq").alias("milestone"), F.lit("org/r").alias("repo"), F.lit("t").alias("title"), "finding_indices", "confidence")
    return A.build_issue_decisions(m, f).select("run_id", "milestone", "action", F.md5(F.array_join("keys", ",")).alias("keys_hash"))


def a1_test_decisions(spark: SparkSession, d: str) -> DataFrame:
    t = _index(spark, d).select("repo", F.col("file_path").alias("target"), F.lit("abc").alias("base_sha"), "content", F.lit(0.95).alias("confidence"))
    return A.build_test_decisions(t).select("repo", "target", "branch", "path", "step", "action")


def a2_decision_signature(spark: SparkSession, d: str) -> DataFrame:
    return A.decision_signature(_decisions(spark, d)).select("seq", "repo_key", "signature")


def a3_with_threshold(spark: SparkSession, d: str) -> DataFrame:
    return A.with_threshold(_decisions(spark, d)).select("seq", "threshold")


def a4_gate_full(spark: SparkSession, d: str) -> DataFrame:
    return A.gate_decisions(_decisions(spark, d), "full").select("seq", "outcome", "recorded", "final_action")


def a4_gate_comment(spark: SparkSession, d: str) -> DataFrame:
    return A.gate_decisions(_decisions(spark, d), "comment").select("seq", "outcome", "recorded", "final_action")


def a5_dedupe_decisions(spark: SparkSession, d: str) -> DataFrame:
    rows = A.decision_signature(_decisions(spark, d)).withColumn("ok", F.col("client_ok"))
    return A.dedupe_decisions(rows, rows.where("seq % 97 = 0")).select("seq", "agent", "action", "signature")


def a6_execute_chain(spark: SparkSession, d: str) -> DataFrame:
    bad = F.col("l_quantity") > 45
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chain"), F.col("l_linenumber").alias("step"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.when(bad, "error").otherwise("executed").alias("outcome"))
    rows = rows.groupBy("chain", "step").agg(F.max("outcome").alias("outcome"))
    return A.execute_chain(rows)


def a7_skip_reviewed(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    prs = table(spark, d, "orders").select(F.concat(F.lit("Org/R"), (k % 5).cast("string")).alias("repo"), k.alias("pr_number"), F.concat(F.lit("s"), (k % 300).cast("string")).alias("head_sha"))
    log = table(spark, d, "customer").select(
        F.concat(F.lit("org/r"), (F.col("c_custkey") % 5).cast("string")).alias("repo"), F.when(F.col("c_custkey") % 3 > 0, "pr_reviewer").otherwise("onboarding").alias("agent"), F.array(F.lit("x"), F.concat(F.lit("head_sha:s"), (F.col("c_custkey") % 200).cast("string"))).alias("evidence")
    )
    return A.skip_reviewed(prs, log)


def a8_summarise_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return A.summarise_outcomes(A.gate_decisions(_decisions(spark, d), "full"), "agent", "action")


def e1_verify_hmac(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth delivery carries a signature of another secret."""
    raw = derived(spark, d, "deliveries").select("delivery_id", "raw")
    signed = raw.withColumn("signature", F.concat(F.lit("sha256="), F.when(F.col("delivery_id") % 5 == 0, E.hmac_sha256(F.col("raw"), b"other")).otherwise(E.hmac_sha256(F.col("raw"), b"secret"))))
    return E.verify_hmac(signed, b"secret").select("delivery_id", "valid")


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return E.parse_deliveries(derived(spark, d, "deliveries"))


def e2_parse_deliveries(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select("delivery_id", "event", "action", "pr_number", "head_sha", "issue_number", "after_sha", "repo_full_name", "sender_login", "sender_type")


def e4_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return E.dispatch(_parsed(spark, d)).select("delivery_id", "function_name", "job_id")


def e3_classify_deliveries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("delivery_id")
    rows = E.dispatch(_parsed(spark, d)).withColumns(
        {"has_secret": k % 101 > 0, "signature": F.when(k % 97 > 0, "s"), "valid": k % 89 > 0, "cooling": k % 4 == 0, "queue_ok": k % 83 > 0, "duplicate": k % 6 == 0, "event": F.when(k % 79 == 0, "ping").otherwise(F.col("event"))}
    )
    return E.classify_deliveries(rows).select("delivery_id", "status", "reason", "http_code")


def e5_dedupe_jobs(spark: SparkSession, d: str) -> DataFrame:
    jobs = E.dispatch(_parsed(spark, d)).where("job_id is not null")
    return E.dedupe_jobs(jobs.select("delivery_id", "ts", "job_id"), 86400.0 * 365).select("delivery_id", "job_id")


def e6_cooldown(spark: SparkSession, d: str) -> DataFrame:
    return E.cooldown(table(spark, d, "events"), F.col("user_id").cast("string"), "ts", "event_id", 6 * 3600.0).select("key", "id")


def e7_admit(spark: SparkSession, d: str) -> DataFrame:
    jobs = E.dispatch(_parsed(spark, d)).where("job_id is not null")
    return E.admit(jobs, 6 * 3600.0, 7 * 86400.0)


def e9_delivery_stats(spark: SparkSession, d: str) -> DataFrame:
    return E.delivery_stats(table(spark, d, "events"), "ts", "event_type", "1 day").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def e8_reindex_stream(spark: SparkSession, d: str) -> DataFrame:
    """The changes from the first snapshot to the second as files, streamed into the stored index in three batches; then a batch comes again."""
    index, folder = _stored_index(spark, d), f"{shared_folder(spark)}/changes-{uuid.uuid4().hex}"
    old, new = derived(spark, d, "code_files"), derived(spark, d, "code_files_v2")
    rows = C.snapshot_diff(old, new).join(new, ["repo", "file_path"], "left").withColumn("at", F.lit("2026-01-01").cast("timestamp"))
    rows.select("repo", "file_path", "status", "content", "at").repartition(3, "repo", "file_path").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(reindex.CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    reindex.reindex(stream, index, f"{folder}/checkpoint").awaitTermination()
    reindex.merge_batches(index, "reindex")(spark.read.schema(reindex.CHANGES).parquet(f"{folder}/in"), 1)
    return index.read().select("repo", "file_path", F.md5("content").alias("hash"))


def s11_action_log(spark: SparkSession, d: str) -> DataFrame:
    """Two writers that don't see each other's rows append to one log; of a key the one recorded first counts."""
    log = VersionedTable(spark, f"{shared_folder(spark)}/log-{uuid.uuid4().hex}", A.LOG_SCHEMA, "repo_key", 8)
    for writer in (0, 1):
        A.append_actions(log, A.gate_decisions(_decisions(spark, d).where(F.col("seq") % 2 == writer), "full"))
    return A.recorded_actions(log).select("seq", "repo_key", "agent", "action", "signature", "outcome", "published")


QUERIES = {k: v for k, v in list(globals().items()) if k[:1] in "dhfaes" and k[1:2].isdigit() and callable(v)}

_H = cte("hunks")
_RANGES = r"""rg as (select repo, pr_number, seq, file_path, row_number() over () as z, unnest(range(0,len(a))) as k, unnest(a) as a, unnest(b) as b from (select *, regexp_extract_all(patch,'@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@',1) as a, regexp_extract_all(patch,'@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@',2) as b from hunks)),
rr as (select repo, pr_number, seq, file_path, cast(k as int) as k, cast(a as int) as start, cast(a as int)+greatest((case when b='' or b is null then 1 else cast(b as int) end)-1,0) as stop from rg)"""
_F = cte("findings")
_CONV = "conv as (select run_id, seq, repo, file, line, case when severity='' then 'medium' else severity end as severity, case when kind='' then 'quality' else kind end as kind, description, fix_sketch from findings where coalesce(file,'')<>'' and line>0)"
_HB = _H.replace("with ", "", 1)
_FB = _F.replace("with ", "", 1)
_VERDICT = """case when i.file_path is null then 'file not in index' when line>line_count and not {hit} then 'line beyond end of file'
  when regexp_matches(description,'(?i)syntax\\s*error|unclosed\\s*paren') and not (language='python' and contains(content,'from .m-')) then 'claims a syntax error but parses'
  when regexp_matches(description,'(?i)add unit tests') then 'banned phrase: add unit tests' when regexp_matches(description||' '||fix_sketch,'(?i)improve docs') then 'banned phrase: improve docs' end"""
_DB = cte("decisions").replace("with ", "", 1)
_SIG = r"""sg as (select *, lower(trim(repo)) as repo_key, sha256(lower(trim(repo))||chr(10)||action||chr(10)||case action when 'comment' then cast(issue as varchar)||chr(10)||left(trim(body),200) when 'create_issue' then lower(trim(title)) when 'close_issue' then cast(issue as varchar) else cast(issue as varchar)||chr(10)||trim(title)||chr(10)||left(trim(body),200) end) as signature,
  case action when 'comment' then 0.3 when 'create_issue' then 0.7 when 'close_issue' then 0.8 else 0.75 end::double as threshold from decisions)"""


def _gate(mode: str) -> str:
    down = "false" if mode == "full" else "action<>'comment'"
    return f"""with {_DB}, {_SIG}, fr as (select *, min(case when client_ok then seq end) over (partition by repo_key, agent, action, signature) as f from sg)
      select seq, case when seq>f then 'deduped' when not client_ok then 'error' when confidence<threshold then 'downgraded_low_confidence' when {down} then 'downgraded_write_mode' else 'executed' end as outcome,
      coalesce(seq<=f,true) and client_ok as recorded, case when confidence<threshold or {down} then 'comment' else action end as final_action from fr"""


_DLB = cte("deliveries").replace("with ", "", 1)
_EV = """ev as (select delivery_id, ts, event, json_extract_string(raw,'$.action') as action, cast(json_extract(raw,'$.pull_request.number') as int) as pr_number, json_extract_string(raw,'$.pull_request.head.sha') as head_sha, cast(json_extract(raw,'$.issue.number') as int) as issue_number,
  json_extract_string(raw,'$.after') as after_sha, json_extract_string(raw,'$.repository.full_name') as repo_full_name, json_extract_string(raw,'$.sender.login') as sender_login, json_extract_string(raw,'$.sender.type') as sender_type from deliveries)"""
_RT = """dp as (select *, lower(repo_full_name) as rk, case when event='pull_request' and action in ('opened','synchronize') and pr_number<>0 then 'review_pr' when event='issues' and action='opened' and issue_number<>0 then 'onboard_repo' when event='push' then 'reindex_repo' end as fn from ev),
jb as (select *, case fn when 'review_pr' then 'review-pr:'||rk||':'||pr_number when 'onboard_repo' then 'onboard:'||rk||':'||issue_number when 'reindex_repo' then 'reindex:'||rk||':'||after_sha end as job_id from dp)"""


def _greedy(rows: str, seconds: int, out: str) -> str:
    """Accepted rows of (key, t, id), one step of the recursion for each accepted row of a key."""
    return f"""recursive src as ({rows}), acc as (select key, min((t, id)) as m from src group by key union all
      select a.key, (select min((s.t, s.id)) from src s where s.key=a.key and s.t >= a.m[1] + {seconds * 1000000}) from acc a where a.m is not null) select {out} from acc where m is not null"""


_ADMIT = """jr as materialized (select rk as key, epoch_us(ts) as t, delivery_id as id, job_id, row_number() over (partition by rk order by ts, delivery_id, job_id) as rn from jb where job_id is not null),
st as (select distinct key, 0::bigint as rn, null::bigint as last, []::struct(job varchar, t bigint)[] as live, null::bigint as id, null::varchar as outcome from jr union all
  select key, rn, case when outcome='dispatched' then t else last end, case when outcome='dispatched' then list_append(live, {{'job': job_id, 't': t}}) else live end, id, outcome from (
    select *, case when t - last < {w} then 'cooldown' when list_contains(list_transform(live, lambda x: x.job), job_id) then 'duplicate' else 'dispatched' end as outcome from (
      select j.key, j.rn, j.t, j.id, j.job_id, s.last, list_filter(s.live, lambda x: j.t - x.t < {h}) as live from st s join jr j on j.key=s.key and j.rn=s.rn+1)))
select id as delivery_id, outcome from st where rn > 0"""

ORACLE_SQL = {
    "d1_parse_pr_files": _H + " select repo, pr_number, cast(row_number() over (partition by repo, pr_number order by seq) as int) as seq, file_path, case when seq%3>0 then status else 'modified' end as status, case when seq%5>0 then additions else 0 end as additions, cast(deletions as int) as deletions, patch from hunks",
    "d2_changed_ranges": _H + ", " + _RANGES + " select repo, pr_number, seq, k, start, stop from rr",
    "d3_cap_pr_files": _H + ", r as (select *, count(*) over w as c, row_number() over (partition by repo, pr_number order by additions desc, seq) as rk, row_number() over (partition by repo, pr_number order by seq) as rs from hunks window w as (partition by repo, pr_number)) select repo, pr_number, seq, additions, cast(case when c>2 then rk else rs end as int) as position from r where c<=2 or rk<=2",
    "d4_diff_context": _with(_SEL, _LINES, _SYMBOLS, _HB, _RANGES) + """, ds as (select distinct r.repo, r.pr_number, r.file_path, s.name, s.kind, s.start_line from rr r join sym s on s.repo=r.repo and s.file_path=r.file_path where start_line<=stop and end_line>=start),
      dc as (select repo, pr_number, file_path, count(*) as n_changed, string_agg(name, ',' order by start_line, name) as changed from ds group by all), ec as (select repo, file_path, count(*) as n_symbols from sym group by all), hf as (select distinct repo, pr_number, file_path from hunks),
      j as (select hf.*, idx.repo is not null as indexed, coalesce(n_symbols,0) as n_symbols, coalesce(n_changed,0) as n_changed, coalesce(changed,'') as changed from hf left join idx on idx.repo=hf.repo and idx.file_path=hf.file_path left join ec on ec.repo=hf.repo and ec.file_path=hf.file_path left join dc on dc.repo=hf.repo and dc.pr_number=hf.pr_number and dc.file_path=hf.file_path)
      select *, count(*) filter (indexed) over w as indexed_files, count(*) over w as total_files from j window w as (partition by repo, pr_number)""",
    "d5_reverse_dependencies": _H + """, nm as (select 'org/repo'||cast(l_partkey%5 as varchar) as repo, cast(floor((l_partkey+10)/5.0) as bigint) as a, cast(floor(l_partkey/5.0) as bigint) as b from lineitem), e as (select repo, 'src/pkg'||cast(a%8 as varchar)||'/m'||cast(a as varchar)||'.py' as src_file, 'src/pkg'||cast(b%8 as varchar)||'/m'||cast(b as varchar)||'.py' as file_path, count(*) as n from nm group by all)
      select h.repo, h.pr_number, h.file_path, src_file, n from (select distinct repo, pr_number, file_path from hunks) h join e on e.repo=h.repo and e.file_path=h.file_path""",
    "h1_parse_commit_log": "select 'f'||cast(o_custkey as varchar) as file_path, 'sha'||cast(o_orderkey as varchar) as sha, 'a'||cast(o_custkey%7 as varchar) as author, strftime(o_orderdate,'%Y-%m-%d') as date, o_orderpriority as message from orders where o_orderkey%10>0",
    "h2_recent_commits": "select * from (select 'f'||cast(o_custkey as varchar) as file_path, 'sha'||cast(o_orderkey as varchar) as sha, cast(row_number() over (partition by o_custkey order by o_orderdate desc, 'sha'||cast(o_orderkey as varchar)) as int) as position from orders where o_orderkey%10>0) where position<=10",
    "h3_blame_summary": "select 'r' as repo, 'f'||cast(l_partkey%100 as varchar) as file_path, 'a'||cast(l_suppkey%9 as varchar) as author, count(*) as lines from lineitem where l_orderkey%3=0 group by all",
    "f1_parse_responses": """select o_orderkey as id, case when o_orderkey%7<>0 and o_orderkey%5<>0 and o_orderkey%11<>0 then cast(o_orderkey%100 as double) end as score, case when o_orderkey%7=0 then 'no json' when o_orderkey%5=0 then '{"verdict":"ok"}' when o_orderkey%11=0 then '{"verdict":"ok","score":"x'||cast(o_orderkey as varchar)||'"}' end as rejected from orders""",
    "f2_convert_findings": _F + ", " + _CONV + " select run_id, seq, file, line, severity, kind from conv",
    "f3_verify_findings": _with(_SEL, _HB, _RANGES, _FB, _CONV) + f", hit as (select distinct c.run_id, c.seq from conv c join rr on rr.repo=c.repo and rr.file_path=c.file where c.line between start and stop) select c.run_id, c.seq, {_VERDICT.format(hit='(h.seq is not null)')} as reason from conv c left join idx i on i.repo=c.repo and i.file_path=c.file left join hit h on h.run_id=c.run_id and h.seq=c.seq",
    "f4_structural_confidence": _with(_SEL, _FB, _CONV) + f", v as (select run_id, {_VERDICT.format(hit='false')} as reason from conv c left join idx i on i.repo=c.repo and i.file_path=c.file), g as (select run_id, count(*) as original, count(*) filter (reason is null) as verified from v group by run_id) select *, round(greatest(0.1, least(1.0, (run_id%10)/10.0::double*verified/original)),6) as confidence from g",
    "f5_overall_confidence": """with m as (select o_orderkey%40 as run_id, [o_orderkey%12-2, (o_orderkey+5)%12-2, (o_orderkey*3)%12-2] as i, (o_orderkey%15)/10.0::double-0.2 as c, o_orderkey%6 as n from orders), g as (select run_id, avg(greatest(0,least(1,c))) as a from m where run_id%4>0 and len(list_filter(i, lambda x: x>=0 and x<n))>0 group by run_id)
      select r.run_id, round(coalesce(a, case when r.run_id%3>0 then 0.5 else 0.3 end),6) as overall from (select distinct run_id from m) r left join g using (run_id)""",
    "f6_validate_picks": """with m as (select o_orderkey as seq, [o_orderkey%12-2, (o_orderkey+5)%12-2, (o_orderkey*3)%12-2] as i, o_orderkey%6 as n from orders), f as (select *, list_filter(i, lambda x: x>=0 and x<n) as g from m), u as (select *, list_filter(g, lambda x, k: list_position(g, x)=k) as gg from f)
      select seq, array_to_string(case when len(gg)>0 then gg[1:2] else range(0, least(3,n)) end, ',') as picks from u""",
    "f7_normalise_verdict": "select o_orderkey as id, case o_orderkey%5 when 0 then 'approve' when 2 then 'request_changes' else 'comment' end as verdict, round(greatest(0.0,least(1.0,(o_orderkey%15)/10.0::double-0.2)),6) as confidence from orders",
    "f8_blend_confidence": "select o_orderkey as id, round(case when o_orderkey%2=0 then least(1.0,(o_orderkey%101)/100.0::double+0.05) else least((o_orderkey%101)/100.0::double,0.4) end,6) as confidence from orders",
    "f9_check_outputs": _F + """, t as (select run_id, lower(file||' '||description||' '||fix_sketch) as t from findings) select * from (select run_id, 'rule0' as rule, cast(case when count(*) filter (contains(t,'unclosed'))=0 then 1 else 0 end as bigint) as violations from t group by run_id
      union all select run_id, 'rule1', count(*) filter (contains(t,'improve docs')) from t group by run_id union all select run_id, 'rule2', cast(case when count(*)<31 then 1 else 0 end as bigint) from t group by run_id) where violations>0""",
    "f10_render_reports": _F + """, x as (select *, seq%1000 as r from findings), g as (select r, file, min(seq) as first, count(*) as n, '### '||file||chr(10)||string_agg('- L'||cast(line as varchar)||' ['||severity||'] '||description, chr(10) order by seq) as block from x group by r, file)
      select r as run_id, cast(sum(n) as bigint) as n_findings, count(*) as n_files, sum(n)>=6 as collapsed, string_agg(block, chr(10) order by first) as body from g group by r""",
    "f10_milestone_bodies": _F + ", " + _CONV + """, m as (select o_orderkey%40 as run_id, o_orderkey as milestone, [o_orderkey%12-2, (o_orderkey+5)%12-2, (o_orderkey*3)%12-2] as i from orders),
      cn as (select *, row_number() over (partition by run_id order by seq)-1 as idx from conv), mi as (select run_id, milestone, unnest(i) as idx, unnest([1,2,3]) as place from m),
      g as (select mi.run_id, milestone, count(*) as n, string_agg('- [ ] **'||upper(severity)||'** _'||kind||'_ at `'||file||':'||cast(line as varchar)||'`'||chr(10)||'  '||coalesce(description,'')||case when fix_sketch<>'' then chr(10)||'  fix: '||fix_sketch else '' end, chr(10) order by place) as items from mi join cn c on c.run_id=mi.run_id and c.idx=mi.idx group by all)
      select m.run_id, m.milestone, cast(coalesce(n,0) as int) as n_cited, coalesce(n,0)>=6 as collapsed, '> milestone '||cast(m.milestone as varchar)||chr(10)||chr(10)||'_Confidence: '||cast(m.milestone%100 as varchar)||'%_'||case when n>0 then chr(10)||chr(10)||'## Findings ('||cast(n as varchar)||')'||chr(10)||chr(10)||items else '' end as body from m left join g on g.run_id=m.run_id and g.milestone=m.milestone""",
    "a1_review_decisions": _F + ", " + _CONV + """, n as (select *, row_number() over (partition by run_id order by seq, file, line) as k from conv), g as (select run_id, min(repo) as repo, count(*) as n, string_agg(file||':'||cast(line as varchar), chr(10) order by k) filter (k<=3) as c, count(*) filter (k<=3) as m from n group by run_id)
      select run_id, repo, 'comment' as action, 'verdict:'||case when run_id%2=0 then 'approve' else 'comment' end||chr(10)||'findings:'||cast(n as varchar)||chr(10)||c as body, cast(m+2 as int) as n_evidence from g""",
    "a1_issue_decisions": _F + ", " + _CONV + """, m as (select o_orderkey%40 as run_id, o_orderkey as milestone, [o_orderkey%12-2, (o_orderkey+5)%12-2, (o_orderkey*3)%12-2] as i from orders), cn as (select *, row_number() over (partition by run_id order by seq)-1 as idx from conv), mi as (select run_id, milestone, unnest(i) as idx from m), k as (select distinct mi.run_id, milestone, file||':'||cast(line as varchar) as key from mi join cn c on c.run_id=mi.run_id and c.idx=mi.idx),
      g as (select run_id, milestone, string_agg(key, ',' order by key) as ks from k group by all) select m.run_id, m.milestone, 'create_issue' as action, md5(ks) as keys_hash from m left join g on g.run_id=m.run_id and g.milestone=m.milestone""",
    "a1_test_decisions": _with(_SEL) + r"""select repo, file_path as target, 'tests/'||regexp_replace(regexp_replace(lower(file_path),'[^a-z0-9]+','-','g'),'^-+|-+$','','g') as branch, 'tests/test_'||regexp_extract(file_path,'([^/]+?)(?:\.[^./]+)?$',1)||'.py' as path, cast(step as int) as step, case step when 1 then 'create_branch' when 2 then 'update_file' else 'open_pr' end as action from idx cross join (select unnest([1,2,3]) as step)""",
    "a2_decision_signature": f"with {_DB}, {_SIG} select seq, repo_key, signature from sg",
    "a3_with_threshold": f"with {_DB}, {_SIG} select seq, threshold from sg",
    "a4_gate_full": _gate("full"),
    "a4_gate_comment": _gate("comment"),
    "a5_dedupe_decisions": f"with {_DB}, {_SIG}, fr as (select * from sg s where not exists (select 1 from sg l where l.seq%97=0 and l.repo_key=s.repo_key and l.agent=s.agent and l.action=s.action and l.signature=s.signature)), m as (select *, min(case when client_ok then seq end) over (partition by repo_key, agent, action, signature) as f from fr) select seq, agent, action, signature from m where f is null or seq<=f",
    "a6_execute_chain": "with r as (select l_orderkey as chain, l_linenumber as step, max(case when l_quantity>45 then 'error' else 'executed' end) as outcome from lineitem group by 1,2) select chain, step, outcome from (select *, coalesce(sum(case when outcome='executed' then 0 else 1 end) over (partition by chain order by step rows between unbounded preceding and 1 preceding),0) as b from r) where b=0",
    "a7_skip_reviewed": "with p as (select 'Org/R'||cast(o_orderkey%5 as varchar) as repo, o_orderkey as pr_number, 's'||cast(o_orderkey%300 as varchar) as head_sha from orders) select * from p where not exists (select 1 from customer where c_custkey%3>0 and 'org/r'||cast(c_custkey%5 as varchar)=lower(repo) and 's'||cast(c_custkey%200 as varchar)=head_sha)",
    "a8_summarise_outcomes": f"with g as ({_gate('full')}), {_DB} select agent, action, count(*) as total, count(*) filter (outcome='executed') as executed, count(*) filter (outcome='deduped') as deduped, count(*) filter (outcome like 'downgraded%') as downgraded, count(*) filter (outcome='error') as errors from g join decisions using (seq) group by all",
    "e1_verify_hmac": "select event_id as delivery_id, event_id%5<>0 as valid from events",
    "e2_parse_deliveries": f"with {_DLB}, {_EV} select * exclude (ts) from ev",
    "e4_dispatch": f"with {_DLB}, {_EV}, {_RT} select delivery_id, fn as function_name, job_id from jb",
    "e3_classify_deliveries": f"""with {_DLB}, {_EV}, {_RT}, c as (select delivery_id, case when delivery_id%101=0 then 'no secret' when delivery_id%97=0 then 'missing signature' when delivery_id%89=0 then 'bad signature' when delivery_id%79=0 then 'ping' when sender_type='Bot' then 'bot sender' when job_id is null then 'no handler' when delivery_id%4=0 then 'cooldown' when delivery_id%83=0 then 'queue unavailable' when delivery_id%6=0 then 'job already queued' end as reason from jb)
      select delivery_id, case when reason is null then 'dispatched' when reason='ping' then 'pong' when reason in ('no secret','queue unavailable','missing signature','bad signature') then 'error' else 'ignored' end as status, reason, cast(case when reason in ('no secret','queue unavailable') then 503 when reason in ('missing signature','bad signature') then 401 else 200 end as int) as http_code from c""",
    "e5_dedupe_jobs": f"with {_DLB}, {_EV}, {_RT} select m[2] as delivery_id, job_id from (select job_id, min((ts, delivery_id)) as m from jb where job_id is not null group by job_id)",
    "e6_cooldown": "with " + _greedy("select cast(user_id as varchar) as key, epoch_us(ts) as t, event_id as id from events", 6 * 3600, "key, m[2] as id"),
    "e7_admit": f"with recursive {_DLB}, {_EV}, {_RT}, " + _ADMIT.format(w=6 * 3600 * 1000000, h=7 * 86400 * 1000000),
    "e9_delivery_stats": "select strftime(ts,'%Y-%m-%d') as day, event_type, count(*) as n from events group by all",
}
ORACLE_SQL["e8_reindex_stream"] = code_queries.ORACLE_SQL["s8_merge_files"]
ORACLE_SQL["s11_action_log"] = f"""with {_DB}, {_SIG}, fr as (select *, min(seq) over (partition by seq%2, repo_key, agent, action, signature) as f from sg where client_ok),
  rc as (select *, row_number() over (partition by repo_key, agent, action, signature order by seq%2, seq) as n from fr where seq=f)
  select seq, repo_key, agent, action, signature, case when confidence<threshold then 'downgraded_low_confidence' else 'executed' end as outcome, cast(seq%2+1 as int) as published from rc where n=1"""
_CONTEXT = ORACLE_SQL["d4_diff_context"].rsplit("select *, count(*) filter", 1)[0]
ORACLE_SQL["d6_pack_context"] = _CONTEXT + """, nm as (select 'org/repo'||cast(l_partkey%5 as varchar) as repo, cast(floor((l_partkey+10)/5.0) as bigint) as a, cast(floor(l_partkey/5.0) as bigint) as b from lineitem),
  e as (select distinct repo, 'src/pkg'||cast(a%8 as varchar)||'/m'||cast(a as varchar)||'.py' as src_file, 'src/pkg'||cast(b%8 as varchar)||'/m'||cast(b as varchar)||'.py' as file_path from nm),
  ib as (select repo, file_path, list_sort(list(src_file)) as who from e group by all),
  pk as (select j.repo, j.pr_number, j.file_path, concat_ws(chr(10), 'file ' || j.file_path, 'changed ' || changed, 'imported by ' || array_to_string(coalesce(who, []::varchar[])[1:5], ',') || case when len(who) > 5 then ' (+' || (len(who) - 5) || ' more)' else '' end,
    substr(array_to_string(list_transform(string_split(content, chr(10)), lambda x, i: i || ': ' || x), chr(10)), 1, 400)) as prompt
    from j left join ib on ib.repo=j.repo and ib.file_path=j.file_path left join idx on idx.repo=j.repo and idx.file_path=j.file_path)
  select repo, pr_number, file_path, cast(length(prompt) as int) as n_chars, md5(prompt) as hash from pk"""
