"""Webhook deliveries in batch form: signature, metadata, routing, cooldown, duplicates and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_reason
from .folds import gated, spaced

PAYLOAD = (
    "action string, pull_request struct<number:int, head:struct<sha:string>>, issue struct<number:int>, after string, "
    "repository struct<full_name:string>, sender struct<login:string, type:string>"
)
# fixed values: (event, action or any, function) of the routes
ROUTES = (
    ("pull_request", "opened", "review_pr"),
    ("pull_request", "synchronize", "review_pr"),
    ("issues", "opened", "onboard_repo"),
    ("push", None, "reindex_repo"),
)


def hmac_sha256(body: Column, secret: bytes) -> Column:
    """Hex HMAC-SHA256 of a string column, in built-in functions."""
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    pad = lambda b: F.lit(bytes(k ^ b for k in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(body, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def verify_hmac(df: DataFrame, secret: bytes) -> DataFrame:
    """`df` (raw, signature) with valid: the signature needs its prefix."""
    return df.withColumn("valid", F.coalesce(F.col("signature") == F.concat(F.lit("sha256="), hmac_sha256(F.col("raw"), secret)), F.lit(False)))


def parse_deliveries(raw: DataFrame) -> DataFrame:
    p = raw.withColumn("p", F.from_json("raw", PAYLOAD))
    return p.select(
        *[c for c in raw.columns if c != "raw"], F.col("p.action").alias("action"), F.col("p.pull_request.number").alias("pr_number"), F.col("p.pull_request.head.sha").alias("head_sha"),
        F.col("p.issue.number").alias("issue_number"), F.col("p.after").alias("after_sha"), F.col("p.repository.full_name").alias("repo_full_name"), F.col("p.sender.login").alias("sender_login"), F.col("p.sender.type").alias("sender_type"),
    )


def dispatch(events: DataFrame) -> DataFrame:
    """`events` with function_name, job_id and repo_key; null where no route or no number fits."""
    fn = F.lit(None).cast("string")
    for event, action, name in sorted(ROUTES, key=lambda r: r[1] is not None):  # an exact action goes before any action
        hit = F.col("event") == event
        fn = F.when(hit & (F.col("action") == action) if action else hit, name).otherwise(fn)
    repo = F.lower("repo_full_name")
    number = F.when(fn == "review_pr", F.col("pr_number")).when(fn == "onboard_repo", F.col("issue_number"))
    good = (F.coalesce("repo_full_name", F.lit("")) != "") & ((fn == "reindex_repo") | (F.coalesce(number, F.lit(0)) != 0))
    job = F.when(fn == "review_pr", F.concat(F.lit("review-pr:"), repo, F.lit(":"), number)).when(fn == "onboard_repo", F.concat(F.lit("onboard:"), repo, F.lit(":"), number)).otherwise(F.concat(F.lit("reindex:"), repo, F.lit(":"), F.coalesce("after_sha", F.lit("unknown"))))
    return events.withColumn("function_name", F.when(good, fn)).withColumn("job_id", F.when(good, job)).withColumn("repo_key", repo)


def cooldown(df: DataFrame, key: Column, ts: str, event_id: str, window_seconds: float = 60.0) -> DataFrame:
    """(key, id, t) of the accepted rows. The accepted time moves only on acceptance; rows without key or time are accepted and move nothing."""
    rows = df.select(F.lower(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(event_id).cast("long").alias("id"))
    return spaced(rows, int(window_seconds * 1e6))


def dedupe_jobs(jobs: DataFrame, horizon_seconds: float) -> DataFrame:
    """Jobs (job_id, ts, delivery_id) that come at least the horizon after the last one kept with their id."""
    kept = cooldown(jobs, F.col("job_id"), "ts", "delivery_id", horizon_seconds)
    return jobs.join(kept.select(F.col("id").alias("delivery_id")), "delivery_id", "left_semi")


def admit(jobs: DataFrame, window_seconds: float = 60.0, horizon_seconds: float = 3600.0, reruns: bool = False) -> DataFrame:
    """(delivery_id, outcome) of jobs (delivery_id, repo_key, job_id, ts): dispatched, cooldown or duplicate.

    Jobs without repository or time meet no gate and are dispatched. With `reruns` a column says which rows were run twice,
    since the gate before their partition wasn't empty.
    """
    rows = jobs.select(F.col("repo_key").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("delivery_id").cast("long").alias("id"), F.col("job_id").alias("job"))
    out = gated(rows, int(window_seconds * 1e6), int(horizon_seconds * 1e6))
    return out.select(F.col("id").alias("delivery_id"), "outcome", *(["rerun"] if reruns else []))


def classify_deliveries(d: DataFrame) -> DataFrame:
    """status, reason and http_code of deliveries with has_secret, signature, valid, event, sender_type, job_id, cooling, queue_ok and duplicate."""
    reason = first_reason(
        (~F.col("has_secret"), "no secret"),
        (F.coalesce("signature", F.lit("")) == "", "missing signature"),
        (~F.coalesce("valid", F.lit(False)), "bad signature"),
        (F.coalesce("event", F.lit("")) == "", "missing event"),
        (F.col("event") == "ping", "ping"),
        (F.coalesce(F.col("sender_type") == "Bot", F.lit(False)), "bot sender"),
        (F.col("job_id").isNull(), "no handler"),
        (F.col("cooling"), "cooldown"),
        (~F.col("queue_ok"), "queue unavailable"),
        (F.col("duplicate"), "job already queued"),
    )
    code = F.when(reason.isin("no secret", "queue unavailable"), 503).when(reason.isin("missing signature", "bad signature"), 401).when(reason == "missing event", 400).otherwise(200)
    status = F.when(reason.isNull(), "dispatched").when(reason == "ping", "pong").when(code >= 400, "error").otherwise("ignored")
    return d.withColumn("reason", reason).withColumn("http_code", code).withColumn("status", status)


def delivery_stats(df: DataFrame, ts: str, status: str, window: str = "1 hour") -> DataFrame:
    return df.groupBy(F.window(F.col(ts).cast("timestamp"), window).alias("w"), status).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), status, "n")
