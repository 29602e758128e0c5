"""Quality rules whose cut-offs follow the corpus: adaptive fences from mergeable quantile sketches.

For every document a few ratios are counted. A sketch of each ratio is kept for each (lang, source): counts of
logarithmic bins (the relative-error sketch of Masson, Rim and Lee, 2019), so that sketches of groups, partitions
or days merge by adding counts, the result does not depend on the order of rows, and a hot source is reduced
before the shuffle. A fence is the median plus FENCE times the distance from the 0.1 quantile to it (at least the
rule's own least spread), so junk above it moves the fence only as far as it moves the median: a group with two fifths of
junk still has its fence near that of its clean texts. A group's fence is drawn towards that of its language as if PRIOR
documents of the language were in it, and that of the language likewise towards the whole corpus: a small group follows its
language, a large one itself, and nothing switches at any size. The fences are joined back and a document goes where one of its counts lies
beyond the fence by more than three of its own standard errors.

Everything is DataFrame functions. Nulls: a null text has no words and fails the base rule; null lang and null
source are groups of their own. Repeated rows are judged alike. A very long text is counted whole inside its row. Ties
don't arise. An empty table gives an empty result. Other columns,
whatever their names, are dropped by `measured` and carried by `filtered`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernels import stored, table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
FENCE = 8.0
#: documents that the fence of the language, or of the whole corpus, counts for
PRIOR = 200
BIN = 1.1
#: rule: (numerator, denominator, least spread)
RULES = {
    "symbols": ("n_symbols", "word_chars", 0.005),
    "upper": ("n_upper", "word_chars", 0.02),
    "other": ("n_other", "word_chars", 0.02),
    "lines": ("n_dup_lines", "n_lines", 0.05),
    "repeats": ("n_repeat_words", "n_words", 0.02),
}


def _paired(a: str, shift: int) -> Column:
    """Digest of each entry with the one `shift` places later."""
    n = F.size(a) - shift
    return F.when(n > 0, F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(shift + 1), n), lambda x, y: F.xxhash64(x, y))).otherwise(F.array().cast("array<bigint>"))


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` and the counts of every text, whole: n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_upper, n_other, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    a = docs.select(
        *keep,
        F.array_remove(F.split(text, SPACE), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(text, r"[\p{L}\x20\x09-\x0D]+", "")).cast("long").alias("n_other"),
    )
    a = a.select(
        *keep,
        "n_symbols",
        "n_upper",
        "n_other",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_1"),
    )
    for k in (1, 2, 4):
        a = a.withColumn(f"_{2 * k}", _paired(f"_{k}", k)).drop(f"_{k}")
    a = a.withColumn("_again", F.size("_8") > F.size(F.array_distinct("_8")))
    # only texts with a repeated window are sorted
    a = a.withColumn("_s", F.when(F.col("_again"), F.sort_array(F.transform("_8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter(
        F.transform("_s", lambda x, k: F.when((x["h"] == F.get("_s", k - 1)["h"]) | (x["h"] == F.get("_s", k + 1)["h"]), x["i"])), lambda i: i.isNotNull()
    )
    a = a.withColumn("_at", F.when(F.col("_again"), F.sort_array(twice)))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("_at", start, lambda acc, p: F.struct((acc["n"] + p + WINDOW - F.greatest(acc["end"], p)).alias("n"), (p + WINDOW).alias("end")))["n"]
    return a.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_again"), covered), F.lit(0)).cast("long")).drop("_8", "_s", "_at", "_again")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def sketches(counts: DataFrame) -> DataFrame:
    """Counts of (lang, source, rule, bin): one sketch for each group and rule, mergeable by adding `n`."""
    ratios = F.array(*[F.struct(F.lit(r).alias("rule"), (F.col(a) / F.greatest(F.col(b), F.lit(1))).alias("x")) for r, (a, b, _) in RULES.items()])
    rows = counts.where(F.col("n_words") > 0).select("lang", "source", F.explode(ratios).alias("r"))
    binned = F.when(F.col("r.x") > 0, F.floor(F.log("r.x") / F.log(F.lit(BIN)))).cast("int")
    return rows.groupBy("lang", "source", F.col("r.rule").alias("rule"), F.coalesce(binned, F.lit(-100000)).alias("bin")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """lang, source, and a column fence_<rule> for each rule."""

    def level(keys: list[str], name: str) -> DataFrame:
        merged = sketch.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*keys, "rule")
        merged = merged.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
        middle = F.when(F.col("bin") == -100000, F.lit(0.0)).otherwise(F.pow(F.lit(BIN), F.col("bin") + 0.5))
        # the first bin whose count reaches the rank
        at = {q: F.min(F.when(100 * F.col("upto") >= q * F.col("all"), middle)) for q in (10, 50)}
        least = reduce(lambda acc, r: F.when(F.col("rule") == r, F.lit(RULES[r][2])).otherwise(acc), RULES, F.lit(0.0))
        out = merged.groupBy(*keys, "rule").agg(at[10].alias("low"), at[50].alias("mid"), F.max("all").alias(f"n_{name}"))
        return out.select(*keys, "rule", f"n_{name}", (F.col("mid") + FENCE * F.greatest(F.col("mid") - F.col("low"), least)).alias(f"f_{name}"))

    own, lang, every = level(["lang", "source"], "own"), level(["lang"], "lang"), level([], "all")
    lang = lang.withColumnRenamed("rule", "rule_l").withColumnRenamed("lang", "lang_l")
    every = every.withColumnRenamed("rule", "rule_a")
    joined = own.join(lang, (F.col("rule") == F.col("rule_l")) & F.col("lang").eqNullSafe(F.col("lang_l"))).join(every, F.col("rule") == F.col("rule_a"))
    drawn = lambda n, own, wider: (F.col(n) * F.col(own) + prior * wider) / (F.col(n) + prior)
    fence = drawn("n_own", "f_own", drawn("n_lang", "f_lang", F.col("f_all")))
    picked = [F.max(F.when(F.col("rule") == r, F.col("fence"))).alias(f"fence_{r}") for r in RULES]
    return joined.select("lang", "source", "rule", fence.alias("fence")).groupBy("lang", "source").agg(*picked)


#: fence rows up to which they are sent to every executor
BROADCAST_ROWS = 20_000


def judged(counts: DataFrame, f: DataFrame, small: bool = False) -> DataFrame:
    """`counts` with base_failed and kept, by the fences `f`."""
    f = f.withColumnRenamed("lang", "_lang").withColumnRenamed("source", "_source")
    out = counts.join(F.broadcast(f) if small else f, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    beyond = reduce(
        lambda x, y: x | y,
        [F.coalesce((F.col(a) - 3 * F.sqrt(F.col(a))) / F.greatest(F.col(b), F.lit(1)) > F.col(f"fence_{r}"), F.lit(False)) for r, (a, b, _) in RULES.items()],
    )
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~beyond).drop("_lang", "_source", *[f"fence_{r}" for r in RULES])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stored(measured(table(spark, sf_dir, "documents"), "doc_id", "lang", "source"))
    f = stored(fences(sketches(counts)))
    return judged(counts, f, f.count() <= BROADCAST_ROWS).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns.

    Every text is counted once: the counts are stored beside the rows, the fences read the counts alone, and no text is
    shuffled while the fences are few.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "lang", "source", "text")
    counts = stored(measured(whole, "_row", "lang", "source"))
    f = stored(fences(sketches(counts.drop("_row"))))
    return judged(counts, f, f.count() <= BROADCAST_ROWS).where("kept").select("_row.*")


ORACLE = r"""
with w as (
  select doc_id, lang, source, coalesce(text,'') as t,
    list_filter(regexp_split_to_array(coalesce(text,''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as words,
    list_filter(string_split(coalesce(text,''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) as lines
  from documents),
g as (select doc_id, i, array_to_string(words[i:i+7], ' ') as gram from (select doc_id, words, unnest(range(1, len(words)-6)) as i from w where len(words) >= 8)),
d as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as c from g) where c > 1),
r as (select doc_id, cast(sum(least(8, nxt - i)) as bigint) as n from (select doc_id, i, coalesce(lead(i) over (partition by doc_id order by i), i+8) as nxt from d) group by doc_id),
c as (
  select w.doc_id, lang, source, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words,'')) as bigint) as word_chars,
    cast(length(regexp_replace(t,'[^#*$%&|<>]+','','g')) as bigint) as n_symbols,
    cast(length(regexp_replace(t,'\P{Lu}+','','g')) as bigint) as n_upper,
    cast(length(regexp_replace(t,'[\p{L} \t\n\x0B\f\r]+','','g')) as bigint) as n_other,
    cast(len(lines) as bigint) as n_lines, cast(len(lines)-len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(r.n,0) as n_repeat_words
  from w left join r on w.doc_id = r.doc_id),
x as (
  select lang, source, 'symbols' as rule, n_symbols/greatest(word_chars,1) as v from c where n_words>0
  union all select lang, source, 'upper', n_upper/greatest(word_chars,1) from c where n_words>0
  union all select lang, source, 'other', n_other/greatest(word_chars,1) from c where n_words>0
  union all select lang, source, 'lines', n_dup_lines/greatest(n_lines,1) from c where n_words>0
  union all select lang, source, 'repeats', n_repeat_words/greatest(n_words,1) from c where n_words>0),
b as (select lang, source, rule, case when v>0 then cast(floor(ln(v)/ln(1.1)) as int) else -100000 end as bin, count(*) as n from x group by all),
least_ as (select * from (values ('symbols',0.005),('upper',0.02),('other',0.02),('lines',0.05),('repeats',0.02)) t(rule, spread)),
lv as (select 'own' as lvl, lang, source, rule, bin, n from b
  union all select 'lang', lang, null, rule, bin, sum(n) from b group by lang, rule, bin
  union all select 'all', null, null, rule, bin, sum(n) from b group by rule, bin),
cu as (select *, sum(n) over (partition by lvl, lang, source, rule order by bin) as upto, sum(n) over (partition by lvl, lang, source, rule) as tot from lv),
q as (select lvl, lang, source, rule, max(tot) as tot,
   min(case when 100*upto >= 10*tot then case when bin=-100000 then 0.0 else pow(1.1::double, bin+0.5) end end) as low,
   min(case when 100*upto >= 50*tot then case when bin=-100000 then 0.0 else pow(1.1::double, bin+0.5) end end) as mid
   from cu group by lvl, lang, source, rule),
f as (select q.*, mid + 8.0*greatest(mid-low, spread) as fence from q join least_ using (rule)),
p as (select o.lang, o.source, o.rule, (o.tot*o.fence + 200*(l.tot*l.fence + 200*a.fence)/(l.tot+200))/(o.tot+200) as fence
   from f o join f l on l.lvl='lang' and l.rule=o.rule and l.lang is not distinct from o.lang join f a on a.lvl='all' and a.rule=o.rule where o.lvl='own'),
pp as (select lang, source, max(fence) filter (rule='symbols') as s, max(fence) filter (rule='upper') as u, max(fence) filter (rule='other') as o,
   max(fence) filter (rule='lines') as l, max(fence) filter (rule='repeats') as r from p group by lang, source),
j as (select c.*, (n_words < 20 or 100*n_repeat_words > 30*n_words) as base_failed,
  coalesce((n_symbols-3*sqrt(n_symbols))/greatest(word_chars,1) > s, false) or coalesce((n_upper-3*sqrt(n_upper))/greatest(word_chars,1) > u, false)
  or coalesce((n_other-3*sqrt(n_other))/greatest(word_chars,1) > o, false) or coalesce((n_dup_lines-3*sqrt(n_dup_lines))/greatest(n_lines,1) > l, false)
  or coalesce((n_repeat_words-3*sqrt(n_repeat_words))/greatest(n_words,1) > r, false) as beyond
  from c left join pp on c.lang is not distinct from pp.lang and c.source is not distinct from pp.source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and not beyond) as kept from j
"""
