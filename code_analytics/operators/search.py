"""Search: symbols by name, text by terms and cover density, vectors, and both together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ..functions.text import bounded
from ..sources.tables import VersionedTable

SEPARATORS = r"[^\p{L}\p{N}]+"
MOST_PUSHED = 1_000
#: documents whose words are sorted at once
POSTING_ROWS = 256


def symbol_lookup(index: DataFrame, symbols: DataFrame, queries: DataFrame, cap: int = 10) -> DataFrame:
    """(query, ordinal, total, repo, file_path, name, kind, start_line, end_line, code) for exact names or Class.name."""
    q = queries.where("trim(query) <> ''").withColumn("dot", F.instr("query", "."))
    q = q.select("query", F.when(F.col("dot") > 0, F.substring_index("query", ".", 1)).alias("q_parent"), F.when(F.col("dot") > 0, F.expr("substring(query, dot + 1)")).otherwise(F.col("query")).alias("name"))
    hits = symbols.join(q, "name").where("q_parent is null or (parent_class = q_parent and kind not in ('class', 'interface'))")
    files = index.where("content is not null")
    hits = hits.join(files.select("repo", "file_path"), ["repo", "file_path"], "left_semi")
    w = Window.partitionBy("query").orderBy("repo", "file_path", "start_line", "kind")
    hits = hits.withColumn("ordinal", F.row_number().over(w)).withColumn("total", F.count("*").over(Window.partitionBy("query"))).where(F.col("ordinal") <= cap)
    # only the hits under the cap meet their contents
    hits = hits.join(files.select("repo", "file_path", "content"), ["repo", "file_path"])
    return hits.select("query", "ordinal", "total", "repo", "file_path", "name", "kind", "start_line", "end_line", code_slice(F.col("content"), F.col("start_line"), F.col("end_line")).alias("code"))


def code_slice(content: Column, start: Column, end: Column) -> Column:
    """Lines start to end with their numbers, right-aligned to the width of the last one."""
    lines = F.split(content, r"\R")
    first = F.greatest(start, F.lit(1))
    last = F.least(end, F.size(lines))
    width = F.length(last.cast("string"))
    some = F.slice(lines, first, F.greatest(last - first + 1, F.lit(0)))
    return F.array_join(F.transform(some, lambda x, i: F.concat(F.lpad((first + i).cast("string"), width, " "), F.lit(": "), x)), "\n")


def tokenize(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, pos, token): lower-cased words; anything but letters and numbers separates."""
    rows = docs.select(*keys, F.posexplode(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SEPARATORS), lambda x: x != "")).alias("pos", "token"))
    return rows


def query_terms(queries: DataFrame) -> DataFrame:
    """(query, term, n_terms) of the distinct terms."""
    terms = F.array_distinct(F.filter(F.split(F.lower("query"), SEPARATORS), lambda x: x != ""))
    return queries.select("query", F.explode(terms).alias("term"), F.size(terms).alias("n_terms"))


def hits(tokens: DataFrame, queries: DataFrame, *keys: str) -> DataFrame:
    """(query, keys, pos, term, n_terms): where a term of a query stands."""
    return tokens.join(bounded(query_terms(queries)), tokens.token == F.col("term")).select("query", *keys, "pos", "term", "n_terms")


def _all_terms(counts: DataFrame, *keys: str) -> DataFrame:
    """Of (query, keys, term, n_terms, n) the documents that hold all terms, with their hits."""
    found = counts.groupBy("query", *keys).agg(F.sum("n").alias("hits"), F.countDistinct("term").alias("found"), F.max("n_terms").alias("n"))
    return found.where("found = n").select("query", *keys, "hits")


def fts_match(tokens: DataFrame, queries: DataFrame, *keys: str) -> DataFrame:
    """(query, keys, hits) of the documents that hold all terms."""
    return _all_terms(hits(tokens, queries, *keys).withColumn("n", F.lit(1)), *keys)


def cover_sums(row: np.ndarray, pos: np.ndarray, term: np.ndarray, n_terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document the sum over minimal covers of 0.1 / (1 + other words in the cover), and its hits.

    The hits are (row of the document, place, number of the term there); a document has the terms 0 to its `n_terms` - 1.
    Along its hits the last place of each term is carried on; the left end of the tightest span that ends at a hit and holds
    all terms is the smallest of these places. Of ends with the same left end the first is minimal. Linear but for the sort.
    """
    order = np.lexsort((pos, row))
    row, pos, term = row[order], pos[order], term[order]
    at = np.arange(len(row))
    begin = np.searchsorted(row, np.arange(len(n_terms)))[row]
    left = at.copy()
    for k in range(n_terms.max(initial=0)):
        last = np.maximum.accumulate(np.where(term == k, at, -1))
        left = np.where(n_terms[row] > k, np.minimum(left, np.where(last < begin, -1, last)), left)
    minimal = left >= 0
    minimal[1:] &= (left[1:] != left[:-1]) | (row[1:] != row[:-1])
    inside = at - left + 1
    words = pos - pos[np.maximum(left, 0)] + 1
    part = np.where(minimal, 0.1 / np.where(minimal, 1 + words - inside, 1), 0.0)
    return np.bincount(row, weights=part, minlength=len(n_terms)).astype(np.float64), np.bincount(row, minlength=len(n_terms))


def _covers(documents: DataFrame, *keys: str) -> DataFrame:
    """(query, keys, rank, hits) of rows (query, keys, places): a document with the gaps of each of a query's terms."""
    names = ["query", *keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = b.column(len(names))
            n_terms = terms.value_lengths().to_numpy().astype(np.int64)
            gaps = terms.flatten()
            size = gaps.value_lengths().to_numpy().astype(np.int64)
            first = np.cumsum(n_terms) - n_terms
            lists = np.repeat(np.arange(len(size)), size)
            row = np.repeat(np.arange(b.num_rows), n_terms)
            pos = np.cumsum(gaps.flatten().to_numpy().astype(np.int64))
            begin = np.concatenate([[0], pos])[np.cumsum(size) - size]  # what the lists before add up to
            rank, hits = cover_sums(row[lists], pos - begin[lists], (np.arange(len(size)) - first[row])[lists], n_terms)
            yield pa.record_batch([*[b.column(i) for i in range(len(names))], pa.array(rank), pa.array(hits)], [*names, "rank", "hits"])

    kept = StructType([documents.schema[c] for c in names]).add("rank", "double").add("hits", "long")
    return documents.select(*names, "places").mapInArrow(run, kept).select(*names, F.round("rank", 6).alias("rank"), "hits")


def _gaps(places: str) -> Column:
    """The first of sorted places and then the distances between them."""
    return F.transform(places, lambda x, i: x - F.coalesce(F.get(places, i - 1), F.lit(0)))


def covers(hit: DataFrame, *keys: str) -> DataFrame:
    """(query, keys, rank, hits) of (query, keys, pos, term, n_terms): the cover density of the documents that hold all terms of a query.

    A document is one row with its places, so its hits are held by one task.
    """
    of_terms = hit.groupBy("query", *keys, "term").agg(F.max("n_terms").alias("n_terms"), F.sort_array(F.collect_list("pos")).alias("p"))
    documents = of_terms.groupBy("query", *keys).agg(F.max("n_terms").alias("n_terms"), F.collect_list(_gaps("p")).alias("places"))
    return _covers(documents.where(F.size("places") == F.col("n_terms")), *keys)


def cover_density(tokens: DataFrame, queries: DataFrame, *keys: str) -> DataFrame:
    """covers of the documents that hold all terms of a query."""
    return covers(hits(tokens, queries, *keys), *keys)


# a stored positional index: a row for each term and document, so a common term is many rows


POSTINGS = "term string, {key} long, gaps array<int>"


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(term, key, gaps): the places of each term in each document, the first one and then the distances between them.

    A document's texts meet once, whole; its terms are gathered in its row, so no occurrence of a word is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, POSTING_ROWS):
                some = b.slice(lo, POSTING_ROWS)
                texts = some.column(1)
                in_text = texts.flatten().value_lengths().to_numpy().astype(np.int64)
                words = texts.flatten().flatten().dictionary_encode()
                code = words.indices.to_numpy().astype(np.int64)
                doc = np.repeat(np.repeat(np.arange(some.num_rows), texts.value_lengths().to_numpy()), in_text)
                pos = np.arange(len(code)) - np.repeat(np.cumsum(in_text) - in_text, in_text)
                order = np.lexsort((pos, doc * len(words.dictionary) + code))
                doc, code, pos = doc[order], code[order], pos[order]
                new = np.ones(len(order), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
                first = np.flatnonzero(new)
                gaps = np.where(new, pos, np.diff(pos, prepend=0)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(gaps))
                yield pa.record_batch([words.dictionary.take(pa.array(code[first])), some.column(0).take(pa.array(doc[first])), lists], ["term", key, "gaps"])

    whole = docs.groupBy(key).agg(F.collect_list(text).alias("texts"))
    of_text = F.transform("texts", lambda t: F.filter(F.split(F.lower(t), SEPARATORS), lambda x: x != ""))
    kept = StructType().add("term", "string").add(docs.schema[key]).add("gaps", ArrayType(IntegerType()))
    return whole.select(key, of_text.alias("words")).mapInArrow(run, kept)


def positional_index(spark: SparkSession, path: str, key: str, n_buckets: int = 64) -> VersionedTable:
    """An index by terms. Documents are added in segments by index.append(postings(docs, key)), each document once."""
    return VersionedTable(spark, path, POSTINGS.format(key=key), "term", n_buckets)


def asked_postings(index: VersionedTable, queries: DataFrame) -> DataFrame:
    """(query, term, n_terms, key, gaps): only the buckets of the queried terms are read, and of these, where the terms are few, their rows."""
    terms = query_terms(queries)
    buckets = {str(r[0]) for r in terms.select(index.bucket()).distinct().collect()}  # at most n_buckets
    rows, few = index.read(buckets=buckets).drop("published"), terms.select("term").distinct().limit(MOST_PUSHED + 1).collect()
    if len(few) <= MOST_PUSHED:
        rows = rows.where(F.col("term").isin([r[0] for r in few]))
    return rows.join(bounded(terms), "term")


def fts_match_indexed(index: VersionedTable, queries: DataFrame, key: str) -> DataFrame:
    """fts_match over the postings of the queried terms."""
    return _all_terms(asked_postings(index, queries).withColumn("n", F.size("gaps").cast("long")), key)


def cover_density_indexed(index: VersionedTable, queries: DataFrame, key: str) -> DataFrame:
    """cover_density over the postings of the queried terms: they are shuffled once, packed as they are stored."""
    documents = asked_postings(index, queries).groupBy("query", key).agg(F.max("n_terms").alias("n_terms"), F.collect_list("gaps").alias("places"))
    return _covers(documents.where(F.size("places") == F.col("n_terms")), key)


def headline(docs: DataFrame, queries: DataFrame, key: str, words: int = 20, fragments: int = 3, index: VersionedTable | None = None) -> DataFrame:
    """(query, key, headline) of the documents that hold a term of the query: words around hits, hits between **.

    The first fragment lies around the first hit, each next one around the first hit beyond the fragment before, up to
    `fragments` of them with ... between; fragments don't overlap. With an index the documents come from its postings.
    """
    terms = queries.select("query", F.array_distinct(F.filter(F.split(F.lower("query"), SEPARATORS), lambda x: x != "")).alias("terms"))
    w = F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), r"\s+"), "")
    found = (hits(tokenize(docs, key), queries, key) if index is None else asked_postings(index, queries)).select("query", key)
    # a text is shuffled once, whole, however many queries it answers, and cut into words where its headlines are made
    found = found.groupBy(key).agg(F.collect_set("query").alias("queries"))
    rows = found.join(docs.select(key, "text"), key).select(key, "text", F.explode("queries").alias("query"))
    rows = rows.join(bounded(terms), "query").select("query", key, "terms", w.alias("w"))
    # only a word that contains a term is taken apart
    is_hit = lambda x: F.exists("terms", lambda t: F.contains(F.lower(x), t)) & F.arrays_overlap(F.split(F.lower(x), SEPARATORS), F.col("terms"))
    marked_at = F.filter(F.transform("w", lambda x, i: F.when(is_hit(x), i + 1)), lambda x: x.isNotNull())

    def place(starts: Column, hit: Column) -> Column:
        free = F.coalesce(F.get(starts, F.size(starts) - 1) + words, F.lit(1))
        return F.when((F.size(starts) < fragments) & (hit >= free), F.concat(starts, F.array(F.greatest(free, hit - words // 2)))).otherwise(starts)

    starts = F.aggregate("h", F.array().cast("array<int>"), place)
    rows = rows.withColumn("h", marked_at).withColumn("starts", F.when(F.size("h") > 0, starts).otherwise(F.array(F.lit(1))))
    marked = lambda x: F.when(is_hit(x), F.concat(F.lit("**"), x, F.lit("**"))).otherwise(x)
    piece = lambda s: F.array_join(F.transform(F.slice("w", s, F.lit(words)), marked), " ")
    return rows.select("query", key, F.array_join(F.transform("starts", piece), " ... ").alias("headline"))


def hash_embed(text: Column, dims: int = 16) -> Column:
    """A unit vector derived from the SHA-256 of the first 8000 characters; null for null or empty text."""
    digest = F.sha2(F.substring(text, 1, 8000), 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.conv(F.substring(digest, 1 + 2 * (i % 32), 2), 16, 10).cast("double") / 127.5 - 1)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(F.length(text) > 0, F.transform(raw, lambda x: x / norm))


def embed(index: DataFrame, model: Callable[[list[str]], list[list[float]]], text: str = "content") -> DataFrame:
    """`index` with `embedding`, from any model that takes a list of texts and gives a list of vectors.

    The model gets the first 8000 characters of the texts that aren't empty, in batches of
    spark.sql.execution.arrow.maxRecordsPerBatch at most; where it gives another number of vectors than it got texts,
    none of that batch is attached.
    """

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        asked = [i for i, t in texts.items() if t]
        found = model([texts[i][:8000] for i in asked]) if asked else []
        if len(found) == len(asked):
            for i, v in zip(asked, found, strict=True):
                out[i] = [float(x) for x in v]
        return out

    return index.withColumn("embedding", vectors(F.col(text)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def grams(text: Column, n: int) -> Column:
    """The different runs of n characters."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def matching_symbols(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, repo, file_path, n): symbols whose lower-cased name holds a term of at least two characters.

    The different names are indexed by their runs of three and of two characters. A term is looked up by the rarest of its
    runs of three (a term of two by itself), and only the names behind that one are searched for it.
    """
    terms = queries.select("query", F.explode(F.array_distinct(F.filter(F.split(F.lower("query"), r"\s+"), lambda x: F.length(x) >= 2))).alias("term"))
    names = symbols.select("name").distinct().withColumn("lower", F.lower("name"))
    index = names.select("name", "lower", F.explode(F.concat(grams(F.col("lower"), 3), grams(F.col("lower"), 2))).alias("gram"))
    t = F.col("term")
    parts = terms.select("term").distinct().select("term", F.explode(F.when(F.length(t) == 2, F.array(t)).otherwise(grams(t, 3))).alias("gram"))
    rarest = parts.join(index.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    found = rarest.join(index, "gram").where(F.contains("lower", t)).select("term", "name")
    asked = terms.join(found, "term").select("query", "name").distinct()
    return symbols.select("repo", "file_path", "name").join(asked, "name").groupBy("query", "repo", "file_path").agg(F.count("*").alias("n"))


def candidates(ranked: DataFrame, by: str, limit: int = 10) -> DataFrame:
    """Of (by, key, rank) the 3 limit documents of each `by` that hybrid_search may take as text candidates."""
    w = Window.partitionBy(by).orderBy(F.desc("rank"), "key")
    return ranked.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= 3 * limit).drop("_n")


def hybrid_search(fts: DataFrame, vectors: DataFrame, boosts: DataFrame, limit: int = 10) -> DataFrame:
    """(query, key, rank, position, total): text rank and vector similarity merged.

    fts: (query, key, rank); vectors: (query, key, distance); boosts: (query, key, n). Each side gives at most 3 limit
    candidates. With vectors for a query 0.5 of the text rank, divided by its maximum, and 0.5 of the
    similarity 1 - d / 2; without, the text rank as it is. Symbols add 0.3 each, 1.0 at most.
    """
    q = Window.partitionBy("query")
    f = candidates(fts, "query", limit)
    v = vectors.withColumn("_n", F.row_number().over(q.orderBy("distance", "key"))).where(F.col("_n") <= 3 * limit).drop("_n")
    f = f.withColumn("top", F.max("rank").over(q)).withColumn("norm", F.when(F.col("top") > 0, F.col("rank") / F.col("top")).otherwise(0.0)).drop("top")
    m = f.join(v, ["query", "key"], "full").withColumn("with_vectors", F.count("distance").over(q) > 0).join(boosts, ["query", "key"], "left")
    vec = F.greatest(F.lit(0.0), 1 - F.col("distance") / 2)
    base = F.when(F.col("with_vectors"), 0.5 * F.coalesce("norm", F.lit(0.0)) + 0.5 * F.coalesce(vec, F.lit(0.0))).otherwise(F.coalesce("rank", F.lit(0.0)))
    m = m.withColumn("score", F.round(base + F.least(0.3 * F.coalesce("n", F.lit(0)), F.lit(1.0)), 4)).withColumn("total", F.count("*").over(q))
    m = m.withColumn("position", F.row_number().over(q.orderBy(F.desc("score"), "key"))).where(F.col("position") <= limit)
    return m.select("query", "key", F.col("score").alias("rank"), "position", "total")


def has_embeddings(index: DataFrame) -> DataFrame:
    """(repo, mode): hybrid where a repository has a vector, else fts."""
    return index.groupBy("repo").agg(F.when(F.bool_or(F.col("embedding").isNotNull()), "hybrid").otherwise("fts").alias("mode"))


def normalise_ranks(ranked: DataFrame) -> DataFrame:
    """`ranked` (query, .., rank) with norm: the rank over the query's largest, 0 where that isn't positive."""
    top = bounded(ranked.groupBy(F.col("query").alias("_query")).agg(F.max("rank").alias("_top")))
    out = ranked.join(top, F.col("query").eqNullSafe(F.col("_query")))
    return out.withColumn("norm", F.when(F.col("_top") > 0, F.col("rank") / F.col("_top")).otherwise(0.0)).drop("_query", "_top")
