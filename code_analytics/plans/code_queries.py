"""Registered queries on source files: selection, symbols, imports, graph, search. Each has the SQL it must equal."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import graph as G
from ..operators import imports as I
from ..operators import preflight as T
from ..operators import search as Q
from ..operators import selection as S
from ..operators import symbols as P
from ..operators import vectors as V
from ..functions.text import bounded, language
from ..sources.corpus import cte, derived, table
from ..sources.shared import exists, shared_folder, stored
from ..sources.tables import VersionedTable
from ..sources.tree import scanned


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "code_files")


def _selected(spark: SparkSession, d: str) -> DataFrame:
    return S.select_source_files(_files(spark, d))


def _index(spark: SparkSession, d: str) -> DataFrame:
    return _selected(spark, d).withColumn("line_count", S.line_count(F.col("content")))


def _edges(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    """The edges of the selected files that `where` holds of, among all files."""
    files = _files(spark, d)
    return I.resolve_imports(I.extract_imports(S.select_source_files(files).where(where)), files, I.package_roots(files))


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return P.extract_symbols(_selected(spark, d))


def _stored_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The symbols as a table of its own, for what reads them more than once: the texts are parsed once."""
    return stored(_symbols(spark, d).select("repo", "file_path", "name", "kind", "start_line", "end_line"))


def _repos(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select((F.col("s_suppkey") % 8).alias("k")).distinct()
    return s.select(F.concat(F.lit("org/repo"), F.col("k").cast("string")).alias("repo"), F.concat(F.lit("Org/Full"), F.col("k").cast("string")).alias("github_full_name"))


def s1_scan_tree(spark: SparkSession, d: str) -> DataFrame:
    """A tree with a folder for each supplier, of which every seventh holds bytes that are no UTF-8, written and scanned."""
    k = F.col("s_suppkey")
    text = F.when(k % 7 == 0, F.unhex(F.lit("FFFE41")).cast("string")).otherwise(F.concat("s_name", F.lit("\n# "), k.cast("string")))
    root = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    rows = table(spark, d, "supplier").select(k.cast("string").alias("place"), text.alias("value")).repartition("place")
    rows.write.partitionBy("place").text(root)
    scan = scanned(spark, root, "r")
    place = F.regexp_extract("file_path", r"^place=([^/]+)/", 1).cast("long").alias("place")
    # the marker that Spark leaves beside the folders is an empty file
    return scan.where("file_path like 'place=%' or reason is not null").select(place, "size", F.when(F.col("reason").isNull(), F.md5("content")).alias("hash"), "reason")


def s2_select_source_files(spark: SparkSession, d: str) -> DataFrame:
    return _selected(spark, d).select("repo", "file_path", "language", "size")


def s3_build_code_index(spark: SparkSession, d: str) -> DataFrame:
    files = P.parsed(_selected(spark, d))
    heads = files.select("repo").distinct().withColumn("head_sha", F.sha2("repo", 256))
    out = S.build_code_index(files, P.extract_symbols(files), I.extract_imports(files), heads)
    n = lambda c: F.size(f"structure.{c}").cast("long").alias(f"n_{c}")
    return out.select("repo", "file_path", "language", F.col("line_count").cast("long").alias("line_count"), "head_sha", n("functions"), n("classes"), n("imports"))


def s4_index_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.index_summary(_index(spark, d), _symbols(spark, d), _edges(spark, d))


def _name_status(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    letter = F.element_at(F.array(*[F.lit(x) for x in ("A", "M", "D", "R085", "C100", "T", "X")]), (k % 7 + 1).cast("int"))
    path = lambda x: F.concat(F.lit(x), F.lit("\\m"), k.cast("string"), F.lit(".py"))
    line = F.when(k % 11 == 0, "M").when(letter.isin("R085", "C100"), F.concat_ws("\t", letter, path("src"), path("new"))).otherwise(F.concat_ws("\t", letter, path("src")))
    return o.select(F.concat(F.lit("org/repo"), (k % 5).cast("string")).alias("repo"), k.alias("seq"), line.alias("line"))


def s5_parse_name_status(spark: SparkSession, d: str) -> DataFrame:
    return C.parse_name_status(_name_status(spark, d))


def s6_snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return C.snapshot_diff(derived(spark, d, "code_files"), derived(spark, d, "code_files_v2"))


def s7_index_mode(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    heads = table(spark, d, "orders").select(
        k.alias("run"), F.when(k % 5 > 0, (k % 3).cast("string")).alias("old_sha"), F.when(k % 7 > 0, (k % 2).cast("string")).alias("new_sha"), (k % 4 > 0).alias("has_changes")
    )
    return C.index_mode(heads).select("run", "mode")


def s8_merge_files(spark: SparkSession, d: str) -> DataFrame:
    old, new = derived(spark, d, "code_files"), derived(spark, d, "code_files_v2")
    merged = C.merge_files(S.select_source_files(old).select("repo", "file_path", "content"), C.snapshot_diff(old, new), new)
    return merged.select("repo", "file_path", F.md5("content").alias("hash"))


def s8_merge_edges(spark: SparkSession, d: str) -> DataFrame:
    old, new = derived(spark, d, "code_files"), derived(spark, d, "code_files_v2")
    edges = lambda f: I.resolve_imports(I.extract_imports(S.select_source_files(f)), f, I.package_roots(f))
    merged = C.merge_edges(edges(old), C.snapshot_diff(old, new), edges(new))
    return merged.groupBy("repo", "src_file").agg(F.count("*").alias("n"), F.count("dst_file").alias("n_resolved"))


def s9_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Two repositories are indexed anew from the second snapshot."""
    fresh = S.select_source_files(derived(spark, d, "code_files_v2").where("repo in ('org/repo1', 'org/repo3')"))
    return C.rebuild(_selected(spark, d), fresh).select("repo", "file_path", F.md5("content").alias("hash"))


def _stored_index(spark: SparkSession, d: str) -> VersionedTable:
    """The selected files as a stored index of its own."""
    out = VersionedTable(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", "repo string, file_path string, content string", n_buckets=8)
    out.append(_selected(spark, d))
    return out


def s9_rebuild_stored(spark: SparkSession, d: str) -> DataFrame:
    """The same on a stored index, of which the other repositories' files stay untouched."""
    index = _stored_index(spark, d)
    C.rebuild_stored(index, S.select_source_files(derived(spark, d, "code_files_v2").where("repo in ('org/repo1', 'org/repo3')")))
    return index.read().select("repo", "file_path", F.md5("content").alias("hash"))


def s10_upsert_repos(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    name = F.concat(F.lit("r"), k.cast("string"))
    old = c.where(k % 3 != 0).select(name.alias("repo"), F.lit("/old").alias("root_path"), F.when(k % 2 == 0, F.concat(F.lit("o/"), name)).alias("github_full_name"), F.lit("dev").alias("default_branch"), (k % 5 == 0).alias("auto_test_generation"))
    new = c.where(k % 4 != 0).select(name.alias("repo"), F.lit("/new").alias("root_path"), F.concat(F.lit("n/"), name).alias("github_full_name"), F.when(k % 7 == 0, F.lit("trunk")).alias("default_branch"))
    return C.upsert_repos(old, new)


def p1_python_symbols(spark: SparkSession, d: str) -> DataFrame:
    return P.python_symbols(_selected(spark, d)).select("repo", "file_path", "name", "kind", "start_line", "end_line", "parent_class", "signature")


def p3_js_symbols(spark: SparkSession, d: str) -> DataFrame:
    return P.js_symbols(_selected(spark, d)).select("repo", "file_path", "name", "kind", "start_line", "end_line", "signature")


def p4_extract_imports(spark: SparkSession, d: str) -> DataFrame:
    return I.extract_imports(_selected(spark, d)).select("repo", "file_path", "raw", "start_line")


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    return S.select_source_files(derived(spark, d, "source_shapes"))


def p2_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of texts with heads over several lines, decorators, docstrings, nested scopes and hidden or broken code."""
    return P.extract_symbols(_shapes(spark, d)).select(
        "repo", "file_path", "name", "kind", "start_line", "end_line", "parent_class", "signature", "docstring", F.array_join("decorators", "|").alias("decorators")
    )


def p4_shapes(spark: SparkSession, d: str) -> DataFrame:
    return I.extract_imports(_shapes(spark, d)).select("repo", "file_path", "raw", "start_line")


def p6_structures(spark: SparkSession, d: str) -> DataFrame:
    """Every file keeps its row, also one that can't be read or has no known language."""
    files = derived(spark, d, "source_shapes").unionByName(derived(spark, d, "source_shapes").select("repo", F.concat("file_path", F.lit(".txt")).alias("file_path"), "content"))
    files = files.withColumn("language", language(F.col("file_path")))
    s = P.structure(F.col("content"), F.col("language"))
    return files.select("repo", "file_path", s.alias("s")).select("repo", "file_path", F.size("s.symbols").cast("long").alias("n_symbols"), F.size("s.imports").cast("long").alias("n_imports"))


def p5_symbol_table(spark: SparkSession, d: str) -> DataFrame:
    return P.symbol_table(_symbols(spark, d)).select("repo", "file_path", "ordinal", "name", "kind", "start_line")


def i1_package_roots(spark: SparkSession, d: str) -> DataFrame:
    return I.package_roots(_files(spark, d))


def i4_import_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


def i2_resolve_python(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d, "language = 'python'").select("repo", "src_file", "dst_file", "raw_import")


def i3_resolve_js(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d, "language <> 'python'").select("repo", "src_file", "dst_file", "raw_import")


def g1_load_bearing(spark: SparkSession, d: str) -> DataFrame:
    return G.load_bearing(_index(spark, d), _edges(spark, d))


def g1_part_in_degree(spark: SparkSession, d: str) -> DataFrame:
    """The same operator on a large graph: orders point to parts."""
    edges = table(spark, d, "lineitem").select(F.lit("all").alias("repo"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst_file"))
    index = table(spark, d, "part").select(F.lit("all").alias("repo"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("file_path"))
    return G.load_bearing(index, edges, 100)


def g2_neighborhood(spark: SparkSession, d: str) -> DataFrame:
    index = stored(_selected(spark, d).select("repo", "file_path"))
    return G.neighborhood(index, stored(_edges(spark, d)), index)


def g3_repo_summary(spark: SparkSession, d: str) -> DataFrame:
    return G.repo_summary(_repos(spark, d), _index(spark, d))


def g4_repo_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.repo_stats(_index(spark, d), _symbols(spark, d), _edges(spark, d))


def g5_resolve_repos(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    name = (k % 11).cast("string")
    asked = F.when(k % 3 == 0, F.concat(F.lit("org/repo"), name)).when(k % 3 == 1, F.concat(F.lit("  ORG/full"), name, F.lit(" "))).otherwise(F.concat(F.lit("none"), name))
    return G.resolve_repos(table(spark, d, "customer").select(asked.alias("request")), _repos(spark, d))


def q1_symbol_lookup(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select((F.col("n_nationkey") * 3).alias("k"))
    q = n.select(F.explode(F.array(F.concat(F.lit("C"), F.col("k").cast("string")), F.concat(F.lit("fn_"), F.col("k").cast("string")))).alias("query"))
    return Q.symbol_lookup(_index(spark, d), _symbols(spark, d), q).select("query", "ordinal", "total", "repo", "file_path", "name", "kind", "code")


def q3_tokenize(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of each token over all documents."""
    t = Q.tokenize(table(spark, d, "documents"), "doc_id")
    return t.groupBy("token").agg(F.count("*").alias("n"), F.max("pos").cast("long").alias("last_pos"))


def _text_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select(F.element_at(F.array(*[F.lit(x) for x in QUERY_TEXTS]), (F.col("r_regionkey") + 1).cast("int")).alias("query"))


QUERY_TEXTS = ("the of", "tion", "was inin", "der und", "la de")


_positions: dict[tuple[str, str], VersionedTable] = {}


def _document_index(spark: SparkSession, d: str) -> VersionedTable:
    """The positional index of the documents, built once a session: two segments, as when documents come later."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _positions or not exists(spark, _positions[at].path):
        index = Q.positional_index(spark, f"{shared_folder(spark)}/positions-{uuid.uuid4().hex}", "doc_id", 16)
        docs = table(spark, d, "documents")
        for part in (0, 1):
            index.append(Q.postings(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == part), "doc_id"))
        _positions[at] = index
    return _positions[at]


def q3_positional_index(spark: SparkSession, d: str) -> DataFrame:
    """Of each term of the index its documents, places and the sum of the first places."""
    return _document_index(spark, d).read().groupBy("term").agg(F.count("*").alias("docs"), F.sum(F.size("gaps")).alias("places"), F.sum(F.get("gaps", F.lit(0))).alias("first_places"))


def q4_fts_match(spark: SparkSession, d: str) -> DataFrame:
    return Q.fts_match_indexed(_document_index(spark, d), _text_queries(spark, d), "doc_id")


def q5_cover_density(spark: SparkSession, d: str) -> DataFrame:
    return Q.cover_density_indexed(_document_index(spark, d), _text_queries(spark, d), "doc_id")


def q6_headline(spark: SparkSession, d: str) -> DataFrame:
    return Q.headline(table(spark, d, "documents"), _text_queries(spark, d), "doc_id", index=_document_index(spark, d))


def q7_hash_embed(spark: SparkSession, d: str) -> DataFrame:
    e = Q.hash_embed(F.col("text"), 8)
    docs = table(spark, d, "documents").select("doc_id", e.alias("e"))
    return docs.select("doc_id", F.round(F.get("e", F.lit(0)), 6).alias("e0"), F.round(F.get("e", F.lit(7)), 6).alias("e7"), F.round(Q.dot(F.col("e"), F.col("e")), 6).alias("norm"))


def q8_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return V.exact(e, e.where("vec_id % 50 = 0"), 10, 1.0)


def q8_vector_index(spark: SparkSession, d: str) -> DataFrame:
    """The same from an inverted file, with at least nine tenths of the rows."""
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 50 = 0")
    return V.InvertedFile(e, queries=asked).search(asked, 10, 1.0)


def q9_has_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    k = F.col("vec_id") % 7
    return Q.has_embeddings(e.select(F.concat(F.lit("r"), k.cast("string")).alias("repo"), F.when(k > 2, F.col("embedding")).alias("embedding")))


def q10_normalise_ranks(spark: SparkSession, d: str) -> DataFrame:
    return Q.normalise_ranks(stored(q5_cover_density(spark, d))).select("query", "doc_id", F.round("norm", 6).alias("norm"))


def q12_matching_symbols(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "nation").select(F.concat(F.lit("a c"), F.col("n_nationkey").cast("string"), F.lit(" method")).alias("query"))
    return Q.matching_symbols(_stored_symbols(spark, d), q)


HYBRID_LIMIT = 10


def q11_hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """A query for every fiftieth vector, with one of the texts; documents by text rank and by the distance of their vector; every seventh has a boost, and one text has no vectors."""
    e = table(spark, d, "embeddings")
    number = (F.floor(F.col("vec_id") / 50) % len(QUERY_TEXTS) + 1).cast("int")
    asked = e.where("vec_id % 50 = 0").select("vec_id", F.element_at(F.array(*[F.lit(x) for x in QUERY_TEXTS]), number).alias("text"))
    name = F.concat("text", F.lit(" #"), F.col("vec_id").cast("string"))
    ranked = stored(q5_cover_density(spark, d).select(F.col("query").alias("text"), F.col("doc_id").alias("key"), "rank"))
    # the queries share few texts: a text's candidates are taken before they meet its queries
    fts = asked.join(bounded(Q.candidates(ranked, "text", HYBRID_LIMIT)), "text").select(name.alias("query"), "text", "key", "rank")
    near = V.exact(e, e.where("vec_id % 50 = 0"), 3 * HYBRID_LIMIT).withColumnRenamed("vec_id", "key")
    vectors = stored(near.join(asked.where("text <> 'tion'").withColumnRenamed("vec_id", "query"), "query").select(F.concat("text", F.lit(" #"), F.col("query").cast("string")).alias("query"), "text", "key", "distance"))
    # a boost is asked for only where a document is a candidate
    asked_boosts = fts.select("query", "text", "key").union(vectors.select("query", "text", "key")).where("key % 7 = 0").distinct()
    boosts = asked_boosts.join(ranked.select("text", "key").distinct(), ["text", "key"], "left_semi").select("query", "key", F.lit(1).cast("long").alias("n"))
    return Q.hybrid_search(fts.drop("text"), vectors.drop("text"), boosts, HYBRID_LIMIT)


def t1_has_existing_tests(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    targets = _selected(spark, d).where("language = 'python'")
    return T.has_existing_tests(targets, files, I.package_roots(files))


def t1_prefix_imports(spark: SparkSession, d: str) -> DataFrame:
    """The same with tests that import below a module, inside a block, or the module as one of several names."""
    files = _files(spark, d).unionByName(derived(spark, d, "test_uses"))
    return T.has_existing_tests(_selected(spark, d).where("language = 'python'"), files, I.package_roots(files))


def t2_importable_names(spark: SparkSession, d: str) -> DataFrame:
    return T.importable_names(_selected(spark, d).where("language = 'python'"), I.package_roots(_files(spark, d)))


def t3_is_feasible(spark: SparkSession, d: str) -> DataFrame:
    return T.is_feasible(_files(spark, d), _index(spark, d), _symbols(spark, d))


def t4_prior_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Feasibility with a log in which every sixth part's module was tried, and as many were looked at by another agent."""
    k, j = F.col("p_partkey"), F.floor(F.col("p_partkey") / 5.0)
    path = F.concat(F.lit("src/pkg"), (j % 8).cast("string"), F.lit("/m"), j.cast("string"), F.lit(".py"))
    log = table(spark, d, "part").where(k % 3 == 0).select(
        F.concat(F.lit("Org/Repo"), (k % 5).cast("string")).alias("repo"), F.when(k % 2 == 0, "test_generator").otherwise("pr_reviewer").alias("agent"), F.array(F.lit("x"), F.concat(F.lit("target_file:"), path)).alias("evidence")
    )
    return T.is_feasible(_files(spark, d), _index(spark, d), _symbols(spark, d), log)


def t5_preview(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    return T.preview(_index(spark, d), files, _symbols(spark, d), I.package_roots(files))


def t6_select_jobs(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    index = _index(spark, d)
    k = F.substring("repo", -1, 1).cast("int")
    summaries = index.select("repo").distinct().select("repo", (k % 4 != 3).alias("opted_in"), F.when(k == 4, "full").otherwise("incremental").alias("mode"), F.sha2("repo", 256).alias("head_sha"))
    added = index.where("language = 'python' and repo <> 'org/repo0'").select("repo", "file_path")
    return T.select_jobs(summaries, added, T.is_feasible(added, index, _symbols(spark, d)), cap=2)


QUERIES = {k: v for k, v in list(globals().items()) if k[:1] in "spigqt" and k[1:2].isdigit() and callable(v)}

_SEL = f"""sel as (select repo, file_path, content, cast(strlen(content) as bigint) as size,
  case regexp_extract(file_path,'[^/](\\.[^./]+)$',1) when '.py' then 'python' when '.ts' then 'typescript' else 'javascript' end as language
  from code_files where regexp_extract(file_path,'[^/](\\.[^./]+)$',1) in ('.py','.ts','.js','.mjs','.cjs','.jsx')
  and not list_has_any(string_split(file_path,'/'), {_list(S.SKIP_DIRS + S.TEST_DIRS)}) and strlen(content) <= 200000
  and not regexp_matches(file_path, '(\\.min\\.js|\\.min\\.css|\\.d\\.ts|\\.pyi|_pb2\\.py|_pb2_grpc\\.py|\\.lock)$')),
idx as (select *, length(content)-length(replace(content,chr(10),''))+(case when right(content,1)=chr(10) then 0 else 1 end) as line_count from sel)"""

_LINES = """ln as (select repo, file_path, language, unnest(range(1,len(l)+1)) as line, unnest(l) as t from (select *, string_split(content,chr(10)) as l from sel))"""

_IMPORTS = r"""imp as (select repo, file_path, language, line, row_number() over (partition by repo, file_path order by line) as ord, rtrim(regexp_extract(t, '^[ \t]*(.*)$', 1)) as raw from ln
  where (language='python' and regexp_matches(t,'^[ \t]*(from[ \t]+\S+[ \t]+import[ \t]+|import[ \t]+)')) or (language<>'python' and regexp_matches(t,'^[ \t]*import\s+([^''";]*from\s+)?[''"][^''"]+[''"];?')))"""

_SYMBOLS = r"""hd as (select repo, file_path, language, line, t, length(regexp_extract(t,'^([ \t]*)',1)) as ind,
    case when language='python' then regexp_extract(t,'^[ \t]*(async[ \t]+)?(def|class)[ \t]+(\w+)',2) else 'function' end as word,
    case when language='python' then regexp_extract(t,'^[ \t]*(async[ \t]+)?(def|class)[ \t]+(\w+)',3) else regexp_extract(t,'function (\w+)',1) end as name from ln
  where (language='python' and regexp_matches(t,'^[ \t]*(async[ \t]+)?(def|class)[ \t]+\w+')) or (language<>'python' and regexp_matches(t,'^export function \w+'))),
nx as (select h.repo, h.file_path, h.line, coalesce(min(l.line) filter (where h.language='python' and l.t<>'' and length(regexp_extract(l.t,'^([ \t]*)',1))<=h.ind), 1000000) as nxt,
   min(l.line) filter (where h.language<>'python' and l.t='}') as closing from hd h left join ln l on l.repo=h.repo and l.file_path=h.file_path and l.line>h.line group by all),
en as (select h.*, n.nxt, case when h.language='python' then (select max(l.line) from ln l where l.repo=h.repo and l.file_path=h.file_path and l.line>=h.line and l.line<n.nxt and l.t<>'') else n.closing end as end_line
   from hd h join nx n on h.repo=n.repo and h.file_path=n.file_path and h.line=n.line),
pa as (select e.repo, e.file_path, e.line, max_by(c.name, c.line) as parent_class from en e join en c on c.word='class' and c.repo=e.repo and c.file_path=e.file_path and c.line<e.line and c.nxt>e.line and c.ind<e.ind where e.word='def' group by all),
sym as (select e.repo, e.file_path, e.name, e.language, case when word='class' then 'class' when parent_class is not null then 'method' else 'function' end as kind, cast(e.line as int) as start_line, cast(end_line as int) as end_line, parent_class,
   case when word='def' then 'def ' || regexp_extract(t,'def[ \t]+(\w+[ \t]*\(.*\))[ \t]*:',1) when word='function' then 'function ' || regexp_extract(t,'(\w+\([^)]*\))',1) end as signature
   from en e left join pa p on p.repo=e.repo and p.file_path=e.file_path and p.line=e.line)"""

_ROOTS = f"""ini as (select distinct repo, regexp_replace(file_path,'/?[^/]*$','') as dir from code_files where regexp_extract(file_path,'([^/]+)$',1)='__init__.py' and not list_has_any(string_split(file_path,'/'), {_list(S.SKIP_DIRS + S.TEST_DIRS)})),
climb as (select repo, dir from ini union select c.repo, regexp_replace(c.dir,'/?[^/]*$','') from climb c join ini i on i.repo=c.repo and i.dir=c.dir where c.dir<>''),
rt as (select distinct repo, dir as root from climb c where not exists (select 1 from ini i where i.repo=c.repo and i.dir=c.dir) or dir='' union select distinct repo, '' from code_files),
roots as (select repo, root, cast(row_number() over (partition by repo order by case when root='' then 0 else len(string_split(root,'/')) end desc, root) - 1 as int) as root_ord from rt)"""

_EDGES = r"""cand as (
  select i.*, 0 as rank, array_to_string(list_filter([regexp_replace(file_path,'/[^/]*$','')], lambda x: x<>''),'') || '/' || replace(regexp_extract(raw,'^from \.(\w+) import',1),'.','/') || '.py' as path from imp i where language='python' and raw like 'from .%'
  union all select i.*, 2*root_ord + k, case when root='' then '' else root || '/' end || replace(case when raw like 'from %' then regexp_extract(raw,'^from (\S+) import',1) else regexp_extract(raw,'^import ([^\s,;]+)',1) end,'.','/') || case when k=0 then '.py' else '/__init__.py' end
    from imp i join roots r on r.repo=i.repo cross join (select unnest([0,1]) as k) where language='python' and raw not like 'from .%'
  union all select i.*, k, regexp_replace(file_path,'/[^/]*$','') || '/' || regexp_extract(raw,'[''"]\./([^''"]+)[''"]',1) || ext from imp i cross join (select unnest(range(0,13)) as k, unnest(['','.ts','.tsx','.js','.jsx','.mjs','.cjs','/index.ts','/index.tsx','/index.js','/index.jsx','/index.mjs','/index.cjs']) as ext) where language<>'python' and regexp_matches(raw,'[''"]\./')),
hit as (select c.repo, c.file_path, c.ord, min_by(c.path, c.rank) as dst_file from cand c join (select distinct repo, file_path as path from code_files) f on f.repo=c.repo and f.path=c.path group by all),
edges as (select i.repo, i.file_path as src_file, h.dst_file, i.raw as raw_import, i.language from imp i left join hit h on h.repo=i.repo and h.file_path=i.file_path and h.ord=i.ord)"""


_NAMES = r"""select * from (select distinct s.repo, s.file_path, regexp_replace(replace(regexp_replace(case when root='' then s.file_path else substr(s.file_path, length(root)+2) end,'\.py$',''),'/','.'),'\.?__init__$','') as name
      from sel s join roots r on r.repo=s.repo where language='python' and (root='' or starts_with(s.file_path, root||'/'))) where name<>''"""
_FEASIBLE = """, c as (select repo, file_path, count(*) as n from sym group by all) select f.repo, f.file_path, case when s.language is null then 'not_indexed' when s.language<>'python' then 'non_python' when c.n is null then 'no_symbols' end as reason from code_files f left join sel s on s.repo=f.repo and s.file_path=f.file_path left join c on c.repo=f.repo and c.file_path=f.file_path"""
_TESTED = rf"""tt as (select repo, file_path, regexp_replace(file_path,'/?[^/]*$','') as dir, regexp_extract(file_path,'([^/]+?)(?:\.[^./]+)?$',1) as stem from sel where language='python'),
cf as (select repo, file_path as test_path, regexp_replace(file_path,'/?[^/]*$','') as dir, regexp_extract(file_path,'([^/]+)$',1) as nm, content,
  list_has_any(string_split(file_path,'/'), {_list(S.SKIP_DIRS)}) as skipped, list_has_any(string_split(file_path,'/'), {_list(S.TEST_DIRS)}) as in_tests from code_files),
tl as (select repo, test_path, unnest(string_split(content,chr(10))) as t from cf where ends_with(nm,'.py') and not skipped and (in_tests or starts_with(nm,'test_') or ends_with(nm,'_test.py'))),
tm as (select repo, test_path, regexp_extract(t,'\bfrom\s+([\w.]+)\s+import\b',1) as m, regexp_extract(t,'\bfrom\s+[\w.]+\s+import\b(.*)$',1) as w, unnest(regexp_extract_all(t,'\bimport\s+([\w.]+)',1)) as p from tl),
tn as (select repo, test_path, array_to_string(string_split(p,'.')[1:k],'.') as name from (select *, unnest(range(1, len(string_split(p,'.'))+1)) as k from tm) union select repo, test_path, m from tm where m<>'' union select repo, test_path, m||'.'||unnest(regexp_extract_all(w,'\w+')) from tm where m<>''),
nms as ({_NAMES}),
c1 as (select t.repo, t.file_path, case when f.nm='test_'||stem||'.py' then 0 else 1 end as rank, test_path, 'sibling' as how from tt t join cf f on f.repo=t.repo and f.dir=t.dir and f.nm in ('test_'||stem||'.py', stem||'_test.py')
  union all select t.repo, t.file_path, 10, test_path, 'in_test_dir' from tt t join cf f on f.repo=t.repo and f.nm in ('test_'||stem||'.py', stem||'_test.py') where in_tests and not skipped
  union all select nms.repo, nms.file_path, 20, test_path, 'imports_target' from nms join tn on nms.repo=tn.repo and nms.name=tn.name),
b1 as (select *, row_number() over (partition by repo, file_path order by rank, test_path) as n from c1),
t1 as (select tt.repo, tt.file_path, 'tests_exist:'||how||':'||test_path as reason from tt left join b1 on b1.repo=tt.repo and b1.file_path=tt.file_path and n=1)"""


def _with(*blocks: str) -> str:
    """The derived source files and further blocks."""
    return cte("code_files").replace("with ", "with recursive ", 1) + "".join(", " + b for b in blocks) + "\n"


_V2 = cte("code_files", "code_files_v2").split("code_files_v2 as", 1)[1]
_DIFF = "diff as (select coalesce(a.repo,b.repo) as repo, coalesce(a.file_path,b.file_path) as file_path, case when a.repo is null then 'added' when b.repo is null then 'deleted' else 'modified' end as status from code_files a full join v2 b on a.repo=b.repo and a.file_path=b.file_path where a.content is distinct from b.content)"


def _of_v2(block: str) -> str:
    """The same block over the second snapshot; its tables end in _v2."""
    return re.sub(r"\b(sel|idx|ln|imp|ini|climb|rt|roots|cand|hit|edges)\b(?!\.)", r"\1_v2", re.sub(r"\bcode_files\b", "v2", block))


_SYM, _EDG = (_SEL, _LINES, _SYMBOLS), (_SEL, _LINES, _IMPORTS, _ROOTS, _EDGES)
_ALL = (_SEL, _LINES, _SYMBOLS, _IMPORTS, _ROOTS, _EDGES)
_REPOS = "reps as (select distinct 'org/repo' || cast(s_suppkey%8 as varchar) as repo, 'Org/Full' || cast(s_suppkey%8 as varchar) as full_name from supplier)"
_TOK = r"""tok as (select doc_id, unnest(range(0,len(l))) as pos, unnest(l) as token from (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text,'')),'[^\p{L}\p{N}]+'), lambda x: x<>'') as l from documents)),
qq as (select case r_regionkey when 0 then 'the of' when 1 then 'tion' when 2 then 'was inin' when 3 then 'der und' else 'la de' end as query from region),
term as (select query, unnest(string_split(query,' ')) as term, len(string_split(query,' ')) as n from qq),
h as (select query, doc_id, pos, term, n from tok join term on token=term)"""
_COVER = """okd as (select query, doc_id from h group by query, doc_id, n having count(distinct term)=n),
hh as (select h.*, row_number() over (partition by query, doc_id order by pos) as nth from h join okd using (query, doc_id)),
lp as (select x.query, x.doc_id, x.pos, x.nth, x.n, y.term, max(y.pos) as p, max(y.nth) as k from hh x join hh y on x.query=y.query and x.doc_id=y.doc_id and y.pos<=x.pos group by all),
ls as (select query, doc_id, pos, nth, min(p) as l, min(k) as lk from lp group by query, doc_id, pos, nth, n having count(*)=n),
cv as (select query, doc_id, l, min(pos) as r, min(nth) as rk, min(lk) as lk from ls group by query, doc_id, l),
fts as (select query, doc_id, round(sum(0.1/(1+(r-l+1)-(rk-lk+1))),6) as rank from cv group by query, doc_id)"""

def _rows(rows: list[tuple]) -> str:
    """A list of rows as SQL, {k} standing for the number of the file."""
    one = lambda v: "null" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "values " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


# what stands in the shapes, read off their texts
_SHAPE_SYMBOLS = [
    ("m{k}.py", "go_{k}", "async_function", 18, 25, None, 'async def go_{k}(\n    x: int,\n    y=")",\n) -> int', "Goes there.", '@deco(\n    "x",\n)|@other'),
    ("m{k}.py", "Outer{k}", "class", 27, 36, None, None, "Holds things.", ""),
    ("m{k}.py", "Inner", "class", 29, 30, None, None, None, ""),
    ("m{k}.py", "get", "method", 30, 30, "Inner", "def get(self)", None, ""),
    ("m{k}.py", "run", "method", 32, 36, "Outer{k}", "def run(self)", None, ""),
    ("m{k}.py", "helper", "method", 34, 35, "Outer{k}", "def helper()", None, ""),
    ("m{k}.ts", "add_{k}", "async_function", 10, 15, None, 'async function add_{k}(\n  x: number,\n  y: string = "{",\n): Promise<number>', "Adds one.", ""),
    ("m{k}.ts", "Box{k}", "class", 17, 25, None, None, None, ""),
    ("m{k}.ts", "open", "method", 19, 21, "Box{k}", "function open(a: T): void", "Opens it.", ""),
    ("m{k}.ts", "load", "async_method", 22, 24, "Box{k}", "async function load()", None, ""),
    ("m{k}.ts", "Shape", "interface", 27, 27, None, None, None, ""),
    ("m{k}.ts", "twice", "function", 29, 29, None, "function twice(n: number): number", None, ""),
    ("m{k}.ts", "later", "async_function", 30, 32, None, "async function later()", None, ""),
    ("bad{k}.py", "fine", "function", 4, 5, None, "def fine()", None, ""),
    ("bad{k}.py", "shout", "function", 7, 8, None, "def shout()", None, ""),
    ("bad{k}.py", "Old", "class", 10, 14, None, None, None, ""),
    ("bad{k}.py", "m", "method", 11, 12, "Old", "def m(self)", None, ""),
    ("bad{k}.py", "n", "method", 13, 14, "Old", "def n(self)", None, ""),
    ("mark{k}.py", "first", "function", 1, 2, None, "def first()", None, ""),
]
_SHAPE_IMPORTS = [
    ("m{k}.py", "import os, sys", 4),
    ("m{k}.py", "from .m{k} import (\n    a,\n    b,\n)", 5),
    ("m{k}.py", "import late", 33),
    ("m{k}.ts", "import { a } from './m{k}';", 1),
    ("m{k}.ts", 'import type {\n  B,\n} from "../b";', 2),
]
_K = lambda c: f"replace({c}, '{{k}}', cast(s_suppkey as varchar))"
_PLACE = f"'org/repo' || cast(s_suppkey%5 as varchar) as repo, 'src/shapes/' || {_K('f')} as file_path"
_SHAPE_SQL = {
    "p2_shapes": f"""select {_PLACE}, {_K('name')} as name, kind, cast(a as int) as start_line, cast(b as int) as end_line, {_K('parent')} as parent_class, {_K('sig')} as signature, doc as docstring, decorators
      from supplier cross join ({_rows(_SHAPE_SYMBOLS)}) t(f, name, kind, a, b, parent, sig, doc, decorators)""",
    "p4_shapes": f"select {_PLACE}, {_K('raw')} as raw, cast(a as int) as start_line from supplier cross join ({_rows(_SHAPE_IMPORTS)}) t(f, raw, a)",
    "p6_structures": f"""select {_PLACE}, n_symbols, n_imports from supplier cross join (select * from (values ('m{{k}}.py', 6::bigint, 3::bigint), ('m{{k}}.ts', 7, 2), ('bad{{k}}.py', 5, 0), ('mark{{k}}.py', 1, 0), ('bad{{k}}.js', 0, 0)) t(f, n_symbols, n_imports)
      union all select f || '.txt', 0::bigint, 0::bigint from (values ('m{{k}}.py'), ('m{{k}}.ts'), ('bad{{k}}.py'), ('mark{{k}}.py'), ('bad{{k}}.js')) t(f))""",
}

ORACLE_SQL = {
    "s1_scan_tree": """with s as (select s_suppkey as place, s_name||chr(10)||'# '||cast(s_suppkey as varchar)||chr(10) as text from supplier)
      select place, case when place%7=0 then 4::bigint else strlen(text) end as size, case when place%7<>0 then md5(text) end as hash, case when place%7=0 then 'not UTF-8' end as reason from s""",
    "s2_select_source_files": _with(_SEL) + "select repo, file_path, language, size from sel",
    "s3_build_code_index": _with(_SEL, _LINES, _SYMBOLS, _IMPORTS) + """select idx.repo, idx.file_path, language, cast(line_count as bigint) as line_count, sha256(idx.repo) as head_sha, coalesce(f,0) as n_functions, coalesce(c,0) as n_classes, coalesce(i,0) as n_imports
      from idx left join (select repo, file_path, count(*) filter (kind<>'class') as f, count(*) filter (kind='class') as c from sym group by all) s on s.repo=idx.repo and s.file_path=idx.file_path
      left join (select repo, file_path, count(*) as i from imp group by all) m on m.repo=idx.repo and m.file_path=idx.file_path""",
    "s4_index_summary": _with(*_ALL) + """select a.*, coalesce(functions,0) as functions, coalesce(classes,0) as classes, coalesce(edges_total,0) as edges_total, coalesce(edges_resolved,0) as edges_resolved
      from (select repo, count(*) as files, cast(sum(line_count) as bigint) as lines from idx group by repo) a left join (select repo, count(*) filter (kind<>'class') as functions, count(*) filter (kind='class') as classes from sym group by repo) s using (repo)
      left join (select repo, count(*) as edges_total, count(dst_file) as edges_resolved from edges group by repo) e using (repo)""",
    "s5_parse_name_status": r"""with o as (select 'org/repo'||cast(o_orderkey%5 as varchar) as repo, o_orderkey as seq, o_orderkey%7 as m, 'src/m'||cast(o_orderkey as varchar)||'.py' as p, 'new/m'||cast(o_orderkey as varchar)||'.py' as q from orders where o_orderkey%11<>0)
      select repo, seq, cast(0 as int) as ord, case m when 0 then 'added' when 1 then 'modified' when 2 then 'deleted' when 3 then 'deleted' when 4 then 'added' when 5 then 'modified' end as status, case when m=4 then q else p end as relative_path, cast(null as varchar) as previous_path from o where m<>6
      union all select repo, seq, 1, 'added', q, p from o where m=3""",
    "s6_snapshot_diff": _with("v2 as" + _V2, _DIFF) + "select * from diff",
    "s7_index_mode": """select o_orderkey as run, case when o_orderkey%5=0 then 'full' when o_orderkey%7=0 then 'full' when o_orderkey%3=o_orderkey%2 then 'noop' when o_orderkey%4>0 then 'incremental' else 'full' end as mode from orders""",
    "s8_merge_files": _with("v2 as" + _V2, _DIFF, _SEL, _SEL.split(",\nidx as")[0].replace("sel as", "sel2 as").replace("from code_files", "from v2").replace("and strlen(content) <= 200000", "")) + """select repo, file_path, md5(content) as hash from sel where not exists (select 1 from diff where diff.repo=sel.repo and diff.file_path=sel.file_path)
      union all select s.repo, s.file_path, md5(content) from sel2 s join diff d on d.repo=s.repo and d.file_path=s.file_path where status<>'deleted'""",
    "s8_merge_edges": _with("v2 as" + _V2, _DIFF, *_EDG, *[_of_v2(b) for b in _EDG]) + """, mg as (select * from edges e where not exists (select 1 from diff d where d.repo=e.repo and d.file_path=e.src_file)
      union all select * from edges_v2 e where exists (select 1 from diff d where d.repo=e.repo and d.file_path=e.src_file and status<>'deleted'))
      select repo, src_file, count(*) as n, count(dst_file) as n_resolved from mg group by all""",
    "s9_rebuild": _with("v2 as" + _V2, _SEL, _SEL.split(",\nidx as")[0].replace("sel as", "sel2 as").replace("from code_files", "from v2")) + "select repo, file_path, md5(content) as hash from sel where repo not in ('org/repo1','org/repo3') union all select repo, file_path, md5(content) from sel2 where repo in ('org/repo1','org/repo3')",
    "s10_upsert_repos": """select 'r'||cast(c_custkey as varchar) as repo, case when c_custkey%4<>0 then '/new' else '/old' end as root_path,
      case when c_custkey%3<>0 and c_custkey%2=0 then 'o/r'||cast(c_custkey as varchar) when c_custkey%4<>0 then 'n/r'||cast(c_custkey as varchar) end as github_full_name,
      case when c_custkey%4<>0 and c_custkey%7=0 then 'trunk' when c_custkey%3<>0 then 'dev' else 'main' end as default_branch, c_custkey%3<>0 and c_custkey%5=0 as auto_test_generation from customer where c_custkey%3<>0 or c_custkey%4<>0""",
    "p1_python_symbols": _with(*_SYM) + "select repo, file_path, name, kind, start_line, end_line, parent_class, signature from sym where language='python'",
    "p3_js_symbols": _with(*_SYM) + "select repo, file_path, name, kind, start_line, end_line, signature from sym where language<>'python'",
    "p4_extract_imports": _with(_SEL, _LINES, _IMPORTS) + "select repo, file_path, raw, cast(line as int) as start_line from imp",
    **_SHAPE_SQL,
    "p5_symbol_table": _with(*_SYM) + "select repo, file_path, cast(row_number() over (partition by repo, file_path order by start_line, case when kind='class' then 0 else 1 end, name) as int) as ordinal, name, kind, start_line from sym",
    "i1_package_roots": _with(_ROOTS) + "select * from roots",
    "i2_resolve_python": _with(*_EDG) + "select repo, src_file, dst_file, raw_import from edges where language='python'",
    "i3_resolve_js": _with(*_EDG) + "select repo, src_file, dst_file, raw_import from edges where language<>'python'",
    "i4_import_edges": _with(*_EDG) + "select * from edges",
    "g1_load_bearing": _with(*_EDG) + """, dg as (select repo, dst_file as file_path, count(*) as c from edges where dst_file is not null group by all)
      select * from (select i.repo, cast(row_number() over (partition by i.repo order by coalesce(c,0) desc, i.file_path) as int) as rank, i.file_path, coalesce(c,0) as in_degree, count(*) over (partition by i.repo) as total_files from idx i left join dg using (repo, file_path)) where rank<=10""",
    "g1_part_in_degree": """select * from (select 'all' as repo, cast(row_number() over (order by coalesce(c,0) desc, f) as int) as rank, f as file_path, coalesce(c,0) as in_degree, count(*) over () as total_files
      from (select 'p'||cast(p_partkey as varchar) as f from part) p left join (select 'p'||cast(l_partkey as varchar) as f, count(*) as c from lineitem group by 1) l using (f)) where rank<=100""",
    "g2_neighborhood": _with(*_EDG) + """, t as (select repo, file_path from idx),
      oe as (select e.repo, src_file as file_path, dst_file as other, row_number() over (partition by e.repo, src_file order by raw_import, dst_file) as n from edges e join t on t.repo=e.repo and t.file_path=src_file where dst_file is not null),
      ie as (select e.repo, dst_file as file_path, src_file as other, row_number() over (partition by e.repo, dst_file order by src_file, raw_import) as n from edges e join t on t.repo=e.repo and t.file_path=dst_file),
      u as (select 'imports' as relation, * from oe where n<=20 union all select 'imported_by', * from ie where n<=20),
      g as (select u.repo, u.file_path, relation, other, min(n) as n from u join t on t.repo=u.repo and t.file_path=other group by all),
      sb as (select a.repo, a.file_path, b.file_path as other, row_number() over (partition by a.repo, a.file_path order by b.file_path) as n from t a join t b on a.repo=b.repo and regexp_replace(a.file_path,'/?[^/]*$','')=regexp_replace(b.file_path,'/?[^/]*$','') and a.file_path<>b.file_path)
      select repo, file_path, relation, cast(row_number() over (partition by repo, file_path, relation order by n) as int) as ordinal, other from g
      union all select repo, file_path, 'sibling', cast(n as int), other from sb where n<=10
      union all select e.repo, src_file, 'unresolved', cast(row_number() over (partition by e.repo, src_file order by raw_import) as int), raw_import from edges e where dst_file is null""",
    "g3_repo_summary": _with(_SEL, _REPOS) + "select r.repo, coalesce(files,0) as files, coalesce(lines,0) as lines from reps r left join (select repo, count(*) as files, cast(sum(line_count) as bigint) as lines from idx group by repo) i using (repo)",
    "g4_repo_stats": _with(*_ALL) + """select a.*, functions, classes, cast(0 as bigint) as interfaces, edges_total, edges_resolved, edges_total-edges_resolved as edges_unresolved, round(100.0*edges_resolved/edges_total,1) as resolved_percent
      from (select repo, count(*) filter (language='python') as python_files, count(*) filter (language='javascript') as javascript_files, count(*) filter (language='typescript') as typescript_files from idx group by repo) a
      join (select repo, count(*) filter (kind<>'class') as functions, count(*) filter (kind='class') as classes from sym group by repo) s using (repo) join (select repo, count(*) as edges_total, count(dst_file) as edges_resolved from edges group by repo) e using (repo)""",
    "g5_resolve_repos": "with " + _REPOS + """, a as (select case c_custkey%3 when 0 then 'org/repo'||cast(c_custkey%11 as varchar) when 1 then '  ORG/full'||cast(c_custkey%11 as varchar)||' ' else 'none'||cast(c_custkey%11 as varchar) end as request from customer)
      select request, coalesce(r.repo, f.repo) as repo from a left join reps r on r.repo=request left join reps f on lower(f.full_name)=lower(trim(request))""",
    "q1_symbol_lookup": _with(*_SYM) + r""", n as (select n_nationkey*3 as k from nation), q as (select 'C'||cast(k as varchar) as query from n union all select 'fn_'||cast(k as varchar) from n),
      m as (select query, row_number() over (partition by query order by s.repo, s.file_path, start_line, kind) as ordinal, count(*) over (partition by query) as total, s.*, content from q join sym s on s.name=query join sel f on f.repo=s.repo and f.file_path=s.file_path)
      select query, cast(ordinal as int) as ordinal, total, repo, file_path, name, kind, (select string_agg(lpad(cast(i as varchar), cast(length(cast(end_line as varchar)) as int), ' ')||': '||string_split(content,chr(10))[i], chr(10) order by i) from (select unnest(range(start_line, end_line+1)) as i)) as code from m where ordinal<=10""",
    "q3_tokenize": "with " + _TOK + " select token, count(*) as n, cast(max(pos) as bigint) as last_pos from tok group by token",
    "q3_positional_index": "with " + _TOK + ", p as (select token as term, doc_id, count(*) as n, min(pos) as first from tok group by all) select term, count(*) as docs, cast(sum(n) as bigint) as places, cast(sum(first) as bigint) as first_places from p group by term",
    "q4_fts_match": "with " + _TOK + " select query, doc_id, count(*) as hits from h group by query, doc_id, n having count(distinct term)=n",
    "q5_cover_density": "with " + _TOK + ", " + _COVER + ", hc as (select query, doc_id, count(*) as hits from h group by all) select query, doc_id, rank, hits from fts join hc using (query, doc_id)",
    "q6_headline": "with " + _TOK + r""", w as (select doc_id, query, list_filter(regexp_split_to_array(coalesce(text,''),'[ \t\n\x0B\f\r]+'), lambda x: x<>'') as w, string_split(query,' ') as ts from documents, qq),
      f as (select *, list_transform(w, lambda x: list_has_any(regexp_split_to_array(lower(x),'[^\p{L}\p{N}]+'), ts)) as hit from w),
      s as (select *, list_filter(range(1, len(w)+1), lambda i: hit[i]) as h from f), s1 as (select *, greatest(1, h[1]-10) as a from s where len(h)>0),
      p2 as (select *, list_filter(h, lambda x: x>=a+20)[1] as p from s1), s2 as (select * exclude (p), case when p is not null then greatest(a+20, p-10) end as b from p2),
      p3 as (select *, list_filter(h, lambda x: x>=b+20)[1] as p from s2), s3 as (select *, case when p is not null then greatest(b+20, p-10) end as c from p3)
      select query, doc_id, array_to_string(list_transform(range(a, least(a+20, len(w)+1)), lambda i: case when hit[i] then '**'||w[i]||'**' else w[i] end), ' ')
        ||case when b is null then '' else ' ... '||array_to_string(list_transform(range(b, least(b+20, len(w)+1)), lambda i: case when hit[i] then '**'||w[i]||'**' else w[i] end), ' ') end
        ||case when c is null then '' else ' ... '||array_to_string(list_transform(range(c, least(c+20, len(w)+1)), lambda i: case when hit[i] then '**'||w[i]||'**' else w[i] end), ' ') end as headline from s3""",
    "q7_hash_embed": """with e as (select doc_id, list_transform(range(0,8), lambda i: (('0x'||substr(sha256(substr(text,1,8000)),1+2*i,2))::int)::double/127.5-1) as v from documents where length(text)>0),
      n as (select doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x*x))) as s from e)
      select documents.doc_id, round(v[1]/s,6) as e0, round(v[8]/s,6) as e7, round(list_sum(list_transform(v, lambda x: (x/s)*(x/s))),6) as norm from documents left join n using (doc_id)""",
    "q8_vector_topk": """with d as (select vec_id, embedding::double[] as e from embeddings), p as (select q.vec_id as query, d.vec_id, round(1-list_dot_product(d.e,q.e)/(sqrt(list_dot_product(d.e,d.e))*sqrt(list_dot_product(q.e,q.e))),6)+0.0 as distance from d, (select * from d where vec_id%50=0) q)
      select * from (select query, vec_id, distance, cast(row_number() over (partition by query order by distance, vec_id) as int) as rank from p) where rank<=10 and distance<=1.0""",
    "q9_has_embeddings": "select distinct 'r'||cast(vec_id%7 as varchar) as repo, case when vec_id%7>2 then 'hybrid' else 'fts' end as mode from embeddings",
    "q10_normalise_ranks": "with " + _TOK + ", " + _COVER + " select query, doc_id, round(rank/max(rank) over (partition by query),6) as norm from fts",
    "q12_matching_symbols": _with(*_SYM) + ", q as (select 'a c'||cast(n_nationkey as varchar)||' method' as query, 'c'||cast(n_nationkey as varchar) as t from nation) select query, repo, file_path, count(*) as n from sym join q on contains(lower(name), t) or contains(lower(name),'method') group by all",
    "q11_hybrid_search": "with " + _TOK + ", " + _COVER.replace("fts as (", "ftx as (") + """, e as (select vec_id, embedding::double[] as e from embeddings),
      ak as (select vec_id, e, case (vec_id//50)%5 when 0 then 'the of' when 1 then 'tion' when 2 then 'was inin' when 3 then 'der und' else 'la de' end as text from e where vec_id%50=0),
      fts as (select text||' #'||cast(vec_id as varchar) as query, doc_id, rank from ak join ftx on ftx.query=text), z as (select text||' #'||cast(vec_id as varchar) as query, e from ak where text<>'tion'),
      v as (select query, vec_id as key, round(1-list_dot_product(e.e,z.e)/(sqrt(list_dot_product(e.e,e.e))*sqrt(list_dot_product(z.e,z.e))),6)+0.0 as distance from e, z),
      vq as (select query, key, distance from (select *, row_number() over (partition by query order by distance, key) as n from v) where n<=30),
      f as (select query, doc_id as key, rank, max(rank) over (partition by query) as top from (select *, row_number() over (partition by query order by rank desc, doc_id) as n from fts) where n<=30),
      m as (select coalesce(f.query,vq.query) as query, coalesce(f.key,vq.key) as key, rank, top, distance from f full join vq on f.query=vq.query and f.key=vq.key),
      b as (select query, doc_id as key from fts where doc_id%7=0),
      sc as (select m.query, m.key, round(case when count(distance) over (partition by m.query)>0 then 0.5*coalesce(case when top>0 then rank/top else 0 end,0)+0.5*coalesce(greatest(0,1-distance/2),0) else coalesce(rank,0) end + case when b.key is not null then 0.3 else 0 end,4) as rank from m left join b on b.query=m.query and b.key=m.key)
      select * from (select query, key, rank, cast(row_number() over (partition by query order by rank desc, key) as int) as position, count(*) over (partition by query) as total from sc) where position<=10""",
    "t1_has_existing_tests": _with(_SEL, _ROOTS, _TESTED) + " select * from t1",
    "t2_importable_names": _with(_SEL, _ROOTS) + _NAMES,
    "t3_is_feasible": _with(*_SYM) + _FEASIBLE,
    "t4_prior_attempts": _with(*_SYM) + _FEASIBLE.replace("select f.repo", """, tr as (select distinct 'org/repo'||cast(p_partkey%5 as varchar) as repo, 'src/pkg'||cast(cast(floor(p_partkey/5.0) as bigint)%8 as varchar)||'/m'||cast(cast(floor(p_partkey/5.0) as bigint) as varchar)||'.py' as file_path from part where p_partkey%6=0)
      select f.repo""", 1).replace("'no_symbols' end", "'no_symbols' when tr.repo is not null then 'prior_attempt' end") + " left join tr on tr.repo=f.repo and tr.file_path=f.file_path",
    "t5_preview": _with(_SEL, _LINES, _SYMBOLS, _ROOTS, _TESTED) + ", t3 as (with " + _FEASIBLE.lstrip(", ") + """)
      select repo, count(*) as files, count(*) filter (t1.reason is null and t3.reason is null) as candidates, count(*) filter (t1.reason is not null) as rejected_a, count(*) filter (t1.reason is null and t3.reason is not null) as rejected_b from t1 join t3 using (repo, file_path) group by repo""",
    "t6_select_jobs": _with(*_SYM) + """, r as (select distinct repo, case when right(repo,1)='3' then 'not_opted_in' when right(repo,1)='4' then 'not_incremental' when right(repo,1)='0' then 'no_added_files' end as skip from sel),
      c as (select distinct repo, file_path from sym where language='python'), k as (select *, row_number() over (partition by repo order by file_path) as n, count(*) over (partition by repo) as tot from c where right(repo,1) in ('1','2'))
      select r.repo, skip, file_path, 'generate-tests:'||lower(r.repo)||':'||file_path||':'||left(sha256(r.repo),7) as job_id, coalesce(greatest(tot-2,0),0) as dropped_over_cap from r left join k on k.repo=r.repo and k.n<=2""",
}
_USED = _with(_SEL.replace("from code_files", "from code_files0"), _ROOTS, _TESTED).replace("code_files as (", "code_files0 as (", 1)
ORACLE_SQL["t1_prefix_imports"] = _USED.replace(", sel as", f", {cte('test_uses').removeprefix('with ')}, code_files as (select * from code_files0 union all select * from test_uses), sel as", 1) + " select * from t1"
ORACLE_SQL["s9_rebuild_stored"] = ORACLE_SQL["s9_rebuild"]
