"""Import statements, package roots and their resolution into edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ancestors, below, parent, parts, strip
from ..sources.shared import stored
from .selection import SKIP_DIRS, TEST_DIRS, in_dirs
from .symbols import structure_of

# fixed values: suffixes and index files tried for a relative JavaScript or TypeScript import, in this order
JS_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
JS_INDEX = tuple("/index" + s for s in JS_SUFFIXES)


def extract_imports(files: DataFrame) -> DataFrame:
    """(repo, file_path, language, ord, raw, start_line) of every import statement; multi-line ones whole."""
    found = files.select("repo", "file_path", "language", structure_of(files)["imports"].alias("_all"))
    rows = found.select("repo", "file_path", "language", F.posexplode("_all").alias("ord", "i"))
    return rows.select("repo", "file_path", "language", "ord", F.rtrim("i.raw").alias("raw"), F.col("i.start_line").alias("start_line"))


def package_roots(files: DataFrame) -> DataFrame:
    """(repo, root, root_ord): parents of the topmost package directories, deepest first, the repository's own root last."""
    usable = ~in_dirs(F.col("file_path"), SKIP_DIRS + TEST_DIRS)
    inits = files.where((F.element_at(parts(F.col("file_path")), -1) == "__init__.py") & usable).select("repo", parent(F.col("file_path")).alias("pkg")).distinct()
    # every ancestor of a package directory, with the directory's depth and the ancestor's
    p = F.filter(parts(F.col("pkg")), lambda x: x != "")
    steps = inits.select("repo", "pkg", F.explode(F.sequence(F.lit(0), F.size(p))).alias("up"), p.alias("p"))
    steps = steps.select("repo", "pkg", "up", F.array_join(F.slice("p", F.lit(1), F.size("p") - F.col("up")), "/").alias("dir"), F.size("p").alias("depth"))
    packages = inits.select("repo", F.col("pkg").alias("dir"), F.lit(True).alias("is_pkg"))
    # the climb ends at the first ancestor that is no package
    end = steps.join(packages, ["repo", "dir"], "left").groupBy("repo", "pkg").agg(F.min_by("dir", F.when(F.col("is_pkg").isNull() | (F.col("dir") == ""), F.col("up"))).alias("root"))
    found = end.select("repo", "root").union(files.select("repo", F.lit("").alias("root"))).distinct()
    depth = F.when(F.col("root") == "", 0).otherwise(F.size(parts(F.col("root"))))
    return found.select("repo", "root", (F.row_number().over(Window.partitionBy("repo").orderBy(depth.desc(), "root")) - 1).alias("root_ord"))


def _join_path(base: Column, rest: Column) -> Column:
    return F.when(base == "", rest).when(rest == "", base).otherwise(F.concat(base, F.lit("/"), rest))


def module_of(imports: DataFrame) -> Column:
    """The module that an import of Python names, with its dots."""
    if "module" in imports.columns:
        return F.col("module")
    text = F.regexp_replace(strip(F.col("raw")), r";+$", "")
    module = F.when(text.startswith("from ") & text.contains(" import "), strip(F.regexp_extract(text, r"^from\s+(.*?) import ", 1))).when(
        text.startswith("import "), F.regexp_extract(text, r"^import\s+([^\s,;]+)", 1)
    )
    return F.when(F.col("language") == "python", module)


def python_modules(imports: DataFrame) -> DataFrame:
    """`imports` of Python with dots (of a relative import) and tail, the module as a path."""
    rows = imports.where("language = 'python'").withColumn("module", module_of(imports)).where("module is not null and module <> ''")
    rows = rows.withColumn("dots", F.length("module") - F.length(F.ltrim("module", F.lit("."))))
    return rows.withColumn("tail", F.replace(F.substring("module", F.col("dots") + 1, F.length("module")), F.lit("."), F.lit("/")))


def _module_files(stem: Column) -> Column:
    """The files a module may be, best first."""
    return F.array(F.struct(F.lit(0).alias("k"), F.concat(stem, F.lit(".py")).alias("path")), F.struct(F.lit(1).alias("k"), _join_path(stem, F.lit("__init__.py")).alias("path")))


def relative_candidates(modules: DataFrame, *keep: str) -> DataFrame:
    """(keep, path, rank): the files a relative Python import may mean."""
    here = F.filter(parts(parent(F.col("file_path"))), lambda x: x != "")
    rows = modules.where("dots > 0").withColumn("here", here).where("dots - 1 <= size(here)")
    base = F.array_join(F.slice("here", F.lit(1), F.size("here") - (F.col("dots") - 1)), "/")
    files = _module_files(_join_path(base, F.col("tail")))
    files = F.when(F.col("tail") == "", F.slice(files, 2, 1)).otherwise(files)
    return rows.select(*keep, F.explode(files).alias("c")).select(*keep, "c.path", F.col("c.k").alias("rank"))


def absolute_hits(modules: DataFrame, files: DataFrame, roots: DataFrame, *keep: str) -> DataFrame:
    """(keep, path, rank): files that an absolute Python import means under some package root.

    A file has as many names as it has roots above it, so an import meets its files by an equal name, not every root of its
    repository.
    """
    py = files.where(F.col("file_path").endswith(".py")).select("repo", F.col("file_path").alias("path")).distinct()
    named = py.select("repo", "path", F.explode(ancestors(F.col("path"))).alias("root")).join(roots, ["repo", "root"])
    named = named.select("repo", "path", "root_ord", below(F.col("path"), F.col("root")).alias("name"))
    asked = modules.where("dots = 0").select(*keep, F.explode(_module_files(F.col("tail"))).alias("c")).select(*keep, F.col("c.path").alias("name"), "c.k")
    return asked.join(named, ["repo", "name"]).select(*keep, "path", (2 * F.col("root_ord") + F.col("k")).alias("rank"))


def normalised(path: Column) -> Column:
    """Without . and ..; null where it leaves the repository."""
    start = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        return F.when(x.isin("", "."), acc).when(x == "..", up).otherwise(F.concat(acc, F.array(x)))

    return F.array_join(F.aggregate(parts(path), start, step), "/")


def js_candidates(imports: DataFrame) -> DataFrame:
    spec = F.regexp_extract("raw", r"""['"]([^'"]+)['"]""", 1)
    rows = imports.where("language <> 'python'").withColumn("spec", spec).where("spec like '.%' or spec like '/%'")
    joined = F.when(F.col("spec").startswith("/"), F.col("spec")).otherwise(F.concat_ws("/", parent(F.col("file_path")), "spec"))
    rows = rows.withColumn("stem", normalised(joined)).where("stem is not null and stem <> ''")
    tails = ("", *JS_SUFFIXES, *JS_INDEX)
    c = F.array(*[F.struct(F.lit(k).alias("rank"), F.concat("stem", F.lit(t)).alias("path")) for k, t in enumerate(tails)])
    return rows.select(*imports.columns, F.explode(c).alias("c")).select(*imports.columns, "c.path", "c.rank")


def resolve_imports(imports: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """(repo, src_file, dst_file, raw_import, language): one edge for each import; dst_file is null where none of its candidates exists.

    `files` are all files of the repositories, indexed or not.
    """
    keys = ["repo", "file_path", "language", "ord", "raw"]
    # read four times below, and behind it the parsed texts: a table of its own, with the module, since filters would match its
    # patterns again for each place where it stands
    imports = imports.select(*keys).where("raw <> ''")
    imports = stored(imports.withColumn("module", module_of(imports)))
    modules = python_modules(imports)
    candidates = relative_candidates(modules, *keys).unionByName(js_candidates(imports.select(*keys)))
    there = files.select("repo", F.col("file_path").alias("path")).distinct()
    hits = candidates.join(there, ["repo", "path"]).unionByName(absolute_hits(modules, files, roots, *keys))
    hit = hits.groupBy("repo", "file_path", "ord").agg(F.min_by("path", "rank").alias("dst_file"))
    out = imports.join(hit, ["repo", "file_path", "ord"], "left")
    return out.select("repo", F.col("file_path").alias("src_file"), "dst_file", F.col("raw").alias("raw_import"), "language")
