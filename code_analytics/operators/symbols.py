"""Symbols of source files. Each text is parsed inside the row of its file; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsing
from ..sources.shared import stored

STRUCTURE = (
    "symbols array<struct<name:string,kind:string,start_line:int,end_line:int,parent_class:string,signature:string,docstring:string,decorators:array<string>>>, "
    "imports array<struct<raw:string,start_line:int>>"
)


def structure(content: Column, language: Column) -> Column:
    """struct<symbols, imports> of a text. A grammar is beyond built-in functions, so texts go to Python in Arrow batches."""
    return F.udf(parsing.structure, f"struct<{STRUCTURE.replace('symbols array', 'symbols:array').replace('imports array', 'imports:array')}>", useArrow=True).asNondeterministic()(content, language)


def parsed(files: DataFrame) -> DataFrame:
    """`files` with the column parsed, stored: symbols and imports of these rows come from one reading of their texts."""
    return stored(files.withColumn("parsed", structure(F.col("content"), F.col("language"))))


def structure_of(files: DataFrame) -> Column:
    return F.col("parsed") if "parsed" in files.columns else structure(F.col("content"), F.col("language"))


def extract_symbols(files: DataFrame) -> DataFrame:
    """(repo, file_path, name, kind, start_line, end_line, parent_class, signature, docstring, decorators) of each symbol.

    A file in an unknown language, or one that can't be parsed, has none.
    """
    found = files.where("language in ('python', 'javascript', 'typescript')").select("repo", "file_path", structure_of(files)["symbols"].alias("s"))
    return found.select("repo", "file_path", F.explode("s").alias("s")).select("repo", "file_path", "s.*")


def python_symbols(files: DataFrame) -> DataFrame:
    return extract_symbols(files.where("language = 'python'"))


def js_symbols(files: DataFrame) -> DataFrame:
    return extract_symbols(files.where("language in ('javascript', 'typescript')"))


def symbol_table(symbols: DataFrame) -> DataFrame:
    """(.., ordinal): the symbols of each file in line order, classes first on a line."""
    is_class = F.col("kind").isin("class", "interface")
    w = Window.partitionBy("repo", "file_path").orderBy("start_line", F.when(is_class, 0).otherwise(1), "name")
    return symbols.withColumn("ordinal", F.row_number().over(w)).withColumn("parent_class", F.when(~is_class, F.col("parent_class")))
