"""The derived corpus: tables of source files, hunks, findings, decisions and deliveries made from the test tables.

The statements run on Spark and on DuckDB and give equal rows. `views` registers the tables and these views for Spark;
`cte` gives the same definitions as a prefix for an oracle statement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shared import exists, last_stored, stored

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# source texts with what the tables' own files lack: heads over lines, nested scopes, decorators, docstrings, hidden code, broken code
SHAPE_PY = r'''"""Module text.
import fake_in_docstring
"""
import os, sys
from .m{k} import (
    a,
    b,
)

TEXT = @@@
def not_a_symbol():
@@@

@deco(
    "x",
)
@other
async def go_{k}(
    x: int,
    y=")",
) -> int:
    """
    Goes there.
    """
    return x

class Outer{k}(Base):
    @@@Holds things.@@@
    class Inner:
        def get(self): return 1

    def run(self):
        import late
        def helper():
            pass
        return helper
'''.replace("@@@", "'''")
SHAPE_TS = r'''import { a } from './m{k}';
import type {
  B,
} from "../b";

/**
 * Adds one.
 * @param x a number
 */
export async function add_{k}(
  x: number,
  y: string = "{",
): Promise<number> {
  return x;
}

export class Box{k}<T> extends Base {
  /** Opens it. */
  open(a: T): void {
    if (a) { return; }
  }
  private async load() {
    // } not the end
  }
}

interface Shape { side: number }

const twice = (n: number): number => n * 2;
export const later = async () => {
  return 1;
};
'''
SHAPE_BAD = r'''def broken(:
    pass

def fine():
    return 1

def shout():
    print @@@x@@@

class Old:
    def m(self):
        print @@@y@@@
    def n(self):
        return 1
'''.replace("@@@", '"')
SHAPE_MARK = "\ufeffdef first():\n    pass\n"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _shape(name: str, text: str) -> str:
    k = "cast(s_suppkey as varchar(20))"
    place = f"concat('org/repo', cast(s_suppkey%5 as varchar(20))) as repo, replace('src/shapes/{name}', '{{k}}', {k}) as file_path"
    return f"select {place}, replace({_literal(text)}, '{{k}}', {k}) as content from supplier"


DERIVED: dict[str, str] = {
    "code_files": r"""
with b as (select p_partkey as k, cast(floor(p_partkey/5.0) as bigint) as j, replace(p_name,' ','_') as nm from part)
select concat('org/repo', cast(k%5 as varchar(20))) as repo,
  case when k%23=0 then concat('tests/test_m',cast(j as varchar(20)),'.py')
       when k%29=0 then concat('node_modules/x/m',cast(j as varchar(20)),'.js')
       when k%31=0 then concat('src/pkg',cast(j%8 as varchar(20)),'/m',cast(j as varchar(20)),'_pb2.py')
       when k%7=0 then concat('web/lib',cast(j%4 as varchar(20)),'/m',cast(j as varchar(20)),'.js')
       else concat('src/pkg',cast(j%8 as varchar(20)),'/m',cast(j as varchar(20)),'.py') end as file_path,
  case when k%7=0 then concat('import {f} from ''./m',cast(j-28 as varchar(20)),''';',chr(10),'import React from ''react'';',chr(10),
                              'export function fn_',nm,'(a) {',chr(10),'  return a;',chr(10),'}',chr(10))
       else concat('import os',chr(10),'from .m',cast(j-8 as varchar(20)),' import f',chr(10),
                   'from pkg',cast((j+1)%8 as varchar(20)),'.m',cast(j+1 as varchar(20)),' import g',chr(10),chr(10),chr(10),
                   'class C',cast(j as varchar(20)),':',chr(10),'    def method_',nm,'(self, x):',chr(10),'        return x',chr(10),
                   chr(10),chr(10),'def f_',nm,'(a, b=1):',chr(10),'    return a',chr(10)) end as content
from b
union all
select distinct concat('org/repo', cast(p_partkey%5 as varchar(20))) as repo,
  concat('src/pkg', cast(cast(floor(p_partkey/5.0) as bigint)%8 as varchar(20)), '/__init__.py') as file_path, '' as content
from part
""",
    "source_shapes": " union all ".join(
        [_shape("m{k}.py", SHAPE_PY), _shape("m{k}.ts", SHAPE_TS), _shape("bad{k}.py", SHAPE_BAD), _shape("mark{k}.py", SHAPE_MARK), _shape("bad{k}.js", "class {{ (")]
    ),
    "test_uses": r"""
select distinct concat('org/repo', cast(p_partkey%5 as varchar(20))) as repo, concat('tests/uses_', cast(cast(floor(p_partkey/5.0) as bigint) as varchar(20)), '_test.py') as file_path,
  concat('try:',chr(10),'    import pkg',cast(cast(floor(p_partkey/5.0) as bigint)%8 as varchar(20)),'.m',cast(cast(floor(p_partkey/5.0) as bigint) as varchar(20)),'.deep as d',chr(10),
         'except ImportError:',chr(10),'    from other import m1, pkg',cast(p_partkey%3 as varchar(20)),chr(10)) as content
from part where p_partkey%37=0
""",
    "code_files_v2": r"""
select repo, file_path,
  case when length(file_path)%5=0 and length(content)%3=0 then concat(content,'# edited',chr(10)) else content end as content
from code_files where not (length(content)%7=0 and length(content)>0)
union all
select repo, replace(file_path,'.py','_new.py') as file_path, content from code_files
where file_path like 'src/%.py' and length(content)%11=0 and length(content)>0
""",
    "hunks": r"""
select concat('org/repo',cast(l_partkey%5 as varchar(20))) as repo, cast(floor(l_orderkey/50.0) as bigint) as pr_number,
  row_number() over (partition by cast(floor(l_orderkey/50.0) as bigint) order by l_orderkey,l_linenumber,l_partkey,l_suppkey,l_quantity,l_returnflag,l_extendedprice,l_discount,l_tax,l_shipdate) as seq,
  concat('src/pkg',cast(cast(floor(l_partkey/5.0) as bigint)%8 as varchar(20)),'/m',cast(cast(floor(l_partkey/5.0) as bigint) as varchar(20)),'.py') as file_path,
  case when l_returnflag='R' then 'added' else 'modified' end as status,
  cast(l_quantity as int) as additions, l_linenumber as deletions,
  concat('@@ -1,2 +',cast(l_linenumber*2 as varchar(20)),',',cast(cast(l_quantity as int)%5 as varchar(20)),' @@ ctx',chr(10),
         '@@ -9 +',cast(12+l_linenumber as varchar(20)),' @@') as patch
from lineitem
""",
    "findings": r"""
select o_orderkey%50 as run_id, o_orderkey as seq, concat('org/repo',cast(o_orderkey%5 as varchar(20))) as repo,
  concat('src/pkg',cast((o_orderkey%500)%8 as varchar(20)),'/m',cast(o_orderkey%500 as varchar(20)),'.py') as file,
  cast(o_custkey%20 as int) as line,
  case substring(o_orderpriority,1,1) when '1' then 'critical' when '2' then 'high' when '3' then 'medium' when '4' then 'low' else '' end as severity,
  case when o_orderstatus='P' then '' else 'bug' end as kind,
  case o_orderkey%6 when 0 then 'Syntax error: unclosed paren' when 1 then 'Add unit tests for this' else concat('possible null in ',o_orderstatus) end as description,
  case when o_orderkey%9=0 then 'improve docs' else 'guard it' end as fix_sketch
from orders
""",
    "decisions": r"""
select o_orderkey as seq, case when o_orderkey%2=0 then 'Org/Repo1' else ' org/repo1' end as repo,
  case when o_orderkey%3=0 then 'onboarding' else 'pr_reviewer' end as agent,
  case o_orderkey%4 when 0 then 'comment' when 1 then 'create_issue' when 2 then 'close_issue' else 'edit_issue' end as action,
  cast(o_custkey%40 as int) as issue, concat('Title ',cast(o_custkey%30 as varchar(20))) as title,
  concat('body ',o_orderpriority) as body, cast(o_orderkey%101 as double)/100 as confidence, (o_custkey%7<>0) as client_ok
from orders
""",
    "deliveries": r"""
select event_id as delivery_id, ts,
  case event_type when 'click' then 'pull_request' when 'signup' then 'issues' when 'purchase' then 'push' when 'view' then 'issue_comment' else 'pull_request' end as event,
  concat('{"action":"',case event_type when 'error' then 'closed' when 'click' then 'synchronize' else 'opened' end,
    '","pull_request":{"number":',cast(event_id%9 as varchar(20)),',"head":{"sha":"s',cast(event_id%50 as varchar(20)),'"}},"issue":{"number":',
    cast(event_id%6 as varchar(20)),'},"after":"s',cast(event_id%50 as varchar(20)),'","repository":{"full_name":"Org/Repo',
    cast(user_id%40 as varchar(20)),'"},"sender":{"login":"u","type":"',case when event_id%10=0 then 'Bot' else 'User' end,'"}}') as raw
from events
""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: dict[tuple[str, str, str], tuple[DataFrame, str]] = {}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of the derived corpus, from the tables of `sf_dir`. The source files are made once a session, as a stored table."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at in _made and exists(spark, _made[at][1]):
        return _made[at][0]
    for t in ("part", "supplier", "lineitem", "orders", "events"):
        if t in DERIVED[name]:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    if name == "code_files_v2":
        derived(spark, sf_dir, "code_files").createOrReplaceTempView("code_files")
    out = spark.sql(DERIVED[name])
    if name.startswith("code_files"):
        # the rows come from one small file; dealt out, they are read in parallel
        out = stored(out.repartition(spark.sparkContext.defaultParallelism, "repo", "file_path"))
        _made[at] = (out, last_stored())
    if name == "deliveries":
        out = out.repartition(spark.sparkContext.defaultParallelism, "delivery_id")
    return out


def cte(*names: str) -> str:
    """`with a as (..), b as (..)`, in the order of the names."""
    return "with " + ", ".join(f"{n} as ({DERIVED[n].strip()})" for n in names)
