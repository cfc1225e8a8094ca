"""The graph's data model: schemas, ids, normalisation and the current version of delivered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "branch string, id string, type string, name string, qualified_name string, file_path string, line int, end_line int, "
    "package string, language string, exported boolean, signature string, doc_comment string, "
    "properties map<string,string>, metrics map<string,double>"
)
EDGE_SCHEMA = "branch string, id string, type string, source_id string, target_id string, properties map<string,string>"
NODE_COLUMNS = [c.strip().split(" ")[0] for c in NODE_SCHEMA.replace("map<string,", "map<string;").split(", ")]
EDGE_COLUMNS = [c.strip().split(" ")[0] for c in EDGE_SCHEMA.replace("map<string,", "map<string;").split(", ")]

# The closed sets of node and edge types.
NODE_TYPES = (
    "Repository Service Module Package File Function Method Class Struct Interface Enum Type Constant Variable APIEndpoint "
    "DBModel DomainModel ViewModel DTO Migration Dependency Document AIGuideline TestFunction TestFile Directory Topic Person"
).split()
EDGE_TYPES = "Contains Imports DependsOn Calls Implements Exposes Consumes Documents Tests Migrates Configures HasTopic AppearsIn".split()


def node_id(kind, path, name) -> Column:
    """First 24 hex digits of sha256 of type:path:name."""
    return F.substring(F.sha2(F.concat_ws(":", *[x if isinstance(x, Column) else F.lit(x) for x in (kind, path, name)]), 256), 1, 24)


edge_id = node_id  # the linker's form: type, source, target


def _unset(df: DataFrame) -> DataFrame:
    """'' (0, false) instead of null, the model's value for unset fields."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if f.name in ("branch", "id") or kind not in ("string", "int", "boolean"):
            out.append(c)
        else:
            out.append(F.coalesce(c, F.lit({"string": "", "int": 0, "boolean": False}[kind])).alias(f.name))
    return df.select(*out)


def current(rows: DataFrame, columns: list[str], deleted: bool) -> DataFrame:
    """The newest delivered row of every (branch, id); rows marked deleted fall away. Nulls become unset values.

    Null ids or branches are dropped, a null indexed_at is oldest. The rank is cut down before the shuffle, so repeated
    deliveries are not moved; columns that a query doesn't use are not read, and a branch filter reaches the scan."""
    cols = [c for c in columns if c not in ("branch", "id")]
    newest = Window.partitionBy("branch", "id").orderBy(F.col("indexed_at").desc_nulls_last())
    ranked = rows.where("id is not null and branch is not null").withColumn("_rank", F.row_number().over(newest)).where("_rank = 1")
    if deleted:
        ranked = ranked.where("deleted_at is null")
    newest = ranked.select("branch", "id", *cols)
    return _unset(newest)


def current_nodes(rows: DataFrame) -> DataFrame:
    return current(rows, NODE_COLUMNS, True)


def current_edges(rows: DataFrame) -> DataFrame:
    return current(rows, EDGE_COLUMNS, False)


#: The same in SQL, put before every reference query: N current nodes, E current edges.
SQL = """
with recursive N as (
  select branch, id, coalesce(type,'') as type, coalesce(name,'') as name, coalesce(qualified_name,'') as qualified_name, coalesce(file_path,'') as file_path,
    coalesce(line,0) as line, coalesce(end_line,0) as end_line, coalesce(package,'') as package, coalesce(language,'') as language, coalesce(exported,false) as exported,
    coalesce(signature,'') as signature, coalesce(doc_comment,'') as doc_comment, properties, metrics
  from (select *, row_number() over (partition by branch, id order by indexed_at desc nulls last) rn from nodes where id is not null and branch is not null)
  where rn = 1 and deleted_at is null),
E as (
  select branch, id, coalesce(type,'') as type, coalesce(source_id,'') as source_id, coalesce(target_id,'') as target_id, properties
  from (select *, row_number() over (partition by branch, id order by indexed_at desc nulls last) rn from edges where id is not null and branch is not null)
  where rn = 1),
M as (select * from N where branch = 'main'),
ME as (select * from E where branch = 'main')
"""
