"""Queries over the graph tables with the SQL that must give the same rows: store algebra, analysis, traversal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import render as R
from ..functions import scalars as X
from ..model import SQL, current_edges, current_nodes, node_id
from ..operators import analysis as A
from ..operators import store as S
from ..operators import traverse as T
from ..session import table

QUERIES: dict = {}
ORACLE: dict = {}
FEATURE = ["fix/relay-timeout", "main"]
ORDER = "case branch when 'fix/relay-timeout' then 0 else 1 end"


class Graph:
    """Current nodes and edges of all branches, and of main."""

    def __init__(self, spark, d):
        self.spark, self.d = spark, d
        self.n, self.e = current_nodes(table(spark, d, "nodes")), current_edges(table(spark, d, "edges"))
        self.mn, self.me = self.n.where("branch = 'main'"), self.e.where("branch = 'main'")

    def table(self, name):
        return table(self.spark, self.d, name)


def query(name, sql=None, prefix=SQL):
    def add(f):
        QUERIES[name] = lambda spark, d: f(Graph(spark, d))
        if sql:
            ORACLE[name] = prefix + sql
        return f

    return add


NODE = "id, type, name, file_path, line, package, language, exported"

# ---- Scans and overlay ----------------------------------------------------------------------------------

query("s01_branch_scan", f"select branch, {NODE} from N where branch = 'main'")(lambda g: g.mn.select("branch", *NODE.split(", ")))
query("s02_type_scan", "select id, name from M where type = 'Interface'")(lambda g: g.mn.where("type = 'Interface'").select("id", "name"))
query("s04_edge_scan", "select branch, id, type, source_id, target_id from E")(lambda g: g.e.select("branch", "id", "type", "source_id", "target_id"))
query("s06_branches", "select distinct branch from (select branch from N union all select branch from E)")(lambda g: S.list_branches(g.n, g.e))

_OVER = f", O as (select * from (select *, row_number() over (partition by id order by {ORDER}) pr from N where branch in ('fix/relay-timeout','main')) where pr = 1)"
query("s05_overlay", _OVER + f" select branch, {NODE} from O")(lambda g: S.overlay(g.n, FEATURE).select("branch", *NODE.split(", ")))


@query("s05_overlay_filtered", f", F as (select *, row_number() over (partition by id order by {ORDER}) pr from N where branch in ('fix/relay-timeout','main') and exported and type = 'Method') select {NODE}, branch as graph_source from F where pr = 1")
def _(g):
    return S.query_nodes(g.n, FEATURE, S.NodeFilter(type="Method", exported=True)).select(*NODE.split(", "), "graph_source")


@query("s03_point_lookup", _OVER + ", t as (select max(id) as id from N) select O.id, O.name, O.branch as graph_source from O join t using (id)")
def _(g):
    wanted = g.n.agg(F.max("id").alias("id")).first().id or ""
    return S.get_node(g.n, FEATURE, wanted).select("id", "name", "graph_source")


query("a01_stats", _OVER + f""", OE as (select * from (select *, row_number() over (partition by id order by {ORDER}) pr from E where branch in ('fix/relay-timeout','main')) where pr = 1)
 select 'node' as kind, type, count(*) as n from O group by type union all select 'node', '', count(*) from O union all select 'edge', type, count(*) from OE group by type union all select 'edge', '', count(*) from OE""")(
    lambda g: S.stats(g.n, g.e, FEATURE))

# ---- Filters -----------------------------------------------------------------------------------------------

query("f01_equality", f"select {NODE} from M where type = 'Function' and language = 'python' and package <> ''")(
    lambda g: g.mn.where(S.NodeFilter(type="Function", language="python").column() & (F.col("package") != "")).select(*NODE.split(", ")))
query("f02_glob", "select id, name from M where regexp_matches(name, '^[^/]*[Ll]edger[^/]*$')")(lambda g: g.mn.where(S.NodeFilter(name_pattern="*[Ll]edger*").column()).select("id", "name"))
query("f03_exported", "select id, name from M where exported and type = 'Struct'")(lambda g: g.mn.where(S.NodeFilter(type="Struct", exported=True).column()).select("id", "name"))
query("f04_property_contains", "select id, name from M where contains(coalesce(properties['receiver'], ''), 'Store') and type = 'Method'")(
    lambda g: g.mn.where(S.NodeFilter(type="Method", properties={"receiver": "Store"}).column()).select("id", "name"))
query("f05_symbols", """select id, name, type, case when line > 0 then file_path || ':' || line else file_path end as location,
 case when end_line > 0 and end_line <> line then line || '-' || end_line else cast(line as varchar) end as lines from M where type <> 'File'""")(lambda g: A.symbols(g.mn))
query("f10_embeddable", "select type, count(*) as n from M where type in ('Function','Method','Class','Struct','Interface','Document','APIEndpoint','Service','DBModel','AIGuideline','Directory','Topic','Person') group by type")(
    lambda g: g.mn.where(F.col("type").isin(S.EMBEDDABLE)).groupBy("type").agg(F.count("*").alias("n")))

_LANG = "case when language <> '' then language else case lower(regexp_extract(file_path, '(\\.[^./]*)$', 1)) when '.go' then 'go' when '.py' then 'python' when '.ts' then 'typescript' when '.tsx' then 'typescript' when '.js' then 'javascript' when '.jsx' then 'javascript' when '.java' then 'java' {more} else '' end end"
_LANG5 = _LANG.format(more="")
_LANG8 = _LANG.format(more="when '.rs' then 'rust' when '.cs' then 'csharp' when '.rb' then 'ruby' when '.rake' then 'ruby'")
_BASE = "regexp_extract(file_path, '([^/]*)$', 1)"
_T5 = f"""case lang when 'go' then {_BASE} like '%\\_test.go' escape '\\' when 'python' then ({_BASE} like 'test\\_%.py' escape '\\' or {_BASE} like '%\\_test.py' escape '\\')
 when 'typescript' then regexp_matches({_BASE}, '\\.(test|spec)\\.tsx?$') when 'javascript' then regexp_matches({_BASE}, '\\.(test|spec)\\.jsx?$')
 when 'java' then regexp_matches({_BASE}, '((Test|Tests|IT)\\.java|^Test.*\\.java)$') {{more}} else false end"""
_TF5 = _T5.format(more="")
_TF8 = _T5.format(more=f"""when 'rust' then list_contains(string_split(file_path, '/'), 'tests') when 'csharp' then regexp_matches({_BASE}, '((Test|Tests)\\.cs|^Test.*\\.cs)$')
 when 'ruby' then regexp_matches({_BASE}, '((_spec|_test)\\.rb|^test_.*\\.rb)$')""")
_FN = """case when lang = 'go' then regexp_matches(name, '^(Test|Benchmark|Example|Fuzz)') when lang = 'python' then starts_with(name, 'test_') and in_test
 when lang in ('typescript','javascript') then in_test when lang = 'java' then starts_with(name, 'test') {more} else false end"""
_FN8 = _FN.format(more="when lang in ('rust','ruby') then starts_with(name, 'test_') and in_test when lang = 'csharp' then starts_with(name, 'Test') and in_test")

query("f08_test_files", f"select id, file_path from (select *, {_TF8} as in_test from (select *, {_LANG8} as lang from M where type in ('File','TestFile'))) where in_test")(
    lambda g: g.mn.where(F.col("type").isin("File", "TestFile") & X.is_test_file(F.col("file_path"), F.col("language"))).select("id", "file_path"))
query("f09_test_functions", f"select id, name from (select *, {_TF8} as in_test from (select *, {_LANG8} as lang from M where type in ('Function','Method','TestFunction'))) where {_FN8}")(
    lambda g: g.mn.where(F.col("type").isin("Function", "Method", "TestFunction") & X.is_test_function(F.col("name"), F.col("language"), F.col("file_path"))).select("id", "name"))

_C5 = f", L as (select *, {_TF5} as in_test from (select *, {_LANG5} as lang from M)), K as (select *, {_FN.format(more='')} as test_fn from L)"
query("j08_unused_antijoin", _C5 + """ select id, name, type, file_path, line, package, language from K where type in ('Function','Method') and not test_fn and name not in ('init','main') and not exported
 and id not in (select target_id from ME where type = 'Calls')""")(lambda g: A.unused(g.mn, g.me))
query("j08_unused_with_exported", _C5 + """ select id, name, type, file_path, line, package, language from K where type in ('Function','Method') and not test_fn and name not in ('init','main')
 and id not in (select target_id from ME where type = 'Calls')""")(lambda g: A.unused(g.mn, g.me, include_exported=True))

_COV = _C5 + """, V as (select id, name, type, file_path, line, package, language, id in (select target_id from ME where type = 'Tests') as covered from K
 where type in ({types}) and not in_test {fn} and file_path not in (select file_path from M where type = 'TestFile'))"""
_COVF, _COVM = _COV.format(types="'File'", fn=""), _COV.format(types="'Function','Method'", fn="and not test_fn")
query("j09_file_coverage", _COVF + " select * from V")(lambda g: A.coverage(g.mn, g.me, "file"))
query("j09_function_coverage", _COVM + " select * from V")(lambda g: A.coverage(g.mn, g.me))
query("a03_package_coverage", _COVM + """ select case when package = '' then '(unknown)' else package end as package, arg_min(language, file_path || chr(1) || id) as language, count(*) as total,
 cast(sum(covered::int) as bigint) as covered, round(100.0 * avg(covered::int), 4) as percent from V group by 1""")(lambda g: A.package_coverage(A.coverage(g.mn, g.me)))
query("a03_coverage_rollup", _COVM + " select language, package, count(*) as total, cast(sum(covered::int) as bigint) as covered from V group by rollup (language, package)")(
    lambda g: A.coverage_rollup(A.coverage(g.mn, g.me)))

# ---- Lookups along edges ------------------------------------------------------------------------------------------

_DIR = """, D as (select source_id as node_id, target_id as peer_id, 'out' as direction, id as edge_id, type as edge_type from ME
 union all select target_id, source_id, 'in', id, type from ME where source_id <> target_id),
 P as (select id as node_id from M where type = 'Interface')"""
_seeds = lambda g: g.mn.where("type = 'Interface'").select(F.col("id").alias("node_id"))


@query("j01_get_edges", ", t as (select max(target_id) as x from ME where type = 'Implements') select id, type, source_id, target_id from ME, t where source_id = x or target_id = x")
def _(g):
    wanted = g.me.where("type = 'Implements'").agg(F.max("target_id").alias("x")).first().x or ""
    return S.get_edges(g.me, wanted).select("id", "type", "source_id", "target_id")


query("j02_neighbours", _DIR + " select distinct D.node_id, D.peer_id, M.name as peer_name, M.type as peer_type from D join P using (node_id) join M on M.id = D.peer_id")(
    lambda g: S.neighbours(g.mn, g.me, _seeds(g)))
query("j03_edges_to_peers", _DIR + """ select D.node_id, edge_id, edge_type, direction, peer_id, coalesce(nullif(M.name, ''), peer_id) as peer_name, coalesce(M.type, '') as peer_type
 from D join P using (node_id) left join M on M.id = D.peer_id""")(lambda g: S.edge_entries(g.mn, g.me, _seeds(g)))
query("p04_edges_resolved_only", _DIR + """ select D.node_id, edge_id, edge_type, direction, peer_id, coalesce(nullif(M.name, ''), peer_id) as peer_name, coalesce(M.type, '') as peer_type
 from D join P using (node_id) join M on M.id = D.peer_id where direction = 'in'""")(lambda g: S.edge_entries(g.mn, g.me, _seeds(g), direction="in", keep_unresolved=False))
query("j04_resolve", " select id, name from M where name = 'main-service' or regexp_matches(name, '^[^/]*Store$') order by id limit 1")(lambda g: S.resolve(g.mn, "*Store").select("id", "name"))
query("j05_implementors", """ select i.id as interface_id, i.name as interface_name, x.id as implementor_id, x.name as implementor_name from M i
 left join (select distinct e.target_id, m.id, m.name from ME e join M m on m.id = e.source_id where e.type = 'Implements') x on x.target_id = i.id where i.type = 'Interface'""")(lambda g: S.implementors(g.mn, g.me))
query("p03_interface_members", """ select i.id as interface_id, count(x.id) as n, coalesce(string_agg(x.name, ',' order by x.name, x.id), '') as names from M i
 left join (select distinct e.target_id, m.id, m.name from ME e join M m on m.id = e.source_id where e.type = 'Implements') x on x.target_id = i.id where i.type = 'Interface' group by 1""")(
    lambda g: S.implementors(g.mn, g.me).groupBy("interface_id").agg(
        F.count("implementor_id").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("implementor_id").isNotNull(), F.struct("implementor_name", "implementor_id")))), lambda x: x["implementor_name"]), ",").alias("names")))
query("a13_centrality", _DIR + " select node_id as id, count(*) as degree from D group by 1")(lambda g: S.centrality(g.me))
query("t03_edges_sorted", _DIR + " select edge_type, direction, count(*) as n from D join P using (node_id) group by all order by all")(
    lambda g: S.edge_entries(g.mn, g.me, _seeds(g)).groupBy("edge_type", "direction").agg(F.count("*").alias("n")).orderBy("edge_type", "direction"))
query("t04_search_limit", " select id, name, type, file_path, line, count(*) over () as total from M where contains(name, 'Ledger') order by file_path, line, id limit 50")(
    lambda g: A.search_nodes(g.mn, F.contains("name", F.lit("Ledger"))))

# ---- Mutations ----------------------------------------------------------------------------------------------------------

_FEAT = "branch = 'fix/relay-timeout'"


@query("k01_upsert", f" select branch, id, name from N where not ({_FEAT}) union all select branch, id, upper(name) from N where {_FEAT}")
def _(g):
    return S.upsert(g.n, g.n.where(_FEAT).withColumn("name", F.upper("name"))).select("branch", "id", "name")


@query("k03_delete_cascade", ", x as (select id from M where type = 'Interface') select branch, id from E where not (branch = 'main' and (source_id in (select id from x) or target_id in (select id from x)))")
def _(g):
    return S.delete_nodes(g.n, g.e, g.mn.where("type = 'Interface'"))[1].select("branch", "id")


@query("k04_delete_edges", " select branch, id from E where not (type = 'Calls' and branch = 'main')")
def _(g):
    return S.delete_edges(g.e, g.me.where("type = 'Calls'")).select("branch", "id")


@query("k05_delete_by_file", ", p as (select distinct file_path from M where type = 'TestFile') select branch, id from N where not (branch = 'main' and file_path in (select file_path from p))")
def _(g):
    return S.delete_by_file(g.n, g.e, "main", g.mn.where("type = 'TestFile'").select("file_path"))[0].select("branch", "id")


query("k06_delete_branch", " select branch, id from E where branch <> 'fix/relay-timeout'")(lambda g: S.delete_branches(g.e, ["fix/relay-timeout"]).select("branch", "id"))
query("k10_stale_branches", " select distinct branch from N where branch not in ('main', 'default')")(lambda g: S.stale_branches(g.n, g.spark.createDataFrame([("main",)], "branch string")))


@query("k07_export_import", " select branch, id, type, name, line, exported, coalesce(properties['kind'], '') as kind from M")
def _(g):
    lines = S.to_export(g.n, g.e, "main")
    return S.from_export(lines)[0].select("branch", "id", "type", "name", "line", "exported", F.coalesce(F.element_at("properties", "kind"), F.lit("")).alias("kind"))


@query("s08_import_into_branch", " select 'copy' as branch, id, source_id, target_id from ME")
def _(g):
    return S.from_export(S.to_export(g.n, g.e, "main"), "copy")[1].select("branch", "id", "source_id", "target_id")


query("s09_peek_branch", " select 'main' as branch from M limit 1")(lambda g: S.peek_branch(S.to_export(g.n, g.e, "main")))


@query("k09_migrate_paths", """, A as (select *, '/work/src/' || file_path as abs, case when name = file_path then '/work/src/' || name else name end as aname from M where file_path <> '')
 select substr(sha256(type || ':' || file_path || ':' || name), 1, 24) as id, type, file_path, name from A""")
def _(g):
    at = lambda c: F.concat(F.lit("/work/src/"), F.col(c))
    away = g.mn.where("file_path <> ''").withColumn("name", F.when(F.col("name") == F.col("file_path"), at("name")).otherwise(F.col("name"))).withColumn("file_path", at("file_path"))
    return S.migrate_paths(away, g.me, "/work/src")[0].select("id", "type", "file_path", "name")


query("x17_node_id", " select id, substr(sha256(type || ':' || file_path || ':' || name), 1, 24) as hashed from M")(
    lambda g: g.mn.select("id", node_id(F.col("type"), F.col("file_path"), F.col("name")).alias("hashed")))

# ---- Statistics -------------------------------------------------------------------------------------------------------------

query("a04_languages", " select language, count(*) as n from M where language <> '' group by 1")(lambda g: A.language_counts(g.mn))
query("a05_top_packages", " select package, count(*) as n from M where package <> '' group by 1 order by n desc, package limit 10")(lambda g: A.top_packages(g.mn))
query("a09_service_summary", """, b as (select * from M where package <> '') select package, count(distinct file_path) as files, count(*) filter (type <> 'File') as symbols,
 count(*) filter (type in ('Function','Method')) as callables, count(*) filter (type in ('Class','Struct','Interface','Enum','Type')) as types, count(*) filter (type = 'APIEndpoint') as endpoints,
 coalesce(any_value(x.k), 0) as depends_on from b left join (select b2.package as pk, count(*) as k from ME e join b b2 on b2.id = e.source_id where e.type = 'DependsOn' group by 1) x on x.pk = b.package group by package""")(
    lambda g: A.service_summary(g.mn, g.me))
query("a19_language_types", " select language, type, count(*) as n from M where language <> '' group by 1, 2")(lambda g: A.language_types(g.mn))
query("a21_top_dirs", " select split_part(file_path, '/', 1) as dir, count(distinct file_path) as files, count(*) as nodes from M where file_path <> '' group by 1")(lambda g: A.top_dirs(g.mn))
_DOCS = ", d as (select doc_id, strlen(text) as n from documents where text is not null)"
_docs = lambda g: g.table("documents").where("text is not null").select("doc_id", F.octet_length("text").cast("long").alias("n"))
query("a16_length_stats", _DOCS + """, r as (select n, row_number() over (order by n) - 1 as i, count(*) over () as k from d)
 select any_value(k) as count, cast(floor(sum(n) / any_value(k)) as bigint) as avg, min(n) filter (i = cast(floor(k * 0.5) as bigint)) as p50, min(n) filter (i = cast(floor(k * 0.9) as bigint)) as p90, max(n) as max, cast(sum(n) as bigint) as total from r""")(
    lambda g: A.length_stats(_docs(g), "n"))
query("a17_size_histogram", _DOCS + """ select case when n<=100 then 0 when n<=500 then 1 when n<=1000 then 2 when n<=2000 then 3 when n<=5000 then 4 when n<=10000 then 5 when n<=20000 then 6 when n<=50000 then 7 when n<=100000 then 8 else 9 end as bucket,
 case when n<=100 then 100 when n<=500 then 500 when n<=1000 then 1000 when n<=2000 then 2000 when n<=5000 then 5000 when n<=10000 then 10000 when n<=20000 then 20000 when n<=50000 then 50000 when n<=100000 then 100000 end as upto, count(*) as n from d group by 1, 2""")(
    lambda g: A.size_histogram(_docs(g), "n"))
query("a18_document_kinds", " select case when coalesce(properties['kind'], '') = '' then '(parsed)' else properties['kind'] end as kind, count(*) as n from M where type = 'Document' group by 1")(lambda g: A.document_kinds(g.mn))
query("t09_largest_documents", _DOCS + " select doc_id, n from d order by n desc, doc_id limit 20")(lambda g: A.largest_documents(_docs(g), "doc_id", "n"))
query("a29_metric_rows", " select id, unnest(map_keys(metrics)) as metric, round(unnest(map_values(metrics)), 2) as value from M where metrics is not null")(lambda g: A.metric_rows(g.mn))
query("w01_latest_version", " select branch, id, name from N")(lambda g: g.n.select("branch", "id", "name"))

# ---- Classification --------------------------------------------------------------------------------------------------------------

_CLS = """, B as (select *, case when len(string_split(file_path, '/')) >= 2 then lower(string_split(file_path, '/')[-2]) else lower(package) end as d, type in ('Class','Struct') as cl, type in ('Function','Method') as fn from M),
 R as (select *, case when language = 'go' and (contains(name, 'Middleware') or (fn and contains(signature, 'http.Handler'))) then 'middleware'
  when cl and ((language = 'go' and regexp_matches(name, '(Repository|Repo|Store|DAO)$')) or (language = 'python' and (d in ('repository','repositories') or regexp_matches(name, '(Repository|Repo)$')))) then 'repository'
  when cl and ((language = 'python' and d in ('service','services','use_case','usecase')) or (language = 'go' and regexp_matches(name, '(Service|UseCase|Interactor)$'))) then 'service'
  when cl and language = 'go' and regexp_matches(name, '(Handler|Controller)$') then 'controller' else '' end as role0 from B),
 C1 as (select *, case when cl and role0 = '' and regexp_matches(name, '(ViewModel|View)$') then 'ViewModel'
  when cl and role0 = '' and (regexp_matches(name, '(DTO|Request|Response|Payload|Command|Query)$') or d in ('dto','viewmodel','api','request','response')) then 'DTO'
  when cl and role0 = '' and (regexp_matches(name, '(Aggregate|ValueObject|DomainEvent)') or (contains(name, 'Entity') and d in ('domain','entity','core','model'))) then 'DomainModel' else type end as new_type from R),
 C2 as (select *, case when new_type = 'DomainModel' and type <> 'DomainModel' then 'domain_model' else role0 end as role from C1),
 CL as (select *, concat_ws(',', case when fn and regexp_matches(name, '^(New|Create|Build|Make).') and (language <> 'go' or contains(signature, '*')) then 'factory' end,
   case when new_type in ('Class','Struct') and name like '%Builder' then 'builder' end, case when role = 'repository' then 'repository' end) as patterns,
  case when role = 'controller' then 'presentation' when role in ('service','domain_model') then 'business' when role = 'repository' then 'data_access' when role = 'middleware' then 'infrastructure'
   when new_type = 'DBModel' then 'data_access' when new_type = 'DomainModel' then 'business' when new_type in ('ViewModel','DTO') then 'presentation'
   when d in ('controller','controllers','handler','handlers','view','views','template','templates','api') then 'presentation' when d in ('service','services','domain','model','entity','core','use_case','usecase') then 'business'
   when d in ('repository','repositories','dao','store','persistence','migration','migrations') then 'data_access' when d in ('config','middleware','util','utils','adapter','adapters','infrastructure','infra') then 'infrastructure' else '' end as layer from C2)"""
_cls = lambda g: C.classify(g.mn)
query("c01_classify", _CLS + " select id, role, new_type, patterns, layer from CL")(lambda g: _cls(g).select("id", "role", "new_type", "patterns", "layer"))
query("a06_patterns", _CLS + """, x as (select unnest(string_split(patterns, ',')) as pattern, name, id from CL where patterns <> ''), y as (select *, row_number() over (partition by pattern order by name, id) r from x)
 select pattern, count(*) as n, string_agg(name, ',' order by r) filter (r <= 3) as examples from y group by 1""")(lambda g: A.pattern_counts(_cls(g)))
query("a07_layers_roles", _CLS + " select layer, role, count(*) as n from CL where layer <> '' or role <> '' group by 1, 2")(lambda g: A.layer_roles(_cls(g)))
query("a10_models", _CLS + """ select case new_type when 'DBModel' then 'database' when 'DomainModel' then 'domain' else 'transfer' end as label, count(*) as n, count(distinct package) as packages
 from CL where new_type in ('DBModel','DomainModel','ViewModel','DTO') group by 1""")(lambda g: A.models(_cls(g)))

query("a20_cross_service", _CLS + """, x as (select 'pattern' as kind, trim(unnest(string_split(patterns, ','))) as name from CL where patterns <> '' union all select 'role', role from CL union all select 'layer', layer from CL),
 pk as (select package, count(*) as n from M where package <> '' group by 1 order by package limit 30) select kind, name, count(*) as n from x where name <> '' group by 1, 2 union all select 'package', package, n from pk""")(lambda g: A.cross_service(_cls(g)))
query("a22_architecture_facets", _CLS + """, y as (select *, row_number() over (partition by role order by name, id) r from CL where role <> '')
 select role, count(*) as n, count(distinct package) as packages, string_agg(name, ',' order by r) filter (r <= 5) as examples from y group by 1""")(lambda g: A.architecture_facets(_cls(g)))
query("t08_summaries", " select id, name from M where type = 'Document' and coalesce(properties['generated'], '') = 'true'")(lambda g: A.summaries(g.mn).select("id", "name"))

# ---- Traversal ----------------------------------------------------------------------------------------------------------------------

_BFS = """, b as (select distinct target_id as id, source_id as nxt from ME where type in ({types}) and source_id <> target_id), roots as (select id as root_id from M where type in ({roots})),
 w as (select root_id, root_id as id, 0 as level from roots union select w.root_id, b.nxt, w.level + 1 from w join b on b.id = w.id where w.level < 3),
 R3 as (select root_id, id, min(level) as level from w group by 1, 2 having min(level) > 0)"""
query("g01_impact", _BFS.format(types="'Imports','DependsOn','Calls','Implements','Tests'", roots="'Interface','Struct'") + " select root_id, id, level from R3")(
    lambda g: T.impact(g.me, g.mn.where("type in ('Interface', 'Struct')").select(F.col("id").alias("root_id"))))
query("g02_model_impact", _BFS.format(types="'Imports','DependsOn','Calls','Contains','Exposes','Migrates'", roots="'Struct','APIEndpoint'") + """ select root_id, R3.id, level, case when M.type = 'Service' then 'service'
 when coalesce(M.properties['architectural_role'], '') = 'controller' then 'controller' when M.type in ('DTO','ViewModel') then 'transfer' when M.type = 'Migration' then 'migration' else 'other' end as category from R3 join M on M.id = R3.id""")(
    lambda g: T.model_impact(g.mn, g.me, g.mn.where("type in ('Struct', 'APIEndpoint')").select(F.col("id").alias("root_id"))))
query("j24_file_links", """, x as (select e.type, s.file_path as s, t.file_path as t from ME e join M s on s.id = e.source_id and s.file_path <> '' join M t on t.id = e.target_id and t.file_path <> ''
 where e.type in ('Imports','DependsOn','Calls') and s.file_path <> t.file_path)
 select s as file_path, t as peer_path, 'dependency' as relation from x where type <> 'Calls' union select t, s, case when type = 'Calls' then 'caller' else 'dependent' end from x""")(lambda g: T.file_links(g.mn, g.me))
_changed = lambda g: g.mn.where("type = 'File'").select(F.col("file_path").alias("path"), F.when(F.col("language") == "ruby", "deleted").otherwise("modified").alias("status"))
query("j25_diff_impact", """, c as (select distinct file_path as path from M where type = 'File' and language <> 'ruby') select distinct c.path, n.id, e.source_id as peer_id, p.file_path as peer_path, e.type
 from c join M n on n.file_path = c.path join ME e on e.target_id = n.id join M p on p.id = e.source_id where e.type in ('Imports','DependsOn','Calls','Implements','Tests') and p.file_path <> c.path""")(lambda g: T.diff_impact(g.mn, g.me, _changed(g)))
query("k14_json", " select to_json({'id': id, 'name': name, 'line': line, 'exported': exported})::varchar as json from M where type = 'Method'")(
    lambda g: R.json_lines(g.mn.where("type = 'Method'").select("id", "name", "line", "exported")))
query("k14_table", " select id, '| ' || replace(name, '|', '\\|') || ' | ' || replace(replace(replace(doc_comment, '|', '\\|'), chr(13), ''), chr(10), ' ') || ' | ' || line || ' |' as line from M")(
    lambda g: g.mn.select("id", R.row_line("name", "doc_comment", "line").alias("line")))
query("j31_branch_symbols", " select id, name, file_path from M where type <> 'File' and file_path in (select file_path from M where type = 'File' and language <> 'ruby')")(
    lambda g: T.branch_symbols(g.mn, _changed(g)).select("id", "name", "file_path"))
