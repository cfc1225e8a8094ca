"""Queries of the link phases with their SQL.

The tables have imports, endpoints and tests, but no manifests, API calls or router mounts; project() adds those
from what is there (libraries imported in a top directory become its manifest, every endpoint is called in
three spellings), and the SQL does the same in its LN."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..model import NODE_COLUMNS, SQL, node_id
from ..operators import link as L
from ..session import cut, drop_cut
from .graph import Graph

QUERIES: dict = {}
ORACLE: dict = {}


#: The columns that imports are matched by.
IMPORTS = ["id", "type", "name", "file_path", "properties"]


def project(g: Graph, columns: list[str] = NODE_COLUMNS):
    """The nodes of main with the projected ones, written once: the phases read them many times over. Only the columns
    that are asked for are read, moved and written."""
    n = cut(g.mn.select(*columns))
    blank = {"branch": F.lit("main"), "qualified_name": F.lit(""), "line": F.lit(0), "end_line": F.lit(0), "package": F.lit(""), "language": F.lit(""), "exported": F.lit(False),
             "signature": F.lit(""), "doc_comment": F.lit(""), "metrics": F.lit(None).cast("map<string,double>")}
    shape = lambda df, **c: df.select(*[(blank | c)[k].alias(k) for k in columns])
    top = X.top_dir(F.col("file_path"))
    lib = g.table("library_files").groupBy(F.col("library").alias("name")).agg(F.max("version").alias("version"))
    man = n.where("type = 'Dependency'").select(top.alias("top"), "name").distinct().join(lib, "name")
    path = F.concat("top", F.lit("/package.json"))
    man = shape(man, id=node_id("Dependency", path, F.col("name")), type=F.lit("Dependency"), name=F.col("name"), file_path=path,
                properties=F.create_map(F.lit("kind"), F.lit("manifest_dep"), F.lit("version"), F.col("version")))
    ends = n.where("type = 'APIEndpoint'").select(L.prop("path").alias("p"), "id", "file_path")
    calls = ends.select("id", F.explode(F.array(
        F.struct(F.lit(1).alias("k"), F.upper("p").alias("path")), F.struct(F.lit(2).alias("k"), F.concat(F.lit("/gateway"), "p").alias("path")),
        F.struct(F.lit(3).alias("k"), F.regexp_replace("p", r"\{[^}]+\}", "42").alias("path")))).alias("c")).select("id", "c.*")
    calls = shape(calls, id=F.concat("id", F.lit("-c"), F.col("k").cast("string")), type=F.lit("Dependency"), name=F.col("path"), file_path=F.concat(F.lit("client/"), F.col("k").cast("string"), F.lit(".ts")),
                  properties=F.create_map(F.lit("kind"), F.lit("api_call"), F.lit("path"), F.col("path")))
    mounts = ends.select(top.alias("top")).distinct()
    mounts = shape(mounts, id=F.concat(F.lit("mount-"), "top"), type=F.lit("Variable"), name=F.lit("router"), file_path=F.concat("top", F.lit("/main.py")),
                   properties=F.create_map(F.lit("kind"), F.lit("router_mount"), F.lit("prefix"), F.concat(F.lit("/"), "top")))
    out = cut(n.unionByName(man).unionByName(calls).unionByName(mounts))
    drop_cut(n)
    return out


PRE = SQL + """, top as (select *, case when file_path = '' then '' when not contains(file_path, '/') or starts_with(file_path, '/') then '(root)' else split_part(file_path, '/', 1) end as top from M),
 man as (select substr(sha256('Dependency:' || t.top || '/package.json:' || t.name), 1, 24) as id, t.name, t.top || '/package.json' as file_path, t.top, l.version
   from (select distinct top, name from top where type = 'Dependency') t join (select library as name, max(version) as version from library_files group by 1) l using (name)),
 ends as (select id, coalesce(properties['path'], '') as p, file_path, top from top where type = 'APIEndpoint'),
 calls as (select id || '-c1' as id, upper(p) as path, 'client' as top from ends union all select id || '-c2', '/gateway' || p, 'client' from ends union all select id || '-c3', regexp_replace(p, '\\{[^}]+\\}', '42', 'g'), 'client' from ends),
 groups as (select distinct top as grp from top where type in ('File','TestFile') and top <> ''),
 svc as (select grp, coalesce(k.id, substr(sha256('Service:' || grp || ':' || grp), 1, 24)) as service_id, k.id is null as created from groups
   left join (select case when file_path <> '' then top else name end as grp, max(id) as id from top where type = 'Service' group by 1) k using (grp))
"""


def query(name, sql=None):
    def add(f):
        QUERIES[name] = lambda spark, d: f(Graph(spark, d))
        if sql:
            ORACLE[name] = PRE + sql
        return f

    return add


_E = lambda t, kind, s="s", d="d": f"substr(sha256('{t}:' || {s} || ':' || {d}), 1, 24) as id, '{t}' as type, {s} as source_id, {d} as target_id, '{kind}' as kind"

query("p14_services", " select grp as \"group\", service_id, created from svc")(lambda g: L.services(project(g)))
query("j06_service_files", f", x as (select distinct service_id as s, top.id as d from top join svc on svc.grp = top.top where type in ('File','TestFile')) select {_E('Contains', 'service_file')} from x")(lambda g: L.link_services(project(g)))
query("j07_endpoints", f", x as (select distinct service_id as s, ends.id as d from ends join svc on svc.grp = ends.top) select {_E('Exposes', '')} from x")(lambda g: L.link_endpoints(project(g)))
query("j10_endpoint_prefix", " select id as endpoint_id, regexp_replace('/' || top || '/' || p, '/+', '/', 'g') as full_path from ends")(lambda g: L.endpoint_paths(project(g)))

_CALLS = """, norm as (select id as endpoint_id, regexp_replace(case when starts_with(rtrim(lower(p), '/'), '/') then rtrim(lower(p), '/') else '/' || rtrim(lower(p), '/') end, '\\{[^}]+\\}|:[a-z_][a-z0-9_]*|<[^>]+>', '*', 'g') as q, top from ends),
 ep as (select q, max(endpoint_id) as endpoint_id from norm group by 1),
 c as (select id as call_id, top, regexp_replace(case when starts_with(rtrim(lower(path), '/'), '/') then rtrim(lower(path), '/') else '/' || rtrim(lower(path), '/') end, '\\{[^}]+\\}|:[a-z_][a-z0-9_]*|<[^>]+>', '*', 'g') as p from calls),
 hit as (select call_id, endpoint_id, case when p = q then 1 when ends_with(p, q) or ends_with(q, p) then 2
   when len(string_split(p,'/')) = len(string_split(q,'/')) and list_bool_and(list_transform(list_zip(string_split(p,'/'), string_split(q,'/')), lambda z: z[1] = z[2] or z[1] = '*' or z[2] = '*')) then 3 end as tier from c, ep),
 best as (select call_id, unnest(arg_min({'e': endpoint_id, 't': tier}, {'t': tier, 'e': endpoint_id}, 1)) as m from hit where tier is not null group by 1),
 mc as (select call_id, m.e as endpoint_id, m.t as tier from best)"""
query("j11_match_calls", _CALLS + " select * from mc")(
    lambda g: (lambda n: L.match_calls(L.api_calls(n), n.where("type = 'APIEndpoint'").select(F.col("id").alias("endpoint_id"), L.prop("path").alias("path"))))(project(g)))
query("j12_api_dependencies", _CALLS + f""", x as (select distinct call_id as s, endpoint_id as d from mc), y as (select distinct a.service_id as s, b.service_id as d from mc join c using (call_id) join norm using (endpoint_id)
 join svc a on a.grp = c.top join svc b on b.grp = norm.top where c.top <> norm.top)
 select {_E('Consumes', '')} from x union all select {_E('DependsOn', 'api_dependency')} from y""")(lambda g: L.link_api_calls(project(g)))
query("j23_unresolved_calls", " select calls.id as call_id, path from calls where id not in (select source_id from ME where type = 'Consumes' union select target_id from ME where type = 'Consumes')")(
    lambda g: L.unresolved_calls(project(g), g.me).select("call_id", "path"))
def _providing(g):
    """Services that provide, as their go module, the first library that their top directory imports."""
    n = project(g)
    libs = L.manifests(n).groupBy(X.top_dir(F.col("file_path")).alias("top")).agg(F.min("name").alias("lib"))
    has = n.withColumn("top", X.top_dir(F.col("file_path"))).join(libs, "top", "left")
    return has.withColumn("properties", F.when((F.col("type") == "Service") & F.col("lib").isNotNull(), F.create_map(F.lit("go_module"), F.col("lib"))).otherwise(F.col("properties"))).select(*NODE_COLUMNS)


query("j13_dependencies", f""", own as (select id as d, name from M where type = 'Service' and name <> '' union select top.id, l.lib from top join (select top, min(name) as lib from man group by 1) l using (top) where type = 'Service'),
 x as (select distinct service_id as s, own.d from man join svc on svc.grp = man.top join own using (name) where service_id <> own.d) select {_E('DependsOn', 'library_dependency')} from x""")(lambda g: L.link_dependencies(_providing(g)))
query("a11_version_conflicts", " select library as name, string_agg(distinct version, ',' order by version) as versions, cast(count(distinct version) as int) as n from library_files group by 1 having count(distinct version) > 1")(
    lambda g: L.version_conflicts(g.table("library_files").select(
        F.col("file_name").alias("id"), F.lit("Dependency").alias("type"), F.col("library").alias("name"), F.lit("").alias("file_path"),
        F.create_map(F.lit("kind"), F.lit("manifest_dep"), F.lit("version"), F.col("version")).alias("properties"))))

_IMP = """, mk as (select id as manifest_id, name as key, top as mg from man union select id, lower(replace(name, '-', '_')), top from man),
 imp as (select id as import_id, name, top as ig from top where type = 'Dependency' and contains(coalesce(properties['kind'], ''), 'import')),
 t as (select import_id, ig, mk.manifest_id, mg, key, case when imp.name = key then 0 when contains(imp.name, '/') and starts_with(imp.name, key || '/') then 1000000 - len(key)
    when contains(imp.name, '.') and key = lower(replace(split_part(imp.name, '.', 1), '-', '_')) then 3000000 when contains(imp.name, '.') and key = split_part(imp.name, '.', 1) then 4000000 end as tier from imp, mk),
 f as (select * from t where tier is not null qualify tier = min(tier) over (partition by import_id)),
 k as (select *, max((mg = ig)::int) over (partition by import_id) as same from f),
 mi as (select distinct import_id, manifest_id, case when tier = 0 then 1 when tier <= 1000000 then 2 else 3 end as tier from k where same = 0 or mg = ig)"""
query("j14_match_imports", _IMP + " select * from mi")(lambda g: (lambda n: L.match_imports(n.where((F.col("type") == "Dependency") & F.contains(L.prop("kind"), F.lit("import"))), L.manifests(n)))(project(g, IMPORTS)))
query("j14_import_edges", _IMP + f", x as (select distinct import_id as s, manifest_id as d from mi) select {_E('DependsOn', 'import_to_manifest')} from x")(lambda g: L.link_imports(project(g, IMPORTS)))
query("j15_same_service", _IMP + " select import_id, count(*) as n from mi group by 1")(
    lambda g: (lambda n: L.match_imports(n.where((F.col("type") == "Dependency") & F.contains(L.prop("kind"), F.lit("import"))), L.manifests(n)))(project(g, IMPORTS)).groupBy("import_id").agg(F.count("*").alias("n")))

# Structural implements over types of any language: the interface's first method is what a struct must have here.
_STRUCT = """, rec as (select file_path as rf, properties['receiver'] as r, list_sort(list(distinct name))[1:2] as ms from M where type = 'Method' and coalesce(properties['receiver'], '') <> '' and not contains(name, ',') group by 1, 2),
 want as (select split_part(rf, '/', 1) as top, min(ms) as ms from rec where len(ms) = 2 group by 1),
 need as (select top.id as d, file_path as f, unnest(ms) as m from top join want using (top) where type = 'Interface'),
 size as (select d, count(*) as k from need group by 1), st as (select id as s, name, file_path as sf from M where type in ('Struct','Class') and name <> ''),
 has as (select distinct s, sf, x.name as m from M x join st on {match} where x.type = 'Method' and coalesce(x.properties['receiver'], '') <> ''),
 x as (select s, need.d from has join need using (m) where sf <> need.f group by 1, 2 having count(*) = (select k from size where size.d = need.d))"""


def _typed(g):
    """Go view of all languages: class-like nodes as structs, and every interface asking for two methods that some type of
    its top directory has, so that division has something to divide."""
    n = project(g)
    receiver = L.prop("receiver")
    have = n.where((F.col("type") == "Method") & (receiver != "") & ~F.col("name").contains(",")).groupBy("file_path", receiver.alias("r")).agg(F.slice(F.array_sort(F.collect_set("name")), 1, 2).alias("ms"))
    want = have.where(F.size("ms") == 2).groupBy(X.top_dir(F.col("file_path")).alias("top")).agg(F.min("ms").alias("ms"))
    n = n.withColumn("top", X.top_dir(F.col("file_path"))).join(want, "top", "left")
    n = n.withColumn("properties", F.when(F.col("type") == "Interface", F.when(F.col("ms").isNotNull(), F.create_map(F.lit("methods"), F.array_join("ms", ",")))).otherwise(F.col("properties"))).select(*NODE_COLUMNS)
    return n.withColumn("language", F.lit("go")).withColumn("type", F.when(F.col("type") == "Class", "Struct").otherwise(F.col("type")))


query("j16_structural_implements", _STRUCT.format(match="contains(x.properties['receiver'], st.name)") + f" select {_E('Implements', 'structural')} from x")(lambda g: L.structural_implements(_typed(g)))
query("j16_exact_receiver", _STRUCT.format(match="x.properties['receiver'] = st.name") + f" select {_E('Implements', 'structural')} from x")(lambda g: L.structural_implements(_typed(g), exact_receiver=True))
query("j33_same_file_implements", _STRUCT.format(match="x.properties['receiver'] = st.name and x.file_path = st.sf").replace("sf <> need.f", "sf = need.f") + f" select {_E('Implements', 'structural')} from x")(
    lambda g: L.structural_implements(_typed(g), same_file=True))


def _named(g):
    """Classes that name the interface of their package, or of any package, as one they implement."""
    n = project(g)
    names = n.where("type = 'Interface'").groupBy("package").agg(F.min("name").alias("iface"))
    want = n.join(names, "package", "left")
    return want.withColumn("properties", F.when((F.col("type") == "Class") & F.col("iface").isNotNull(), F.create_map(F.lit("implements"), F.concat("iface", F.lit(", Missing")))).otherwise(F.col("properties"))).select(*NODE_COLUMNS)


query("j17_nominal_implements", f""", nm as (select package, min(name) as iface from M where type = 'Interface' group by 1),
 c as (select top.id as s, top, package, iface from top join nm using (package) where type = 'Class'), i as (select id as d, name, top, package from top where type = 'Interface'),
 x as (select s, d from (select s, d, row_number() over (partition by s order by (c.top <> i.top)::int, (c.package <> i.package)::int, d) r from c join i on i.name = c.iface) where r = 1)
 select {_E('Implements', 'nominal')} from x""")(lambda g: L.nominal_implements(_named(g)))


def _protocols(g):
    """Interfaces read as Python protocols that the classes of their package take as a base."""
    n = _named(g).withColumn("language", F.lit("python"))
    p = F.col("properties")
    return n.withColumn("properties", F.when(F.col("type") == "Interface", F.create_map(F.lit("protocol"), F.lit("true"))).when(F.element_at(p, "implements").isNotNull(), F.create_map(F.lit("bases"), F.element_at(p, "implements"))).otherwise(p))


query("j18_protocols", f""", nm as (select package, min(name) as iface from M where type = 'Interface' group by 1),
 c as (select top.id as s, top, package, iface from top join nm using (package) where type = 'Class'), i as (select id as d, name, top, package from top where type = 'Interface'),
 x as (select s, d from (select s, d, row_number() over (partition by s order by (c.top <> i.top)::int, (c.package <> i.package)::int, d) r from c join i on i.name = c.iface) where r = 1)
 select {_E('Implements', 'protocol')} from x""")(lambda g: L.nominal_implements(_protocols(g)))

_P = "regexp_replace(file_path, '{a}', '{b}')"
query("j19_test_files", """, lang as (select *, case when language <> '' then language when file_path like '%.go' then 'go' when file_path like '%.py' then 'python' when regexp_matches(file_path, '\\.tsx?$') then 'typescript'
  when regexp_matches(file_path, '\\.jsx?$') then 'javascript' when file_path like '%.java' then 'java' when file_path like '%.rs' then 'rust' when file_path like '%.cs' then 'csharp' when regexp_matches(file_path, '\\.(rb|rake)$') then 'ruby' else '' end as lang from M where type = 'TestFile'),
 c as (select id as s, 0 as pos, case when lang = 'go' and file_path like '%\\_test.go' escape '\\' then regexp_replace(file_path, '_test\\.go$', '.go') when lang = 'python' and regexp_matches(file_path, '(^|/)test_[^/]*$') then regexp_replace(file_path, '(^|/)test_([^/]*)$', '\\1\\2')
   when lang = 'typescript' and regexp_matches(file_path, '\\.(test|spec)\\.tsx?$') then regexp_replace(file_path, '\\.(test|spec)\\.(tsx?)$', '.\\2') when lang = 'javascript' and regexp_matches(file_path, '\\.(test|spec)\\.jsx?$') then regexp_replace(file_path, '\\.(test|spec)\\.(jsx?)$', '.\\2')
   when lang = 'java' and regexp_matches(file_path, '(Tests|Test|IT)\\.java$') then regexp_replace(file_path, '(Tests|Test|IT)\\.java$', '.java') when lang = 'csharp' and regexp_matches(file_path, '(Tests|Test)\\.cs$') then regexp_replace(file_path, '(Tests|Test)\\.cs$', '.cs')
   when lang = 'ruby' and regexp_matches(file_path, '(_spec|_test)\\.rb$') then regexp_replace(file_path, '(_spec|_test)\\.rb$', '.rb') end as path from lang
  union all select id, 1, case when lang = 'python' and file_path like '%\\_test.py' escape '\\' then regexp_replace(file_path, '_test\\.py$', '.py') when lang in ('java','csharp') and regexp_matches(file_path, '(^|/)Test[^/]*$') then regexp_replace(file_path, '(^|/)Test([^/]*)$', '\\1\\2')
   when lang = 'ruby' and regexp_matches(file_path, '(^|/)test_[^/]*$') then regexp_replace(file_path, '(^|/)test_([^/]*)$', '\\1\\2') end from lang),
 fl as (select file_path as path, max(id) as d from M where type = 'File' group by 1),
 x as (select s, arg_min(d, pos) as d from c join fl using (path) where s <> d group by 1) select """ + _E("Tests", "file_coverage") + " from x")(lambda g: L.link_test_files(project(g)))


def _tested(g):
    """Go and Python code with a test file for every file and a test function for every function beside it."""
    n = project(g).where("type in ('File', 'Function', 'Method') and language in ('go', 'python') and file_path <> ''")
    go = F.col("language") == "go"
    path = F.when(go, F.regexp_replace("file_path", r"\.go$", "_test.go")).otherwise(F.regexp_replace("file_path", "([^/]+)$", "test_$1"))
    files = n.where("type = 'File'").withColumn("file_path", path).withColumn("id", F.concat("id", F.lit("-t"))).withColumn("type", F.lit("TestFile"))
    name = F.when(go, F.concat(F.lit("Test"), "name")).otherwise(F.concat(F.lit("test_"), "name"))
    funcs = n.where("type = 'Function'").withColumn("name", name).withColumn("file_path", path).withColumn("id", F.concat("id", F.lit("-t"))).withColumn("type", F.lit("TestFunction"))
    return n.unionByName(files).unionByName(funcs)


_TESTED = """, gp as (select *, case when language = 'go' then regexp_replace(file_path, '\\.go$', '_test.go') else regexp_replace(file_path, '([^/]*)$', 'test_\\1') end as tpath,
   case when contains(file_path, '/') then regexp_replace(file_path, '/[^/]*$', '') else '.' end as dir from M where type in ('File','Function','Method') and language in ('go','python') and file_path <> '')"""
query("j19_test_files_found", _TESTED + """, c as (select id || '-t' as s, 0 as pos, case when language = 'go' then regexp_replace(tpath, '_test\\.go$', '.go') else regexp_replace(tpath, '(^|/)test_([^/]*)$', '\\1\\2') end as path, tpath from gp where type = 'File' and (language <> 'go' or tpath like '%\\_test.go' escape '\\')
 union all select id || '-t', 1, case when language = 'python' and tpath like '%\\_test.py' escape '\\' then regexp_replace(tpath, '_test\\.py$', '.py') end, tpath from gp where type = 'File'),
 fl as (select file_path as path, max(id) as d from gp where type = 'File' group by 1), x as (select s, arg_min(d, pos) as d from c join fl using (path) group by 1) select """ + _E("Tests", "file_coverage") + " from x")(lambda g: L.link_test_files(_tested(g)))
query("j20_test_functions", _TESTED + """, tf as (select id || '-t' as s, dir, package as pkg, language, name from gp where type = 'Function'),
 cand as (select s, dir, pkg, unnest(c) as c, generate_subscripts(c, 1) as pos from (select *, case when language = 'python' then [name] when strpos(name, '_') > 1 then
    (case when substr(name, strpos(name, '_') + 1) <> '' then [split_part(name, '_', 1), substr(name, strpos(name, '_') + 1), split_part(name, '_', 1) || '.' || substr(name, strpos(name, '_') + 1)] else [split_part(name, '_', 1)] end) else [name] end as c from tf)),
 pool as (select type, name as c, dir, package as pkg, id, (type = 'Function' and ((language = 'go' and regexp_matches(name, '^(Test|Benchmark|Example|Fuzz)')) or (language = 'python' and starts_with(name, 'test_') and regexp_matches(file_path, '(^|/)(test_[^/]*\\.py|[^/]*_test\\.py)$')))) as t from gp where type in ('Function','Method')),
 hits as (select s, pos, 0 as tier, max(id) as d from cand join pool using (c, dir) where type = 'Function' and not t group by 1, 2 union all select s, pos, 1, max(id) from cand join pool using (c, dir) where type = 'Method' group by 1, 2
  union all select s, pos, 2, max(id) from cand join pool using (c, pkg) where type = 'Function' and not t and pkg <> '' group by 1, 2 union all select s, pos, 3, max(id) from cand join pool using (c, pkg) where type = 'Method' and pkg <> '' group by 1, 2),
 x as (select s, arg_min(d, pos * 10 + tier) as d from hits group by 1) select """ + _E("Tests", "function_coverage") + " from x")(lambda g: L.link_test_functions(_tested(g)))


def _calling(g):
    """Callables with the names of what their Calls edges point at as unresolved calls."""
    n = project(g)
    to = g.me.where("type = 'Calls'").join(n.select(F.col("id").alias("target_id"), F.col("name").alias("callee")), "target_id").where("callee <> '' and not contains(callee, ',')")
    names = to.groupBy(F.col("source_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("callee")), ",").alias("calls"))
    return n.join(names, "id", "left").withColumn("properties", F.when(F.col("calls").isNotNull(), F.create_map(F.lit("unresolved_calls"), F.col("calls"))).otherwise(F.col("properties"))).select(*NODE_COLUMNS)


query("j21_cross_file_calls", f""", code as (select *, case when contains(file_path, '/') then regexp_replace(file_path, '/[^/]*$', '') else '.' end as dir from M where language = 'go' and type in ('Function','Method')),
 u as (select distinct c.id as s, c.package, c.file_path as ff, c.dir as fd, t.name from ME e join code c on c.id = e.source_id join M t on t.id = e.target_id where e.type = 'Calls' and t.name <> '' and not contains(t.name, ',')),
 x as (select distinct s, d from (select u.s, code.id as d, row_number() over (partition by u.s, u.name order by (u.fd <> code.dir)::int, code.id) r from u join code on code.package = u.package and code.name = u.name where u.ff <> code.file_path) where r = 1)
 select {_E('Calls', 'cross_file')} from x""")(lambda g: L.link_calls(_calling(g)))


def _with_documents(g):
    """The columns that mentions are found by: the nodes of main, written once, and the documents."""
    d = g.table("documents").where("text is not null").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("id"), F.lit("Document").alias("type"), F.lit("").alias("name"), F.col("text").alias("doc_comment"))
    return cut(g.mn.select("id", "type", "name").where(F.col("type").isin(L.DOCUMENTED))).withColumn("doc_comment", F.lit("")).unionByName(d)


query("j22_document_mentions", """, d as (select 'doc' || doc_id as s, lower(text) as t from documents where strlen(lower(text)) >= 20),
 nn as (select lower(name) as nm, id from M where type in ('Function','Method','Class','Struct','Interface','Package','File') and strlen(lower(name)) >= 3),
 x as (select d.s, nn.id as d from d join (select distinct nm from nn) u on contains(d.t, u.nm) join nn on nn.nm = u.nm)
 select distinct substr(sha256('edge:' || s || ':' || d || ':Documents'), 1, 24) as id, 'Documents' as type, s as source_id, d as target_id, '' as kind from x""")(lambda g: L.link_documents(_with_documents(g)))
query("f18_event_ends", """ select id, top as service, produces, consumes from (select *, regexp_matches(lower(name), 'publish|emit|send_event|dispatch|fire') or regexp_matches(lower(signature), 'publish|emit|send_event|dispatch') as produces,
 regexp_matches(lower(name), 'subscribe|on_event|handle_event|consume|listener') or regexp_matches(lower(signature), 'subscribe|on_event|handle_event|consumer') as consumes from top where type = 'Function') where produces or consumes""")(lambda g: L.event_ends(project(g)))


def _matches(g):
    """Every endpoint as a model's match for the clients' service, each third one of low confidence."""
    n = cut(project(g))
    third = F.pmod(F.length(L.prop("path")), F.lit(3)) == 0
    return n, n.where("type = 'APIEndpoint'").select(F.lit("client").alias("service"), L.prop("path").alias("endpoint_path"), F.when(third, "low").otherwise("high").alias("confidence"))


query("j32_inferred_matches", _CALLS + """, ok as (select distinct norm.q from ends join norm on norm.endpoint_id = ends.id where length(ends.p) % 3 <> 0),
 b as (select ok.q, ep.endpoint_id as e, c.call_id, (len(string_split(p,'/')) = len(string_split(q,'/')) and list_bool_and(list_transform(list_zip(string_split(p,'/'), string_split(q,'/')), lambda z: z[1] = z[2] or z[1] = '*' or z[2] = '*'))) as fits from ok join ep using (q), c),
 w as (select q, e, call_id from b qualify row_number() over (partition by q order by (not fits)::int, call_id) = 1),
 x as (select distinct call_id as s, e as d from w), y as (select distinct a.service_id as s, v.service_id as d from w join norm on norm.endpoint_id = w.e join svc v on v.grp = norm.top join svc a on a.grp = 'client' where a.service_id <> v.service_id)
 select substr(sha256('llm_Consumes:' || s || ':' || d), 1, 24) as id, 'Consumes' as type, s as source_id, d as target_id, '' as kind from x union all select substr(sha256('llm_DependsOn:' || s || ':' || d), 1, 24), 'DependsOn', s, d, 'api_dependency' from y""")(
    lambda g: L.link_inferred(*_matches(g)))
# In a chain the third phase sees the endpoints' full paths. Of the tables' nodes four phases link nothing: no manifest names a
# service, and no node has interface methods, calls or a test beside its source; those have their own queries above.
_FULL = _CALLS.replace(", top from ends)", ", top from (select id, top, case when p <> '' then regexp_replace('/' || top || '/' || p, '/+', '/', 'g') else p end as p from ends))", 1)
_CHAIN = _FULL + _IMP + f""", dm as (select distinct d.s, M.id as d from (select id as s, lower(doc_comment) as t from M where type = 'Document' and strlen(lower(doc_comment)) >= 20) d
   join M on M.type in ('Function','Method','Class','Struct','Interface','Package','File') and strlen(lower(M.name)) >= 3 and contains(d.t, lower(M.name))),
 sd as (select distinct call_id, c.top as ctop, norm.top as etop from mc join c using (call_id) join norm using (endpoint_id) where c.top <> norm.top),
 allp as (select {_E('Contains', 'service_file')}, 'services' as phase from (select distinct service_id as s, top.id as d from top join svc on svc.grp = top.top where type in ('File','TestFile'))
  union all select {_E('Exposes', '')}, 'endpoints' from (select distinct service_id as s, ends.id as d from ends join svc on svc.grp = ends.top)
  union all select {_E('Consumes', '')}, 'api_calls' from (select distinct call_id as s, endpoint_id as d from mc)
  union all select {_E('DependsOn', 'api_dependency')}, 'api_calls' from (select distinct x.service_id as s, y.service_id as d from sd join svc x on x.grp = ctop join svc y on y.grp = etop)
  union all select {_E('DependsOn', 'import_to_manifest')}, 'imports' from (select distinct import_id as s, manifest_id as d from mi)
  union all select substr(sha256('edge:' || s || ':' || d || ':Documents'), 1, 24), 'Documents', s, d, '', 'documents' from dm)"""
query("a25_phase_counts", _CHAIN + f" select v.phase, count(allp.phase) as linked from (select unnest({list(L.PHASES)}) as phase) v left join allp on allp.phase = v.phase group by 1")(lambda g: L.count_phases(project(g, L.READ)))
query("u03_all_phases", _CHAIN + " select id, type, source_id, target_id, kind, phase from allp")(lambda g: L.run_phases(project(g, L.READ)))
query("j35_prerequisites", f""", t as (select id, name, coalesce((select string_agg(name, ' ') from M m2 where m2.package = M.package and m2.type = 'Interface'), '') as pre from M where type in ('Interface'))
 , x as (select distinct a.id as s, b.id as d from (select id, unnest(string_split(pre, ' ')) as w from t) a join t b on b.name = a.w where a.id <> b.id) select {_E('DependsOn', 'prerequisite')} from x""")(
    lambda g: (lambda t: L.link_prerequisites(t.join(t.groupBy("package").agg(F.array_join(F.collect_list("name"), " ").alias("prerequisites")), "package")))(g.mn.where("type = 'Interface'").select("id", "name", "package")))
query("j36_providers", f""", p as (select min(id) as id, split_part(name, '_', 1) as name from M where type = 'Function' and contains(name, '_') and split_part(name, '_', 1) <> '' group by 2),
 x as (select distinct r.id as s, p.id as d from M r join p on p.name = split_part(r.name, '_', 1) where r.type = 'Function' and contains(r.name, '_')) select {_E('DependsOn', 'provider')} from x""")(
    lambda g: (lambda r: L.link_providers(r, r.groupBy(F.split_part("name", F.lit("_"), F.lit(1)).alias("name")).agg(F.min("id").alias("id")).where("name <> ''")))(g.mn.where("type = 'Function' and contains(name, '_')").select("id", "name")))
