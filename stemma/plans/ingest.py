"""Queries of sources, extraction and incremental indexing, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..model import SQL
from ..operators import documents as D
from ..sources import extract as E
from ..sources import files as Fi
from ..sources import git as G
from ..sources import manifests as Ma
from ..streaming import events as Ev
from .graph import Graph

QUERIES: dict = {}
ORACLE: dict = {}


def query(name, sql=None, prefix=""):
    def add(f):
        QUERIES[name] = lambda spark, d: f(Graph(spark, d))
        if sql:
            ORACLE[name] = prefix + sql
        return f

    return add


_files = lambda g: g.table("source_files")

# ---- Files --------------------------------------------------------------------------------------------------------

IGNORE = ["# build output", "*.min.js", "node_modules/", "**/testdata/**", "vendor", "!*.pb.go", "*_pb2*.py"]
_IGN = """case when regexp_matches(b, '^[^/]*_pb2[^/]*\\.py$') or regexp_matches(p, '^/?(.*/)?[^/]*_pb2[^/]*\\.py(/.*)?$') then true when regexp_matches(p, '\\.pb\\.go$') then false when list_contains(string_split(p, '/'), 'vendor') then true
 when regexp_matches(p, '^/?([^/]+/)*testdata(/.*)?$') then true when list_contains(string_split(p, '/'), 'node_modules') then true when regexp_matches(b, '\\.min\\.js$') then true else false end"""
query("f11_ignored", f"select p as path, {_IGN} as ignored from (select distinct path as p, regexp_extract(path, '([^/]*)$', 1) as b from source_files)")(
    lambda g: _files(g).select("path").distinct().select("path", Fi.ignored(F.col("path"), Fi.ignore_rules(IGNORE)).alias("ignored")))
query("f12_file_class", "select distinct path, case when path like '%.min.js' then 'skip' else 'text' end as class from source_files")(
    lambda g: _files(g).select("path", Fi.file_class(F.col("path"), (".min.js",)).alias("class")).distinct())
query("f13_binary", "select path, bool_or(strpos(hex(content[1:512]), '00') > 0 and regexp_matches(hex(content[1:512]), '^([0-9A-F]{2})*00')) as is_binary from source_files group by 1".replace("content[1:512]", "content"))(
    lambda g: _files(g).groupBy("path").agg(F.max(Fi.is_binary(F.col("content"))).alias("is_binary")))
query("x07_languages", "select distinct path, case lower(regexp_extract(path, '(\\.[^./]*)$', 1)) when '.go' then 'go' when '.py' then 'python' when '.ts' then 'typescript' when '.js' then 'javascript' when '.java' then 'java' when '.rs' then 'rust' when '.cs' then 'csharp' when '.rb' then 'ruby' else '' end as language from source_files")(
    lambda g: _files(g).select("path", X.infer_language(F.col("path"), True).alias("language")).distinct())
query("x15_mime", """select doc_id, case regexp_extract(file_path, '(\\.[^./]*)$', 1) when '.png' then 'image/png' when '.pdf' then 'application/pdf' when '.jpg' then 'image/jpeg' when '.gif' then 'image/gif' when '.svg' then 'image/svg+xml' else 'application/octet-stream' end as mime
 from (select doc_id, 'd/' || doc_id || ['.png', '.pdf', '.jpg', '.gif', '.svg', '.go', ''][doc_id % 7 + 1] as file_path from documents)""")(
    lambda g: g.table("documents").select("doc_id", Fi.mime_type(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, [".png", ".pdf", ".jpg", ".gif", ".svg", ".go", ""])), (F.pmod("doc_id", F.lit(7)) + 1).cast("int")))).alias("mime")))
query("s11_dispatch", "select distinct path, case when path like '%.go' then 'go' when path like '%.py' then 'python' else 'generic' end as parser from source_files")(
    lambda g: Fi.dispatch(_files(g).select("path").distinct(), {".go": "go", ".py": "python"}, {"go.mod": "manifest"}, "generic").select("path", "parser"))
query("s16_changed_files", """with s as (select path, min(modification_time) as seen from source_files where path not like '%.rb' group by 1), n as (select path, max(modification_time) as m from source_files where path not like '%.java' group by 1)
 select coalesce(n.path, s.path) as path, case when seen is null then 'added' when m is null then 'deleted' when m > seen then 'modified' end as change from n full join s on n.path = s.path where seen is null or m is null or m > seen""")(
    lambda g: Fi.changed_files(
        _files(g).where("path not like '%.java'").groupBy("path").agg(F.max("modification_time").alias("modification_time")),
        _files(g).where("path not like '%.rb'").groupBy("path").agg(F.min("modification_time").alias("modification_time"))))
query("s23_csv_preview", """with k as (select distinct result_id, string_split(chunk_text, chr(10)) as l from rag_results where chunk_text is not null), t as (select result_id, list_transform(l, lambda x: regexp_replace(x, '^ +| +$', '', 'g')) as l from k)
 select distinct result_id, 'CSV headers: ' || l[1] || case when len(l) > 1 then chr(10) || 'Sample rows:' || chr(10) || array_to_string(l[2:6], chr(10)) || chr(10) || case when len(l) > 6 then '...' || chr(10) else '' end else '' end as preview from t""")(lambda g: g.table("rag_results").where("chunk_text is not null").select("result_id", Fi.csv_preview(F.col("chunk_text")).alias("preview")).distinct())
query("u04_gone_files", "select distinct path from source_files where path like '%.rb'")(lambda g: _files(g).select("path").subtract(_files(g).where("path not like '%.rb'").select("path")))


def _status_lines(g):
    """Lines of a name-status diff made of the files: ruby deleted, java renamed, the rest modified."""
    return _files(g).select("path").distinct().select(F.when(F.col("path").endswith(".rb"), F.concat(F.lit("D\t"), "path")).when(F.col("path").endswith(".java"), F.concat(F.lit("R100\told\t"), "path")).otherwise(F.concat(F.lit("M\t"), "path")).alias("value"))


query("s12_diff_since", "select distinct path, case when path like '%.rb' then 'deleted' else 'modified' end as change from source_files")(lambda g: G.since(_status_lines(g)))
query("s13_branch_diff", "select path, case when path like '%.rb' then 'deleted' when path like '%.java' then 'renamed' else 'modified' end as status, cast(max(length) % 100 as int) as additions, 0 as deletions from source_files group by path")(
    lambda g: G.branch_diff(_files(g).groupBy("path").agg(F.max("length").alias("n")).select(F.concat_ws("\t", (F.col("n") % 100).cast("string"), F.lit("-"), "path").alias("value")), _status_lines(g)))
query("s14_log", "select distinct sha256(path) as hash, 'dev' as author, '2024-01-01' as date, 'touch ' || path || ' | again' as message from source_files")(
    lambda g: G.log(_files(g).select("path").distinct().select(F.concat(F.sha2("path", 256), F.lit("|dev|2024-01-01|touch "), "path", F.lit(" | again")).alias("value"))))
query("s18_manifests", "select 'r' || doc_id || '/requirements.txt' as path, 'manifest_dep' as kind, 'pkg-' || doc_id as name, '>=' || n_chars as version, 2 as line from documents where n_chars is not null")(
    lambda g: Ma.manifest_rows(g.table("documents").where("n_chars is not null").select(F.concat(F.lit("r"), F.col("doc_id").cast("string"), F.lit("/requirements.txt")).alias("path"), F.concat(F.lit("# wanted\npkg-"), F.col("doc_id").cast("string"), F.lit(">="), F.col("n_chars").cast("string"), F.lit("\n-i x\n")).alias("content"))).where("kind = 'manifest_dep'").select("path", "kind", "name", "version", "line"))

# ---- Extraction --------------------------------------------------------------------------------------------------------

_one = lambda g: _files(g).groupBy("path").agg(F.max(F.struct("modification_time", "content")).alias("f")).select("path", "f.content")
query("e01_code_nodes")(lambda g: E.graph_of(E.extract(_one(g)), "main")[0].select("id", "type", "name", "file_path", "line", "end_line", "language", "signature"))
query("e01_code_edges")(lambda g: E.graph_of(E.extract(_one(g)), "main")[1].select("id", "type", "source_id", "target_id"))
query("e02_python_imports", """with f as (select path, max(decode(content)) as t from source_files s join (select path, max(modification_time) as modification_time from source_files group by 1) using (path, modification_time) where path like '%.py' group by 1),
 l as (select path, unnest(string_split(replace(t, chr(13) || chr(10), chr(10)), chr(10))) as s from f)
 select distinct path as file_path, case when regexp_matches(s, '^\\s*from\\s') then regexp_extract(s, '^\\s*from\\s+([\\w.]+)\\s+import\\b', 1) else regexp_extract(s, '^\\s*import\\s+([\\w.]+)', 1) end as name from l
 where regexp_matches(s, '^\\s*from\\s+[\\w.]+\\s+import\\b') or regexp_matches(s, '^\\s*import\\s+[\\w.]+')""")(
    lambda g: E.extract(_one(g).where("path like '%.py'")).where("type = 'Dependency' and kind = 'node'").select("file_path", "name"))
# Fences and front matter as states over the lines: inside a fence only its closing line counts.
_MD = """with recursive t as (select doc_id, replace(text, chr(13) || chr(10), chr(10)) as t from documents where text is not null),
 d as (select doc_id, unnest(string_split(t, chr(10))) as s, generate_subscripts(string_split(t, chr(10)), 1) as i from t),
 f as (select doc_id, i, s, regexp_replace(s, '^\\s+|\\s+$', '', 'g') = '---' as bar, regexp_matches(s, '^```\\w*\\s*$') as op, regexp_matches(s, '^```\\s*$') as cl from d),
 fm as (select doc_id, case when bool_or(i = 1 and bar) then coalesce(min(i) filter (i > 1 and bar), 0) else 0 end as last from f group by 1),
 b as (select f.*, last from f join fm using (doc_id)),
 st as (select doc_id, last + 1 as i, false as inside from fm union all select st.doc_id, st.i + 1, case when inside then not cl else op end from st join b on b.doc_id = st.doc_id and b.i = st.i)"""
query("e10_markdown_sections", _MD + " select distinct 'd/' || b.doc_id || '.md' as file_path, regexp_replace(regexp_extract(s, '^#{1,6}\\s+(.+)$', 1), '^\\s+|\\s+$', '', 'g') as name from b join st on st.doc_id = b.doc_id and st.i = b.i where not inside and not op and regexp_matches(s, '^#{1,6}\\s+.+$')")(
    lambda g: E.extract(_documents(g, ".md")).where("element_at(properties, 'kind') = 'section'").select("file_path", "name").distinct())
query("e16_generic_documents", "select 'd/' || doc_id || '.text' as path, 'sha256:' || sha256(text) as hash from documents where text is not null")(
    lambda g: E.extract(_documents(g, ".text")).where("kind = 'node'").select(F.col("file_path").alias("path"), F.element_at("properties", "content_hash").alias("hash")))


def _documents(g, suffix):
    """All documents with a text, as files."""
    return g.table("documents").where("text is not null").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(suffix)).alias("path"), F.col("text").alias("content"))


query("e10_markdown_nodes")(
    lambda g: E.extract(_documents(g, ".md")).where("kind = 'node'").select(
        "file_path", "type", "name", "line", "end_line", *[F.element_at("properties", k).alias(k) for k in ("kind", "level", "lang")], F.to_json(F.map_filter("properties", lambda k, _: k.startswith("fm_"))).alias("front_matter")))
QUERIES["e16_all_documents"], ORACLE["e16_all_documents"] = QUERIES["e16_generic_documents"], ORACLE["e16_generic_documents"]
query("p13_document_nodes", "select distinct substr(sha256('Document:' || path || ':' || path), 1, 24) as id, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '.' end as package, 'sha256:' || sha256(content) as content_hash, length as size from source_files")(
    lambda g: D.document_nodes(_files(g)).select("id", "package", "content_hash", "size").distinct())
query("b04_cache_misses", "select sha256(content) as hash from source_files where path not like '%.go' and sha256(content) not in (select sha256(content) from source_files where path like '%.go') group by 1")(
    lambda g: D.to_process(_files(g), _files(g).where("path like '%.go'").select(F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("hash"))).select(F.expr("substring(hash, 8)").alias("hash")))

# ---- Incremental ------------------------------------------------------------------------------------------------------------

_events = lambda g: g.table("events").select(F.col("user_id").alias("path"), F.col("event_type").alias("op"), F.col("ts").cast("timestamp").alias("ts"))
query("r01_debounce", """with e as (select user_id as path, event_type as op, ts from events where ts is not null), r as (select *, sum(coalesce((ts >= p + interval 60 minutes)::int, 1)) over (partition by path order by ts, op rows unbounded preceding) as run
  from (select *, lag(ts) over (partition by path order by ts, op) as p from e)) select path, min(ts) as start, max(ts) as "end", arg_max(op, {'a': ts, 'b': op}) as op, count(*) as events from r group by path, run""")(
    lambda g: Ev.debounce(_events(g), "60 minutes").withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz")))
query("r01_sessions", """with e as (select user_id as path, ts from events where ts is not null), r as (select *, sum(coalesce((ts >= p + interval 60 minutes)::int, 1)) over (partition by path order by ts rows unbounded preceding) as run
  from (select *, lag(ts) over (partition by path order by ts) as p from e)) select path, min(ts) as start, max(ts) + interval 60 minutes as "end", count(*) as events from r group by path, run""")(
    lambda g: Ev.session_counts(_events(g), "60 minutes", "path", "ts").withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz")))
query("r02_operations", "select user_id as path, arg_max(case event_type when 'signup' then 'Create' when 'purchase' then 'Write' when 'error' then 'Remove' else 'Rename' end, {'a': ts, 'b': case event_type when 'signup' then 'Create' when 'purchase' then 'Write' when 'error' then 'Remove' else 'Rename' end}) as op from events where event_type <> 'view' group by 1")(
    lambda g: Ev.last_operations(_events(g).withColumn("op", F.when(F.col("op") == "signup", "CREATE|WRITE").when(F.col("op") == "purchase", "WRITE").when(F.col("op") == "error", "REMOVE").when(F.col("op") == "view", "CHMOD").otherwise("RENAME"))))


@query("r03_apply_batch", " , gone as (select distinct file_path as p from M where file_path like '%.py') select branch, id from N where not (branch = 'main' and file_path in (select p from gone))", SQL)
def _(g):
    batch = g.mn.where("file_path like '%.py'").select(F.col("file_path").alias("path"), F.lit("REMOVE").alias("op"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    return Ev.apply_batch(g.n, g.e, batch, lambda paths: (g.n.limit(0), g.e.limit(0)), "main")[0].select("branch", "id")
