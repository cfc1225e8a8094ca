"""Queries of retrieval, text metrics, scalar functions and clustering, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import scalars as X
from ..model import SQL
from ..operators import faces as C
from ..operators import retrieve as R
from ..operators import store as S
from ..session import cut
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


# ---- Text ------------------------------------------------------------------------------------------------------

_SRC = """with f as (select path, max(decode(content)) as t from source_files s join (select path, max(modification_time) as modification_time from source_files group by 1) using (path, modification_time) group by 1),
 src as (select path, t, case lower(regexp_extract(path, '(\\.[^./]*)$', 1)) when '.go' then 'go' when '.py' then 'python' when '.ts' then 'typescript' when '.js' then 'javascript' when '.java' then 'java' when '.rs' then 'rust' when '.cs' then 'csharp' when '.rb' then 'ruby' else '' end as lang from f)"""


def _sources(g):
    """Newest version of every file as text with its language by suffix."""
    f = g.table("source_files").groupBy("path").agg(F.max(F.struct("modification_time", F.col("content").cast("string").alias("t"))).alias("x"))
    return f.select("path", F.col("x.t").alias("t"), X.infer_language(F.col("path")).alias("lang"))


_W = lambda w: f"len(regexp_extract_all(t, '\\b{w}\\b'))" if w[0].isalpha() else f"len(regexp_extract_all(t, '{''.join(chr(92) + c for c in w)}'))"
query("a26_complexity", f""" select path, case lang {' '.join(f"when '{k}' then 1 + " + ' + '.join(_W(w) for w in v.split()) for k, v in M.BRANCHES.items())} else 1 end as complexity from src""", _SRC)(
    lambda g: _sources(g).select("path", M.complexity(F.col("t"), F.col("lang")).cast("long").alias("complexity")))
query("a28_markers", " select path, len(regexp_extract_all(t, '(?i)\\bTODO\\b')) as todo_count, len(regexp_extract_all(t, '(?i)\\bFIXME\\b')) as fixme_count, len(regexp_extract_all(t, '(?i)\\bHACK\\b')) as hack_count from src", _SRC)(
    lambda g: _sources(g).select("path", *[c.cast("long").alias(n) for n, c in zip(("todo_count", "fixme_count", "hack_count"), M.markers(F.col("t")))]))
_TRIM = "trim(regexp_replace(l, '[\\t\\r\\f\\v]', ' ', 'g'))"
query("a27_lines", f""", li as (select path, lang, unnest(string_split(case when t like '%\n' then t[:-2] else t end, chr(10))) as l, generate_subscripts(string_split(case when t like '%\n' then t[:-2] else t end, chr(10)), 1) as i from src),
 p as (select path, lang, i, {_TRIM} as l from li where not (l is null)),
 rec as (select path, total, blank from (select path, count(*) as total, count(*) filter (l = '') as blank from p group by 1)) select path, cast(total as int) as total, cast(blank as int) as blank from rec""", _SRC)(
    lambda g: _sources(g).select("path", M.lines_of_code(F.col("t"), F.col("lang")).alias("m")).select("path", "m.total", "m.blank"))
_LOC = f""", li as (select path, lang, unnest(string_split(case when t like '%\n' then t[:-2] else t end, chr(10))) as l, generate_subscripts(string_split(case when t like '%\n' then t[:-2] else t end, chr(10)), 1) as i from src),
 p as (select path, lang, i, {_TRIM} as l from li where not (l is null)),
 fl as (select *, case lang when 'python' then starts_with(l, '\"\"\"') or starts_with(l, chr(39) || chr(39) || chr(39)) when 'html' then starts_with(l, '<!--') else starts_with(l, '/*') end as st,
   case lang when 'python' then ends_with(l, '\"\"\"') or ends_with(l, chr(39) || chr(39) || chr(39)) when 'html' then contains(l, '-->') else contains(l, '*/') end as en,
   case lang when 'python' then (ends_with(l, '\"\"\"') or ends_with(l, chr(39) || chr(39) || chr(39))) and length(l) > 3 when 'html' then ends_with(l, '-->') else ends_with(l, '*/') end as es,
   case when lang in ('go','java','typescript','javascript') then starts_with(l, '//') when lang = 'python' then starts_with(l, '#') when lang = 'html' then false else starts_with(l, '//') or starts_with(l, '#') end as one from p),
 rec as (select path, 1 as i, false as was, false as cm from src union all
   select fl.path, fl.i + 1, case when l = '' then was when was then not en when st then not es else false end, l <> '' and (was or st or one) from rec join fl on fl.path = rec.path and fl.i = rec.i),
 loc as (select fl.path, count(*) as total, count(*) filter (fl.l = '') as blank, any_value(k.n) as comment from fl join (select path, count(*) filter (cm) as n from rec group by 1) k on k.path = fl.path group by 1)"""
_RSRC = _SRC.replace("with f as", "with recursive f as", 1)
query("a27_lines_of_code", _LOC + " select path, cast(total as int) as total, cast(blank as int) as blank, cast(comment as int) as comment, cast(total - blank - comment as int) as code from loc", _RSRC)(lambda g: _sources(g).select("path", M.lines_of_code(F.col("t"), F.col("lang")).alias("m")).select("path", "m.*"))
_CC = f"case lang {' '.join(f"when '{k}' then 1 + " + ' + '.join(_W(w) for w in v.split()) for k, v in M.BRANCHES.items())} else 1 end"
query("a29_all_metrics", _LOC + f""" select path, 'cyclomatic_complexity' as metric, cast({_CC} as double) as value from src union all select path, 'lines_of_code', total from loc union all select path, 'blank_lines', blank from loc
 union all select path, 'comment_lines', comment from loc union all select path, 'code_lines', total - blank - comment from loc union all select path, 'todo_count', len(regexp_extract_all(t, '(?i)\\bTODO\\b')) from src
 union all select path, 'fixme_count', len(regexp_extract_all(t, '(?i)\\bFIXME\\b')) from src union all select path, 'hack_count', len(regexp_extract_all(t, '(?i)\\bHACK\\b')) from src""", _RSRC)(lambda g: _sources(g).select("path", M.all_metrics(F.col("t"), F.col("lang")).alias("m")).select("path", F.explode("m").alias("metric", "value")))

# Chunks by recursion: each step cuts one chunk off; offsets are in bytes, so the oracle covers ASCII texts exactly.
query("v01_chunks")(lambda g: R.chunks(g.table("documents"), "doc_id", "text"))
query("v01_chunk_counts_ascii", """with recursive d as (select doc_id, text as t, length(text) as n from documents where text is not null and strlen(text) = length(text)),
 c as (select doc_id, t, n, 0 as k, 0 as pos, cast(null as bigint) as cut from d
  union all select doc_id, t, n, k + 1, case when nxt - 200 > pos then nxt - 200 else nxt end, nxt from (select *, case when pos + 1500 >= n then n
    else pos + 1200 + coalesce(nullif(300 - strpos(reverse(substr(t, pos + 1201, 300)), chr(10) || chr(10)) + 1, 301), nullif(300 - strpos(reverse(substr(t, pos + 1201, 300)), chr(10)) + 1, 301),
      nullif(300 - strpos(reverse(substr(t, pos + 1201, 300)), ' .') + 1, 301), nullif(300 - strpos(reverse(substr(t, pos + 1201, 300)), ' ') + 1, 301), 300) end as nxt from c where cut is null or cut < n)),
 e as (select doc_id, n, max(k) as chunks, max(cut) filter (cut < n) as lastcut from c where k > 0 group by 1, 2)
 select doc_id, cast(case when n <= 1500 then 1 when n - (lastcut - 200) < 100 then chunks - 1 else chunks end as bigint) as chunks from e""")(
    lambda g: R.chunks(g.table("documents").where(F.octet_length("text") == F.length("text")), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("chunks")))
query("v02_embeddable_text", """ select id, name || case when package <> '' then chr(10) || 'Package: ' || package else '' end || case when file_path <> '' then chr(10) || 'File: ' || file_path else '' end
 || case when qualified_name <> '' and qualified_name <> name then chr(10) || 'Qualified: ' || qualified_name else '' end || case when coalesce(properties['architectural_role'], '') <> '' then chr(10) || 'Role: ' || properties['architectural_role'] else '' end
 || case when doc_comment <> '' then chr(10) || doc_comment else '' end || case when signature <> '' then chr(10) || signature else '' end as text
 from M where (doc_comment <> '' or signature <> '') and type in ('Function','Method','Class','Struct','Interface','Document','APIEndpoint','Service','DBModel','AIGuideline','Directory','Topic','Person')""", SQL)(lambda g: R.node_texts(g.mn))
query("v03_index")(lambda g: R.embed(R.chunks(R.node_texts(g.mn), "id", "text"), "chunk_text", prefix="search_document: "))

# ---- Vectors: every twentieth row is a query against all rows --------------------------------------------------------

query("v04_knn", """with e as (select vec_id, embedding::double[] as v from embeddings), s as (select q.vec_id as query, e.vec_id as id, list_cosine_similarity(q.v, e.v) as score from e q, e where q.vec_id % 20 = 0),
 r as (select *, row_number() over (partition by query order by round(score, 12) desc, id) as rank from s) select query, id, round(score, 6) as score, cast(rank as int) as rank from r where rank <= 10""")(
    lambda g: (lambda e: R.knn(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10))(g.table("embeddings")).withColumn("score", F.round("score", 6)))
query("x22_cosine", """select a.vec_id as id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")(
    lambda g: (lambda e: e.alias("a").join(e.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1).select(F.col("a.vec_id").alias("id"), F.round(X.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("cosine")))(g.table("embeddings")))

_Q = "how does the ledger snapshot store merge"
_KW = """, kw as (select id, sum(hit) as matches from (select id, (contains(name, w) and not contains(name, '/') or contains(name, upper(w[1]) || w[2:]) and not contains(name, '/') or package = w)::int as hit
  from M, (select unnest(['ledger','snapshot','store','merge']) as w) where type in ('Function','Method','Class','Struct','Interface','Document','APIEndpoint','Service','DBModel','AIGuideline','Directory','Topic','Person')) group by 1 having sum(hit) > 0)"""
query("v05_keywords", _KW + " select id, cast(matches as int) as matches from kw", SQL)(lambda g: R.keyword_hits(g.mn, X.keywords(_Q)))
_DEG = """, dd as (select source_id as id, id as eid from ME union select target_id, id from ME), deg as (select id, count(*) as degree from dd group by 1),
 vec as (select id, round(((('0x' || substr(sha256(id), 1, 6))::bigint) % 1000) / 1000.0, 3) as score from M where type = 'Method')"""
_RR = _KW + _DEG + """, cand as (select coalesce(vec.id, kw.id) as id, coalesce(vec.score, 0) as vector, coalesce(kw.matches, 0) as matches from vec full join kw on kw.id = vec.id),
 j as (select cand.*, M.type, coalesce(deg.degree, 0) as degree from cand join M using (id) left join deg using (id)),
 sc as (select *, round(0.55 * case when vector = 0 and matches > 0 then 0.5 * matches / 4.0 else vector end + 0.20 * matches / 4.0 + 0.10 * (type in ('Function','Method','Struct','Class','Interface','Enum','Type','APIEndpoint','TestFunction'))::int + 0.15 * degree / greatest(max(degree) over (), 1), 9) as score from j)"""


def _vector_scores(g):
    """A stated vector score per method, from its id, in place of an embedding service."""
    return g.mn.where("type = 'Method'").select("id", F.round((F.conv(F.substring(F.sha2("id", 256), 1, 6), 16, 10).cast("long") % 1000) / 1000.0, 3).alias("score"))


query("v08_rerank", _RR + " select id, vector, cast(matches as int) as matches, degree, score, cast(row_number() over (order by score desc, id) as int) as rank from sc", SQL)(
    lambda g: R.rerank(_vector_scores(g), g.mn, g.me, R.keyword_hits(g.mn, X.keywords(_Q)), 4))
query("v08_search", _RR + " select id, vector, cast(matches as int) as matches, degree, score, cast(row_number() over (order by score desc, id) as int) as rank from sc order by score desc, id limit 15", SQL)(
    lambda g: R.search(g.mn, g.me, _vector_scores(g), _Q))
query("j28_one_hop", """, D as (select source_id as node_id, target_id as peer_id, 'out' as direction, id as edge_id, type as edge_type from ME union all select target_id, source_id, 'in', id, type from ME where source_id <> target_id),
 x as (select D.*, p.name as peer_name, row_number() over (partition by node_id, edge_type order by peer_id, direction, edge_id) as place from D join M p on p.id = D.peer_id where node_id in (select id from M where type = 'Method') and edge_type in ('Calls','Implements','Imports','DependsOn','Tests','Documents'))
 select node_id, edge_type, direction, peer_id, peer_name, cast(place as int) as place from x where place <= 5""", SQL)(lambda g: R.one_hop(g.mn, g.me, g.mn.where("type = 'Method'").select(F.col("id").alias("node_id"))))
query("p05_rag_rows", " select query_id, result_id, cast(round(score * 100) as int) as relevance, cast(row_number() over (partition by query_id order by score desc, result_id) as int) as place from (select distinct query_id, result_id, score from rag_results where score is not null)")(
    lambda g: R.rag_rows(g.table("rag_results")))
query("f14_rag_filters", """ select distinct result_id from rag_results where type in ('Function','Method','Document') and contains(lower(package), 'l') and lower(language) = 'go' and score >= 0.3 and type not in ('Document','AIGuideline')""")(
    lambda g: R.rag_filters(g.table("rag_results"), ["Function", "Method", "Document"], "L", "Go", True, 0.3).select("result_id").distinct())
query("w05_ranks", " select result_id, round(s, 6) as score, cast(row_number() over (order by s desc, result_id) as int) as rank from (select result_id, max(score) as s from rag_results where score is not null group by 1)")(
    lambda g: R.ranked(g.table("rag_results").where("score is not null").groupBy("result_id").agg(F.max("score").alias("score")).withColumnRenamed("result_id", "id")).select(F.col("id").alias("result_id"), F.round("score", 6).alias("score"), "rank"))

query("v06_best_chunk", "select query_id as node_id, max(score) as score, min(rank) filter (score = m) as chunk_index from (select *, max(score) over (partition by query_id) as m from rag_results where score is not null) group by 1")(
    lambda g: R.best_chunk(g.table("rag_results").where("score is not null").select(F.col("query_id").alias("node_id"), "score", F.col("rank").alias("chunk_index"))))
query("v08_ask")(lambda g: R.ask(g.mn, g.me, R.embed(R.chunks(R.node_texts(g.mn), "id", "text"), "chunk_text", prefix="search_document: "), _Q, types=["Function", "Method"]))
query("v10_semantic_context", _DEG + """, best as (select * from vec order by score desc, id limit 20),
 txt as (select id, substr(name || case when package <> '' then chr(10) || 'Package: ' || package else '' end || case when file_path <> '' then chr(10) || 'File: ' || file_path else '' end
 || case when qualified_name <> '' and qualified_name <> name then chr(10) || 'Qualified: ' || qualified_name else '' end || case when coalesce(properties['architectural_role'], '') <> '' then chr(10) || 'Role: ' || properties['architectural_role'] else '' end
 || case when doc_comment <> '' then chr(10) || doc_comment else '' end || case when signature <> '' then chr(10) || signature else '' end, 1, 800) as text from M where doc_comment <> '' or signature <> ''),
 D as (select source_id as node_id, target_id as peer_id, id as edge_id, type as edge_type from ME union all select target_id, source_id, id, type from ME where source_id <> target_id),
 x as (select node_id, row_number() over (partition by node_id, edge_type order by peer_id, edge_id) as place from D join M p on p.id = D.peer_id where node_id in (select id from best) and edge_type in ('Calls','Implements','Imports','DependsOn','Tests','Documents'))
 select best.id, score, text, coalesce(k.n, 0) as links from best join txt using (id) left join (select node_id, count(*) as n from x where place <= 5 group by 1) k on k.node_id = best.id""", SQL)(lambda g: R.semantic_context(g.mn, g.me, _vector_scores(g)))
query("x20_question_entities", """with w as (select doc_id, list_transform(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: regexp_replace(w, '^["''`(]+|["''`),.?!:;]+$', '', 'g')) as l from documents where text is not null)
 select doc_id, coalesce(list_filter(l, lambda w: regexp_matches(w, '^[\\w./-]+\\.[A-Za-z]{1,5}$'))[1], list_filter(l, lambda w: regexp_matches(w, '^[A-Za-z_]\\w*$') and (regexp_matches(w, '[a-z][A-Z]') or contains(w, '_')))[1], '') as entity from w""")(lambda g: g.table("documents").where("text is not null").select("doc_id", X.entity_in_question(F.col("text")).alias("entity")))
query("x25_diff_files", "select distinct path from source_files")(
    lambda g: g.table("source_files").select(F.explode(X.diff_files(F.concat(F.lit("--- a/x\n+++ b/"), "path", F.lit("\n@@ -1 +1 @@\n")))).alias("path")).distinct())

# ---- Scalars over the tables -----------------------------------------------------------------------------------------------

_TOP = "case when file_path = '' then '' when not contains(file_path, '/') or starts_with(file_path, '/') then '(root)' else split_part(file_path, '/', 1) end"
query("x01_paths", f" select id, {_TOP} as top, case when not contains(file_path, '/') then '.' when regexp_replace(file_path, '/[^/]*$', '') = '' then '/' else regexp_replace(file_path, '/[^/]*$', '') end as dir, regexp_extract(file_path, '([^/]*)$', 1) as base, lower(regexp_extract(file_path, '(\\.[^./]*)$', 1)) as ext from M", SQL)(
    lambda g: g.mn.select("id", X.top_dir(F.col("file_path")).alias("top"), X.dir_name(F.col("file_path")).alias("dir"), X.base_name(F.col("file_path")).alias("base"), X.extension(F.col("file_path")).alias("ext")))
query("x03_urls", """ select id, regexp_replace(case when starts_with(rtrim(lower(p), '/'), '/') then rtrim(lower(p), '/') else '/' || rtrim(lower(p), '/') end, '\\{[^}]+\\}|:[a-z_][a-z0-9_]*|<[^>]+>', '*', 'g') as url,
 case when starts_with(regexp_replace(p, '/+', '/', 'g'), '/') then regexp_replace(p, '/+', '/', 'g') else '/' || regexp_replace(p, '/+', '/', 'g') end as path from (select id, properties['path'] as p from M where type = 'APIEndpoint' and properties['path'] is not null)""", SQL)(
    lambda g: g.mn.where("type = 'APIEndpoint' and properties['path'] is not null").select("id", X.normalize_url(F.element_at("properties", "path")).alias("url"), X.normalize_path(F.element_at("properties", "path")).alias("path")))
query("x05_python_names", " select distinct name, lower(replace(name, '-', '_')) as norm from M where type = 'Dependency'", SQL)(lambda g: g.mn.where("type = 'Dependency'").select("name", X.normalize_python(F.col("name")).alias("norm")).distinct())
query("x11_comma_split", " select id, trim(unnest(string_split(properties['methods'], ','))) as method from M where coalesce(properties['methods'], '') <> ''", SQL)(
    lambda g: g.mn.select("id", F.explode(X.comma_split(F.element_at("properties", "methods"))).alias("method")))
query("x12_immediate_dir", " select id, case when len(string_split(file_path, '/')) >= 2 then string_split(file_path, '/')[-2] else package end as dir from M", SQL)(lambda g: g.mn.select("id", X.immediate_dir(F.col("file_path"), F.col("package")).alias("dir")))
query("x13_topics", " select id, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) as topic from M where type = 'Topic'", SQL)(lambda g: g.mn.where("type = 'Topic'").select("id", X.normalize_topic(F.col("name")).alias("topic")))
query("x16_content_hash", " select distinct path, sha256(content) as hash from source_files")(lambda g: g.table("source_files").select("path", F.sha2("content", 256).alias("hash")).distinct())
query("x18_truncate", " select id, case when length(doc_comment) > 40 then doc_comment[1:40] || '...' else doc_comment end as doc from M", SQL)(lambda g: g.mn.select("id", X.truncate(F.col("doc_comment"), 40).alias("doc")))
query("x19_snippet", """with k as (select result_id, list_filter(list_transform(string_split(chunk_text, chr(10)), lambda x: regexp_replace(x, '^ +| +$', '', 'g')), lambda x: x <> '' and not starts_with(x, '```')) as l from rag_results where chunk_text is not null),
 s as (select result_id, coalesce(array_to_string(l[1:3], ' | '), '') as s from k) select distinct result_id, case when length(s) > 200 then substr(s, 1, 200) || '...' else s end as snippet from s""")(lambda g: g.table("rag_results").where("chunk_text is not null").select("result_id", X.snippet(F.col("chunk_text")).alias("snippet")).distinct())
query("p11_directories", """ , d as (select distinct file_path as p from M where type in ('File','TestFile') and contains(file_path, '/')), k as (select p, string_split(p, '/') as s from d), u as (select unnest(range(1, len(s))) as n, s from k)
 select distinct array_to_string(s[1:n], '/') as dir, case when n > 1 then array_to_string(s[1:n-1], '/') else '' end as parent from u""", SQL)(
    lambda g: g.mn.where("type in ('File', 'TestFile') and contains(file_path, '/')").select(F.split("file_path", "/").alias("s")).select(F.explode(F.sequence(F.lit(1), F.size("s") - 1)).alias("n"), "s").select(
        F.array_join(F.slice("s", 1, F.col("n")), "/").alias("dir"), F.when(F.col("n") > 1, F.array_join(F.slice("s", 1, F.greatest(F.col("n") - 1, F.lit(1))), "/")).otherwise("").alias("parent")).distinct())
query("p12_topic_nodes", " select distinct substr(sha256('Topic::' || trim(regexp_replace(lower(name), '\\s+', ' ', 'g'))), 1, 24) as id, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) as topic from M where type = 'Topic'", SQL)(
    lambda g: g.mn.where("type = 'Topic'").select(X.normalize_topic(F.col("name")).alias("topic")).distinct().select(S.node_id("Topic", "", F.col("topic")).alias("id"), "topic"))

# ---- Clustering: of all valid faces, in runs that no similar pair crosses ----------------------------------------------------------


def _faces(g):
    """Valid faces, whatever cluster they had."""
    f = g.table("face_records").where("size(embedding) = 128")
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return f.where(ok).select(F.col("face_id").alias("id"), F.col("image_path").alias("image"), "embedding", F.col("cluster_id").alias("cluster"))


def _clustered(g):
    """Valid faces of the record's earlier clusters."""
    return _faces(g).where("cluster > 0")


def _absorbed(f):
    labels = cut(C.cluster_whole(f, "average", 0.6, 2, reach=0.5))
    return C.absorb_noise(f, labels, 0.5).join(labels.select("run", "id"), "id").select("run", "id", "cluster")


query("l01_average_linkage")(lambda g: C.cluster_whole(_faces(g), "average", 0.3, 2))
query("l03_dbscan")(lambda g: C.cluster_whole(_faces(g), "dbscan", 0.75, 2))
query("l02_absorb_noise")(lambda g: _absorbed(_faces(g)))
query("l06_suggest_merges", """with f as (select face_id, cluster_id as c, embedding::double[] as v from face_records where len(embedding) = 128 and cluster_id > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 u as (select c, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) as v from f), e as (select c, unnest(v) as x, generate_subscripts(v, 1) as i from u), m as (select c, i, avg(x) as x from e group by 1, 2)
 select a.c as a, b.c as b, round(sum(a.x * b.x), 6) as avg from m a join m b on a.i = b.i and a.c < b.c group by 1, 2 having sum(a.x * b.x) > 0.2""")(
    lambda g: (lambda f: C.suggest_merges(f, f.select("id", "cluster")))(_clustered(g)).withColumn("avg", F.round("avg", 6)))
query("a24_pair_similarity", """with f as (select face_id, cluster_id as c, embedding::double[] as v from face_records where len(embedding) = 128 and cluster_id > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 u as (select c, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) as v from f), e as (select c, unnest(v) as x, generate_subscripts(v, 1) as i from u), m as (select c, i, avg(x) as x from e group by 1, 2),
 p as (select a.c as a, b.c as b, sum(a.x * b.x) as s from m a join m b on a.i = b.i and a.c < b.c group by 1, 2 having sum(a.x * b.x) > 0.3)
 select p.a, p.b, round(any_value(s), 6) as avg, round(max(list_inner_product(x.v, y.v)), 6) as max from p join u x on x.c = p.a join u y on y.c = p.b group by 1, 2""")(
    lambda g: (lambda f, l: C.greatest_similarity(f, l, cut(C.suggest_merges(f, l, 0.3))).select("a", "b", F.round("avg", 6).alias("avg"), F.round("max", 6).alias("max")))(*(lambda f: (f, f.select("id", "cluster")))(_clustered(g))))
query("a23_cluster_sizes", "select cluster_id as cluster, count(*) as size from face_records where cluster_id > 0 group by 1")(lambda g: C.cluster_sizes(g.table("face_records").select(F.col("cluster_id").alias("cluster"))))
query("l04_merge", "select face_id as id, case when cluster_id in (2, 3) then 1 else cluster_id end as cluster from face_records where cluster_id is not null")(
    lambda g: C.merge_clusters(g.table("face_records").where("cluster_id is not null").select(F.col("face_id").alias("id"), F.col("cluster_id").alias("cluster")), g.spark.createDataFrame([(2, "two")], "cluster int, name string"), [2, 3], 1)[0])
query("l05_split")(lambda g: (lambda f: C.split_cluster(f, f.select("id", "cluster"), 1, 0.75))(_clustered(g)))
query("l08_suppression", """with recursive b as (select image_path as image, face_idx as idx, {'a': bbox.min_x::bigint, 'b': bbox.min_y::bigint, 'c': bbox.max_x::bigint, 'd': bbox.max_y::bigint} as x, row_number() over (partition by image_path order by confidence desc, face_idx) as r
   from face_records where bbox.min_x is not null and confidence is not null),
 step as (select image, 0 as r, [x][1:0] as kept, -1 as idx, false as ok from b where r = 1 union all
  select image, r, case when ok then list_append(kept, x) else kept end, idx, ok from (select b.image, b.r, kept, x, b.idx, len(list_filter(kept, lambda k: greatest(0, least(x.c, k.c) - greatest(x.a, k.a)) * greatest(0, least(x.d, k.d) - greatest(x.b, k.b)) >
    0.3 * greatest(greatest(0, x.c - x.a) * greatest(0, x.d - x.b) + greatest(0, k.c - k.a) * greatest(0, k.d - k.b) - greatest(0, least(x.c, k.c) - greatest(x.a, k.a)) * greatest(0, least(x.d, k.d) - greatest(x.b, k.b)), 1e-9))) = 0 as ok
   from step join b on b.image = step.image and b.r = step.r + 1))
 select image, idx from step where ok""")(lambda g: C.suppress(g.table("face_records").select(F.col("image_path").alias("image"), F.col("face_idx").alias("idx"), "confidence", "bbox.*")))
query("p15_appearances", "select distinct 'person ' || cluster_id as person, image_path as image from face_records where cluster_id > 0")(
    lambda g: (lambda f: C.appearances(f.select("id", "image"), f.select("id", "cluster"), f.select("cluster", F.concat(F.lit("person "), F.col("cluster").cast("string")).alias("name")).distinct()))(
        g.table("face_records").where("cluster_id > 0").select(F.col("face_id").alias("id"), F.col("image_path").alias("image"), F.col("cluster_id").alias("cluster"))))
