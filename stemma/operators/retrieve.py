"""Retrieval: chunks, embeddings by pluggable providers, exact nearest neighbours, keyword search and reranking.

Vectors are compared in blocks: a query set is small and stated, so it is broadcast behind a size check, and every
partition of chunks keeps only its best rows per query before anything is shuffled."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..session import ship
from .store import CODE_TYPES, EMBEDDABLE, centrality, directed, glob

MAX_QUERY_BYTES = 64 << 20


def chunk_bounds(data: bytes, size: int = 1500, overlap: int = 200, least: int = 100) -> list[tuple[int, int]]:
    """(from, to) of the chunks: at most size bytes, cut in the last fifth after a blank line, else a line, a sentence,
    a blank, else hard; the next one starts overlap bytes before. A tail below `least` joins its predecessor."""
    if len(data) <= size:
        return [(0, len(data))]
    out, at = [], 0
    while at < len(data):
        end = at + size
        if end >= len(data):
            if out and len(data) - at < least:
                out[-1] = (out[-1][0], out[-1][1], at)
            else:
                out.append((at, len(data)))
            break
        low = max(at, end - size // 5)
        cut = end
        for mark in (b"\n\n", b"\n", b". ", b" "):
            k = data.rfind(mark, low, end)
            if k >= 0:
                cut = k + len(mark)
                break
        out.append((at, cut))
        at = cut - overlap if cut - overlap > at else cut
    return out


def chunk_texts(text: str, size: int = 1500, overlap: int = 200, least: int = 100) -> list[str]:
    data = text.encode("utf-8", "replace")
    # A small tail is appended whole, so the bytes it shares with its predecessor come twice.
    return [(data[b[0] : b[1]] + (data[b[2] :] if len(b) == 3 else b"")).decode("utf-8", "replace") for b in chunk_bounds(data, size, overlap, least)]


def chunks(rows: DataFrame, key: str, text: str, size: int = 1500, overlap: int = 200, least: int = 100) -> DataFrame:
    """(key, chunk_index, chunk_text). Null texts give no chunk, an empty text one empty chunk."""
    ship(rows.sparkSession)

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: chunk_texts(t, size, overlap, least))

    short = F.octet_length(text) <= size
    src = rows.where(F.col(text).isNotNull()).select(key, text)
    few = src.where(short).select(key, F.lit(0).alias("chunk_index"), F.col(text).alias("chunk_text"))  # stays in the JVM
    return few.unionByName(src.where(~short).select(key, F.posexplode(cut(F.col(text))).alias("chunk_index", "chunk_text")))


def node_texts(nodes: DataFrame) -> DataFrame:
    """(id, text) of all embeddable nodes that have something to embed."""
    return nodes.where(F.col("type").isin(EMBEDDABLE)).select("id", X.embeddable_text().alias("text")).where("text <> ''")


# ---- Embedding providers (B03) --------------------------------------------------------------------------------

_PROVIDERS: dict[str, Callable[[list[str]], np.ndarray]] = {}


def register_provider(name: str, embed: Callable[[list[str]], np.ndarray]) -> None:
    _PROVIDERS[name] = embed


def hash_embed(texts: list[str], dim: int = 32) -> np.ndarray:
    """Deterministic stand-in: code points over 1000 added up by byte offset, unit length."""
    out = np.zeros((len(texts), dim), np.float32)
    for r, t in enumerate(texts):
        at = 0
        for ch in t:
            out[r, at % dim] += ord(ch) / 1000.0
            at += len(ch.encode("utf-8", "replace"))
    n = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(n > 0, n, 1)


register_provider("hash", hash_embed)


def embed(rows: DataFrame, text: str, provider: str = "hash", prefix: str = "") -> DataFrame:
    """rows with a column embedding; prefix is put before every text (search_document: or search_query:)."""
    ship(rows.sparkSession)
    f = _PROVIDERS[provider]

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(f([prefix + (t or "") for t in s])))

    return rows.withColumn("embedding", run(F.col(text)))


def needs_reindex(meta: DataFrame, provider: str, model: str) -> bool:
    """Whether the index was built by another provider or model, or not at all."""
    row = meta.select("provider", "model").limit(1).collect()
    return not row or (row[0].provider, row[0].model) != (provider, model)


# ---- Nearest neighbours (V04, T07) ----------------------------------------------------------------------------------


def knn(rows: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int) -> DataFrame:
    """(query, id, score, rank): the k rows of highest cosine for every query, exact, ties to the smaller id.

    The queries are broadcast in slices of at most about MAX_QUERY_BYTES, one after the other; rows of another length, null
    or zero take no part."""
    ship(rows.sparkSession)
    size = queries.agg(F.sum(F.size(query_vector) * 8)).first()[0] or 0
    slices = max(1, -(-int(size) // MAX_QUERY_BYTES))
    part = F.pmod(F.xxhash64(F.col(query_key).cast("long")), F.lit(slices))
    found = [_knn_slice(rows, key, vector, queries.where(part == n) if slices > 1 else queries, query_key, query_vector, k) for n in range(slices)]
    w = Window.partitionBy("query").orderBy(F.round("score", 12).desc(), "id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _knn_slice(rows: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int) -> DataFrame:
    """(query, id, score): the k best rows of every partition for each query of a slice that fits the broadcast."""
    spark = rows.sparkSession
    q = queries.select(F.col(query_key).cast("long"), F.col(query_vector).cast("array<double>")).where(F.col(query_vector).isNotNull()).collect()
    shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in q])

    def best(frames):
        ids = np.array([i for i, v in shared.value if any(v)], np.int64)
        m = np.array([v for _, v in shared.value if any(v)], np.float64)
        if not len(ids):
            return
        m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
        for pdf in frames:
            ok = [v is not None and len(v) == m.shape[1] for v in pdf["v"]]
            pdf = pdf[ok]
            if pdf.empty:
                continue
            x = np.array(pdf["v"].tolist(), np.float64)
            n = np.sqrt((x * x).sum(axis=1))
            with np.errstate(invalid="ignore", divide="ignore"):
                s = np.where((n > 0) & np.isfinite(n), (m @ x.T) / n, -2.0)
            key_ids = pdf["id"].to_numpy()
            near = np.round(s, 12)
            least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -1.5)
            row, col = np.nonzero((near >= least[:, None]) & (near > -1.5))  # the k best and what ties with the last
            order = np.lexsort((key_ids[col], -near[row, col], row))
            row, col = row[order], col[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            yield pd.DataFrame({"query": ids[row[first]], "id": key_ids[col[first]], "score": s[row[first], col[first]]})

    return rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInPandas(best, "query long, id long, score double")


def best_chunk(hits: DataFrame) -> DataFrame:
    """Per node its best chunk, ties to the lower chunk index."""
    return hits.groupBy("node_id").agg(F.max_by(F.struct("score", "chunk_index"), F.struct(F.col("score"), -F.col("chunk_index"))).alias("b")).select("node_id", "b.score", "b.chunk_index")


# ---- Keywords and ranking (V05, V07, V08, A12, W05, W06) -------------------------------------------------------------------


def keyword_hits(nodes: DataFrame, words: list[str]) -> DataFrame:
    """(id, matches): how many of the keywords an embeddable node's name contains (as it is or capitalised) or its
    package equals."""
    one = lambda w: (glob(F.col("name"), f"*{w}*") | glob(F.col("name"), f"*{w[:1].upper() + w[1:]}*") | (F.col("package") == w)).cast("int")
    total = sum((one(w) for w in words[1:]), one(words[0])) if words else F.lit(0)
    return nodes.where(F.col("type").isin(EMBEDDABLE)).select("id", total.alias("matches")).where("matches > 0")


def rerank(hits: DataFrame, nodes: DataFrame, edges: DataFrame, keywords: DataFrame, total_keywords: int, limit: int | None = None) -> DataFrame:
    """hits(id, score) and keyword matches -> (id, vector, matches, degree, score, rank).

    0.55 vector + 0.20 share of keywords + 0.10 for code + 0.15 degree over the candidates' greatest degree; nodes
    found by keywords only count half their share as vector score."""
    both = hits.select("id", F.col("score").alias("vector")).join(keywords, "id", "full_outer").fillna(0.0, ["vector"]).fillna(0, ["matches"])
    cand = both.join(nodes.select("id", "type"), "id").join(centrality(edges), "id", "left").fillna(0, ["degree"])
    share = F.col("matches") / F.lit(float(max(total_keywords, 1)))
    vector = F.when((F.col("vector") == 0) & (F.col("matches") > 0), 0.5 * share).otherwise(F.col("vector"))
    most = F.greatest(F.coalesce(cand.agg(F.max("degree").alias("m")).scalar(), F.lit(1)), F.lit(1))  # over the candidates only
    score = 0.55 * vector + 0.20 * share + 0.10 * F.col("type").isin(CODE_TYPES).cast("double") + 0.15 * F.col("degree") / most
    out = cand.select("id", "vector", "matches", "degree", F.round(score, 9).alias("score"))
    if limit:
        top = out.orderBy(F.col("score").desc(), "id").limit(limit)  # at most `limit` rows to rank
        return top.select("id", "vector", "matches", "degree", "score", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")).alias("rank"))
    return ranked(out)


def ranked(scored: DataFrame, steps: int = 10_000) -> DataFrame:
    """scored(id, score from 0 to 1, ...) with its rank by score and id over all rows: rows are ranked within bands of the
    score, and a band begins where the better ones end. Only the bands' sizes are summed up in one task."""
    band = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")) * steps)
    rows = scored.withColumn("_band", band)
    sizes = rows.groupBy("_band").agg(F.count("*").alias("_k"))
    before = sizes.select("_band", (F.sum("_k").over(Window.orderBy(F.col("_band").desc())) - F.col("_k")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_band").orderBy(F.col("score").desc(), "id"))
    return rows.join(F.broadcast(before), "_band").withColumn("rank", (F.col("_before") + place).cast("int")).drop("_band", "_before")


def fetch_size(limit: int = 15, filtered: bool = False) -> int:
    """How many chunks a search fetches for its limit, so that enough nodes are left after merging and filtering."""
    return min(200, min(max(limit, 1), 30) * (10 if filtered else 5))


def tool_fetch_size(top_k: int = 15, filtered: bool = False) -> int:
    """The same for the tool: its own limit, three times as many (60 at most) where it filters by type."""
    k = min(max(top_k, 1), 30)
    return min(60, 3 * k) if filtered else k


DOCUMENT_TYPES = ["Document", "AIGuideline"]


def rag_filters(rows: DataFrame, types: list[str] | None = None, package: str = "", language: str = "", no_docs: bool = False, min_score: float = 0.0) -> DataFrame:
    """The rows(type, package, language, score) that pass the filters after a search; null never passes one."""
    ok = F.lit(True)
    if types:
        ok = ok & F.col("type").isin(types)
    if package:
        ok = ok & F.contains(F.lower("package"), F.lit(package.lower()))
    if language:
        ok = ok & (F.lower("language") == language.lower())
    if no_docs:
        ok = ok & ~F.col("type").isin(DOCUMENT_TYPES)
    if min_score > 0:
        ok = ok & (F.col("score") >= min_score)
    return rows.where(ok)


def rag_rows(hits: DataFrame, query: str = "query_id", result: str = "result_id") -> DataFrame:
    """A search's rows as they are shown: each (query, result, score) once, its relevance in percent and its place within
    the query by score and id. Rows without a score are left out."""
    one = hits.where("score is not null").select(query, result, "score").distinct()
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.col("score").desc(), result))
    return one.select(query, result, F.round(F.col("score") * 100).cast("int").alias("relevance"), place.alias("place"))


def ask(nodes: DataFrame, edges: DataFrame, index: DataFrame, question: str, limit: int = 15, provider: str = "hash", **filters) -> DataFrame:
    """From a question to ranked nodes: embed it as a query, fetch chunks of index(id, chunk_index, embedding), keep each
    node's best one, and search under the filters."""
    spark = nodes.sparkSession
    q = embed(spark.createDataFrame([(0, question)], "query long, text string"), "text", provider, "search_query: ")
    numbered = index.where("embedding is not null").select(F.xxhash64("id", "chunk_index").alias("chunk"), F.col("id").alias("node_id"), "chunk_index", "embedding")
    found = knn(numbered, "chunk", "embedding", q, "query", "embedding", fetch_size(limit, bool(filters.get("types")) or bool(filters.get("no_docs"))))
    best = best_chunk(found.select(F.col("id").alias("chunk"), "score").join(numbered.drop("embedding"), "chunk"))
    return search(nodes, edges, best.select(F.col("node_id").alias("id"), "score"), question, limit, **filters)


def search(nodes: DataFrame, edges: DataFrame, hits: DataFrame, question: str, limit: int = 15, types: list[str] | None = None, package: str = "", language: str = "", no_docs: bool = False, min_score: float = 0.0) -> DataFrame:
    """Hybrid search: filters after the top-k, keyword hits injected under the same filters, rerank, cut."""
    kept, words = rag_filters(nodes, types, package, language, no_docs), X.keywords(question)
    return rerank(hits, kept, edges, keyword_hits(kept, words), len(words), min(max(limit, 1), 30)).where(F.col("score") >= min_score)


def one_hop(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, per_type: int = 5) -> DataFrame:
    """Up to per_type edges of each type of every seed(node_id), by peer id."""
    kinds = ["Calls", "Implements", "Imports", "DependsOn", "Tests", "Documents"]
    links = directed(edges.where(F.col("type").isin(kinds))).join(seeds.select("node_id").distinct(), "node_id")
    named = links.join(nodes.select(F.col("id").alias("peer_id"), F.col("name").alias("peer_name")), "peer_id")
    w = Window.partitionBy("node_id", "edge_type").orderBy("peer_id", "direction", "edge_id")
    return named.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_type).select("node_id", "edge_type", "direction", "peer_id", "peer_name", F.col("r").alias("place"))


# ---- The stored index (K12, K13, V10) -----------------------------------------------------------------------------------


def save_index(chunks_with_vectors: DataFrame, path: str, provider: str, model: str, dim: int) -> None:
    """Writes the chunks and a one-row meta table with the counts and a version one above the stored one."""
    spark = chunks_with_vectors.sparkSession
    try:
        version = spark.read.json(f"{path}/meta").first().version + 1
    except Exception:  # noqa: BLE001 - no index yet
        version = 1
    chunks_with_vectors.write.mode("overwrite").parquet(f"{path}/chunks")
    n = spark.read.parquet(f"{path}/chunks").agg(F.count("*").alias("chunks"), F.count_distinct("id").alias("nodes"))
    n.select(F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.lit(dim).alias("dim"), "chunks", "nodes", F.lit(version).alias("version"), F.current_timestamp().alias("built_at")).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_index(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/chunks"), spark.read.json(f"{path}/meta")


def remove_nodes(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The index without the chunks of some nodes(id)."""
    return index.join(ids.select("id").distinct(), "id", "left_anti")


def semantic_context(nodes: DataFrame, edges: DataFrame, hits: DataFrame, top: int = 20, most: int = 800) -> DataFrame:
    """The best nodes with their text of at most `most` characters and how many neighbours they have."""
    best = hits.orderBy(F.col("score").desc(), "id").limit(top)
    near = one_hop(nodes, edges, best.select(F.col("id").alias("node_id"))).groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("links"))
    text = node_texts(nodes).select("id", F.substr("text", F.lit(1), F.lit(most)).alias("text"))
    return best.join(text, "id").join(near, "id", "left").fillna(0, ["links"])
