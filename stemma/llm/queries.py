"""Queries and reference SQL of the problems tagged llm; production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from . import bpe, cluster, docs, generated, mix, mojibake, similar, split


def _groups(spark, d):
    return cluster.similarity_groups(table(spark, d, "face_records"), "face_id", "embedding")


def _p3_found(spark, d):
    g = _groups(spark, d)
    if g is None:
        return spark.createDataFrame([], "face_id long, first_face_id long")
    return g.select(F.col("id").alias("face_id"), F.col("group").alias("first_face_id"))


def _p3_described(by):
    def run(spark, d):
        g = _groups(spark, d)
        if g is None:
            return spark.createDataFrame([], f"`{by}` long, size long, typical array<long>")
        return cluster.describe(g, by)

    return run


def _p5_found(spark, d):
    p = similar.pairs(similar.nearest(table(spark, d, "face_records"), "face_id", "embedding"))
    return p.select(F.col("a").alias("face_id_a"), F.col("b").alias("face_id_b"))


def _pieces(spark, d):
    return split.split_items(table(spark, d, "rag_results"), "result_id", "chunk_text")


def _p6_found(spark, d):
    # A result above the limit is one that the operator cut: it has a second piece.
    return _pieces(spark, d).where("piece_no = 1").select(F.col("item").cast("long").alias("result_id"))


def _p6_pieces(spark, d):
    return _pieces(spark, d).select(F.col("item").cast("long").alias("result_id"), "piece_no", "n_pieces", "start", "end", "text")


def _p8_ids(spark, d):
    return bpe.encode_corpus(table(spark, d, "documents"))


QUERIES = {
    "p3_found": _p3_found,
    "p3_groups": _p3_described("group"),
    "p3_markov_clusters": _p3_described("cluster"),
    "p5_found": _p5_found,
    "p6_found": _p6_found,
    "p6_pieces": _p6_pieces,
    "p8_ids": _p8_ids,
}

ORACLE = {
    "p6_found": "select distinct result_id from rag_results where strlen(chunk_text) > 1500",
}


def _reasons(spark, d):
    return generated.file_reasons(table(spark, d, "source_files"), table(spark, d, "library_files"))


def _p1_report(spark, d):
    """Files per language as the graph states it (nodes.language of the newest File or TestFile row) and reason."""
    n = table(spark, d, "nodes").where(F.col("type").isin("File", "TestFile") & (F.col("branch") == "main"))
    said = n.groupBy("file_path").agg(F.max(F.struct("indexed_at", "language")).alias("n")).select(F.col("file_path").alias("path"), F.lower(F.coalesce("n.language", F.lit(""))).alias("language"))
    r = _reasons(spark, d).join(said, "path", "left")
    hand = ~(F.col("generated") | F.col("minified") | F.col("vendored") | F.col("data"))
    return r.groupBy(F.coalesce("language", F.lit("")).alias("language")).agg(
        F.count("*").alias("files"), F.count_if(hand).alias("hand_written"), *(F.count_if(c).alias(c) for c in ("generated", "minified", "vendored", "data")))


QUERIES |= {
    "p1_found": lambda s, d: generated.not_hand_written(_reasons(s, d)).select(F.col("path").alias("file_path")),
    "p1_report": _p1_report,
}


def _node_pairs(spark, d, code=True):
    return docs.node_pairs(table(spark, d, "nodes"), table(spark, d, "source_files"), code)


QUERIES |= {
    "p4_found": lambda s, d: _node_pairs(s, d, False).select("branch", "node_id"),
    "p4_pairs": _node_pairs,
    "p4_source_pairs": lambda s, d: docs.source_pairs(table(s, d, "source_files")),
}


def _mix(spark, d):
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


QUERIES |= {
    "p9_copies": lambda s, d: _mix(s, d)[0],
    "p9_shares": lambda s, d: _mix(s, d)[1],
}


def _garbled(spark, d):
    return mojibake.find_garbled(table(spark, d, "documents"))


QUERIES |= {
    "p10_found": lambda s, d: mojibake.garbled_ids(table(s, d, "documents")),
    "p10_restored": _garbled,
}
