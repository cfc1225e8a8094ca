"""Document extraction results and their cache (B04): results keyed by content hash, also negative ones, and topic
and directory nodes made of them (P11-P13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..model import edge_id, node_id

RESULTS = "hash string, summary string, topics array<string>, entities array<string>, skipped boolean"


def to_process(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose content has no cached result (a skip counts as one); equal contents are processed once."""
    hashed = files.withColumn("hash", F.concat(F.lit("sha256:"), F.sha2("content", 256)))
    return hashed.join(cache.select("hash"), "hash", "left_anti").dropDuplicates(["hash"])


def topic_rows(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of results(doc_id, topics): topics are normalised and shared across documents, as their ids have no path."""
    each = results.select("doc_id", F.explode("topics").alias("t")).select("doc_id", X.normalize_topic(F.col("t")).alias("topic")).where("topic <> ''").distinct()
    nodes = each.select("topic").distinct().select(node_id("Topic", "", F.col("topic")).alias("id"), F.lit("Topic").alias("type"), F.col("topic").alias("name"))
    edges = each.select(edge_id("edge", F.col("doc_id"), F.concat(node_id("Topic", "", F.col("topic")), F.lit(":HasTopic"))).alias("id"), F.lit("HasTopic").alias("type"), F.col("doc_id").alias("source_id"), node_id("Topic", "", F.col("topic")).alias("target_id"))
    return nodes, edges


def directories(paths: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): every ancestor directory of the paths and its Contains edges, the last one to the document."""
    p = paths.select(F.col(path).alias("p")).where("p <> ''").distinct().withColumn("s", F.split("p", "/"))
    up = p.where(F.size("s") > 1).select("p", "s", F.explode(F.sequence(F.lit(1), F.size("s") - 1)).alias("n")).select("p", F.array_join(F.slice("s", 1, F.col("n")), "/").alias("dir"), F.size("s").alias("size"), "n", "s")
    did = lambda c: node_id("Directory", c, c)
    nodes = up.select("dir").distinct().select(did(F.col("dir")).alias("id"), F.lit("Directory").alias("type"), F.col("dir").alias("name"))
    child = F.when(F.col("n") == F.col("size") - 1, node_id("Document", F.col("p"), F.col("p"))).otherwise(did(F.array_join(F.slice("s", 1, F.col("n") + 1), "/")))
    e = up.select(did(F.col("dir")).alias("source_id"), child.alias("target_id")).distinct()
    return nodes, e.select(edge_id("Contains", F.col("source_id"), F.col("target_id")).alias("id"), F.lit("Contains").alias("type"), "source_id", "target_id")


def document_nodes(files: DataFrame) -> DataFrame:
    """Document nodes of files(path, content, length): id, package = directory, hash, mime type, kind and text of up to 1 MB."""
    from ..sources.files import file_class, mime_type

    p = F.col("path")
    text = F.when(file_class(p) == "text", F.decode("content", "UTF-8"))
    return files.select(
        node_id("Document", p, p).alias("id"), F.lit("Document").alias("type"), p.alias("name"), X.dir_name(p).alias("package"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("content_hash"),
        mime_type(p).alias("mime"), file_class(p).alias("kind"), F.col("length").alias("size"), text.alias("text"))
