"""Analysis queries: unused symbols, test coverage, package and architecture statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X


def unused(nodes: DataFrame, edges: DataFrame, types: tuple = ("Function", "Method"), include_exported: bool = False) -> DataFrame:
    """Callables that no Calls edge enters, without tests, init, main and (unless asked for) exported ones."""
    skip = (F.col("type") == "TestFunction") | X.is_test_function(F.col("name"), F.col("language"), F.col("file_path"), False) | F.col("name").isin("init", "main")
    if not include_exported:
        skip = skip | F.col("exported")
    pool = nodes.where(F.col("type").isin(*types) & ~skip)
    called = edges.where("type = 'Calls'").select(F.col("target_id").alias("id"))
    return pool.join(called, "id", "left_anti").select("id", "name", "type", "file_path", "line", "package", "language")


def coverage(nodes: DataFrame, edges: DataFrame, level: str = "function") -> DataFrame:
    """(id, name, type, file_path, line, package, language, covered): files, or functions and methods, that a Tests edge
    enters; test files and what lies in them are left out."""
    is_file = X.is_test_file(F.col("file_path"), F.col("language"), False)
    tests = nodes.where("type = 'TestFile'").select("file_path").distinct()
    if level == "file":
        pool = nodes.where((F.col("type") == "File") & ~is_file)
    else:
        pool = nodes.where(F.col("type").isin("Function", "Method") & ~is_file & ~X.is_test_function(F.col("name"), F.col("language"), F.col("file_path"), False))
    pool = pool.join(tests, "file_path", "left_anti")
    hit = edges.where("type = 'Tests'").select(F.col("target_id").alias("id"), F.lit(True).alias("hit")).distinct()
    return pool.join(hit, "id", "left").select("id", "name", "type", "file_path", "line", "package", "language", F.coalesce("hit", F.lit(False)).alias("covered"))


def package_coverage(covered: DataFrame) -> DataFrame:
    """(package, language, total, covered, percent); the language of the package's first row by path and id."""
    package = F.when(F.col("package") == "", "(unknown)").otherwise(F.col("package"))
    return covered.groupBy(package.alias("package")).agg(
        F.min_by("language", F.struct("file_path", "id")).alias("language"), F.count("*").alias("total"), F.sum(F.col("covered").cast("long")).alias("covered"),
        F.round(100.0 * F.avg(F.col("covered").cast("double")), 4).alias("percent"))


def coverage_rollup(covered: DataFrame) -> DataFrame:
    """Coverage per language and package with subtotals (null = all)."""
    return covered.rollup("language", "package").agg(F.count("*").alias("total"), F.sum(F.col("covered").cast("long")).alias("covered"))


def language_counts(nodes: DataFrame) -> DataFrame:
    return nodes.where("language <> ''").groupBy("language").agg(F.count("*").alias("n"))


def top_packages(nodes: DataFrame, n: int = 10) -> DataFrame:
    per = nodes.where("package <> ''").groupBy("package").agg(F.count("*").alias("n"))
    return per.orderBy(F.col("n").desc(), "package").limit(n)


def pattern_counts(classified: DataFrame) -> DataFrame:
    """Per design pattern: nodes and the first three names."""
    each = classified.where("patterns <> ''").select(F.explode(F.split("patterns", ",")).alias("pattern"), "name", "id")
    w = Window.partitionBy("pattern").orderBy("name", "id")
    some = each.withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("r", "name"))).alias("x"))
    return each.groupBy("pattern").agg(F.count("*").alias("n")).join(some, "pattern").select("pattern", "n", F.array_join(F.transform("x", lambda s: s["name"]), ",").alias("examples"))


def layer_roles(classified: DataFrame) -> DataFrame:
    return classified.where("layer <> '' or role <> ''").groupBy("layer", "role").agg(F.count("*").alias("n"))


def service_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per package: files, symbols, functions, types, endpoints and outgoing DependsOn edges."""
    base = nodes.where("package <> ''")
    n = base.groupBy("package").agg(
        F.count_distinct("file_path").alias("files"), F.count_if(F.col("type") != "File").alias("symbols"), F.count_if(F.col("type").isin("Function", "Method")).alias("callables"),
        F.count_if(F.col("type").isin("Class", "Struct", "Interface", "Enum", "Type")).alias("types"), F.count_if(F.col("type") == "APIEndpoint").alias("endpoints"))
    out = edges.where("type = 'DependsOn'").select(F.col("source_id").alias("id")).join(base.select("id", "package"), "id").groupBy("package").agg(F.count("*").alias("depends_on"))
    return n.join(out, "package", "left").fillna(0, ["depends_on"])


def models(classified: DataFrame) -> DataFrame:
    """(label, n, names): database, domain and transfer models (view models and DTOs together), names by name."""
    label = F.when(F.col("new_type") == "DBModel", "database").when(F.col("new_type") == "DomainModel", "domain").when(F.col("new_type").isin("ViewModel", "DTO"), "transfer")
    return classified.withColumn("label", label).where("label is not null").groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("package").alias("packages"))


def language_types(nodes: DataFrame) -> DataFrame:
    return nodes.where("language <> ''").groupBy("language", "type").agg(F.count("*").alias("n"))


def top_dirs(nodes: DataFrame) -> DataFrame:
    """Groups by first path component; a file at the root is a group of its own."""
    return nodes.where("file_path <> ''").groupBy(F.split_part("file_path", F.lit("/"), F.lit(1)).alias("dir")).agg(F.count_distinct("file_path").alias("files"), F.count("*").alias("nodes"))


def length_stats(docs: DataFrame, length: str) -> DataFrame:
    """(count, avg, p50, p90, max, total) of a length column; the percentiles are the values at floor(n * p) of the sorted
    lengths, counted up over the distinct lengths so that nothing is gathered."""
    per = docs.where(F.col(length).isNotNull()).groupBy(F.col(length).cast("long").alias("v")).agg(F.count("*").alias("k"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)  # over distinct lengths, not over rows
    run = per.withColumn("upto", F.sum("k").over(w)).withColumn("n", F.sum("k").over(Window.partitionBy()))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col("v")))
    return run.agg(
        F.sum("k").alias("count"), F.floor(F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("avg"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("v").alias("max"), F.sum(F.col("v") * F.col("k")).alias("total"))


SIZE_EDGES = [100, 500, 1000, 2000, 5000, 10000, 20000, 50000, 100000]


def size_histogram(docs: DataFrame, length: str) -> DataFrame:
    """(bucket, upto, n): ten buckets with inclusive upper edges, the last one open (null)."""
    b, upto = F.lit(len(SIZE_EDGES)), F.lit(None).cast("long")
    for i in reversed(range(len(SIZE_EDGES))):
        b = F.when(F.col(length) <= SIZE_EDGES[i], i).otherwise(b)
        upto = F.when(F.col(length) <= SIZE_EDGES[i], SIZE_EDGES[i]).otherwise(upto)
    return docs.where(F.col(length).isNotNull()).groupBy(b.alias("bucket"), upto.alias("upto")).agg(F.count("*").alias("n"))


def document_kinds(nodes: DataFrame) -> DataFrame:
    kind = F.coalesce(F.element_at("properties", "kind"), F.lit(""))
    return nodes.where("type = 'Document'").groupBy(F.when(kind == "", "(parsed)").otherwise(kind).alias("kind")).agg(F.count("*").alias("n"))


def largest_documents(docs: DataFrame, key: str, length: str, n: int = 20) -> DataFrame:
    return docs.select(key, length).orderBy(F.col(length).desc_nulls_last(), key).limit(n)


def symbols(nodes: DataFrame) -> DataFrame:
    """Everything but files, with location and line range, in the order of file and line."""
    return nodes.where("type <> 'File'").select("id", "name", "type", X.location(F.col("file_path"), F.col("line")).alias("location"), X.line_range(F.col("line"), F.col("end_line")).alias("lines"), "file_path", "line").orderBy("file_path", "line", "id").drop("file_path", "line")


def metric_rows(nodes: DataFrame) -> DataFrame:
    """(id, metric, value) of all nodes with metrics, rounded to two places."""
    return nodes.where("metrics is not null").select("id", F.explode("metrics").alias("metric", "value")).select("id", "metric", F.round("value", 2).alias("value"))


def summaries(nodes: DataFrame) -> DataFrame:
    """Generated summary documents, patterns last, then by name."""
    made = F.coalesce(F.element_at("properties", "generated"), F.lit("")) == "true"
    kind = F.coalesce(F.element_at("properties", "kind"), F.lit(""))
    return nodes.where((F.col("type") == "Document") & made).orderBy((kind == "patterns").cast("int"), "name")


def search_nodes(nodes: DataFrame, condition, n: int = 50) -> DataFrame:
    """The first n matches by file, line and id, with the number of all matches."""
    hits = nodes.where(condition)
    total = hits.agg(F.count("*").alias("total")).scalar()
    return hits.orderBy("file_path", "line", "id").limit(n).select("id", "name", "type", "file_path", "line", total.alias("total"))


def architecture_facets(classified: DataFrame, per_role: int = 5) -> DataFrame:
    """(role, n, packages, examples): nodes and packages per role and the first few names."""
    some = classified.where("role <> ''")
    w = Window.partitionBy("role").orderBy("name", "id")
    first = some.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_role).groupBy("role").agg(F.array_sort(F.collect_list(F.struct("r", "name"))).alias("x"))
    return some.groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("package").alias("packages")).join(first, "role").select("role", "n", "packages", F.array_join(F.transform("x", lambda s: s["name"]), ",").alias("examples"))


def cross_service(classified: DataFrame, packages: int = 30) -> DataFrame:
    """(kind, name, n) over all services: design patterns, roles and layers with their nodes, and the first packages by
    name with theirs."""
    each = lambda df, kind, name: df.groupBy(name.alias("name")).agg(F.count("*").alias("n")).where("name <> ''").select(F.lit(kind).alias("kind"), "name", "n")
    pattern = each(classified.select(F.explode(F.split("patterns", ",")).alias("p")).select(F.trim("p").alias("p")), "pattern", F.col("p"))
    named = each(classified, "package", F.col("package")).orderBy("name").limit(packages)
    return pattern.unionByName(each(classified, "role", F.col("role"))).unionByName(each(classified, "layer", F.col("layer"))).unionByName(named)
