"""Link phases: every phase is a join over the node table that yields edges.

All phases take the current nodes (one row per id, overlay applied) and return edges with the columns of EDGES; run in a
chain, the first two also change the nodes that the later ones read (created services, full paths of endpoints).
Where the semantics leave a choice open, the lowest id is taken."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..model import edge_id, node_id
from ..session import cut, drop_cut
from .orphans import BloomFilter

EDGES = ["id", "type", "source_id", "target_id", "kind"]


def prop(key: str) -> Column:
    return F.coalesce(F.element_at("properties", key), F.lit(""))


def _edges(pairs: DataFrame, edge_type: str, kind: str, distinct: bool = False) -> DataFrame:
    """pairs(source_id, target_id) as distinct edges of one kind; distinct: they are already, and aren't moved for it."""
    pairs = pairs.select("source_id", "target_id")
    return (pairs if distinct else pairs.distinct()).select(
        edge_id(edge_type, F.col("source_id"), F.col("target_id")).alias("id"), F.lit(edge_type).alias("type"), "source_id", "target_id", F.lit(kind).alias("kind"))


def _pick(rows: DataFrame, key: str, *order) -> DataFrame:
    """The first row per key; a window only over the candidates of one key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def substrings(rows: DataFrame, text: str, longest: int, out: str, keep: list[str]) -> DataFrame:
    """keep columns with every distinct substring of a text of 1 to `longest` characters as column out.

    Long texts are first cut into overlapping slices, so no row holds more than some (256 + 2 * longest) * longest
    substrings, however long a text is."""
    size = max(256, longest)
    at = F.sequence(F.lit(0), F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / size).cast("int"))
    slices = rows.where(F.length(text) > 0).select(*keep, F.explode(F.transform(at, lambda k: F.substr(text, k * size + 1, F.lit(size + longest)))).alias("_s"))
    ends = F.transform(F.sequence(F.lit(1), F.length("_s")), lambda a: F.transform(F.sequence(F.lit(1), F.least(F.length("_s") - a + 1, F.lit(longest))), lambda n: F.substr("_s", a, n)))
    return slices.select(*keep, F.explode(F.array_distinct(F.flatten(ends))).alias(out))


GRAM = 4


def contained(texts: DataFrame, text: str, names: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """keep columns of texts and name, for every distinct name that a text contains. Empty names are in no text.

    A name's key is one of its runs of GRAM characters (the whole name if it is shorter), the one that fewest texts hold;
    a text's keys are all of its runs of up to GRAM characters, so their number grows with its length only, however long
    the names are. What the keys bring together is checked."""
    rows = texts.select(*dict.fromkeys([*keep, text]))
    grams = substrings(rows, text, GRAM, "_gram", rows.columns).distinct()
    held = grams.groupBy("_gram").agg(F.count("*").alias("_held"))
    wanted = names.select(F.col(name).alias("_name")).where(F.length(name) > 0).distinct()
    offered = wanted.select("_name", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("_name") - GRAM + 1, F.lit(1))), lambda k: F.substr("_name", k, F.lit(GRAM))))).alias("_gram"))
    # A name with a run that no text holds is in none.
    rated = offered.join(held, "_gram", "left").groupBy("_name").agg(F.min_by("_gram", F.struct("_held", "_gram")).alias("_gram"), F.count_if(F.col("_held").isNull()).alias("_none"))
    met = grams.join(rated.where("_none = 0").select("_name", "_gram"), "_gram")
    return met.where(F.contains(F.col(text), F.col("_name"))).select(*keep, F.col("_name").alias(name)).distinct()


# ---- Phases 1 and 2: services, endpoints -------------------------------------------------------------------


def services(nodes: DataFrame) -> DataFrame:
    """(group, service_id, created): every top directory's service, the last one by id, or a new one where files
    have none."""
    groups = nodes.where("type in ('File', 'TestFile')").select(X.top_dir(F.col("file_path")).alias("group")).where("group <> ''").distinct()
    group = F.when(F.col("file_path") != "", X.top_dir(F.col("file_path"))).otherwise(F.col("name"))
    known = nodes.where("type = 'Service'").groupBy(group.alias("group")).agg(F.max("id").alias("known_id"))
    return groups.join(known, "group", "left").select(
        "group", F.coalesce("known_id", node_id("Service", F.col("group"), F.col("group"))).alias("service_id"), F.col("known_id").isNull().alias("created"))


def link_services(nodes: DataFrame) -> DataFrame:
    """Service contains File (phase 1)."""
    files = nodes.where("type in ('File', 'TestFile')").select(F.col("id").alias("target_id"), X.top_dir(F.col("file_path")).alias("group"))
    return _edges(files.join(services(nodes), "group").select(F.col("service_id").alias("source_id"), "target_id"), "Contains", "service_file")


def endpoint_paths(nodes: DataFrame) -> DataFrame:
    """(endpoint_id, full_path): an endpoint's path behind the prefix of the nearest directory above it that mounts
    a router. Ancestors are exploded, so the nearest-ancestor lookup is an equi-join."""
    mounts = nodes.where((F.col("type") == "Variable") & (prop("kind") == "router_mount")).select(X.dir_name(F.col("file_path")).alias("dir"), prop("prefix").alias("prefix"))
    mounts = mounts.groupBy("dir").agg(F.min("prefix").alias("prefix"))
    ends = nodes.where("type = 'APIEndpoint'").select(F.col("id").alias("endpoint_id"), prop("path").alias("path"), F.split(X.dir_name(F.col("file_path")), "/").alias("parts"))
    up = ends.select("endpoint_id", "path", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"), "parts").withColumn("dir", F.array_join(F.slice("parts", 1, F.col("depth")), "/"))
    best = up.join(mounts, "dir").groupBy("endpoint_id").agg(F.max_by("prefix", "depth").alias("prefix"))
    return ends.join(best, "endpoint_id", "left").select("endpoint_id", X.normalize_path(F.concat(F.coalesce("prefix", F.lit("")), F.lit("/"), "path")).alias("full_path"))


def link_endpoints(nodes: DataFrame) -> DataFrame:
    """Service exposes endpoint (phase 2), by top directory."""
    ends = nodes.where("type = 'APIEndpoint'").select(F.col("id").alias("target_id"), X.top_dir(F.col("file_path")).alias("group"))
    return _edges(ends.join(services(nodes), "group").select(F.col("service_id").alias("source_id"), "target_id"), "Exposes", "")


# ---- Phase 3: API calls ---------------------------------------------------------------------------------------


def _segment_keys(rows: DataFrame, path: str, keep: list[str], caller: bool) -> DataFrame:
    """(keep, path, n, k1, k2, k3): a literal meets its equal and the other side's wildcard, a wildcard everything; each
    match of two segments has exactly one key."""
    parts = F.split(path, "/")

    def keys(segment: Column) -> Column:
        # A caller's wildcard is looked for by the end's literals and wildcards under one key, and the other way round.
        mine, theirs = F.lit("*call"), F.lit("*end")
        if caller:
            return F.when(segment == "*", F.array(mine)).otherwise(F.array(F.concat(F.lit("="), segment), theirs))
        return F.when(segment == "*", F.array(theirs, mine)).otherwise(F.array(F.concat(F.lit("="), segment), mine))

    out = rows.select(*keep, path, F.size(parts).alias("n"), parts.alias("_s"))
    for k, at in (("k1", F.lit(2)), ("k2", F.lit(3)), ("k3", F.lit(-1))):
        out = out.withColumn(k, F.explode(keys(F.coalesce(F.try_element_at("_s", at), F.lit("")))))
    return out.drop("_s")


def match_calls(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """calls(call_id, path) and endpoints(endpoint_id, path) -> (call_id, endpoint_id, tier): exact path, then one path
    a suffix of the other, then equal segments with wildcards; lowest tier, then lowest endpoint id.

    Suffixes are exploded into join keys on either side. Wildcards are joined on the number of segments and, at the first,
    second and last one, the literal or a wildcard of the other side, so every match has one key and no tier compares all
    pairs of tables."""
    c = calls.select("call_id", X.normalize_url(F.col("path")).alias("p"))
    # Endpoints that share a path are one entry; the last one (highest id) stands for it.
    e = endpoints.groupBy(X.normalize_url(F.col("path")).alias("q")).agg(F.max("endpoint_id").alias("endpoint_id"))
    exact = c.join(e, F.col("p") == F.col("q")).select("call_id", "endpoint_id", F.lit(1).alias("tier"))
    tails = lambda col: F.transform(F.sequence(F.lit(1), F.length(col)), lambda i: F.substr(col, i))
    c_tail = c.select("call_id", "p", F.explode(tails(F.col("p"))).alias("k")).where("k like '/%'")
    e_tail = e.select("endpoint_id", "q", F.explode(tails(F.col("q"))).alias("k")).where("k like '/%'")
    suffix = c_tail.join(e, F.col("k") == F.col("q")).select("call_id", "endpoint_id").unionByName(c.join(e_tail, F.col("k") == F.col("p")).select("call_id", "endpoint_id"))
    wild = _segment_keys(c, "p", ["call_id"], True).join(_segment_keys(e, "q", ["endpoint_id"], False), ["n", "k1", "k2", "k3"])
    wild = wild.where(X.match_segments(F.col("p"), F.col("q"))).select("call_id", "endpoint_id")
    found = exact.unionByName(suffix.withColumn("tier", F.lit(2))).unionByName(wild.withColumn("tier", F.lit(3)))
    return found.groupBy("call_id").agg(F.min(F.struct("tier", "endpoint_id")).alias("m")).select("call_id", "m.endpoint_id", "m.tier")


def api_calls(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("type") == "Dependency") & (prop("kind") == "api_call")).select(F.col("id").alias("call_id"), prop("path").alias("path"), "file_path")


def link_api_calls(nodes: DataFrame) -> DataFrame:
    """Call consumes endpoint, and the caller's service depends on the endpoint's (phase 3)."""
    ends = nodes.where("type = 'APIEndpoint'").select(F.col("id").alias("endpoint_id"), F.when(prop("full_path") != "", prop("full_path")).otherwise(prop("path")).alias("path"), F.col("file_path").alias("end_path"))
    calls = api_calls(nodes)
    hits = match_calls(calls, ends)
    consumes = _edges(hits.select(F.col("call_id").alias("source_id"), F.col("endpoint_id").alias("target_id")), "Consumes", "")
    s = services(nodes)
    sides = hits.join(calls.select("call_id", X.top_dir(F.col("file_path")).alias("g1")), "call_id").join(ends.select("endpoint_id", X.top_dir(F.col("end_path")).alias("g2")), "endpoint_id")
    both = sides.where("g1 <> g2").select("g1", "g2").distinct()
    both = both.join(s.select(F.col("group").alias("g1"), F.col("service_id").alias("source_id")), "g1").join(s.select(F.col("group").alias("g2"), F.col("service_id").alias("target_id")), "g2")
    return consumes.unionByName(_edges(both, "DependsOn", "api_dependency"))


def unresolved_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """API calls that no Consumes edge touches."""
    touched = edges.where("type = 'Consumes'").select(F.explode(F.array("source_id", "target_id")).alias("call_id"))
    return api_calls(nodes).join(touched, "call_id", "left_anti")


# ---- Phases 4 and 5: manifests and imports ------------------------------------------------------------------------


def manifests(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("type") == "Dependency") & (prop("kind") == "manifest_dep")).select("id", "name", "file_path", prop("version").alias("version"))


def link_dependencies(nodes: DataFrame) -> DataFrame:
    """A service depends on the service that provides its manifest dependency, by name or go module (phase 4)."""
    s = services(nodes)
    owner = nodes.where("type = 'Service'").select(F.col("id").alias("target_id"), F.explode(F.array_distinct(F.array("name", prop("go_module")))).alias("name")).where("name <> ''")
    deps = manifests(nodes).withColumn("group", X.top_dir(F.col("file_path"))).join(s.select("group", F.col("service_id").alias("source_id")), "group")
    return _edges(deps.join(owner, "name").where("source_id <> target_id"), "DependsOn", "library_dependency")


def version_conflicts(nodes: DataFrame) -> DataFrame:
    """(name, versions, n): manifest dependencies asked for in more than one version."""
    per = manifests(nodes).where("version <> ''").groupBy("name").agg(F.array_sort(F.collect_set("version")).alias("v"))
    return per.where(F.size("v") > 1).select("name", F.array_join("v", ",").alias("versions"), F.size("v").alias("n"))


def match_imports(imports: DataFrame, deps: DataFrame) -> DataFrame:
    """imports(id, name, file_path), deps(id, name, file_path) -> (import_id, manifest_id, tier).

    Tiers: exact name; longest prefix at a slash; first dotted component (normalised, then as is); with two dots a
    contained name. An import stops at its first tier with a match; of several matches those of its own top
    directory are kept if there are any. Prefixes and contained names are exploded into join keys.

    Every tier has one key per name, so the first key that any manifest has is found per distinct name. An import meets the
    manifests of its own top directory under it, and all of them only if there are none: no pair is made that isn't kept."""
    m = deps.select(F.col("id").alias("manifest_id"), F.explode(F.array_distinct(F.array("name", X.normalize_python(F.col("name"))))).alias("key"), X.top_dir(F.col("file_path")).alias("group"))
    i = imports.select(F.col("id").alias("import_id"), "name", X.top_dir(F.col("file_path")).alias("group"))
    names = i.select("name").distinct()
    keyed = lambda df, col, tier: df.select("name", col.alias("key")).where("key is not null and key <> ''").withColumn("tier", F.lit(tier))
    parts = F.split("name", "/")
    prefixes = names.where(F.col("name").contains("/")).select("name", F.explode(F.sequence(F.size(parts) - 1, F.lit(1))).alias("k"))
    prefixes = prefixes.select("name", F.array_join(F.slice(parts, 1, F.col("k")), "/").alias("key")).withColumn("tier", F.lit(1000000) - F.length("key"))
    dotted, first = names.where(F.col("name").contains(".")), F.split_part("name", F.lit("."), F.lit(1))
    twice = names.where(F.size(F.split("name", r"\.")) >= 3)
    low = twice.withColumn("low", F.lower("name"))
    dots = deps.select(F.col("name").alias("key"), F.lower(F.replace("name", F.lit("-"), F.lit("."))).alias("sub")).distinct()
    # Which contained name is taken is open; the smallest is.
    within = low.join(contained(low, "low", dots, "sub", ["low"]), "low").join(dots, "sub")
    within = within.groupBy("name").agg(F.min("key").alias("key")).withColumn("tier", F.lit(5000000))
    keys = reduce(DataFrame.unionByName, [keyed(names, F.col("name"), 0), prefixes, keyed(dotted, X.normalize_python(first), 3000000), keyed(dotted, first, 4000000), within])
    best = keys.join(m.select("key").distinct(), "key", "left_semi").groupBy("name").agg(F.min(F.struct("tier", "key")).alias("b"))
    chosen = i.join(best.select("name", "b.key", "b.tier"), "name").select("import_id", "key", "group", "tier")
    # Whether an import's own directory has the key is asked of the directories, which are no more than the manifests.
    held = m.select("key", "group", F.lit(True).alias("own")).distinct()
    asked = chosen.join(held, ["key", "group"], "left")
    own = asked.where("own").join(m, ["key", "group"]).select("import_id", "manifest_id", "tier")
    others = asked.where("own is null and group is not null").select("import_id", "key", "tier").join(m, "key").select("import_id", "manifest_id", "tier")
    tier = F.when(F.col("tier") == 0, 1).when(F.col("tier") <= 1000000, 2).when(F.col("tier") <= 4000000, 3).otherwise(4)
    return own.unionByName(others).select("import_id", "manifest_id", tier.alias("tier"))


def link_imports(nodes: DataFrame) -> DataFrame:
    imports = nodes.where((F.col("type") == "Dependency") & F.contains(prop("kind"), F.lit("import")))
    return _edges(match_imports(imports, manifests(nodes)).select(F.col("import_id").alias("source_id"), F.col("manifest_id").alias("target_id")), "DependsOn", "import_to_manifest", distinct=True)


# ---- Phase 6: implements --------------------------------------------------------------------------------------------


def structural_implements(nodes: DataFrame, language: str = "go", exact_receiver: bool = False, same_file: bool = False) -> DataFrame:
    """Struct implements interface when its methods hold all of the interface's: relational division by counting.

    A method belongs to every struct whose name its receiver contains (exact_receiver: equals). same_file=False
    wants different files, True the same one (the parser's own phase)."""
    lang = nodes.where(F.col("language") == language)
    need = lang.where("type = 'Interface'").select(F.col("id").alias("target_id"), F.col("file_path").alias("ifile"), F.explode(F.array_distinct(X.comma_split(prop("methods")))).alias("method"))
    size = need.groupBy("target_id").agg(F.count("*").alias("needed"))
    structs = lang.where("type = 'Struct'").select(F.col("id").alias("source_id"), F.col("name").alias("sname"), F.col("file_path").alias("sfile")).where("sname <> ''")
    wanted = need.select("method").distinct()
    methods = lang.where("type = 'Method'").select(F.col("name").alias("method"), prop("receiver").alias("receiver"), "file_path").join(wanted, "method", "left_semi").where("receiver <> ''")
    if same_file:
        has = methods.join(structs, (F.col("receiver") == F.col("sname")) & (F.col("file_path") == F.col("sfile")))
    elif exact_receiver:
        has = methods.join(structs, F.col("receiver") == F.col("sname"))
    else:
        r = methods.select("method", "receiver").distinct()
        has = r.join(contained(r, "receiver", structs, "sname", ["receiver"]), "receiver").join(structs, "sname")
    have = has.select("source_id", "sfile", "method").distinct()
    both = have.join(need, "method").where((F.col("sfile") == F.col("ifile")) if same_file else (F.col("sfile") != F.col("ifile")))
    full = both.groupBy("source_id", "target_id").agg(F.count("*").alias("n")).join(size, "target_id").where("n = needed")
    return _edges(full, "Implements", "structural")


def _best_match(rows: DataFrame) -> DataFrame:
    """Per (source_id, wanted name): same top directory, then same package, then the lowest id."""
    rows = rows.withColumn("key", F.concat_ws("|", "source_id", "wanted"))
    return _pick(rows, "key", (F.col("stop") != F.col("ttop")).cast("int"), (F.col("spkg") != F.col("tpkg")).cast("int"), "target_id")


def nominal_implements(nodes: DataFrame) -> DataFrame:
    """Class implements the interfaces named in its 'implements' (6b), and Python protocols named in its 'bases' (6c)."""
    sides = lambda p: (F.col("id").alias(p + "_id"), X.top_dir(F.col("file_path")).alias(p[0] + "top"), F.col("package").alias(p[0] + "pkg"))
    out = []
    for key, kind, face in (("implements", "nominal", F.lit(True)), ("bases", "protocol", (F.col("language") == "python") & (prop("protocol") == "true"))):
        src = nodes.where("type in ('Class', 'Struct', 'Enum')" if kind == "nominal" else "type = 'Class' and language = 'python'")
        src = src.select(*sides("source"), F.explode(F.array_distinct(X.comma_split(prop(key)))).alias("wanted"))
        dst = nodes.where((F.col("type") == "Interface") & face).select(*sides("target"), F.col("name").alias("wanted"))
        out.append(_edges(_best_match(src.join(dst, "wanted").where("source_id <> target_id")), "Implements", kind))
    return out[0].unionByName(out[1])


# ---- Phase 7: tests ------------------------------------------------------------------------------------------------------


def _any(nodes: DataFrame, kind: str) -> Column:
    """Whether there is any node of a type, as a scalar subquery."""
    return F.coalesce(nodes.agg(F.max(F.col("type") == kind).alias("any")).scalar(), F.lit(False))


def link_test_files(nodes: DataFrame) -> DataFrame:
    """Test file tests its source file: the first candidate path that a File node has. Without TestFile nodes the test
    files among the File nodes are taken."""
    tests = nodes.where((F.col("type") == "TestFile") | ~_any(nodes, "TestFile") & (F.col("type") == "File") & X.is_test_file(F.col("file_path"), F.col("language")))
    cand = tests.select(F.col("id").alias("source_id"), F.posexplode(X.source_paths(F.col("file_path"), X.language_of(F.col("language"), F.col("file_path")))).alias("pos", "path"))
    files = nodes.where("type = 'File'").groupBy(F.col("file_path").alias("path")).agg(F.max("id").alias("target_id"))
    best = cand.join(files, "path").where("source_id <> target_id").groupBy("source_id").agg(F.min_by("target_id", "pos").alias("target_id"))
    return _edges(best, "Tests", "file_coverage")


def link_test_functions(nodes: DataFrame) -> DataFrame:
    """Test function tests a function: per candidate name the function, then the method of its directory, then of its
    package; the first candidate with a hit wins, duplicate names resolve to the highest id."""
    is_test = X.is_test_function(F.col("name"), F.col("language"), F.col("file_path"))
    tests = nodes.where((F.col("type") == "TestFunction") | ~_any(nodes, "TestFunction") & (F.col("type") == "Function") & is_test)
    lang = X.language_of(F.col("language"), F.col("file_path"))
    cand = tests.select(F.col("id").alias("source_id"), X.dir_name(F.col("file_path")).alias("dir"), F.col("package").alias("pkg"), F.posexplode(X.source_names(F.col("name"), lang)).alias("pos", "cand"))
    hits = []
    for tier, (kind, by) in enumerate((("Function", "dir"), ("Method", "dir"), ("Function", "pkg"), ("Method", "pkg"))):
        pool = nodes.where((F.col("type") == kind) & (F.lit(True) if kind == "Method" else ~is_test)).select("id", F.col("name").alias("cand"), X.dir_name(F.col("file_path")).alias("dir"), F.col("package").alias("pkg"))
        pool = pool.where(F.col(by) != "").groupBy("cand", by).agg(F.max("id").alias("target_id"))
        hits.append(cand.join(pool, ["cand", by]).select("source_id", "target_id", F.struct("pos", F.lit(tier).alias("tier")).alias("rank")))
    best = reduce(DataFrame.unionByName, hits).groupBy("source_id").agg(F.min_by("target_id", "rank").alias("target_id"))
    return _edges(best, "Tests", "function_coverage")


# ---- Phase 8: calls across files ---------------------------------------------------------------------------------------------


def link_calls(nodes: DataFrame, language: str = "go") -> DataFrame:
    """Callable calls the function or method of that name in its package in another file; the same directory first,
    then the lowest id."""
    code = nodes.where((F.col("language") == language) & F.col("type").isin("Function", "Method"))
    calls = code.select(F.col("id").alias("source_id"), "package", F.col("file_path").alias("from"), F.explode(F.array_distinct(X.comma_split(prop("unresolved_calls")))).alias("name"))
    to = code.select(F.col("id").alias("target_id"), "package", F.col("file_path").alias("to"), "name")
    hits = calls.join(to, ["package", "name"]).where("from <> to").withColumn("key", F.concat_ws("|", "source_id", "name"))
    return _edges(_pick(hits, "key", (X.dir_name(F.col("from")) != X.dir_name(F.col("to"))).cast("int"), "target_id"), "Calls", "cross_file")


# ---- Phase 9: documents -----------------------------------------------------------------------------------------------------------

DOCUMENTED = ["Function", "Method", "Class", "Struct", "Interface", "Package", "File"]


def link_documents(nodes: DataFrame) -> DataFrame:
    """Document documents every code node whose name its text contains (names of 3 bytes, texts of 20 and more,
    case ignored). Names of blanks only are never mentioned.

    A text that contains a name has each of the name's runs (of word characters or of marks) within one of its own
    runs. So the distinct runs of all texts are searched for the names' runs; a name is looked for by the one that fewest texts
    hold, and one with a run that no text holds by none. Of the texts only the runs that some name is looked for by are
    moved, told by a Bloom filter. A name of one run is contained where the run is; others are checked against the texts."""
    runs = lambda c: F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+)"), F.lit(1))
    docs = nodes.where("type = 'Document'").select(F.col("id").alias("source_id"), F.lower("doc_comment").alias("text")).where(F.octet_length("text") >= 20)
    names = nodes.where(F.col("type").isin(DOCUMENTED)).select(F.col("id").alias("target_id"), F.lower("name").alias("name")).where(F.octet_length("name") >= 3)
    longest = F.reduce("_runs", F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    parted = names.select("name").distinct().withColumn("_runs", runs("name")).withColumn("_longest", longest)
    # Short runs are in nearly every text; a name has one of them for a key only if it is its longest.
    offered = parted.select("name", F.explode(F.array_distinct(F.filter("_runs", lambda x: (F.length(x) >= GRAM) | (x == F.col("_longest"))))).alias("key"))
    words = docs.select("source_id", F.explode(F.array_distinct(runs("text"))).alias("w"))
    texts = cut(words.groupBy("w").agg(F.count("*").alias("texts")))
    seen = cut(contained(texts, "w", offered, "key", ["w"]))
    held = seen.join(texts, "w").groupBy("key").agg(F.sum("texts").alias("texts"))
    rated = offered.join(held, "key", "left").groupBy("name").agg(F.min_by("key", F.struct("texts", "key")).alias("key"), F.count_if(F.col("texts").isNull()).alias("none"))
    wanted = cut(rated.where("none = 0").join(seen, "key").select("w", "name", (F.col("name") == F.col("key")).alias("whole")))
    live = wanted.select(F.lit("").alias("branch"), F.col("w").alias("id")).distinct()
    near = words.where(BloomFilter(live, live.count()).might_contain(F.lit(""), F.col("w")))
    pairs = cut(near.join(wanted, "w").select("source_id", "name", "whole").distinct())
    parts = pairs.where("not whole")
    asked = parts.select(F.lit("").alias("branch"), F.col("source_id").alias("id")).distinct()
    checked = parts.join(docs.where(BloomFilter(asked, asked.count()).might_contain(F.lit(""), F.col("source_id"))), "source_id").where(F.contains("text", "name")).select("source_id", "name").distinct()
    hits = pairs.where("whole").select("source_id", "name").unionByName(checked)
    # Pairs of a text and a name are distinct, so those of their nodes are, and the largest result isn't moved.
    out = hits.join(names, "name")
    return out.select(
        edge_id("edge", F.col("source_id"), F.concat("target_id", F.lit(":Documents"))).alias("id"), F.lit("Documents").alias("type"), "source_id", "target_id", F.lit("").alias("kind"))


# ---- Event ends and matches found by a model (F18, J32) --------------------------------------------------------------------------------

# Words in names and signatures that tell producers and consumers of events.
PRODUCER_NAMES, PRODUCER_SIGNATURES = ["publish", "emit", "send_event", "dispatch", "fire"], ["publish", "emit", "send_event", "dispatch"]
CONSUMER_NAMES, CONSUMER_SIGNATURES = ["subscribe", "on_event", "handle_event", "consume", "listener"], ["subscribe", "on_event", "handle_event", "consumer"]


def event_ends(nodes: DataFrame) -> DataFrame:
    """(id, service, produces, consumes) of the functions whose name or signature speaks of events, case ignored."""
    says = lambda column, words: reduce(Column.__or__, [F.contains(F.lower(column), F.lit(w)) for w in words])
    produces = says("name", PRODUCER_NAMES) | says("signature", PRODUCER_SIGNATURES)
    consumes = says("name", CONSUMER_NAMES) | says("signature", CONSUMER_SIGNATURES)
    return nodes.where("type = 'Function'").select("id", X.top_dir(F.col("file_path")).alias("service"), produces.alias("produces"), consumes.alias("consumes")).where("produces or consumes")


def link_inferred(nodes: DataFrame, matches: DataFrame) -> DataFrame:
    """matches(service, endpoint_path, confidence), as a language model returns them for a service's unresolved calls ->
    EDGES: the service's first call (lowest id) that fits the path, else its first call, consumes the endpoint of that
    path (of several the highest id), and the services depend on each other. Low confidence and unknown paths give none."""
    ends = nodes.where("type = 'APIEndpoint'").groupBy(X.normalize_url(prop("path")).alias("path")).agg(F.max(F.struct("id", "file_path")).alias("end"))
    sure = matches.where("confidence is null or confidence <> 'low'").select("service", X.normalize_url(F.col("endpoint_path")).alias("path")).distinct().join(ends, "path")
    calls = api_calls(nodes).select(X.top_dir(F.col("file_path")).alias("service"), "call_id", X.normalize_url(F.col("path")).alias("call_path"))
    fits = F.when(X.match_segments(F.col("call_path"), F.col("path")), 0).otherwise(1)
    best = sure.join(calls, "service").groupBy("service", "path").agg(F.min(F.struct(fits.alias("miss"), "call_id")).alias("c"), F.first("end").alias("end"))
    consumes = best.select(F.col("c.call_id").alias("source_id"), F.col("end.id").alias("target_id")).distinct()
    s = services(nodes).select("group", "service_id")
    both = best.select("service", X.top_dir(F.col("end.file_path")).alias("to")).distinct().join(s.select(F.col("group").alias("service"), F.col("service_id").alias("source_id")), "service")
    both = both.join(s.select(F.col("group").alias("to"), F.col("service_id").alias("target_id")), "to").where("source_id <> target_id").select("source_id", "target_id").distinct()
    made = lambda df, kind, note: df.select(edge_id(f"llm_{kind}", F.col("source_id"), F.col("target_id")).alias("id"), F.lit(kind).alias("type"), "source_id", "target_id", F.lit(note).alias("kind"))
    return made(consumes, "Consumes", "").unionByName(made(both, "DependsOn", "api_dependency"))


# ---- Parser-level joins (J35, J36) ----------------------------------------------------------------------------------------------------


def link_prerequisites(targets: DataFrame) -> DataFrame:
    """targets(id, name, prerequisites as blank-separated text): target depends on the targets it names."""
    want = targets.select(F.col("id").alias("source_id"), F.explode(F.array_distinct(F.filter(F.split("prerequisites", r"\s+"), lambda x: x != ""))).alias("name"))
    return _edges(want.join(targets.select(F.col("id").alias("target_id"), "name"), "name").where("source_id <> target_id"), "DependsOn", "prerequisite")


def link_providers(resources: DataFrame, providers: DataFrame) -> DataFrame:
    """resources(id, name like aws_bucket.x) depend on the provider that their name's first part names."""
    r = resources.select(F.col("id").alias("source_id"), F.split_part("name", F.lit("_"), F.lit(1)).alias("name"))
    return _edges(r.join(providers.select(F.col("id").alias("target_id"), "name"), "name"), "DependsOn", "provider")


PHASES = {
    "services": link_services, "endpoints": link_endpoints, "api_calls": link_api_calls, "dependencies": link_dependencies, "imports": link_imports,
    "implements": lambda n: structural_implements(n).unionByName(nominal_implements(n)),
    "tests": lambda n: link_test_files(n).unionByName(link_test_functions(n)), "calls": link_calls, "documents": link_documents,
}
#: The columns that the phases read.
READ = ["id", "type", "name", "file_path", "package", "language", "doc_comment", "properties"]
NEW_PHASES = ["implements", "tests", "calls"]


def add_services(nodes: DataFrame) -> DataFrame:
    """The nodes with a Service for every top directory of files that has none: its name is the directory, its path unset."""
    made = services(nodes).where("created")
    kinds = dict(nodes.dtypes)
    given = {"id": F.col("service_id"), "type": F.lit("Service"), "name": F.col("group"), "exported": F.lit(True), "properties": F.create_map(F.lit("kind"), F.lit("auto"))}
    unset = {"string": F.lit(""), "int": F.lit(0), "boolean": F.lit(False)}
    return nodes.unionByName(made.select(*[given.get(c, unset.get(kinds[c], F.lit(None))).cast(kinds[c]).alias(c) for c in nodes.columns]))


def add_full_paths(nodes: DataFrame) -> DataFrame:
    """The nodes with the full_path of every endpoint that a mounted router gives another path than its own."""
    full = endpoint_paths(nodes).withColumnRenamed("endpoint_id", "id")
    new = F.col("full_path").isNotNull() & (prop("path") != "") & (F.col("full_path") != prop("path"))
    others = F.map_filter(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda k, _: k != "full_path")
    return nodes.join(full, "id", "left").withColumn("properties", F.when(new, F.map_concat(others, F.create_map(F.lit("full_path"), F.col("full_path")))).otherwise(F.col("properties"))).select(*nodes.columns)


#: What a phase leaves behind in the nodes for the phases after it.
CHANGES = {"services": add_services, "endpoints": add_full_paths}


def chain(nodes: DataFrame, phases: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after the phases in their order: each reads the nodes as the ones before it left them. Edges carry
    their phase's name. The nodes are written once (unless they are a stored table already) and once more per phase that
    changes them, so that the many joins of the phases read narrow columns of a stored table instead of repeating its plan."""
    now, found = nodes if hasattr(nodes, "_stemma_path") else cut(nodes), []
    for name in phases or PHASES:
        if name in CHANGES:
            before, now = now, cut(CHANGES[name](now))
            if not found and before is not nodes:
                drop_cut(before)
        found.append(PHASES[name](now).withColumn("phase", F.lit(name)))
    return now, reduce(DataFrame.unionByName, found)


def run_phases(nodes: DataFrame, phases: list[str] | None = None) -> DataFrame:
    """All edges of a chain of phases, with the phase's name. Only the columns that phases read are written."""
    return chain(nodes if nodes.columns == READ else nodes.select(*READ), phases)[1]


def phase_counts(edges: DataFrame, phases: list[str] | None = None) -> DataFrame:
    """(phase, linked) of every phase that ran, also of those that linked nothing."""
    names = edges.sparkSession.createDataFrame([(p,) for p in phases or PHASES], "phase string")
    return names.join(edges.groupBy("phase").agg(F.count("*").alias("linked")), "phase", "left").fillna(0, ["linked"])


def count_phases(nodes: DataFrame, phases: list[str] | None = None) -> DataFrame:
    """phase_counts of a chain of phases, each counted as soon as the nodes are as it finds them: the driver holds one
    phase's plan at a time, and nodes that a later phase has changed are dropped."""
    given = nodes if nodes.columns == READ else nodes.select(*READ)
    now, linked = given if hasattr(given, "_stemma_path") else cut(given), []
    for name in phases or PHASES:
        if name in CHANGES:
            before, now = now, cut(CHANGES[name](now))
            if before is not nodes:
                drop_cut(before)
        linked.append((name, PHASES[name](now).count()))
    if now is not nodes:
        drop_cut(now)
    return nodes.sparkSession.createDataFrame(linked, "phase string, linked long")
