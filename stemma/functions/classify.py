"""Architectural classification of nodes as nested conditions over property lists.

Input columns: the node's; lists are comma-joined properties. Output: role, reclassified type, patterns, layer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import comma_split, immediate_dir

# Fixed values of the rules: suffixes, annotations, base classes and directory names.
DTO_SUFFIXES = ["DTO", "Request", "Response", "Payload", "Command", "Query"]
DTO_DIRS = ["dto", "viewmodel", "api", "request", "response"]
DOMAIN_DIRS = ["domain", "entity", "core", "model"]
SERVICE_DIRS = ["service", "services", "use_case", "usecase"]
REPOSITORY_DIRS = ["repository", "repositories"]
DB_ANNOTATIONS = ["Entity", "Table", "Document", "MappedSuperclass"]
LAYER_DIRS = {
    "presentation": ["controller", "controllers", "handler", "handlers", "view", "views", "template", "templates", "api"],
    "business": ["service", "services", "domain", "model", "entity", "core", "use_case", "usecase"],
    "data_access": ["repository", "repositories", "dao", "store", "persistence", "migration", "migrations"],
    "infrastructure": ["config", "middleware", "util", "utils", "adapter", "adapters", "infrastructure", "infra"],
}
DATA_ACCESS = ["find", "get", "save", "delete", "create", "update", "list"]


def _or(*c: Column) -> Column:
    return reduce(lambda a, b: a | b, c)


def _has(items: Column, values: list[str]) -> Column:
    return F.exists(items, lambda x: x.isin(values))


def classify(nodes: DataFrame) -> DataFrame:
    """nodes with role, new_type, patterns (comma-joined) and layer. Later role rules overwrite earlier ones (controller,
    service, repository, middleware); a reclassified node keeps its id."""
    prop = lambda k: F.coalesce(F.element_at("properties", k), F.lit(""))
    n = nodes
    for k in ("annotations", "decorators", "bases", "implements", "methods", "extends"):
        n = n.withColumn("_" + k, comma_split(prop(k)))
    n = n.withColumn("_dir", F.lower(immediate_dir(F.col("file_path"), F.col("package"))))
    name, lang, sig, d = F.col("name"), F.col("language"), F.col("signature"), F.col("_dir")
    ann, dec, bases, impl, meth, ext = (F.col("_" + k) for k in ("annotations", "decorators", "bases", "implements", "methods", "extends"))
    class_like, callable_ = F.col("type").isin("Class", "Struct"), F.col("type").isin("Function", "Method")
    ends = lambda *s: _or(*[name.endswith(x) for x in s])
    by_lang = lambda **rules: reduce(lambda acc, kv: acc.when(lang == kv[0], kv[1]), list(rules.items())[1:], F.when(lang == list(rules)[0], list(rules.values())[0])).otherwise(False)

    lowered = F.transform(meth, F.lower)
    counted = F.size(F.filter(lowered, lambda m: ~m.isin("getinstance", "instance", "getclass") & _or(*[m.startswith(p) for p in DATA_ACCESS])))
    data_access = (F.size(meth) >= 3) & (counted >= 3) & (counted > F.floor(F.size(meth) / 2))

    db_model = by_lang(
        java=_has(ann, DB_ANNOTATIONS), python=_has(bases, ["Model", "Base", "Document"]),
        go=ends("Model", "Entity") & (prop("fields") != ""), typescript=_has(dec, ["Entity", "Schema"]))
    no_db = ~_has(ann, DB_ANNOTATIONS)
    domain = class_like & no_db & (_or(*[name.contains(t) for t in ("Aggregate", "ValueObject", "DomainEvent")]) | (name.contains("Entity") & d.isin(DOMAIN_DIRS)))
    view_model = ends("ViewModel", "View")
    dto = ends(*DTO_SUFFIXES) | ((lang == "java") & _has(ann, ["JsonProperty", "Serializable"])) | d.isin(DTO_DIRS)

    controller = class_like & by_lang(
        java=_has(ann, ["Controller", "RestController", "RequestMapping"]),
        python=F.exists(dec, lambda x: x.contains("app.route") | x.contains("router")) | _has(bases, ["APIView", "ViewSet"]),
        typescript=_has(dec, ["Controller"]), go=ends("Handler", "Controller"))
    service = class_like & by_lang(java=_has(ann, ["Service", "Component"]), python=d.isin(SERVICE_DIRS), typescript=_has(dec, ["Injectable"]), go=ends("Service", "UseCase", "Interactor"))
    repository = class_like & (by_lang(java=_has(ann, ["Repository"]), go=ends("Repository", "Repo", "Store", "DAO"), python=d.isin(REPOSITORY_DIRS) | ends("Repository", "Repo")) | data_access)
    middleware = by_lang(
        go=name.contains("Middleware") | (callable_ & sig.contains("http.Handler")), python=F.exists(dec, lambda x: x.contains("middleware")),
        typescript=_has(impl, ["NestMiddleware"]) | _has(dec, ["Middleware"]), java=_has(ann, ["Filter"]) | _has(impl, ["Filter", "HandlerInterceptor"]))
    role = F.when(middleware, "middleware").when(repository, "repository").when(service, "service").when(controller, "controller").otherwise("")

    n = n.withColumn("role", role)
    free = F.col("role") == ""
    new_type = (
        F.when(class_like & db_model, "DBModel").when(class_like & free & view_model, "ViewModel").when(class_like & free & dto, "DTO")
        .when(class_like & free & domain, "DomainModel").otherwise(F.col("type")))

    factory = callable_ & _or(*[name.startswith(p) & (F.length(name) > len(p)) for p in ("New", "Create", "Build", "Make")]) & ((lang != "go") | sig.contains("*"))
    listens = lambda a: F.exists(a, lambda x: F.lower(x).contains("listener") | F.lower(x).contains("observer"))
    observer = listens(impl) | listens(ext) | (_has(lowered, ["subscribe", "on", "addobserver", "addlistener"]) & _has(lowered, ["notify", "emit", "notifyobservers", "notifylisteners"]))
    still = new_type.isin("Class", "Struct")  # a reclassified type is no longer class-like
    singleton = still & _has(lowered, ["getinstance", "instance", "shared"])
    builder = still & (ends("Builder") | _has(meth, ["Build", "build"]))
    patterns = F.concat_ws(",", F.when(factory, "factory"), F.when(singleton, "singleton"), F.when(observer, "observer"), F.when(builder, "builder"), F.when(F.col("role") == "repository", "repository"))

    n = n.withColumn("new_type", new_type).withColumn("patterns", patterns)
    n = n.withColumn("role", F.when(class_like & free & (F.col("new_type") == "DomainModel"), "domain_model").otherwise(F.col("role")))
    layer = (
        F.when(F.col("role") == "controller", "presentation").when(F.col("role").isin("service", "domain_model"), "business").when(F.col("role") == "repository", "data_access")
        .when(F.col("role") == "middleware", "infrastructure").when(F.col("new_type") == "DBModel", "data_access").when(F.col("new_type") == "DomainModel", "business")
        .when(F.col("new_type").isin("ViewModel", "DTO"), "presentation"))
    for value, dirs in LAYER_DIRS.items():
        layer = layer.when(d.isin(dirs), value)
    return n.withColumn("layer", layer.otherwise("")).drop("_annotations", "_decorators", "_bases", "_implements", "_methods", "_extends", "_dir")
