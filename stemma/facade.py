"""GraphStore: the query surface over one pair of tables, with named tools (B06, B08) and SQL views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import render
from .functions.classify import classify
from .model import current_edges, current_nodes
from .operators import analysis, link, retrieve, store, traverse


class GraphStore:
    """Nodes and edges read through branches in order of priority; writes go to the first of them."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, branches: list[str]):
        self.nodes, self.edges, self.branches = nodes, edges, branches

    @classmethod
    def delivered(cls, nodes: DataFrame, edges: DataFrame, branches: list[str]) -> "GraphStore":
        """From tables of deliveries: the newest row of each (branch, id)."""
        return cls(current_nodes(nodes), current_edges(edges), branches)

    @property
    def view(self) -> tuple[DataFrame, DataFrame]:
        return store.overlay(self.nodes, self.branches), store.overlay(self.edges, self.branches)

    def query(self, flt: store.NodeFilter | None = None) -> DataFrame:
        return store.query_nodes(self.nodes, self.branches, flt)

    def get(self, node: str) -> DataFrame:
        return store.get_node(self.nodes, self.branches, node)

    def stats(self) -> DataFrame:
        return store.stats(self.nodes, self.edges, self.branches)

    def upsert(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> "GraphStore":
        own = lambda df: df.withColumn("branch", F.lit(self.branches[0]))
        n = store.upsert(self.nodes, own(nodes).select(*self.nodes.columns)) if nodes is not None else self.nodes
        e = store.upsert(self.edges, own(edges).select(*self.edges.columns)) if edges is not None else self.edges
        return GraphStore(n, e, self.branches)

    def delete_files(self, paths: DataFrame) -> "GraphStore":
        n, e = store.delete_by_file(self.nodes, self.edges, self.branches[0], paths)
        return GraphStore(n, e, self.branches)

    def link(self, phases: list[str] | None = None) -> "GraphStore":
        """The store with the edges of the link phases, the services they create and the full paths they find."""
        given, _ = self.view
        nodes, found = link.chain(given, phases)
        edges = found.groupBy("id").agg(F.first(F.struct("type", "source_id", "target_id", "kind")).alias("e")).select(
            "id", "e.type", "e.source_id", "e.target_id", F.create_map(F.lit("kind"), F.col("e.kind")).alias("properties"))
        before = given.select("id", F.element_at("properties", "full_path").alias("_was"))
        full = F.element_at("properties", "full_path")
        changed = nodes.join(before, "id", "left").where((F.col("type") == "Service") & (link.prop("kind") == "auto") | full.isNotNull() & ~full.eqNullSafe(F.col("_was")))
        return self.upsert(changed.drop("_was"), edges)

    def register_views(self) -> None:
        n, e = self.view
        n.createOrReplaceTempView("graph_nodes")
        e.createOrReplaceTempView("graph_edges")

    def tool(self, name: str, **arguments) -> DataFrame:
        return TOOLS[name](self, **arguments)


    def context(self, name: str, **arguments) -> str:
        """An agent's context as text: overview, architecture, service, file, impact, model, guidelines, coverage."""
        return render.context_text(name, {k: f(self, **arguments) for k, f in CONTEXTS[name].items()})


CONTEXTS: dict[str, dict[str, Callable[..., DataFrame]]] = {
    "overview": {"Graph": lambda s: s.stats(), "Languages": lambda s: analysis.language_counts(s.view[0]), "Packages": lambda s: analysis.top_packages(s.view[0])},
    "architecture": {"Layers and roles": lambda s: analysis.layer_roles(classify(s.view[0])), "Patterns": lambda s: analysis.pattern_counts(classify(s.view[0])), "Across services": lambda s: analysis.cross_service(classify(s.view[0]))},
    "service": {"Services": lambda s: analysis.service_summary(*s.view)},
    "file": {"Symbols": lambda s, path: analysis.symbols(s.view[0].where(F.col("file_path") == path)), "Links": lambda s, path: traverse.file_links(*s.view).where(F.col("file_path") == path)},
    "impact": {"Impact": lambda s, node: TOOLS["get_impact_analysis"](s, node)},
    "model": {"Models": lambda s: analysis.models(classify(s.view[0]))},
    "guidelines": {"Guidelines": lambda s: TOOLS["get_project_guidelines"](s).select("file_path", "doc_comment")},
    "coverage": {"Packages": lambda s: analysis.package_coverage(analysis.coverage(*s.view, "function"))},
}

# The tools' names are the interface that callers know.
TOOLS: dict[str, Callable[..., DataFrame]] = {
    "get_graph_overview": lambda s: s.stats(),
    "get_architecture_overview": lambda s: analysis.layer_roles(classify(s.view[0])),
    "get_service_info": lambda s: analysis.service_summary(*s.view),
    "get_file_info": lambda s, path: traverse.file_links(*s.view).where(F.col("file_path") == path),
    "get_impact_analysis": lambda s, node: traverse.impact(s.view[1], store.resolve(s.view[0], node).select(F.col("id").alias("root_id"))),
    "search_nodes": lambda s, pattern: analysis.search_nodes(s.view[0], store.glob(F.col("name"), pattern)),
    "get_model_info": lambda s: analysis.models(classify(s.view[0])),
    "get_project_guidelines": lambda s: s.query(store.NodeFilter(type="AIGuideline")),
    "query_file_symbols": lambda s, path: analysis.symbols(s.view[0].where(F.col("file_path") == path)),
    "query_interface_implementors": lambda s: store.implementors(*s.view),
    "query_node_edges": lambda s, node, direction="both": store.edge_entries(*s.view, store.resolve(s.view[0], node).select(F.col("id").alias("node_id")), direction=direction, keep_unresolved=False),
    "query_unused": lambda s: analysis.unused(*s.view).orderBy("file_path", "line", "id"),
    "query_coverage": lambda s, level="function": analysis.coverage(*s.view, level).orderBy("file_path", "line", "id"),
    "semantic_search": lambda s, vectors, question, limit=15: retrieve.search(*s.view, vectors, question, limit),
}
