"""Queries and reference SQL of the general problems (2 and 7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.hierarchy import descendants, edge_nodes, hierarchies, loop_edges, parent_links
from ..operators.orphans import find_orphans, orphan_report
from ..session import table


def _orphans(spark, d):
    return find_orphans(table(spark, d, "edges"), table(spark, d, "nodes"))


def _hierarchy(spark, d, with_paths=True):
    e = table(spark, d, "edges")
    return hierarchies(parent_links(e), edge_nodes(e), with_paths=with_paths)


QUERIES = {
    "p2_found": lambda s, d: _orphans(s, d).select("branch", "edge_id", "side", "reason"),
    "p2_report": lambda s, d: orphan_report(_orphans(s, d)),
    "p7_found": lambda s, d: _hierarchy(s, d, False).select("node_id", "root_id", "depth"),
    "p7_paths": lambda s, d: _hierarchy(s, d).select("node_id", "root_id", "depth", F.array_join("path", " > ").alias("path"), "n_descendants").where("depth >= 0"),
    "p7_descendants": lambda s, d: descendants(_hierarchy(s, d)).select("ancestor_id", "node_id", F.col("distance").cast("int").alias("distance")),
    "p7_loops": lambda s, d: loop_edges(_hierarchy(s, d, False)),
}

_P2 = """
with e as (select * from (select *, row_number() over (partition by branch, id order by indexed_at desc) rn from edges) where rn = 1),
x as (select branch, id, type, 'source' as side, source_id as n, indexed_at as t from e
      union all select branch, id, type, 'target', target_id, indexed_at from e),
o as (select x.branch, x.id as edge_id, x.type, side, t,
        case when count(n.id) = 0 then 'missing' when bool_or(n.indexed_at > t) then 'late' else 'deleted' end as reason
      from x left join nodes n on n.id = x.n and (n.branch = x.branch or n.branch = 'main')
      where x.n <> ''
      group by 1, 2, 3, 4, 5
      having not coalesce(bool_or(n.indexed_at <= t and (n.deleted_at is null or n.deleted_at > t)), false))
"""

_P7 = """
with recursive r as (select * from edges where branch = 'main' and type = 'Contains' and source_id <> '' and target_id <> ''),
p as (select child, parent from (select target_id as child, source_id as parent,
        row_number() over (partition by target_id order by indexed_at desc, source_id) rn from r) where rn = 1),
ids as (select source_id as id from r union select target_id from r),
down as (select id as node_id, id as root_id, 0 as depth, id as path from ids where id not in (select child from p)
         union all select p.child, d.root_id, d.depth + 1, d.path || ' > ' || p.child from down d join p on p.parent = d.node_id),
lost as (select id from ids where id not in (select node_id from down)),
up as (select id, id as x, 0 as n from lost
       union all select u.id, p.parent, u.n + 1 from up u join p on p.child = u.x where u.n < 64),
on_loop as (select id from up where n > 0 and x = id group by 1),
ring as (select u.id, min(u.x) as root_id, count(distinct u.x) as loop_size from up u where u.id in (select id from on_loop) group by 1),
hang as (select u.id, max(r.root_id) as root_id from up u join ring r on r.id = u.x group by 1),
anc as (select d.node_id, p.parent as ancestor_id, 1 as distance from down d join p on p.child = d.node_id
        union all select a.node_id, p.parent, a.distance + 1 from anc a join p on p.child = a.ancestor_id)
"""

ORACLE = {
    "p2_found": _P2 + "select branch, edge_id, side, reason from o",
    "p2_report": _P2 + "select type, branch, strftime(t, '%Y-%m') as month, side, reason, count(*) as orphans from o group by all",
    "p7_found": _P7 + "select node_id, root_id, depth from down union all select id, root_id, -1 from hang",
    "p7_paths": _P7 + """select d.node_id, d.root_id, d.depth, d.path, coalesce(k.n, 0) as n_descendants
        from down d left join (select ancestor_id, count(*) as n from anc group by 1) k on k.ancestor_id = d.node_id""",
    "p7_descendants": _P7 + "select ancestor_id, node_id, distance from anc",
    "p7_loops": _P7 + "select r.id as node_id, p.parent as parent_id, r.root_id, cast(r.loop_size as int) as loop_size from ring r join p on p.child = r.id",
}
