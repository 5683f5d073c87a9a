"""Plans as plain data."""

from __future__ import annotations

from .hypergraph import berge_acyclic, degree, places
from .model import JoinTree, QueryGraph, Relation


def relation(r: Relation, graph: QueryGraph, tree: JoinTree | None = None) -> dict:
    out = {"name": r.name, "type": r.kind, "columns": [f"v{v}" for v in sorted(r.variables)]}
    if r.members:
        out["internal"] = [m.name for m in r.members]
    if r.cardinality:
        out["cardinality"] = r.cardinality
    if tree is not None:
        out["reserves"] = [f"v{v}" for v in sorted(tree.reserved(r))]
    return out


def tree(t: JoinTree, graph: QueryGraph) -> dict:
    """A candidate: nodes, edges with key types, root, the enumerated subset, comparisons with their paths, residual conditions."""
    return {
        "relations": [relation(n, graph, t) for n in t.nodes],
        "edges": [{"src": p.name, "dst": c.name, "key": t.key_type(p, c)} for p, c in t.edges],
        "root": t.root.name,
        "subset": sorted(n.name for n in t.connex),
        "comparisons": [
            {"text": c.text, "operator": c.op, "left": sorted(c.left), "right": sorted(c.right), "path": [f"{p.name}->{x.name}" for p, x in places(t, c)]} for c in graph.comparisons
        ],
        "extraConditions": [c.text for c in graph.residual],
        "fixRoot": t.fixed_root,
        "degree": degree(t, graph.comparisons),
        "bergeAcyclic": berge_acyclic(t, graph.comparisons),
    }


def plan(graph: QueryGraph, trees: list[JoinTree]) -> dict:
    return {
        "isFull": graph.full,
        "outputVariables": [f"v{v}" for v in sorted(graph.output)],
        "groupByVariables": None if graph.grouping is None else [f"v{v}" for v in sorted(graph.grouping)],
        "joinTrees": [tree(t, graph) for t in trees],
    }
