"""From a join tree to DataFrame operations: reduce bottom-up, then enumerate top-down.

Reduction removes rows that can't be in an answer and never changes how often a row counts: a child restricts its parent by
a semi-join, or, where an order comparison has one side below the edge, by the least or greatest value of that side per join
key, which is filtered at once if the other side is there and travels on upwards if not. Enumeration joins the reduced relations of
the connex part from the root down and applies every comparison again.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import joins
from .frontend import Condition, Core
from .model import JoinTree, Relation


TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _sides(c: Condition, low: frozenset[str], high: frozenset[str]) -> tuple | None:
    """The comparison's (smaller, greater) side, if they lie in those relations."""
    smaller, greater = (c.left, c.right) if c.comparison.op in ("<", "<=") else (c.right, c.left)
    of = (c.comparison.left, c.comparison.right) if c.comparison.op in ("<", "<=") else (c.comparison.right, c.comparison.left)
    return (smaller, greater) if of[0] <= low and of[1] <= high else None


@dataclass
class Part:
    """A node's rows so far. attributes: variable -> column names; names: the leaves whose columns it has;
    carried: columns with extremes of comparison sides from below."""

    frame: DataFrame
    attributes: dict[int, list[str]]
    names: frozenset[str]
    carried: dict[int, str] = field(default_factory=dict)
    below: frozenset[str] = frozenset()  # leaves in the subtree so far
    auxiliary: bool = False  # a projection, which meets its own relation on columns that may be null
    unique: frozenset[int] = frozenset()  # variables of which no two rows have the same values, as an aggregate made them


class Lowering:
    def __init__(self, core: Core, tree: JoinTree):
        self.core, self.tree = core, tree
        self.exact: set[int] = set()  # comparisons that reduction applies in full
        self.parts: dict[Relation, Part] = {}
        self.blurred: set[int] = set()  # comparisons that shared an edge, so that one extreme each can't settle them together
        self.made = 0
        self.top = None if core.distinct else core.top()
        self.bests: dict[Relation, str] = {}  # node -> its parent's column with the best sum of terms below

    # -- leaves

    def column(self, expression) -> Column:
        return self.core.bridge.column(expression)

    def leaf(self, name: str) -> tuple[DataFrame, dict[int, list[str]]]:
        """A leaf's rows after its own conditions, and its column names by variable."""
        leaf, wanted = self.core.leaves[name], self._wanted(name)
        frame = self.core.bridge.named(self.core.bridge.frame(leaf.plan), list(leaf.attributes.values()))
        for e in leaf.filters:
            frame = frame.where(self.column(e))
        by_variable, uses = self.core.attributes(name), self._uses()
        for v, (i, *more) in by_variable.items():
            if uses[v] > 1:  # a null joins nothing
                frame = frame.where(F.col(f"c{i}").isNotNull())
            for j in more:  # a column that equals another of the same relation
                frame = frame.where(F.col(f"c{i}") == F.col(f"c{j}"))
        kept = {v: names for v, ids in by_variable.items() if (names := [f"c{i}" for i in ids if i in wanted])}
        return frame.select(*(n for names in kept.values() for n in names)), kept

    def _wanted(self, name: str) -> set[int]:
        """Expression ids of a leaf that joins, comparisons or the nodes above read."""
        own = self.core.leaves[name].attributes
        shared = {v for v, n in self._uses().items() if n > 1}
        read = {i for c in self.core.conditions for i in joins.ids(c.expression.references())}
        found = {i for i in own if self.core.variable[i] in shared or i in read or i in self.core.needed}
        return found or set(list(own)[:1])

    def _uses(self) -> dict[int, int]:
        count: dict[int, int] = {}
        for r in self.core.graph.relations:
            for v in r.variables:
                count[v] = count.get(v, 0) + 1
        return count

    def node(self, relation: Relation) -> Part:
        if relation.kind == "auxiliary":
            one = next((m for m in relation.leaves() if relation.variables <= m.variables), None)
            part = self.node(relation.members[0]) if one is None else Part(*self.leaf(one.name), frozenset())
            frame, attributes = part.frame, part.attributes
            kept = {v: names[0] for v, names in attributes.items() if v in relation.variables}
            frame = frame.select(*(F.col(n).alias(f"a{n}") for n in kept.values())).distinct()
            return Part(frame, {v: [f"a{n}"] for v, n in kept.items()}, frozenset(), auxiliary=True, unique=frozenset(kept))
        names = [m.name for m in relation.leaves()]
        made = {}
        for name in joins.connected_order([(m.name, m.variables) for m in relation.leaves()]):
            frame, attributes = self.leaf(name)
            unique = frozenset(self.core.variable[i] for i in self.core.leaves[name].unique)
            made[name] = Part(frame, attributes, frozenset([name]), {}, frozenset([name]), unique=unique)
        part = self.triangle(list(made.values())) or reduce(self.joined, made.values())
        if len(names) > 1:
            part.frame = self._filtered(part.frame, [c for c in self.core.conditions if c.comparison.ends <= part.names])
        return part

    # -- joins

    def on(self, a: Part, b: Part) -> list[tuple[Column, Column]]:
        return [(F.col(a.attributes[v][0]), F.col(b.attributes[v][0])) for v in sorted(a.attributes.keys() & b.attributes.keys())]

    def triangle(self, parts: list[Part]) -> Part | None:
        """Three parts of which each two share variables that the third hasn't, joined in the worst-case-optimal bound."""
        if len(parts) != 3:
            return None
        shared = [a.attributes.keys() & b.attributes.keys() for a, b in zip(parts, [*parts[1:], parts[0]], strict=True)]
        if not all(shared) or any(x & y for x, y in zip(shared, [*shared[1:], shared[0]], strict=True)):
            return None
        r, s, t = parts
        frame = joins.triangle(r.frame, s.frame, t.frame, self.on(r, s), self.on(s, t), self.on(t, r))
        every = {v: [n for p in parts for n in p.attributes.get(v, [])] for p in parts for v in p.attributes}
        return Part(frame, every, r.names | s.names | t.names, {}, r.below | s.below | t.below)

    def band(self, a: Part, b: Part) -> tuple[Column, Column, object, bool, bool] | None:
        """(low, at, width, whether in time, whether b is the low side) of two comparisons low <= at and at <= low + width between the parts."""
        known = [c for c in self.core.conditions if c.comparison.op and c.comparison.ends <= a.names | b.names]
        for x in known:
            for y in known:
                for turned, (p, q) in enumerate(((a, b), (b, a))):
                    below, above = _sides(x, p.names, q.names), _sides(y, q.names, p.names)
                    if below and above and below[1].semanticEquals(above[0]) and (width := self.core.bridge.step(below[0], above[1])):
                        return self.column(below[0]), self.column(below[1]), *width, bool(turned)
        return None

    def joined(self, a: Part, b: Part) -> Part:
        on, band = self.on(a, b), self.band(a, b)
        if band and on:
            low, at, width, moment, turned = band
            frame = joins.inner_band(b.frame, a.frame, [(y, x) for x, y in on], low, at, width, moment) if turned else joins.inner_band(a.frame, b.frame, on, low, at, width, moment)
        else:
            frame = joins.inner(a.frame, b.frame, on)
        both = {v: a.attributes.get(v, []) + b.attributes.get(v, []) for v in {**a.attributes, **b.attributes}}
        return Part(frame, both, a.names | b.names, {}, a.below | b.below)

    def _filtered(self, frame: DataFrame, conditions: list[Condition]) -> DataFrame:
        return reduce(lambda f, c: f.where(self.column(c.expression)), conditions, frame)

    # -- reduction

    def side(self, condition: Condition, part: Part, subtree: frozenset[str]) -> tuple[Column, bool] | None:
        """(value, whether smaller is better) of the side that lies in the subtree, if just one does and it is at hand."""
        c = condition.comparison
        if c.op is None:
            return None
        left, right = c.left <= subtree, c.right <= subtree
        if left == right:
            return None
        names, expression = (c.left, condition.left) if left else (c.right, condition.right)
        if c.number in part.carried:
            value = F.col(part.carried[c.number])
        elif names <= part.names:
            value = self.column(expression)
        else:
            return None
        return value, (c.op in ("<", "<=")) == left

    def compare(self, condition: Condition, low_or_high: Column, subtree: frozenset[str], other: Column) -> Column:
        c = condition.comparison
        a, b = (low_or_high, other) if c.left <= subtree else (other, low_or_high)
        return joins.COMPARE[c.op](a, b)

    def far_side(self, condition: Condition, part: Part, subtree: frozenset[str]) -> Column | None:
        """The other side's value, if the parent has it."""
        c = condition.comparison
        names, expression = (c.right, condition.right) if c.left <= subtree else (c.left, condition.left)
        if names <= part.names:
            return self.column(expression)
        return F.col(part.carried[c.number]) if names <= part.below and c.number in part.carried else None

    def worth(self, node: Relation, part: Part, below: list[Relation]) -> Column:
        """The greatest sum of terms that a row of a node can reach: its own, and the best of these children."""
        terms = [self.column(e).cast("double") for e, name in self.top[0] if name in part.names]
        return reduce(lambda x, y: x + y, [*terms, *(F.col(self.bests[c]) for c in below)], F.lit(0.0))

    def fold_best(self, p: Relation, c: Relation) -> Part:
        """p's part, with the best sum of terms below the edge to c, and without rows that nothing there fits."""
        parent, child = self.parts[p], self.parts[c]
        self.bests[c] = f"best{len(self.bests)}"
        frame = joins.best_below(parent.frame, child.frame, self.on(parent, child), self.worth(c, child, self.tree.children(c)), self.bests[c])
        return Part(frame, parent.attributes, parent.names, {}, parent.below | child.below, parent.auxiliary, parent.unique)

    def fold(self, parent: Part, child: Part) -> Part:
        """parent, without rows that no row below the edge fits."""
        subtree = child.below
        pending = [(c, s) for c in self.core.conditions if c.comparison.number not in self.exact and (s := self.side(c, child, subtree))]
        keys = self.on(parent, child)
        out = Part(parent.frame, parent.attributes, parent.names, dict(parent.carried), parent.below | child.below, parent.auxiliary, parent.unique)
        nulls = parent.auxiliary or child.auxiliary
        spanning = [c for c in self.core.conditions if c.comparison.number not in self.exact and c.comparison.ends & subtree and not c.comparison.ends <= subtree]
        unique = bool(child.unique) and child.unique <= parent.attributes.keys() & child.attributes.keys()
        ends = len(pending) == len(spanning) > 1 and all(self.far_side(c, parent, subtree) is not None for c, _ in pending)
        if ends and len(pending) == 2 and keys:
            pair = [(s[0], c.comparison.op if c.comparison.left <= subtree else TURNED[c.comparison.op], self.far_side(c, parent, subtree)) for c, s in pending]
            out.frame = joins.semi_two(parent.frame, child.frame, keys, *pair, nulls)
            self.exact.update(c.comparison.number for c, _ in pending)
        elif ends:
            extra = [self.compare(c, s[0], subtree, self.far_side(c, parent, subtree)) for c, s in pending]
            out.frame = joins.semi(parent.frame, child.frame, keys, extra, nulls)
            self.exact.update(c.comparison.number for c, _ in pending)
        elif pending:
            (c, (value, least)) = pending[0]
            number = c.comparison.number
            self.made += 1
            name = f"x{self.made}"
            frame = joins.extreme(parent.frame, child.frame, keys, value, least, name, nulls, unique)
            far = self.far_side(c, parent, subtree)
            if far is None:
                out.frame, out.carried[number] = frame, name
            else:
                out.frame = frame.where(self.compare(c, F.col(name), subtree, far)).drop(name)
                out.carried.pop(number, None)
                if len(pending) == len(spanning) == 1:
                    self.exact.add(number)
        else:
            out.frame = joins.semi(parent.frame, child.frame, keys, (), nulls, unique)
        if pending and len(spanning) > 1:
            self.blurred.update(c.comparison.number for c in spanning)
        return out

    def reduce(self) -> None:
        self.parts = {n: self.node(n) for n in self.tree.nodes}
        for p, c in reversed(self.tree.edges):
            self.parts[p] = self.fold_best(p, c) if self.top else self.fold(self.parts[p], self.parts[c])

    def settled(self) -> bool:
        """Whether reduction has applied every comparison that enumeration of the connex part can't apply again."""
        inside = frozenset(m.name for n in self.tree.connex if n.kind != "auxiliary" for m in n.leaves())
        return all(c.comparison.ends <= inside or c.comparison.number in self.exact - self.blurred for c in self.core.conditions)

    # -- enumeration

    def enumerate(self) -> DataFrame:
        order = [n for n in self.tree.nodes if n in self.tree.connex]
        part, done = self.parts[order[0]], set()
        if self.top:  # a root row reaches its bound, so answers below the k-th bound aren't wanted
            part.frame = joins.at_least_kth(part.frame, self.worth(order[0], part, self.tree.children(order[0])), self.top[1])
        for k, n in enumerate([*order[1:], None]):
            if self.top and k:
                here = set(order[: k + 1])
                part.frame = joins.above_kth(part.frame, self.worth(order[k], part, [c for p, c in self.tree.edges if p in here and c not in here]))
            ready = [c for c in self.core.conditions if c.comparison.ends <= part.names and c.comparison.number not in done]
            done.update(c.comparison.number for c in ready)
            part.frame = self._filtered(part.frame, ready)
            if n is not None:
                part = self.joined(part, self.parts[n])
        return self.complete(part)

    def complete(self, part: Part) -> DataFrame:
        """The needed columns; a column of a relation that isn't there is one that equals it."""
        names = {i: part.attributes[self.core.variable[i]] for i in self.core.needed}
        return part.frame.select(*(F.col(f"c{i}" if f"c{i}" in n else n[0]).alias(f"c{i}") for i, n in names.items()))


def lower(core: Core, tree: JoinTree) -> DataFrame | None:
    """The whole query by reduction over the tree; None if a comparison can't be settled that way.

    Where duplicates of an answer don't matter only the connex part is enumerated; else every relation is.
    """
    everything = JoinTree(tree.root, tree.edges, frozenset(n for n in tree.nodes if n.kind != "auxiliary"), tree.fixed_root)
    if not core.distinct:
        tree = everything
    plan = Lowering(core, tree)
    plan.reduce()
    if not plan.tree.connex or not plan.settled():
        if tree.root.kind == "auxiliary":
            return None
        plan.tree = everything
    found = plan.enumerate()
    return core.rebuilt(found.distinct() if core.distinct else found)
