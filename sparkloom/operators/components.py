"""Strongly connected components, and cycles that stand for them, by labels and tables of edges alone.

Paths without a choice are contracted first, by jumps that double, so a ring of any length takes a
logarithm of rounds. What is left is trimmed and coloured: the greatest node that reaches a node is its
colour, and what reaches that node backwards within its colour is a component. No table of pairs that
reach each other is ever made; the largest has a row for each edge or node.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored


def _renamed(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for new, old in names.items()])


@dataclass
class Jumps:
    """Where chains lead. ends: (node, to) for nodes whose chain leaves them; rings: (node, label) of
    closed chains, named by their least node; levels: (node, to) 1, 2, 4, … steps on, while inside."""

    ends: DataFrame
    rings: DataFrame
    levels: list[DataFrame]


def jumps(chain: DataFrame) -> Jumps:
    """Follows (node, next), one row for each node, to the first node that has no row of its own."""
    inside = chain.select(F.col("node").alias("next"), F.lit(True).alias("inside"))
    now = stored(chain.join(inside, "next", "left").select("node", F.col("next").alias("to"), F.col("inside").isNotNull().alias("open"), F.col("node").alias("least")))
    levels, n, before, reach = [], now.filter("open").count(), -1, 1
    while n and (n != before or reach < n):
        # A round that closes no chain leaves closed ones alone, and chains into them: jumps that reach
        # as far as there are nodes end inside the rings and have seen all of them.
        open_ = now.filter("open")
        levels.append(open_.select("node", "to"))
        further = open_.select("node", "to", F.col("least").alias("own")).join(_renamed(now, to="node", to2="to", open="open", least="least"), "to")
        now = stored(now.filter("not open").union(further.select("node", F.col("to2").alias("to"), "open", F.least("own", "least").alias("least"))))
        before, n, reach = n, now.filter("open").count(), 2 * reach
    closed = now.filter("open")
    rings = closed.join(closed.select(F.col("to").alias("node")).distinct(), "node", "left_semi").select("node", F.col("least").alias("label"))
    return Jumps(now.filter("not open").select("node", "to"), rings, levels)


@dataclass
class Contracted:
    """One contraction: entries (from, to) into chains from outside, and where the chains lead."""

    entries: DataFrame
    jumps: Jumps

    def expanded(self, labels: DataFrame) -> DataFrame:
        """Labels of the contracted graph, and of those chain nodes that lie between two of one label:
        such that an edge of that label enters the chain, and all that follow."""
        ends = _renamed(self.jumps.ends, to="node", end="to")
        seeds = self.entries.join(_renamed(labels, **{"from": "node", "label": "label"}), "from").join(ends, "to").join(_renamed(labels, end="node", label2="label"), "end")
        on = stored(seeds.filter("label = label2").select(F.col("to").alias("node"), "label").distinct())
        for level in self.jumps.levels if not on.isEmpty() else []:
            on = stored(on.union(on.join(level, "node").select(F.col("to").alias("node"), "label")).distinct())
        return labels.union(on).union(self.jumps.rings)


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, Contracted]:
    """(edges, loops, how): edges (from, to) without the nodes that one edge alone leaves: what enters
    them goes on to where their chain ends. An edge that comes back to its own node is a loop there."""
    single = edges.groupBy("from").agg(F.count("*").alias("n"), F.first("to").alias("next")).filter("n = 1")
    chain = stored(_renamed(single, node="from", next="next"))
    found = jumps(chain)
    outside = edges.join(_renamed(chain, **{"from": "node"}), "from", "left_anti")
    entries = stored(outside.join(_renamed(chain, to="node"), "to", "left_semi").select("from", "to"))
    direct = outside.join(_renamed(chain, to="node"), "to", "left_anti").select("from", "to")
    moved = entries.join(_renamed(found.ends, to="node", end="to"), "to").select("from", F.col("end").alias("to"))
    both = stored(direct.union(moved).distinct())
    return both.filter(F.col("from") != F.col("to")), both.filter(F.col("from") == F.col("to")).select(F.col("from").alias("node")), Contracted(entries, found)


def trimmed_once(edges: DataFrame) -> DataFrame:
    """Edges whose start is entered and whose end is left."""
    entered, left = edges.select(F.col("to").alias("from")).distinct(), edges.select(F.col("from").alias("to")).distinct()
    return stored(edges.join(entered, "from", "left_semi").join(left, "to", "left_semi").select("from", "to"))


def coloured(edges: DataFrame) -> DataFrame:
    """(node, label) of components of two nodes or more. Rounds grow with the longest shortest path
    inside what contraction and trimming have left."""
    out = edges.select(F.col("from").alias("node"), F.col("from").alias("label")).limit(0)
    while not edges.isEmpty():
        nodes = edges.select(F.col("from").alias("node")).union(edges.select("to")).distinct()
        colour, changed = stored(nodes.withColumn("label", F.col("node"))), True
        while changed:
            sent = edges.join(_renamed(colour, **{"from": "node", "label": "label"}), "from").groupBy(F.col("to").alias("node")).agg(F.max("label").alias("sent"))
            both = stored(colour.join(sent, "node", "left").select("node", F.greatest("label", "sent").alias("label"), F.coalesce(F.col("sent") > F.col("label"), F.lit(False)).alias("new")))
            changed = not both.filter("new").isEmpty()
            colour = both.select("node", "label")
        own = edges.join(_renamed(colour, **{"from": "node", "label": "label"}), "from").join(_renamed(colour, to="node", label2="label"), "to")
        own = stored(own.filter("label = label2").select("from", "to", "label"))
        front = found = stored(colour.filter("node = label"))
        while not front.isEmpty():  # backwards from each colour's greatest node
            front = own.join(front.select(F.col("node").alias("to")), "to").select(F.col("from").alias("node"), "label").distinct()
            front = stored(front.join(found, "node", "left_anti"))
            found = stored(found.union(front))
        out = out.union(found)
        rest = own.select("from", "to").join(_renamed(found, **{"from": "node"}), "from", "left_anti").join(_renamed(found, to="node"), "to", "left_anti")
        edges = trimmed_once(rest.select("from", "to"))
    sizes = out.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1").select("label")
    return out.join(sizes, "label", "left_semi").select("node", "label")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of (from, to) that reach themselves: two of them have one
    component if each reaches the other, and its name is its least node. Rows with a null are no edges;
    repeated ones count once."""
    every = stored(edges.filter("`from` is not null and `to` is not null").select("from", "to").distinct())
    loops = every.filter(F.col("from") == F.col("to")).select(F.col("from").alias("node"))
    now, steps, looped = every.filter(F.col("from") != F.col("to")), [], [loops]
    n, last = now.count(), 0
    while n and (not last or 2 * n <= last):  # a round that halves the graph is worth its jobs
        last = n
        now = trimmed_once(now)
        n = now.count()
        if 2 * n <= last:
            continue
        for _ in (0, 1) if n else ():  # nodes that one edge leaves, then nodes that one edge enters
            if now.isEmpty():
                break
            now, own, how = contracted(now)
            now = _renamed(now, **{"from": "to", "to": "from"})
            steps.append(how)
            looped.append(own)
        n = now.count()
    labels = stored(coloured(now)) if n else every.select(F.col("from").alias("node"), F.col("from").alias("label")).limit(0)
    for k in range(len(steps), -1, -1):  # loops of a graph, then what was contracted to make it
        alone = looped[k].join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
        labels = stored(labels.union(alone))
        if k:
            labels = stored(steps[k - 1].expanded(labels))
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return stored(labels.join(least, "label").select("node", "component").distinct())


def _choiceless(inner: DataFrame) -> DataFrame:
    """Edges (component, from, to, via) between nodes with a choice: those that one edge enters and one
    edge leaves are in `via`, in order. Each component's least node stays."""
    out, into = (inner.groupBy(F.col(c).alias("node")).agg(F.count("*").alias("n"), F.min("component").alias("component"), F.first(o).alias("other")).filter("n = 1") for c, o in (("from", "to"), ("to", "from")))
    plain = stored(out.join(into.select("node"), "node", "left_semi").filter("node != component").select("node", F.col("other").alias("to")))
    inside = plain.select(F.col("node").alias("to"), F.lit(True).alias("inside"))
    now = plain.join(inside, "to", "left").select("node", "to", F.col("inside").isNotNull().alias("open"), F.col("node").alias("last"), F.lit(1).cast("long").alias("hops"), F.lit(0).cast("long").alias("steps"))
    now = stored(now)
    while not now.filter("open").isEmpty():
        further = now.filter("open").select("node", "to", F.col("hops").alias("h")).join(_renamed(now, to="node", to2="to", open="open", last="last", hops="hops", steps="steps"), "to")
        further = further.select("node", F.col("to2").alias("to"), "open", "last", (F.col("h") + F.col("hops")).alias("hops"), (F.col("h") + F.col("steps")).alias("steps"))
        now = stored(now.filter("not open").union(further))
    walk = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("steps", "node")))), lambda x: x["node"])
    chains = now.groupBy("last", "to").agg(walk.alias("via")).select(F.col("via")[0].alias("entry"), F.col("to").alias("end"), "via")
    branching = inner.join(_renamed(plain, **{"from": "node"}), "from", "left_anti")
    direct = branching.join(_renamed(plain, to="node"), "to", "left_anti")
    kind = dict(inner.dtypes)["from"]
    through = branching.join(chains, F.col("to") == F.col("entry")).select("component", "from", F.col("end").alias("to"), "via")
    return stored(direct.select("component", "from", "to", F.array().cast(f"array<{kind}>").alias("via")).union(through))


def _paths(steps: DataFrame, roots: DataFrame, ahead: bool) -> DataFrame:
    """(component, node, path, edge): a path with the fewest edges from each component's root, the least
    of them, or to it (`ahead` false), and its edge at the node's end. Paths grow from a frontier."""
    start, end = ("from", "to") if ahead else ("to", "from")
    edge = F.struct("from", "to", "via")
    none = F.lit(None).cast(steps.select(edge.alias("e")).schema["e"].dataType)
    known = front = stored(roots.select("component", F.col("component").alias("node"), F.array("component").alias("path"), none.alias("edge")))
    while not front.isEmpty():
        grown = front.select(F.col("node").alias(start), "path").join(steps, start)
        path = F.concat("path", "via", F.array(end)) if ahead else F.concat(F.array(end), "via", "path")
        grown = grown.select("component", F.col(end).alias("node"), path.alias("path"), edge.alias("edge")).join(known.select("node"), "node", "left_anti")
        least = grown.groupBy("component", "node").agg(F.min(F.struct("path", "edge")).alias("p"))
        front = stored(least.select("component", "node", "p.path", "p.edge"))
        known = known.union(front)
    return known


def _from_least(cycle: Column) -> Column:
    """An open cycle from its least node on, closed."""
    at = F.array_position(cycle, F.array_min(cycle))
    turned = F.concat(F.slice(cycle, at, F.size(cycle)), F.slice(cycle, F.lit(1), at - 1))
    return F.array_append(turned, F.element_at(turned, 1))


def fundamental_cycles(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(cycle): simple cycles of any length, their least node first and last, that together hold every
    edge which a spanning tree of its component leaves out; loops are cycles of one. A component has at
    least one and at most edges - nodes + 1 of them. `members` are components, if they are known.

    The tree leads from the component's least node to the others; such an edge is closed by the tree
    to its start and by a way from its end back, cut where the two first meet.
    """
    members = components(edges) if members is None else members
    every = edges.filter("`from` is not null and `to` is not null").select("from", "to").distinct()
    own = every.join(_renamed(members, **{"from": "node", "component": "component"}), "from").join(_renamed(members, to="node", c2="component"), "to").filter("component = c2")
    own = stored(own.select("component", "from", "to"))
    loops = own.filter(F.col("from") == F.col("to")).select(F.array("from", "to").alias("cycle"))
    steps = _choiceless(own.filter(F.col("from") != F.col("to")))
    roots = steps.select("component").distinct()
    there, back = stored(_paths(steps, roots, True)), stored(_paths(steps, roots, False))
    edge = F.struct("from", "to", "via")
    left_out = steps.withColumn("edge", edge).join(there.select("edge").filter("edge is not null"), "edge", "left_anti").select("from", "to", "via")
    both = left_out.join(_renamed(there, **{"from": "node", "f": "path"}), "from").join(_renamed(back, to="node", b="path"), "to")
    both = both.withColumn("meet", F.element_at(F.array_intersect("b", "f"), 1))
    there_from = F.slice("f", F.array_position("f", F.col("meet")), F.size("f"))
    back_to = F.slice("b", F.lit(1), F.array_position("b", F.col("meet")) - 1)
    cycle = F.concat(there_from, F.col("via"), back_to)
    return stored(both.select(_from_least(cycle).alias("cycle")).distinct().union(loops))
