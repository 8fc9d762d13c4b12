"""Parent-child edges of unknown depth to full hierarchies.

Method: bottom-up peeling. In each round the nodes without remaining children leave and send
what hangs from them, as rows, to their parents: themselves and their list of descendants, from which subtree sizes follow.
Where a round takes little (long thin chains), the chains are contracted first: nodes with one remaining child and one
remaining parent are ranked by pointer doubling, send their lists to the top of their chain and are replaced by one
weighted edge, so the number of rounds follows the logarithm of the size in trees, not the depth. What can't be peeled
contains the cycles: chains that never end are cycles, the rest is split by colouring. A cycle's edges out of it are then
given a port that collects all items of the cycle and their lists, and the peeling goes on above it. The steps in reverse
assign paths and depths from the roots down, and complete the lists of contracted chains.

Rounds are Spark jobs while more than ``local_edges`` edges remain (0: to the end). The rest, of that proven size, is peeled
by one task in the same way: leaf by leaf, lists sent upwards, ports on cycles, paths in reverse.

Defined results
  * Ends are compared as given; null ends are ignored; repeated edges count once; an edge to itself is a cycle.
  * A node with several parents (the graph is then no tree) keeps every parent in ``closure``; its path follows the
    parent of least depth, ties broken by the smallest id.
  * Nodes on a cycle are named with ``on_cycle`` and have no root, depth, path or descendants. Nodes below a cycle start a
    path of their own (``root`` is the topmost ancestor that is below the cycle). Ancestors of a cycle are ordinary
    nodes; the items of the cycle and all below them are their descendants.
  * No edges, no rows.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, release, ship

#: Chains are contracted once a round takes less than this share of the edges.
THIN = 0.15
#: Edges that one task may finish.
LOCAL_EDGES = 20_000
#: Chain positions in one join key: a long chain is spread over so many keys.
STRETCH = 1024
_PORT = "\0"  # opens the name of a port; no node has it


def _distinct_edges(edges: DataFrame, child: str, parent: str) -> DataFrame:
    return edges.select(F.col(child).cast("string").alias("child"), F.col(parent).cast("string").alias("parent")).na.drop().distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _is_port(c: str) -> Column:
    return F.col(c).startswith(_PORT)


def _chains(live: DataFrame, fixed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(members, loops) of the live graph. members (v, up, w, via, top, d): nodes with one child and one parent, with the
    top of their chain and the distance to it; loops (v): such nodes whose chain never ends. ``fixed`` nodes take no part."""
    ends = live.select(F.col("child").alias("v"), F.lit(1).alias("u"), F.lit(0).alias("k"), F.struct("parent", "w", "via").alias("e"))
    ends = ends.unionByName(live.select(F.col("parent").alias("v"), F.lit(0).alias("u"), F.lit(1).alias("k"), F.lit(None).cast(ends.schema["e"].dataType).alias("e")))
    one = ends.groupBy("v").agg(F.sum("u").alias("u"), F.sum("k").alias("k"), F.max("e").alias("e")).filter(f"u = 1 and k = 1 and not startswith(v, '{_PORT}')")
    if fixed is not None:
        one = one.join(fixed.select(F.col("node").alias("v")), "v", "left_anti")
    unary = materialise(one.select("v", F.col("e.parent").alias("up"), F.col("e.w").alias("w"), F.col("e.via").alias("via")))
    here = unary.select(F.col("v").alias("up"), F.lit(False).alias("last"))
    jumps = materialise(unary.join(here, "up", "left").select("v", F.coalesce("last", F.lit(True)).alias("done"), F.when(F.col("last").isNull(), F.col("v")).otherwise(F.col("up")).alias("to"), F.when(F.col("last").isNull(), 0).otherwise(F.col("w")).alias("d")))
    finished, left = jumps.agg(F.count_if("done"), F.count_if(~F.col("done"))).first()
    while left:
        step = jumps
        for _ in range(2):  # two doublings a job
            there = step.select(F.col("v").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"), F.col("done").alias("done2"))
            step = step.join(there, "to").select("v", (F.col("done") | F.col("done2")).alias("done"), F.col("to2").alias("to"), F.when(F.col("done"), F.col("d")).otherwise(F.col("d") + F.col("d2")).alias("d"))
        new = materialise(step)
        release(jumps)
        jumps = new
        before = finished
        finished, left = jumps.agg(F.count_if("done"), F.count_if(~F.col("done"))).first()
        if finished == before:  # a chain that ends has nodes at every distance, so the others never end
            break
    members = materialise(unary.join(jumps.filter("done").select("v", F.col("to").alias("top"), "d"), "v"))
    loops = materialise(jumps.filter("not done").select("v"))
    release(unary, jumps)
    return members, loops


def _contract(live: DataFrame, members: DataFrame, loops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(live graph without the chains, chains (top, child, parent, length to the parent, w, via))."""
    out = F.array_sort(F.collect_list(F.struct("d", "v", "via")))
    inner = F.flatten(F.transform(out, lambda x: F.concat(x["via"], F.array(x["v"]))))
    ends = members.groupBy("top").agg(F.max(F.struct("d", "v")).alias("b"), F.max(F.when(F.col("v") == F.col("top"), F.struct(F.col("up").alias("parent"), F.col("w").alias("wt")))).alias("t"), inner.alias("inner"))
    low = live.select("child", F.col("parent").alias("bottom"), F.col("w").alias("wc"), F.col("via").alias("vc"))
    chains = materialise(
        ends.select("top", F.col("b.v").alias("bottom"), F.col("b.d").alias("d"), "t.parent", "t.wt", "inner").join(low, "bottom")
        .select("top", "child", "parent", "wt", (F.col("wt") + F.col("d") + F.col("wc")).alias("w"), F.concat("inner", "vc").alias("via"))
    )
    gone = members.select("v").union(loops)
    rest = live.join(gone.withColumnRenamed("v", "child"), "child", "left_anti").join(gone.withColumnRenamed("v", "parent"), "parent", "left_anti")
    return materialise(rest.select("child", "parent", "w", "via").unionByName(chains.select("child", "parent", "w", "via"))), chains


def _trim_above(edges: DataFrame) -> DataFrame:
    """Take away, round by round, nodes without remaining parents: they can't be on a cycle."""
    before = edges.count()
    while True:
        kept = materialise(edges.join(edges.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("child", "parent"))
        if (now := kept.count()) == before:
            return kept
        edges, before = kept, now


def _components(edges: DataFrame) -> DataFrame:
    """(node, part): nodes on cycles and their strongly connected component. Colouring: the greatest id that reaches a
    node over child -> parent edges colours it; a colour's own node and what reaches it back inside the colour is one
    component. Found components leave, the rest is coloured anew. Each pass is a join; nothing is collected."""
    found: list[DataFrame] = []
    edges = _trim_above(edges.select("child", "parent").distinct())
    while not edges.isEmpty():
        nodes = edges.select(F.col("child").alias("n")).union(edges.select(F.col("parent").alias("n"))).distinct()
        colour = materialise(nodes.select("n", F.col("n").alias("c")))
        while True:
            new = colour
            for _ in range(2):
                sent = edges.join(new.withColumnRenamed("n", "child"), "child").select(F.col("parent").alias("n"), "c")
                new = new.union(sent).groupBy("n").agg(F.max("c").alias("c"))
            new = materialise(new)
            done = new.join(colour, ["n", "c"], "left_anti").isEmpty()
            release(colour)
            colour = new
            if done:
                break
        within = edges.join(colour.withColumnsRenamed({"n": "child", "c": "cc"}), "child").join(colour.withColumnsRenamed({"n": "parent", "c": "pc"}), "parent").filter("cc = pc")
        inside = materialise(within.select("child", "parent", F.col("cc").alias("c")))
        reached = materialise(inside.filter("parent = c").select(F.col("child").alias("n"), "c").distinct())
        size = reached.count()
        while True:
            more = inside.join(reached.select(F.col("n").alias("parent"), "c"), ["parent", "c"]).select(F.col("child").alias("n"), "c")
            new = materialise(reached.union(more).distinct())
            now = new.count()
            release(reached)
            reached = new
            if now == size:
                break
            size = now
        found.append(reached.select(F.col("n").alias("node"), F.col("c").alias("part")))
        heads = colour.filter("n = c").select("n").union(reached.select("n")).distinct()
        left = edges.join(heads.withColumnRenamed("n", "child"), "child", "left_anti").join(heads.withColumnRenamed("n", "parent"), "parent", "left_anti").select("child", "parent")
        edges = _trim_above(materialise(left))
    return materialise(_union(found)) if found else materialise(edges.select(F.col("child").alias("node"), F.col("child").alias("part")))


def _ports(live: DataFrame, cyclic: DataFrame) -> DataFrame:
    """The live graph with the inner edges of each component replaced by edges from its items to a port for each item
    that an outer parent hangs on, weighted by their distance inside. The graph is free of cycles then."""
    c = cyclic.select(F.col("node").alias("child"), F.col("part").alias("cp"))
    p = cyclic.select(F.col("node").alias("parent"), F.col("part").alias("pp"))
    marked = materialise(live.join(c, "child", "left").join(p, "parent", "left").withColumn("same", F.coalesce(F.col("cp") == F.col("pp"), F.lit(False))))
    outer = marked.filter("cp is not null and not same")
    exits = outer.select(F.col("child").alias("exit"), F.col("cp").alias("part")).distinct()
    inner = marked.filter("same").join(exits.select(F.col("part").alias("cp")).distinct(), "cp", "left_semi")
    near = materialise(inner.filter("child <> parent").groupBy(F.col("parent").alias("a"), F.col("child").alias("x")).agg(F.min("w").alias("k")))
    size = near.count()
    while size:
        right = near.select(F.col("a").alias("x"), F.col("x").alias("y"), F.col("k").alias("k2"))
        further = near.join(right, "x").filter("a <> y").select("a", F.col("y").alias("x"), (F.col("k") + F.col("k2")).alias("k"))
        new = materialise(near.unionByName(further).groupBy("a", "x").agg(F.min("k").alias("k")))
        same = new.join(near, ["a", "x", "k"], "left_anti").isEmpty()
        release(near)
        near = new
        if same:
            break
    none = F.array().cast("array<string>").alias("via")
    to_port = near.join(exits.select(F.col("exit").alias("a")).distinct(), "a", "left_semi").select(F.col("x").alias("child"), "a", F.col("k").alias("w"))
    to_port = to_port.unionByName(exits.select(F.col("exit").alias("child"), F.col("exit").alias("a"), F.lit(0).alias("w")).distinct())
    kept = marked.filter("cp is null").select("child", "parent", "w", "via")
    kept = kept.unionByName(to_port.select("child", F.concat(F.lit(_PORT), "a").alias("parent"), "w", none))
    out = materialise(kept.unionByName(outer.select(F.concat(F.lit(_PORT), "child").alias("child"), "parent", "w", "via")))
    release(marked, near)
    return out


def _strong_parts(nodes: list[str], up: dict[str, list]) -> dict[str, str]:
    """Node -> component, of nodes that reach themselves, with an explicit stack."""
    inside, order, low, stack, held = set(nodes), {}, {}, [], set()
    parts: dict[str, str] = {}
    for first in nodes:
        work = [] if first in order else [(first, iter(up.get(first, ())))]
        if work:
            order[first] = low[first] = len(order)
            stack.append(first)
            held.add(first)
        while work:
            v, rest = work[-1]
            for w, *_ in rest:
                if w in inside and w not in order:
                    order[w] = low[w] = len(order)
                    stack.append(w)
                    held.add(w)
                    work.append((w, iter(up.get(w, ()))))
                    break
                if w in held:
                    low[v] = min(low[v], order[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == order[v]:
                    members = []
                    while not members or members[-1] != v:
                        members.append(stack.pop())
                    held.difference_update(members)
                    if len(members) > 1 or any(w == v for w, *_ in up.get(v, ())):
                        parts.update(dict.fromkeys(members, max(members)))
    return parts


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


class _Core:
    """The same peeling in one task over at most ``local_edges`` edges."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.up: dict[str, list[tuple[str, int, list[str]]]] = defaultdict(list)
        nodes: dict[str, None] = {}
        for batch in batches:
            for c, p, w, via in zip(*(column.to_pylist() for column in batch.columns)):
                self.up[c].append((p, w, via))
                nodes[c] = nodes[p] = None
        self.order: list[str] = []
        self.kids = Counter(p for rows in self.up.values() for p, *_ in rows)
        self.parts: dict[str, str] = {}
        self._drain(list(nodes))
        gone = set(self.order)
        left = [n for n in nodes if n not in gone]
        self.parts = _strong_parts(left, self.up)
        if self.parts:
            self._open_cycles()
            left += [n for n in self.up if n.startswith(_PORT)]
            self.kids = Counter(p for n in left for p, *_ in self.up.get(n, ()))
            self._drain(left)

    def _drain(self, nodes: list[str]) -> None:
        queue = [n for n in nodes if not self.kids[n]]
        while queue:
            v = queue.pop()
            self.order.append(v)
            for p, *_ in self.up.get(v, ()):
                self.kids[p] -= 1
                if not self.kids[p]:
                    queue.append(p)

    def _open_cycles(self) -> None:
        inner: dict[str, list[tuple[str, int]]] = defaultdict(list)  # parent -> children of its component
        outer: dict[str, list[tuple[str, int, list[str]]]] = defaultdict(list)
        for c in self.parts:
            for p, w, via in self.up.get(c, ()):
                if self.parts.get(p) == self.parts[c]:
                    inner[p].append((c, w))
                else:
                    outer[c].append((p, w, via))
            self.up[c] = []
        for s, edges in outer.items():
            near, heap = {}, [(0, s)]
            while heap:
                d, v = heapq.heappop(heap)
                if v not in near:
                    near[v] = d
                    for c, w in inner[v]:
                        heapq.heappush(heap, (d + w, c))
            for x, d in near.items():
                self.up[x].append((_PORT + s, d, []))
            self.up[_PORT + s] = edges

    def cycles(self) -> Iterator[pa.RecordBatch]:
        yield _batch(node=pa.array(list(self.parts), pa.string()), part=pa.array(list(self.parts.values()), pa.string()))

    def pairs(self) -> Iterator[pa.RecordBatch]:
        """Lists inside the core; a list is dropped once its parents have it."""
        lists: dict[str, dict[str, int]] = defaultdict(dict)
        a, x, k = [], [], []
        for v in self.order:
            own = lists.pop(v, {})
            if v not in self.parts:
                a += [v] * len(own)
                x += own
                k += own.values()
            sent = own if v.startswith(_PORT) else {v: 0, **own}
            for p, w, _ in self.up.get(v, ()):
                to = lists[p]
                for y, d in sent.items():
                    if to.get(y, d + w + 1) > d + w:
                        to[y] = d + w
            if len(a) > 100_000:
                yield _batch(node=pa.array(a, pa.string()), x=pa.array(x, pa.string()), k=pa.array(k, pa.int32()))
                a, x, k = [], [], []
        yield _batch(node=pa.array(a, pa.string()), x=pa.array(x, pa.string()), k=pa.array(k, pa.int32()))

    def paths(self) -> Iterator[pa.RecordBatch]:
        path: dict[str, list[str]] = {}
        for v in reversed(self.order):
            if v not in self.parts and not v.startswith(_PORT):
                ways = [(len(path.get(p, ())) + len(via), via[-1] if via else p, path.get(p, []) + via) for p, _, via in self.up.get(v, ()) if p in path or via]
                path[v] = [*min(ways)[2], v] if ways else [v]
        rows = list(path.items())
        for i in range(0, len(rows), 1000):
            some = rows[i : i + 1000]
            yield _batch(node=pa.array([n for n, _ in some], pa.string()), path=pa.array([x for _, x in some], pa.list_(pa.string())))


def _run_core(batches: Iterator[pa.RecordBatch], what: str) -> Iterator[pa.RecordBatch]:
    yield from getattr(_Core(batches), what)()


class _Peeling:
    """All rounds over the edges; ``lists`` also sends lists of descendants."""

    def __init__(self, edges: DataFrame, lists: bool, local_edges: int):
        ship(edges.sparkSession)
        self.edges = materialise(edges)
        self.steps: list[tuple[str, DataFrame, DataFrame | None]] = []
        self.lists: list[DataFrame] = []
        cyclic: list[DataFrame] = []
        fixed = None
        live = materialise(self.edges.select("child", "parent", F.lit(1).alias("w"), F.array().cast("array<string>").alias("via")))
        n, barren = live.count(), False
        while n > local_edges:
            parents = live.select(F.col("parent").alias("child"), F.lit(True).alias("inner")).distinct()
            marked = materialise(live.join(parents, "child", "left").select("child", "parent", "w", "via", F.col("inner").isNull().alias("leaves")))
            release(live)
            gone = marked.agg(F.count_if("leaves")).first()[0]
            live = marked.filter("not leaves").drop("leaves")
            if gone:
                self._leave(marked.filter("leaves").drop("leaves"), lists)
            if n > gone and (gone == 0 or (gone < THIN * n and not barren)):
                members, loops = _chains(live, fixed)
                chained, looped = members.count(), loops.count()
                barren = not chained and not looped
                if not barren:
                    cyclic.append(loops.select(F.col("v").alias("node"), F.lit("").alias("part")))
                    rest, chains = _contract(live, members, loops)
                    if chained:
                        self._climb(members, chains, lists)
                    live = rest
                elif gone == 0:
                    fixed = _components(live)
                    cyclic.append(fixed)
                    live = _ports(live, fixed)
                n = live.count()
            else:
                n -= gone
        self.core = live.coalesce(1) if n else None
        if n:
            cyclic.append(self._in_core("cycles", "node string, part string"))
            if lists:
                pairs = materialise(self._in_core("pairs", "node string, x string, k int"))
                sent = pairs.select("node", F.col("x").alias("descendant"), F.col("k").alias("distance"))
                if self.lists:
                    own = _union(self.lists).join(pairs.select(F.col("x").alias("node"), F.col("node").alias("a"), "k"), "node")
                    sent = sent.unionByName(own.select(F.col("a").alias("node"), "descendant", (F.col("distance") + F.col("k")).alias("distance")))
                self.lists.append(materialise(sent.groupBy("node", "descendant").agg(F.min("distance").alias("distance"))))
        self.cyclic = self._cycle_members(cyclic)

    def _in_core(self, what: str, schema: str) -> DataFrame:
        return self.core.select("child", "parent", "w", "via").mapInArrow(partial(_run_core, what=what), schema)

    def _leave(self, removed: DataFrame, lists: bool) -> None:
        """Leaves send themselves and their lists to their parents."""
        self.steps.append(("leaves", removed, None))
        if lists:
            sent = removed.filter(~_is_port("child")).select(F.col("parent").alias("node"), F.col("child").alias("descendant"), F.col("w").alias("distance"))
            if self.lists:
                own = _union(self.lists).join(removed.select(F.col("child").alias("node"), "parent", "w"), "node")
                sent = sent.unionByName(own.select(F.col("parent").alias("node"), "descendant", (F.col("distance") + F.col("w")).alias("distance")))
            self.lists.append(materialise(sent.groupBy("node", "descendant").agg(F.min("distance").alias("distance"))))

    def _climb(self, members: DataFrame, chains: DataFrame, lists: bool) -> None:
        """Chains send themselves and their lists to the parent of their top."""
        self.steps.append(("chains", members, chains))
        if lists:
            up = members.select("v", "top", "d").join(chains.select("top", "parent", "wt"), "top").select(F.col("v").alias("node"), "parent", (F.col("d") + F.col("wt")).alias("w"))
            sent = up.select(F.col("parent").alias("node"), F.col("node").alias("descendant"), F.col("w").alias("distance"))
            if self.lists:
                own = _union(self.lists).join(up, "node").select(F.col("parent").alias("node"), "descendant", (F.col("distance") + F.col("w")).alias("distance"))
                sent = sent.unionByName(own)
            self.lists.append(materialise(sent.groupBy("node", "descendant").agg(F.min("distance").alias("distance"))))

    def _cycle_members(self, found: list[DataFrame]) -> DataFrame:
        """(node, part): all nodes on cycles; a contracted chain is on one if both of its ends are on the same."""
        if not found:
            return materialise(self.edges.limit(0).select(F.col("child").alias("node"), F.col("child").alias("part")))
        all_found = materialise(_union(found))
        for kind, members, chains in reversed(self.steps):
            if kind == "chains":
                c = all_found.select(F.col("node").alias("child"), F.col("part").alias("cp"))
                p = all_found.select(F.col("node").alias("parent"), F.col("part").alias("pp"))
                on = chains.join(c, "child").join(p, "parent").filter("cp = pp").select("top", F.col("cp").alias("part"))
                more = members.join(on, "top").select(F.col("v").alias("node"), "part")
                all_found = materialise(all_found.unionByName(more))
        return all_found

    def ordinary(self, members: DataFrame, chains: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members and chains that are on no cycle."""
        on = self.cyclic.select(F.col("node").alias("top"))
        return members.join(on, "top", "left_anti"), chains.join(on, "top", "left_anti")

    def descendants(self) -> DataFrame:
        """(node, descendant, distance), least distances; the steps in reverse complete the lists of chains."""
        ports = self.cyclic.select(F.col("node").alias("child"), F.lit(True).alias("cyc"))
        pieces = list(self.lists)
        sent_up = list(self.lists)
        for kind, members, chains in reversed(self.steps):
            if kind != "chains":
                continue
            members, chains = self.ordinary(members, chains)
            # What hangs from a chain's own nodes goes to the nodes above them; long chains in stretches.
            low = members.select(F.col("v").alias("node"), "top", F.col("d").alias("dl"))
            own = low.select("node", F.col("node").alias("descendant"), F.lit(0).alias("distance"))
            if sent_up:
                own = own.unionByName(_union(sent_up).join(low.select("node"), "node", "left_semi"))
            part = own.join(low, "node").withColumn("s", F.explode(F.sequence(F.lit(0), F.floor(F.col("dl") / STRETCH).cast("int"))))
            high = members.select(F.col("v").alias("above"), "top", F.col("d").alias("dh"), F.floor(F.col("d") / STRETCH).cast("int").alias("s"))
            up = part.join(high, ["top", "s"]).filter("dh < dl").select(F.col("above").alias("node"), "descendant", (F.col("distance") + F.col("dl") - F.col("dh")).alias("distance"))
            # And what hangs from its lowest child, complete by now, goes to all of them; a cycle is seen through its port.
            below = chains.join(ports, "child", "left").select("top", F.when(F.col("cyc"), F.concat(F.lit(_PORT), "child")).otherwise(F.col("child")).alias("node"), (F.col("w") - F.col("wt")).alias("to_top"))
            whole = below.filter(~_is_port("node")).select("top", F.col("node").alias("descendant"), "to_top").unionByName(_union(pieces).join(below, "node").select("top", "descendant", (F.col("to_top") + F.col("distance")).alias("to_top")))
            down = whole.join(members.select("v", "top", "d"), "top").select(F.col("v").alias("node"), "descendant", (F.col("to_top") - F.col("d")).alias("distance"))
            pieces.append(materialise(up.unionByName(down).groupBy("node", "descendant").agg(F.min("distance").alias("distance"))))
        if not pieces:
            return self.edges.limit(0).select(F.col("parent").alias("node"), F.col("child").alias("descendant"), F.lit(1).alias("distance"))
        every = _union(pieces).filter(~_is_port("node")).join(self.cyclic.select("node"), "node", "left_anti")
        return every.groupBy("node", "descendant").agg(F.min("distance").alias("distance"))

    def paths(self) -> DataFrame:
        """(node, path) of all nodes on no cycle, in reverse order of leaving: parents come before children."""
        off = self.cyclic.select("node")
        none = F.array().cast("array<string>")
        roots = self.edges.select(F.col("parent").alias("node")).distinct().join(self.edges.select(F.col("child").alias("node")), "node", "left_anti")
        done = [materialise(roots.select("node", F.array("node").alias("path")))]
        if self.core is not None:
            done.append(materialise(self._in_core("paths", "node string, path array<string>").join(roots, "node", "left_anti")))
        for kind, rows, chains in reversed(self.steps):
            known = _union(done).select(F.col("node").alias("parent"), F.col("path").alias("base"))
            if kind == "leaves":
                mine = rows.filter(~_is_port("child")).join(off.select(F.col("node").alias("child")), "child", "left_anti")
                head = F.coalesce("base", none)
                direct = F.when(F.size("via") > 0, F.element_at("via", -1)).otherwise(F.col("parent"))
                way = F.when(F.col("base").isNotNull() | (F.size("via") > 0), F.struct((F.size(head) + F.size("via")).alias("n"), direct.alias("by"), F.concat(head, "via").alias("before")))
                best = mine.join(known, "parent", "left").groupBy("child").agg(F.min(way).alias("b"))
                new = best.select(F.col("child").alias("node"), F.concat(F.coalesce("b.before", none), F.array("child")).alias("path"))
            else:
                members, chains = self.ordinary(rows, chains)
                order = members.groupBy("top").agg(F.array_sort(F.collect_list(F.struct("d", "v", "via"))).alias("m"))
                each = chains.join(known, "parent", "left").select("top", F.coalesce("base", none).alias("base")).join(order, "top").select("base", "m", F.posexplode("m").alias("i", "x"))
                before = F.flatten(F.transform(F.slice("m", 1, F.col("i") + 1), lambda x: F.concat(x["via"], F.array(x["v"]))))
                new = each.select(F.col("x.v").alias("node"), F.concat("base", before).alias("path"))
            done.append(materialise(new))
        return _union(done)


def cycle_nodes(edges: DataFrame, child: str = "child", parent: str = "parent", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node): every node that reaches itself over one or more edges."""
    peeling = _Peeling(_distinct_edges(edges, child, parent), False, local_edges)
    return peeling.cyclic.select("node").distinct()


def hierarchy(edges: DataFrame, child: str = "child", parent: str = "parent", sizes: bool = False, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, parent, root, depth, path, on_cycle), one row for each node of ``edges``, and with ``sizes`` n_descendants, the
    size of its subtree without itself (null on cycles); see the module text."""
    peeling = _Peeling(_distinct_edges(edges, child, parent), sizes, local_edges)
    rows = peeling.paths().select("node", "path", F.lit(False).alias("on_cycle"))
    out = rows.unionByName(peeling.cyclic.select("node", F.lit(None).cast("array<string>").alias("path"), F.lit(True).alias("on_cycle")).distinct())
    out = out.select(
        "node", F.when(F.size("path") > 1, F.element_at("path", -2)).alias("parent"), F.element_at("path", 1).alias("root"), F.when(F.col("path").isNotNull(), F.size("path") - 1).alias("depth"), "path", "on_cycle"
    )
    if sizes:
        counted = peeling.descendants().groupBy("node").agg(F.count("*").alias("n_descendants"))
        out = out.join(counted, "node", "left").withColumn("n_descendants", F.when(~F.col("on_cycle"), F.coalesce("n_descendants", F.lit(0))))
    return out


def closure(edges: DataFrame, child: str = "child", parent: str = "parent", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, descendant, distance): all descendants of every node that is on no cycle, over every parent, with the least
    distance. Lists travel as rows, never as one value, so a root above a third of all nodes stays a set of rows spread
    over all tasks."""
    return _Peeling(_distinct_edges(edges, child, parent), True, local_edges).descendants()
