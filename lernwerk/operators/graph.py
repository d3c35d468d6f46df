"""Call graphs of many programs in one edge table (program, caller, callee)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, written

#: Steps of one call, one colour or one layer. A loop that is not done by then raises an error and gives no short result.
MOST_STEPS = 100_000
#: Programs with so many edges at most are worked out whole inside a task; larger ones by joins over all tasks.
MOST_LOCAL = 1 << 17


def call_edges(calls: DataFrame, ignored: list[str]) -> DataFrame:
    """Distinct calls with their number; calls outside any function belong to ``__main__``."""
    c = calls.withColumn("caller", F.coalesce("caller", F.lit("__main__"))).where(~F.col("callee").isin(*ignored))
    return c.groupBy("program", "caller", "callee", "line").agg(F.count("*").alias("hits"))


def reachable(edges: DataFrame, roots: DataFrame, refs: DataFrame | None = None, top_level: DataFrame | None = None, most_rounds: int = MOST_STEPS, most_local: int = MOST_LOCAL) -> DataFrame:
    """(program, node) reached from the roots, themselves included: inside a task in programs of ``most_local`` links at most, else a frontier at a time.

    ``refs`` are mentions (program, caller, callee), which propagate like calls. In a program without
    a root every function of ``top_level`` (program, node) is one, or every function where it has none there.
    """
    links = _links(edges, refs)
    calls = links.select("program", F.col("caller").alias("node"), "callee")
    roots = roots.select("program", "node")
    known = nodes(links)
    if top_level is not None:
        top = top_level.select("program", "node")
        known = known.join(top.select("program").distinct(), "program", "left_anti").unionByName(top)
    first = roots.unionByName(known.join(roots.select("program").distinct(), "program", "left_anti"))
    marked = calls.select("program", F.col("node").alias("caller"), "callee", F.lit(False).alias("root"))
    small, large = _by_size(marked, most_local)
    begun = first.distinct().select("program", F.col("node").alias("caller"), F.col("node").alias("callee"), F.lit(True).alias("root"))
    if large is not None:
        begun = cut(begun)
        named = large.select("program").distinct()
        far = _reached(large.select("program", F.col("caller").alias("node"), "callee"), begun.join(named, "program", "left_semi").select("program", F.col("caller").alias("node")), most_rounds)
        begun = begun.join(named, "program", "left_anti")
    near = _by_program(small.unionByName(begun), _reach, lambda node: f"node {node}")
    return near if large is None else near.unionByName(far)


def _reached(calls: DataFrame, roots: DataFrame, most_rounds: int) -> DataFrame:
    """The roots and all that ``calls`` (program, node, callee) reach from them, a frontier a round."""
    seen = frontier = cut(roots)
    for _ in range(most_rounds):
        step = frontier.join(calls, ["program", "node"]).select("program", F.col("callee").alias("node")).distinct()
        frontier = cut(step.join(seen, ["program", "node"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))
    raise RuntimeError(f"functions are still being reached after {most_rounds} rounds")


def _links(edges: DataFrame, refs: DataFrame | None) -> DataFrame:
    columns = ["program", "caller", "callee"]
    return edges.select(*columns) if refs is None else edges.select(*columns).unionByName(refs.select(*columns)).distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select("program", F.col("caller").alias("node")).unionByName(edges.select("program", F.col("callee").alias("node"))).distinct()


def dead_functions(edges: DataFrame, live: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """Functions that are not live, and why: never called, or called by dead code alone (which is listed). Those of ``refs`` are functions too."""
    dead = nodes(_links(edges, refs)).join(live, ["program", "node"], "left_anti")
    callers = edges.select("program", F.col("callee").alias("node"), F.col("caller")).where("node <> caller").groupBy("program", "node").agg(F.array_sort(F.collect_set("caller")).alias("callers"))
    out = dead.join(callers, ["program", "node"], "left")
    return out.select("program", "node", F.when(F.col("callers").isNull(), "never called").otherwise("called by dead code").alias("reason"), F.array_join(F.transform(F.coalesce("callers", F.array()), lambda c: c.cast("string")), ",").alias("callers"))


def recursive_functions(edges: DataFrame, most_local: int = MOST_LOCAL, most_rounds: int = MOST_STEPS) -> DataFrame:
    """Functions that call themselves, and those from which a cycle of several can be reached."""
    direct = edges.where("caller = callee").select("program", F.col("caller").alias("node")).distinct().withColumn("direct", F.lit(True))
    small, large = _by_size(edges.where("caller <> callee"), most_local)
    leads = _solved(small).where("leads").select("program", "node")
    if large is not None:
        several = coloured_clusters(large, most_rounds).withColumn("n", F.count("*").over(Window.partitionBy("program", "cluster"))).where("n > 1")
        back = large.select("program", F.col("callee").alias("node"), F.col("caller").alias("callee"))
        leads = leads.unionByName(_reached(back, several.select("program", "node"), most_rounds))
    return direct.join(leads.withColumn("indirect", F.lit(True)), ["program", "node"], "full_outer").fillna(False)


def clusters(edges: DataFrame, most_local: int = MOST_LOCAL, most_rounds: int = MOST_STEPS) -> DataFrame:
    """(program, node, cluster): functions that reach each other share the least of them as their cluster.

    Programs of ``most_local`` edges or fewer go to one task each, many to a batch; the others are coloured.
    """
    small, large = _by_size(edges, most_local)
    out = _solved(small).select("program", "node", "cluster")
    return out if large is None else out.unionByName(coloured_clusters(large, most_rounds))


def dependency_order(edges: DataFrame, most_rounds: int = MOST_STEPS, most_local: int = MOST_LOCAL) -> DataFrame:
    """(program, cluster, layer): callees first; a cluster's layer is its longest way down."""
    small, large = _by_size(edges, most_local)
    out = _solved(small).select("program", "cluster", "layer").distinct()
    return out if large is None else out.unionByName(_peeled(large, coloured_clusters(large, most_rounds), most_rounds))


def _by_size(edges: DataFrame, most_local: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges of programs of ``most_local`` edges at most, and those of others, if there are any."""
    e = edges.select("program", "caller", "callee", *[c for c in edges.columns if c == "root"])
    big = cut(e.groupBy("program").agg(F.count("*").alias("n")).where(F.col("n") > most_local).select(F.col("program").alias("big")))
    if (n := big.count()) == 0:
        return e, None
    named = F.col("program").eqNullSafe(F.col("big"))
    large = F.broadcast(big) if n <= MOST_STEPS else big
    return e.join(large, named, "left_anti"), cut(e.join(large, named, "left_semi").distinct())


def _components(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of each node's strongly connected component, callees first (depth first, without recursion)."""
    order = np.argsort(src, kind="stable")
    callees, first = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    at, low, found, part = first[:-1].copy(), [0] * n, [0] * n, [-1] * n
    seen, parts, open_ = 0, 0, []
    for root in range(n):
        if found[root]:
            continue
        path = [root]
        while path:
            v = path[-1]
            if not found[v]:
                seen += 1
                found[v] = low[v] = seen
                open_.append(v)
            if at[v] < first[v + 1]:
                w = callees[at[v]]
                at[v] += 1
                if not found[w]:
                    path.append(w)
                elif part[w] < 0:
                    low[v] = min(low[v], found[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == found[v]:
                while True:
                    w = open_.pop()
                    part[w] = parts
                    if w == v:
                        break
                parts += 1
    return np.array(part, np.int64), parts


def _solve(edges: pd.DataFrame) -> pd.DataFrame:
    """Every node of whole programs with its cluster, the cluster's layer, and whether a cycle of several can be reached."""
    programs, names = pd.factorize(edges["program"], use_na_sentinel=False)
    codes, labels = pd.factorize(pd.concat([edges["caller"], edges["callee"]]), sort=True)
    keys, ends = np.unique(np.concatenate([programs, programs]) * len(labels) + codes, return_inverse=True)
    src, dst = np.split(ends, 2)
    part, parts = _components(len(keys), src, dst)
    least = np.full(parts, len(labels))
    np.minimum.at(least, part, keys % len(labels))
    layer, leads = [0] * parts, (np.bincount(part, minlength=parts) > 1).tolist()
    up, down = part[src], part[dst]
    for i in np.lexsort((down, up)):  # callees have lower numbers, so theirs are settled
        a, b = up[i], down[i]
        if a != b:
            layer[a] = max(layer[a], layer[b] + 1)
            leads[a] = leads[a] or leads[b]
    return pd.DataFrame({"program": names[keys // len(labels)], "node": labels[keys % len(labels)], "cluster": labels[least[part]], "layer": np.array(layer, np.int32)[part], "leads": np.array(leads, bool)[part]})


def _reach(edges: pd.DataFrame) -> pd.DataFrame:
    """Nodes of whole programs that are reached from those of rows marked ``root``."""
    programs, names = pd.factorize(edges["program"], use_na_sentinel=False)
    codes, labels = pd.factorize(pd.concat([edges["caller"], edges["callee"]]), sort=True)
    keys, ends = np.unique(np.concatenate([programs, programs]) * len(labels) + codes, return_inverse=True)
    src, dst = np.split(ends, 2)
    order = np.argsort(src, kind="stable")
    first, callees = np.searchsorted(src[order], np.arange(len(keys) + 1)), dst[order]
    live, todo = np.zeros(len(keys), bool), np.unique(src[edges["root"].to_numpy(bool)])
    live[todo] = True
    todo = todo.tolist()
    while todo:
        v = todo.pop()
        more = callees[first[v] : first[v + 1]]
        more = np.unique(more[~live[more]])
        live[more] = True
        todo += more.tolist()
    found = keys[live]
    return pd.DataFrame({"program": names[found // len(labels)], "node": labels[found % len(labels)]})


def _by_program(edges: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], columns: Callable[[str], str]) -> DataFrame:
    """``work`` over programs that each fit into a task: their rows come sorted, and are worked on in runs of whole programs."""
    kinds = dict(edges.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            codes = pd.factorize(held["program"], use_na_sentinel=False)[0]
            if (done := codes != codes[-1:]).any():  # the last program may go on
                yield work(held[done])
                held = held[~done]
        if held is not None and len(held):
            yield work(held)

    return edges.repartition("program").sortWithinPartitions("program").mapInPandas(run, f"program {kinds['program']}, {columns(kinds['caller'])}")


def _solved(edges: DataFrame) -> DataFrame:
    return _by_program(edges, _solve, lambda node: f"node {node}, cluster {node}, layer int, leads boolean")


def _trimmed(e: DataFrame) -> DataFrame:
    """Edges between nodes that are both called and calling; what falls off lies on no cycle."""
    both = e.select("program", F.col("caller").alias("node")).intersect(e.select("program", F.col("callee").alias("node")))
    return written(e.join(both.withColumnRenamed("node", "caller"), ["program", "caller"], "left_semi").join(both.withColumnRenamed("node", "callee"), ["program", "callee"], "left_semi"))


def _contracted(e: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges with each path of thin nodes (one edge in, one out) as one edge; the thin nodes with the two ends of their path; and
    the nodes of cycles that are thin all round, with their cluster.

    Pointers along the paths double in every round. A thin node belongs to its ends' cluster if both have the same, else to none.
    """
    one = lambda side, other, name: e.groupBy("program", F.col(side).alias("node")).agg(F.count("*").alias("n"), F.min(other).alias(name)).where("n = 1").drop("n")
    thin = written(one("callee", "caller", "back").join(one("caller", "callee", "ahead"), ["program", "node"]).withColumn("low", F.col("node")))
    names = thin.select("program", F.col("node").alias("caller"))
    wide = e.join(names, ["program", "caller"], "left_anti").join(names.withColumnRenamed("caller", "callee"), ["program", "callee"], "left_anti")
    for _ in range(max(1, thin.count()).bit_length() + 1):
        fore = thin.select("program", F.col("node").alias("ahead"), F.col("ahead").alias("ahead2"), F.col("low").alias("low2"))
        aft = thin.select("program", F.col("node").alias("back"), F.col("back").alias("back2"))
        far = thin.join(fore, ["program", "ahead"], "left").join(aft, ["program", "back"], "left")
        moved = F.col("ahead2").isNotNull() | F.col("back2").isNotNull()
        thin = written(far.select("program", "node", F.coalesce("back2", "back").alias("back"), F.coalesce("ahead2", "ahead").alias("ahead"), F.least("low", F.coalesce("low2", "low")).alias("low"), moved.alias("moved")))
        if thin.where("moved").isEmpty():
            break
    paths = thin.where("not moved").select("program", "node", "back", "ahead")
    again = paths.select("program", F.col("back").alias("caller"), F.col("ahead").alias("callee")).where("caller <> callee")
    return written(wide.unionByName(again).distinct()), paths, thin.where("moved").select("program", "node", F.col("low").alias("cluster"))


def _coloured(e: DataFrame, most_rounds: int) -> DataFrame | None:
    """(program, node, cluster) of nodes on cycles; the label is any node of the cluster."""
    out = None
    add = lambda more: more if out is None else out.unionByName(more)
    for _ in range(most_rounds):
        e = _trimmed(e)
        if e.isEmpty():
            return out
        # the largest name that reaches a node is its colour; a colour's own node and what reaches it inside the colour are a cluster
        colours = written(nodes(e).withColumn("colour", F.col("node")))
        for _ in range(most_rounds):
            passed = e.join(colours.withColumnRenamed("node", "caller"), ["program", "caller"]).groupBy("program", F.col("callee").alias("node")).agg(F.max("colour").alias("sent"))
            now = written(colours.join(passed, ["program", "node"], "left").select("program", "node", F.greatest("colour", "sent").alias("colour"), (F.col("sent") > F.col("colour")).alias("more")))
            colours = now.drop("more")
            if now.where("more").isEmpty():
                break
        else:
            raise RuntimeError(f"colours are still spreading after {most_rounds} rounds")
        same = e.join(colours.withColumnRenamed("node", "caller"), ["program", "caller"]).join(colours.withColumnRenamed("node", "callee"), ["program", "callee", "colour"])
        back = written(same.select("program", F.col("callee").alias("node"), F.col("caller").alias("callee")))
        roots = colours.where("node = colour").select("program", "node")
        whole = _reached(back, roots, most_rounds).join(colours, ["program", "node"]).select("program", "node", F.col("colour").alias("cluster"))
        out = add(written(whole))
        gone = whole.select("program", F.col("node").alias("caller"))
        e = written(e.join(gone, ["program", "caller"], "left_anti").join(gone.withColumnRenamed("caller", "callee"), ["program", "callee"], "left_anti"))
    raise RuntimeError(f"nodes are still without a colour after {most_rounds} rounds")


def coloured_clusters(edges: DataFrame, most_rounds: int = MOST_STEPS) -> DataFrame:
    """``clusters`` by joins alone, for programs of any size: nodes off every cycle are trimmed, paths contracted, the rest is coloured.

    What is held is a row a node and a row an edge; no pairs of nodes that reach each other are made.
    """
    e, undo, cycles = written(edges.where("caller <> callee").select("program", "caller", "callee").distinct()), [], []
    size = None
    while size is None or (now := e.count()) < 0.9 * size:
        size = e.count() if size is None else now
        e, paths, rings = _contracted(_trimmed(e))
        undo.append(paths)
        cycles.append(rings)
    found = reduce(DataFrame.unionByName, cycles)
    if (rest := _coloured(e, most_rounds)) is not None:
        found = found.unionByName(rest)
    label = lambda end: found.select("program", F.col("node").alias(end), F.col("cluster").alias(f"of_{end}"))
    for paths in reversed(undo):
        ends = paths.join(label("back"), ["program", "back"], "left").join(label("ahead"), ["program", "ahead"], "left")
        one = F.when(F.col("back") == F.col("ahead"), F.coalesce("of_back", "back")).otherwise(F.when(F.col("of_back") == F.col("of_ahead"), F.col("of_back")))
        inside = ends.select("program", "node", one.alias("cluster"), "back").where("cluster is not null")
        found = written(found.unionByName(inside.select("program", "node", "cluster")).unionByName(inside.select("program", F.col("back").alias("node"), "cluster")).distinct())
    least = found.groupBy("program", "cluster").agg(F.min("node").alias("least"))
    named = found.join(least, ["program", "cluster"]).select("program", "node", "least")
    return nodes(edges).join(named, ["program", "node"], "left").select("program", "node", F.coalesce("least", "node").alias("cluster"))


def _peeled(edges: DataFrame, named: DataFrame, most_rounds: int) -> DataFrame:
    """Layers of clusters, one a round from the bottom."""
    named = cut(named)
    a = named.select("program", F.col("node").alias("caller"), F.col("cluster").alias("up"))
    b = named.select("program", F.col("node").alias("callee"), F.col("cluster").alias("down"))
    left = cut(edges.join(a, ["program", "caller"]).join(b, ["program", "callee"]).where("up <> down").select("program", "up", "down").distinct())
    rest = cut(named.select("program", "cluster").distinct())
    out = None
    for layer in range(most_rounds):
        busy = left.select("program", F.col("up").alias("cluster")).distinct()
        free = rest.join(busy, ["program", "cluster"], "left_anti").withColumn("layer", F.lit(layer))
        free = cut(free)
        out = free if out is None else out.unionByName(free)
        rest = cut(rest.join(free, ["program", "cluster"], "left_anti"))
        left = cut(left.join(free.select("program", F.col("cluster").alias("down")), ["program", "down"], "left_anti"))
        if rest.isEmpty():
            return out
    raise RuntimeError(f"clusters are still without a layer after {most_rounds} rounds")
