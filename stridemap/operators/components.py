"""Connected components of undirected graphs as a DataFrame fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemap.session import discard, materialize, materialize_counted


def _union_find(pairs) -> dict:
    """node -> least node of its component."""
    up: dict = {}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        up.setdefault(a, a)
        up.setdefault(b, b)
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64, local_edges: int = 200_000) -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node reachable.

    Up to `local_edges` distinct edges are one task with a union-find. Beyond, every node holds a parent, at first the least of itself and its neighbours. In each
    round a node and its parent hook to the least grandparent seen among the neighbours, and paths are halved by
    pointer jumping, so the number of rounds is about the logarithm of a component's diameter. All
    steps are joins and minima with partial aggregation; a round's result is written, which
    cuts lineage and survives the loss of executors. Null ends and loops are ignored.
    """
    both = materialize(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v").distinct(), "edges")
    if both.count() <= local_edges:
        kind = both.schema["u"].dataType.simpleString()

        def solve(frames):
            import pandas as pd

            found = _union_find(p for frame in frames for p in zip(frame["u"].tolist(), frame["v"].tolist(), strict=True))
            yield pd.DataFrame(sorted(found.items()), columns=["node", "component"])

        return materialize(both.coalesce(1).mapInPandas(solve, f"node {kind}, component {kind}"), "components")
    links = materialize(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    state = materialize(links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")), "parents")
    for _ in range(max_rounds):
        up = state.select(F.col("u").alias("p"), F.col("p").alias("g"))
        jumped = state.join(up, "p").select("u", "p", "g")
        around = links.join(jumped.select(F.col("u").alias("v"), F.col("g").alias("seen")), "v").groupBy("u").agg(F.min("seen").alias("seen"))
        offers = jumped.join(around, "u")
        hooks = offers.select("u", F.least("g", "seen").alias("q")).unionByName(offers.select(F.col("p").alias("u"), F.col("seen").alias("q")))
        merged = hooks.groupBy("u").agg(F.min("q").alias("q"))
        following, moved = materialize_counted(state.join(merged, "u").select("u", F.least("p", "q").alias("p"), (F.col("q") < F.col("p")).alias("moved")), "moved", "parents")
        discard(state)
        state = following
        if not moved:
            discard(links)
            return state.select(F.col("u").alias("node"), F.col("p").alias("component"))
    raise RuntimeError(f"no fixpoint in {max_rounds} rounds")


def component_sizes(nodes: DataFrame) -> DataFrame:
    """(component, size) of rows (node, component)."""
    return nodes.groupBy("component").agg(F.count("*").alias("size"))


def in_large_components(labelled: DataFrame, least: int) -> DataFrame:
    """(node) of those rows (node, component) whose component has `least` nodes or more."""
    large = component_sizes(labelled).where(F.col("size") >= least).select("component")
    return labelled.join(large, "component", "left_semi").select("node")


def _tarjan(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """node -> least node of its strong component, with an explicit stack."""
    after: dict[int, list[int]] = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    waiting: list[int] = []
    on_stack: set[int] = set()
    out: dict[int, int] = {}
    for root in after:
        if root in number:
            continue
        number[root] = low[root] = len(number)
        waiting.append(root)
        on_stack.add(root)
        work = [(root, iter(after[root]))]
        while work:
            node, rest = work[-1]
            child = next(rest, None)
            if child is None:
                work.pop()
                if work:
                    parent = work[-1][0]
                    low[parent] = min(low[parent], low[node])
                if low[node] == number[node]:
                    at = len(waiting) - 1
                    while waiting[at] != node:
                        at -= 1
                    members = waiting[at:]
                    del waiting[at:]
                    on_stack.difference_update(members)
                    out.update(dict.fromkeys(members, min(members)))
            elif child not in number:
                number[child] = low[child] = len(number)
                waiting.append(child)
                on_stack.add(child)
                work.append((child, iter(after[child])))
            elif child in on_stack:
                low[node] = min(low[node], number[child])
    return out


def _spread_least(edges: DataFrame, labels: DataFrame, max_rounds: int) -> DataFrame:
    """Labels (node, color): each becomes the least of those of all nodes that reach it over edges (src, dst)."""
    labels = materialize(labels.withColumn("fresh", F.lit(True)), "colors")
    for _ in range(max_rounds):
        offers = labels.where("fresh").join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("offer"))
        both = labels.join(offers, "node", "left")
        better = F.coalesce(F.col("offer") < F.col("color"), F.lit(False))
        following, n = materialize_counted(both.select("node", F.when(better, F.col("offer")).otherwise(F.col("color")).alias("color"), better.alias("fresh")), "fresh", "colors")
        discard(labels)
        labels = following
        if n == 0:
            return labels.select("node", "color")
    raise RuntimeError(f"no fixpoint in {max_rounds} rounds")


def strong_components(edges: DataFrame, local_edges: int = 2_000_000, max_rounds: int = 100_000) -> DataFrame:
    """(node, component) for every node with an edge; component is the least node of the strong component.

    A graph of at most `local_edges` distinct edges is one task of Tarjan's algorithm. A larger one goes
    by colours: nodes without an edge in or out are components of their own and are trimmed; the others take the least
    node that reaches them, and the nodes of a colour that reach its own node backwards are
    that node's component. Then the rest goes round again.
    """
    pairs = materialize(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "pairs")
    if pairs.count() <= local_edges:
        kind = pairs.schema["src"].dataType.simpleString()

        def solve(frames):
            import pandas as pd

            rows = [p for frame in frames for p in zip(frame["src"].tolist(), frame["dst"].tolist(), strict=True)]
            yield pd.DataFrame(sorted(_tarjan(rows).items()), columns=["node", "component"])

        return pairs.coalesce(1).mapInPandas(solve, f"node {kind}, component {kind}")
    done: list[DataFrame] = []
    left = materialize(pairs.where("src <> dst"), "left")
    nodes = materialize(pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct(), "nodes")
    for _ in range(max_rounds):
        while True:  # trim
            kept = nodes.join(left.select(F.col("src").alias("node")).distinct(), "node", "left_semi").join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
            kept = materialize(kept, "nodes")
            alone = materialize(nodes.join(kept, "node", "left_anti").select("node", F.col("node").alias("component")), "alone")
            if alone.limit(1).count() == 0:
                break
            done.append(alone)
            nodes = kept
            left = materialize(left.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi"), "left")
        if nodes.limit(1).count() == 0:
            break
        colors = materialize(_spread_least(left, nodes.select("node", F.col("node").alias("color")), max_rounds), "colors")
        named = left.join(colors.select(F.col("node").alias("src"), F.col("color").alias("c")), "src").join(colors.select(F.col("node").alias("dst"), F.col("color").alias("d")), "dst")
        back = materialize(named.where("c = d").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "back")
        # reached backwards from the colour's own node: 0 spreads, others keep 1
        seen = _spread_least(back, colors.select("node", F.when(F.col("node") == F.col("color"), 0).otherwise(1).cast("bigint").alias("color")), max_rounds)
        found = materialize(colors.join(seen.where("color = 0").select("node"), "node", "left_semi").select("node", F.col("color").alias("component")), "found")
        done.append(found)
        nodes = materialize(nodes.join(found.select("node"), "node", "left_anti"), "nodes")
        left = materialize(left.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi"), "left")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
