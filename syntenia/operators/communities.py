"""Community detection on weighted graphs (G3, G4): one grouped function per connected component.

Modularity and the map equation are taken over the whole graph, so every component is given the whole
graph's weight.  No community spans two components.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import discard, materialize

Edges = list[tuple[int, int, float]]


def label_propagation(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(node, label): each node takes the label of greatest summed weight among its neighbors and itself, ties to the smallest."""
    both = materialize(edges.select("i", "j", "sim").union(edges.select("j", "i", "sim")).toDF("node", "other", "sim"), "both")
    labels = both.select("node").distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node", "label").agg(F.sum("sim").alias("sim"))
        # a node's own label counts like its strongest edge, which keeps two-node groups from swapping labels
        own = both.groupBy("node").agg(F.max("sim").alias("sim")).join(labels, "node").select("node", "label", "sim")
        votes = votes.unionByName(own).groupBy("node", "label").agg(F.round(F.sum("sim"), 9).alias("sim"))
        new = materialize(votes.groupBy("node").agg(F.min(F.struct((-F.col("sim")).alias("s"), "label"))["label"].alias("label")), "labels")
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").filter("label <> old").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            break
    return labels


def adjacency(nodes: list[int], edges: Edges) -> dict[int, dict[int, float]]:
    """Summed weights of the edges between different nodes, both ways."""
    weight: dict[int, dict[int, float]] = {n: {} for n in nodes}
    for i, j, w in edges:
        if i != j:
            weight[i][j] = weight[i].get(j, 0.0) + w
            weight[j][i] = weight[j].get(i, 0.0) + w
    return weight


def fold(weight: dict[int, dict[int, float]], group: dict[int, int]) -> tuple[dict[int, dict[int, float]], dict[int, float]]:
    """The graph whose nodes are the groups, and the weight inside each."""
    new: dict[int, dict[int, float]] = {c: {} for c in set(group.values())}
    inside = dict.fromkeys(new, 0.0)
    for n, e in weight.items():
        for m, w in e.items():
            if group[n] == group[m]:
                inside[group[n]] += w / 2
            else:
                new[group[n]][group[m]] = new[group[n]].get(group[m], 0.0) + w
    return new, inside


def louvain(nodes: list[int], edges: Edges, total: float | None = None) -> dict[int, int]:
    """Modularity by local moves and aggregation; nodes in order, ties to the smallest community.  ``total``: the graph's summed degrees."""
    member = {n: n for n in nodes}
    weight = adjacency(nodes, edges)
    loops = dict.fromkeys(nodes, 0.0)
    for i, j, w in edges:
        if i == j:
            loops[i] += w
    while True:
        degree = {n: sum(e.values()) + 2 * loops[n] for n, e in weight.items()}
        whole = total or sum(degree.values()) or 1.0
        group, held = {n: n for n in weight}, dict(degree)
        moved, moved_any = True, False
        while moved:
            moved = False
            for n in sorted(weight):
                old = group[n]
                held[old] -= degree[n]
                links: dict[int, float] = {old: 0.0}
                for m, w in weight[n].items():
                    links[group[m]] = links.get(group[m], 0.0) + w
                gain = {c: w - held[c] * degree[n] / whole for c, w in links.items()}
                top = max(gain.values())
                best = old if gain[old] >= top - 1e-12 else min(c for c, v in gain.items() if v >= top - 1e-12)
                held[best] += degree[n]
                if best != old:
                    group[n], moved, moved_any = best, True, True
        member = {n: group[c] for n, c in member.items()}
        if not moved_any:
            return member
        weight, inside = fold(weight, group)
        new_loops = dict.fromkeys(weight, 0.0)
        for n, own in loops.items():
            new_loops[group[n]] += own
        loops = {c: own + inside[c] for c, own in new_loops.items()}


def fast_greedy(nodes: list[int], edges: Edges, total: float | None = None) -> dict[int, int]:
    """Agglomeration: the two communities whose union raises modularity most are united until none does; ties to the smallest."""
    weight = adjacency(nodes, edges)
    degree = {n: sum(e.values()) for n, e in weight.items()}
    for i, j, w in edges:
        if i == j:
            degree[i] += 2 * w
    whole = total or sum(degree.values()) or 1.0
    member = {n: n for n in nodes}
    while True:
        gains = [(w - degree[a] * degree[b] / whole, -a, -b) for a, e in weight.items() for b, w in e.items() if a < b]
        gain, a, b = max(gains, default=(0.0, 0, 0))
        if gain <= 1e-12:
            return member
        a, b = -a, -b
        for m, w in weight.pop(b).items():
            del weight[m][b]
            if m != a:
                weight[a][m] = weight[a].get(m, 0.0) + w
                weight[m][a] = weight[a][m]
        degree[a] += degree.pop(b)
        member = {n: a if c == b else c for n, c in member.items()}


def _plogp(x: float) -> float:
    return x * log2(x) if x > 1e-15 else 0.0


def codelength(nodes: list[int], edges: Edges, member: dict[int, int], total: float | None = None) -> float:
    """The map equation of two levels for undirected flow, less the nodes' own constant term."""
    weight = adjacency(nodes, edges)
    flow = {n: sum(e.values()) for n, e in weight.items()}
    whole = total or sum(flow.values()) or 1.0
    p, q = {}, {}
    for n, e in weight.items():
        c = member[n]
        p[c] = p.get(c, 0.0) + flow[n] / whole
        q[c] = q.get(c, 0.0) + sum(w for m, w in e.items() if member[m] != c) / whole
    return _plogp(sum(q.values())) - 2 * sum(map(_plogp, q.values())) + sum(_plogp(q[c] + p[c]) for c in p)


def infomap(nodes: list[int], edges: Edges, total: float | None = None) -> dict[int, int]:
    """Least code length of a random walk by local moves and aggregation; nodes in order, ties to the smallest module."""
    member = {n: n for n in nodes}
    weight = adjacency(nodes, edges)
    whole = total or sum(sum(e.values()) for e in weight.values()) or 1.0
    flow = {n: sum(e.values()) / whole for n, e in weight.items()}
    while True:
        out = {n: sum(e.values()) / whole for n, e in weight.items()}
        group, p, q = {n: n for n in weight}, dict(flow), dict(out)
        leaves = sum(q.values())
        moved, moved_any = True, False
        while moved:
            moved = False
            for n in sorted(weight):
                old = group[n]
                links: dict[int, float] = {old: 0.0}
                for m, w in weight[n].items():
                    links[group[m]] = links.get(group[m], 0.0) + w / whole
                # without n, then with n in each module it touches
                rest_p, rest_q = p[old] - flow[n], q[old] - out[n] + 2 * links[old]
                best, best_cost = old, 0.0
                for c in sorted(links):
                    if c == old:
                        continue
                    new_q = q[c] + out[n] - 2 * links[c]
                    new_leaves = leaves - q[old] - q[c] + rest_q + new_q
                    cost = _plogp(new_leaves) - _plogp(leaves) - 2 * (_plogp(rest_q) + _plogp(new_q) - _plogp(q[old]) - _plogp(q[c]))
                    cost += _plogp(rest_q + rest_p) + _plogp(new_q + p[c] + flow[n]) - _plogp(q[old] + p[old]) - _plogp(q[c] + p[c])
                    if cost < best_cost - 1e-10:
                        best, best_cost = c, cost
                if best != old:
                    new_q = q[best] + out[n] - 2 * links[best]
                    leaves += rest_q + new_q - q[old] - q[best]
                    p[old], q[old] = rest_p, rest_q
                    p[best], q[best] = p[best] + flow[n], new_q
                    group[n], moved, moved_any = best, True, True
        member = {n: group[c] for n, c in member.items()}
        if not moved_any:
            return member
        weight, _ = fold(weight, group)
        flow = {c: p[c] for c in weight}


def scan_of(find: Callable[[list[int], Edges, float | None], dict[int, int]], total: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A component's communities, each named by its smallest gene."""

    def scan(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        found = find(sorted(int(g) for g in nodes["gene_id"]), sorted((int(i), int(j), float(s)) for i, j, s in zip(edges["i"], edges["j"], edges["sim"], strict=True)), total)
        least: dict[int, int] = {}
        for n, c in found.items():
            least[c] = min(n, least.get(c, n))
        return pd.DataFrame([(n, least[c]) for n, c in sorted(found.items())], columns=["gene_id", "leader"])

    return scan
