import heapq
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators.dedup import undirected
from graphloom.operators.merges import greedy


def graph(spark, seed, n=12, m=18):
    draw = random.Random(seed)
    pairs = sorted({(f"n{draw.randrange(n):02}", f"n{draw.randrange(n):02}") for _ in range(m)})
    nodes = spark.createDataFrame([(f"n{k:02}",) for k in range(n)], "id string")
    return nodes, spark.createDataFrame(pairs, "src string, dst string"), [f"n{k:02}" for k in range(n)], pairs


def near(pairs, both=True):
    out = {}
    for a, b in pairs:
        if a != b:
            out.setdefault(a, set()).add(b)
            if both:
                out.setdefault(b, set()).add(a)
    return out


def bfs(adj, s):
    dist, todo = {s: 0}, [s]
    for v in todo:
        for w in sorted(adj.get(v, ())):
            if w not in dist:
                dist[w] = dist[v] + 1
                todo.append(w)
    return dist


def table(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    nodes, edges, ids, pairs = graph(spark, seed, m=9)
    adj = near(pairs)
    assert table(G.components(nodes, edges), "id", "component") == {v: min(bfs(adj, v)) for v in ids}
    out = near(pairs, both=False)
    want = {v: min(w for w in ids if w in bfs(out, v) and v in bfs(out, w)) for v in ids}
    assert table(G.strong_components(nodes, edges), "id", "component") == want


def test_distances_paths_and_hops(spark):
    nodes, edges, ids, pairs = graph(spark, 3)
    adj, out = near(pairs), near(pairs, both=False)
    some = [("n00", "n05"), ("n01", "n02"), ("n03", "n11"), ("n04", "n04")]
    frame = spark.createDataFrame(some, "a string, b string")
    got = {(r["a"], r["b"]): (r["hops"], r["connected"]) for r in G.hops(edges, frame).collect()}
    assert got == {(a, b): (bfs(out, a).get(b, 0), b in bfs(out, a)) for a, b in some}

    def walks(a, b, k):
        return [p for n in range(1, k + 1) for p in itertools.permutations([v for v in ids if v not in (a, b)], n - 1) if all(y in adj.get(x, ()) for x, y in zip((a, *p), (*p, b)))]

    counts = {(r["a"], r["b"]): (r["n_paths"], r["hops"]) for r in G.path_counts(edges, frame).collect()}
    for a, b in some[:3]:
        found = walks(a, b, 3)
        assert counts.get((a, b)) == ((len(found), min(map(len, found)) + 1) if found else None)
    path = G.shortest_path(edges, "n00", "n05")
    assert (path is None) == ("n05" not in bfs(adj, "n00")) and (path is None or len(path) == bfs(adj, "n00")["n05"] + 1)
    assert G.shortest_path(edges, "n00", "n00") == ["n00"]


def test_cheapest_ways(spark):
    _, _, ids, pairs = graph(spark, 4)
    weighted = [(a, b, 1 / (1 + k % 4)) for k, (a, b) in enumerate(pairs)]
    adj = {}
    for a, b, w in weighted:
        for x, y in ((a, b), (b, a)):
            adj.setdefault(x, []).append((y, w))
    start = pairs[0][0]
    best, heap = {}, [(0.0, start)]
    while heap:
        c, v = heapq.heappop(heap)
        if v not in best:
            best[v] = c
            for w, x in adj[v]:
                heapq.heappush(heap, (c + x, w))
    got = table(G.path_costs(spark.createDataFrame(weighted, "a string, b string, weight double"), F.lit(start)), "id", "cost")
    assert got.keys() == best.keys() and all(abs(got[v] - best[v]) < 1e-12 for v in best)


def test_centralities(spark):
    nodes, edges, ids, pairs = graph(spark, 5, 10, 16)
    out = near(pairs, both=False)
    n = len(ids)
    want = dict.fromkeys(ids, 0.0)
    for s in ids:
        dist = bfs(out, s)
        ways = {s: 1}
        for v in sorted(dist, key=dist.get):
            for w in out.get(v, ()):
                if dist.get(w) == dist[v] + 1:
                    ways[w] = ways.get(w, 0) + ways[v]
        gain = dict.fromkeys(ids, 0.0)
        for w in sorted(dist, key=dist.get, reverse=True):
            for v in ids:
                if w in out.get(v, ()) and dist.get(v, -9) + 1 == dist[w]:
                    gain[v] += ways[v] / ways[w] * (1 + gain[w])
            if w != s:
                want[w] += gain[w] / ((n - 1) * (n - 2))
    got = table(G.betweenness(nodes, edges), "id", "betweenness")
    assert all(abs(got[v] - want[v]) < 1e-12 for v in ids)
    rank = table(G.pagerank(nodes, edges.withColumn("weight", F.lit(1)), 60), "id", "rank")
    assert abs(sum(rank.values()) - 1) < 1e-9
    adj = near(pairs)
    big = max((frozenset(bfs(adj, v)) for v in ids), key=lambda c: (len(c), min(c)))
    inner = spark.createDataFrame([(v,) for v in sorted(big)], "id string")
    close = table(G.closeness(edges, inner), "id", "closeness")
    assert all(abs(close[v] - (len(big) - 1) / sum(bfs(adj, v).values())) < 1e-12 for v in big)
    row = G.path_lengths(edges, inner).first()
    every = [d for v in big for d in bfs(adj, v).values() if d]
    assert abs(row["mean_length"] - sum(every) / len(every)) < 1e-12 and row["diameter"] == max(every)


def test_clustering_and_communities(spark):
    nodes, edges, ids, pairs = graph(spark, 6, 12, 26)
    adj = near(pairs)
    got = table(G.clustering(nodes, edges), "id", "clustering")
    for v in ids:
        ns = adj.get(v, set())
        links = sum(b in adj[a] for a, b in itertools.combinations(ns, 2))
        assert abs(got[v] - (2 * links / (len(ns) * (len(ns) - 1)) if len(ns) > 1 else 0)) < 1e-12

    m = sum(map(len, adj.values())) / 2

    def q(groups):
        return sum(sum(b in adj.get(a, ()) for a in g for b in g) / (2 * m) - (sum(len(adj.get(a, ())) for a in g) / (2 * m)) ** 2 for g in groups)

    groups = [{v} for v in ids]
    while True:
        gains = [(q([g for g in groups if g not in (a, b)] + [a | b]) - q(groups), a, b) for a, b in itertools.combinations(groups, 2) if any(y in adj.get(x, ()) for x in a for y in b)]
        best = max((g for g, _, _ in gains), default=0)
        if best <= 1e-12:
            break
        _, a, b = min((min(a), min(b), k) for k, (g, a, b) in enumerate(gains) if g > best - 1e-12)[2:] and next((g, a, b) for g, a, b in sorted(gains, key=lambda x: sorted((min(x[1]), min(x[2])))) if g > best - 1e-12)
        groups = [g for g in groups if g not in (a, b)] + [a | b]
    parts = G.greedy_communities(nodes, edges)
    found = {}
    for r in parts.collect():
        found.setdefault(r["community"], set()).add(r["id"])
    assert abs(q(found.values()) - q(groups)) < 0.05 and all(min(g) == c for c, g in found.items())
    pair = edges.where("src <> dst")
    assert abs(G.modularity(pair, parts).first()[0] - q(found.values())) < 1e-9
    assert -0.5 <= G.modularity(pair, G.label_communities(nodes, edges)).first()[0] <= 1


def test_levels_and_random_graph(spark):
    nodes, edges, ids, pairs = graph(spark, 7)
    seed = nodes.where("id = 'n00'")
    out = near(pairs, both=False)
    got = table(G.bfs_levels(edges, seed, 4), "id", "depth")
    assert got == {v: d + 1 for v, d in bfs(out, "n00").items() if d < 4}
    many = spark.range(200).selectExpr("cast(id as string) as id")
    a, b = G.random_graph(many, 0.1, 1).collect(), G.random_graph(many, 0.1, 1).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and abs(len(a) / (200 * 199 / 2) - 0.1) < 0.01


def test_sampled_sources(spark):
    draw = random.Random(11)
    pairs = [(f"n{k:02}", f"n{(k + 1) % 24:02}") for k in range(24)] + [(f"n{draw.randrange(24):02}", f"n{draw.randrange(24):02}") for _ in range(20)]
    edges = spark.createDataFrame([p for p in pairs if p[0] != p[1]], "src string, dst string")
    nodes = spark.createDataFrame([(f"n{k:02}",) for k in range(24)], "id string")
    # All nodes as sources give the exact values.
    for exact, sample in ((G.betweenness(nodes, edges), G.betweenness(nodes, edges, 24)), (G.closeness(edges, nodes), G.closeness(edges, nodes, 24))):
        want, got = (dict(map(tuple, t.collect())) for t in (exact, sample))
        assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)
    assert G.path_lengths(edges, nodes, 99).first() == G.path_lengths(edges, nodes).first()
    # A few sources: the distances of just these.
    few = [r["id"] for r in G.sampled(nodes, 5).collect()]
    assert len(few) == 5 and few == [r["id"] for r in G.sampled(nodes.repartition(3), 5).collect()]
    dist = [tuple(r) for r in G.distances(undirected(edges), nodes).where("dist > 0").collect()]
    some = [d for s, _, d in dist if s in few]
    row = G.path_lengths(edges, nodes, 5).first()
    assert row["diameter"] == max(some) and abs(row["mean_length"] - sum(some) / len(some)) < 1e-9
    near = {v: [d for s, w, d in dist if s in few and w == v] for v in dict.fromkeys(w for _, w, _ in dist)}
    got = dict(map(tuple, G.closeness(edges, nodes, 5).collect()))
    assert all(abs(got[v] - len(ds) / sum(ds)) < 1e-9 for v, ds in near.items())


def test_hops_of_many_sources_equal_rounds_of_joins(spark):
    from graphloom.operators import hops as H

    draw = random.Random(3)
    pairs = {(f"n{draw.randrange(90):02}", f"n{draw.randrange(90):02}") for _ in range(160)}
    edges = spark.createDataFrame(sorted(pairs), "src string, dst string")
    nodes = spark.createDataFrame([(f"n{k:02}",) for k in range(90)] + [("alone",)], "id string")
    want = {tuple(r) for r in G.distances(edges, nodes).collect()}
    got = [tuple(r) for r in H.all_distances(edges, nodes).collect()]
    assert len(got) == len(want) and set(got) == want and ("alone", "alone", 0) in want
    assert {tuple(r) for r in H.all_distances(edges, nodes, 2).collect()} == {r for r in want if r[2] <= 2}
    sums = {r["id"]: (r["s"], r["n"]) for r in H.distance_sums(edges, nodes).collect()}
    assert sums == {v: (sum(d for _, w, d in want if w == v), sum(1 for _, w, d in want if w == v and d)) for v in {w for _, w, _ in want}}
    assert {tuple(r) for r in H.distance_counts(edges, nodes).collect()} == {(d, sum(x[2] == d for x in want)) for d in {x[2] for x in want} - {0}}
    none = spark.createDataFrame([], "src string, dst string")
    assert [tuple(r) for r in H.all_distances(none, nodes.where("id = 'alone'")).collect()] == [("alone", "alone", 0)]
    # One round of tasks: no table is written for each distance.
    from graphloom import storage

    before = len(storage._written)
    G.path_lengths(edges, nodes).collect(), G.closeness(edges, nodes).collect()
    assert len(storage._written) == before


def test_communities_of_more_edges_than_fit_a_driver(spark):
    ids = spark.range(70_000).select(F.format_string("n%06d", F.col("id") * 3).alias("a"), F.format_string("n%06d", F.col("id") * 3 + 1).alias("b"), F.format_string("n%06d", F.col("id") * 3 + 2).alias("c"))
    sides = [ids.select(F.col(x).alias("src"), F.col(y).alias("dst")) for x, y in ("ab", "ac", "bc")]
    edges = sides[0].unionByName(sides[1]).unionByName(sides[2])
    nodes = ids.select(F.explode(F.array("a", "b", "c")).alias("id"))
    got = G.greedy_communities(nodes, edges).groupBy("community").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    assert got.where("community = first and n = 3").count() == got.count() == 70_000


def test_greedy_merges_equal_the_model():
    """The plain sequence: all gains anew after each merge."""
    for seed in range(20):
        draw = random.Random(seed)
        n = draw.randrange(2, 30)
        pairs = sorted({tuple(sorted(draw.sample(range(n), 2))) for _ in range(draw.randrange(1, 60))})
        m, group = len(pairs), {v: {v} for v in range(n)}
        degree = {v: sum(v in p for p in pairs) for v in range(n)}
        while True:
            of = {v: k for k, g in group.items() for v in g}
            links = {}
            for a, b in pairs:
                if of[a] != of[b]:
                    key = min(of[a], of[b]), max(of[a], of[b])
                    links[key] = links.get(key, 0) + 1
            gains = [(-(w / m - degree[a] * degree[b] / (2 * m * m)), a, b) for (a, b), w in links.items()]
            g, a, b = min(gains, default=(0, 0, 0))
            if g >= 0:
                break
            group[a] |= group.pop(b)
            degree[a] += degree.pop(b)
        assert greedy(*np.array(pairs).T, n) == [of[v] for v in range(n)], seed
