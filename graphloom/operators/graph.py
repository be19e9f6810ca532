"""Graph algorithms as loops over DataFrames (T1 to T22). Edges are (src, dst) with `type` or `weight` where it matters.

Every round is written to the shared folder (storage.cut), so plans stay short and lost executors don't matter. Paths
and parents are chosen by the smallest id on ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import vocabulary as V
from graphloom.operators import hops as H
from graphloom.operators import merges as M
from graphloom.operators.dedup import undirected
from graphloom.storage import cut


def _empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def bfs_levels(edges: DataFrame, seeds: DataFrame, max_depth: int, expand: Column | None = None) -> DataFrame:
    """(id, depth) of nodes reached from seeds (depth 1) along edges; `expand` says which targets are entered."""
    seen = cut(seeds.select("id").distinct().withColumn("depth", F.lit(1)), "bfs")
    frontier = seen
    for depth in range(2, max_depth + 1):
        steps = edges.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
        steps = steps.where(expand) if expand is not None else steps
        frontier = cut(steps.distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)), "bfs")
        if _empty(frontier):
            break
        seen = seen.unionByName(frontier)
    return seen


def distances(edges: DataFrame, sources: DataFrame, max_hops: int = 100) -> DataFrame:
    """(source, id, dist): hops from each source, by search from all sources at once."""
    links = cut(edges.select("src", "dst").distinct(), "links")
    seen = cut(sources.select(F.col("id").alias("source"), F.col("id")).distinct().withColumn("dist", F.lit(0)), "dist")
    frontier = seen
    for dist in range(1, max_hops + 1):
        steps = frontier.join(links, frontier["id"] == links["src"]).select("source", F.col("dst").alias("id")).distinct()
        frontier = cut(steps.join(seen, ["source", "id"], "left_anti").withColumn("dist", F.lit(dist)), "dist")
        if _empty(frontier):
            break
        seen = seen.unionByName(frontier)
    return seen


def hops(edges: DataFrame, pairs: DataFrame, max_hops: int = 100) -> DataFrame:
    """(a, b, hops, connected) for pairs, along directed edges; hops 0 where there is no way."""
    found = distances(edges, pairs.select(F.col("a").alias("id")), max_hops)
    met = pairs.select("a", "b").distinct().join(found.select(F.col("source").alias("a"), F.col("id").alias("b"), "dist"), ["a", "b"], "left")
    return met.select("a", "b", F.coalesce("dist", F.lit(0)).alias("hops"), F.col("dist").isNotNull().alias("connected"))


def shortest_path(edges: DataFrame, start: str, goal: str, max_hops: int = 100) -> list[str] | None:
    """The nodes of a shortest undirected path, None if there is none; the smallest parent on ties."""
    if start == goal:
        return [start]
    links = cut(undirected(edges), "links")
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, None, 0)], "id string, parent string, dist int")
    frontier = seen
    for dist in range(1, max_hops + 1):
        steps = links.join(frontier.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        frontier = cut(steps.join(seen.select("id"), "id", "left_anti").withColumn("dist", F.lit(dist)), "path")
        if _empty(frontier):
            return None
        seen = seen.unionByName(frontier)
        if not _empty(frontier.where(F.col("id") == goal)):
            break
    path, node = [goal], goal
    while node != start:
        node = seen.where(F.col("id") == node).select("parent").first()[0]
        path.append(node)
    return path[::-1]


def path_costs(edges: DataFrame, start: Column, max_rounds: int = 1000) -> DataFrame:
    """(id, cost, parent) of the cheapest undirected ways from one node; edges (a, b, weight), weights not negative."""
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))
    links = cut(both.groupBy("src", "dst").agg(F.min("weight").alias("weight")), "links")
    best = cut(links.where(F.col("src") == start).select(F.col("src").alias("id")).distinct().select("id", F.lit(0.0).alias("cost"), F.lit(None).cast(links.schema["src"].dataType).alias("parent")), "cost")
    changed = best
    for _ in range(max_rounds):
        offers = changed.join(links, changed["id"] == links["src"]).select(F.col("dst").alias("id"), (F.col("cost") + F.col("weight")).alias("cost"), F.col("src").alias("parent"))
        offer = offers.groupBy("id").agg(F.min(F.struct("cost", "parent")).alias("o")).select("id", F.col("o.cost").alias("new"), F.col("o.parent").alias("via"))
        merged = best.join(offer, "id", "full_outer")
        better = F.col("new").isNotNull() & (F.col("cost").isNull() | (F.col("new") < F.col("cost")))
        step = cut(merged.select("id", F.when(better, F.col("new")).otherwise(F.col("cost")).alias("cost"), F.when(better, F.col("via")).otherwise(F.col("parent")).alias("parent"), better.alias("better")), "cost")
        best, changed = step.drop("better"), step.where("better").drop("better")
        if _empty(changed):
            break
    return best


def simple_paths(edges: DataFrame, pairs: DataFrame, cutoff: int = 3, directed: bool = False) -> DataFrame:
    """(a, b, path, hops): all paths without repeated nodes of at most `cutoff` edges between pairs.

    Walks from both ends of a pair meet on an edge, so a node of many edges between them is never spread.
    """
    links = cut(edges.select("src", "dst").where("src <> dst").distinct() if directed else undirected(edges), "links")
    wanted = cut(pairs.select("a", "b").where("a <> b").distinct(), "wanted")

    def walks(end: str, src: str, dst: str, most: int) -> list[DataFrame]:
        out = [wanted.select(end, F.col(end).alias(f"at_{end}"), F.array(end).alias(f"path_{end}")).distinct()]
        for _ in range(most):
            grown = out[-1].join(links, F.col(f"at_{end}") == F.col(src)).where(~F.array_contains(f"path_{end}", F.col(dst)))
            parts = (f"path_{end}", F.array(dst)) if end == "a" else (F.array(dst), f"path_{end}")
            out.append(cut(grown.select(end, F.col(dst).alias(f"at_{end}"), F.concat(*parts).alias(f"path_{end}")), "walks"))
        return out

    forth, back = walks("a", "src", "dst", cutoff // 2), walks("b", "dst", "src", (cutoff - 1) // 2)
    out = None
    for k in range(1, cutoff + 1):
        met = wanted.join(forth[k // 2], "a").join(back[k - 1 - k // 2], "b").where(~F.arrays_overlap("path_a", "path_b"))
        met = met.join(links, (F.col("at_a") == F.col("src")) & (F.col("at_b") == F.col("dst")))
        found = met.select("a", "b", F.concat("path_a", "path_b").alias("path"), F.lit(k).alias("hops"))
        out = found if out is None else out.unionByName(found)
    return out


def path_counts(edges: DataFrame, pairs: DataFrame, cutoff: int = 3) -> DataFrame:
    """T5: (a, b, n_paths, hops): how many simple paths, and the length of the shortest."""
    return simple_paths(edges, pairs, cutoff).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_paths"), F.min("hops").alias("hops"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component), named by the smallest id in it; labels fall to neighbours' and jump to labels' labels."""
    both = cut(undirected(edges), "links")
    labels = cut(nodes.select("id").unionByName(both.select(F.col("src").alias("id"))).distinct().withColumn("l", F.col("id")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("src"), "l"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("l").alias("m"))
        low = labels.join(near, "id", "left").select("id", "l", F.least("l", F.coalesce("m", "l")).alias("m"))
        jump = low.select(F.col("id").alias("m"), F.col("m").alias("j"))
        new = cut(low.join(jump, "m", "left").select("id", F.col("l").alias("old"), F.least("m", F.coalesce("j", "m")).alias("l")), "labels")
        labels = new.select("id", "l")
        if _empty(new.where("l <> old")):
            return labels.withColumnRenamed("l", "component")


def _reached(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(id, colour) of what each start (id, colour) reaches inside its own part of the graph (edges carry `part`)."""
    seen = cut(start, "reach")
    frontier = seen
    while True:
        steps = frontier.join(edges, (frontier["id"] == edges["src"])).select(F.col("dst").alias("id"), "colour").distinct()
        frontier = cut(steps.join(seen, "id", "left_anti"), "reach")
        if _empty(frontier):
            return seen
        seen = seen.unionByName(frontier)


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): nodes that reach each other, by forward and backward search from a pivot of each part.

    Nodes that nothing of their part leads to, or that lead to nothing of it, are components by themselves.
    """
    left = cut(nodes.select("id").unionByName(edges.select(F.col("src").alias("id"))).unionByName(edges.select(F.col("dst").alias("id"))).distinct().withColumn("part", F.lit("0")), "parts")
    out = None
    while not _empty(left):
        ends = edges.select("src", "dst").where("src <> dst").distinct()
        own = left.select(F.col("id").alias("src"), F.col("part").alias("p1"))
        inner = cut(ends.join(own, "src").join(left.select(F.col("id").alias("dst"), F.col("part").alias("p2")), "dst").where("p1 = p2").select("src", "dst"), "inner")
        core = left.join(inner.select(F.col("src").alias("id")).distinct(), "id", "left_semi").join(inner.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
        core = cut(core, "core")
        alone = left.join(core, "id", "left_anti").select("id", F.col("id").alias("component"))
        out = alone if out is None else out.unionByName(alone)
        if _empty(core):
            break
        pivots = core.groupBy("part").agg(F.min("id").alias("id")).select("id", F.col("id").alias("colour"))
        forward = _reached(inner, pivots)
        backward = _reached(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")), pivots)
        marks = core.join(forward.select("id", F.col("colour").alias("f")), "id", "left").join(backward.select("id", F.col("colour").alias("b")), "id", "left")
        marks = cut(marks, "marks")
        done = marks.where("f is not null and b is not null").select("id", F.col("f").alias("component"))
        out = out.unionByName(done)
        rest = marks.where("f is null or b is null")
        left = cut(rest.select("id", F.concat_ws("/", "part", F.when(F.col("f").isNotNull(), "f").when(F.col("b").isNotNull(), "b").otherwise("r")).alias("part")), "parts")
    return out


def largest_component(labels: DataFrame) -> DataFrame:
    """The nodes of the component with most nodes, the first one on ties."""
    best = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return labels.join(F.broadcast(best.select("component")), "component", "left_semi").select("id")


def sampled(nodes: DataFrame, k: int | None, seed: int = 42) -> DataFrame:
    """The k nodes with the smallest seeded hashes, all where k is None."""
    ids = nodes.select("id").distinct()
    return ids if k is None else ids.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k)


def path_lengths(edges: DataFrame, nodes: DataFrame, sources: int | None = None) -> DataFrame:
    """(mean_length, diameter) over all pairs of nodes of one undirected component.

    With a number of `sources` only ways from so many sampled nodes are taken, so rows grow with the nodes and not with
    their square: the mean is an estimate then, and the diameter a lower bound.
    """
    d = H.distance_counts(undirected(edges), sampled(nodes, sources))
    return d.agg((F.sum(F.col("dist") * F.col("n")).cast("double") / F.sum("n")).alias("mean_length"), F.max("dist").alias("diameter"))


def closeness(edges: DataFrame, nodes: DataFrame, sources: int | None = None) -> DataFrame:
    """(id, closeness): (n - 1) / sum of distances, in one undirected component.

    With a number of `sources` the mean distance is taken over so many sampled nodes, other than the node itself.
    """
    # Undirected: the distances to a node are those from it.
    met = H.distance_sums(undirected(edges), sampled(nodes, sources))
    return nodes.select("id").distinct().join(met, "id", "left").select("id", F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("s")), F.lit(0.0)).alias("closeness"))


def triangles(edges: DataFrame) -> DataFrame:
    """(id, triangles): edges point to the end of larger degree, so that no node's list of targets is long.

    A pair of targets is formed once, in the order that an edge between them would have.
    """
    both = undirected(edges)
    degree = both.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    ranked = both.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst")
    out = cut(ranked.where("d < e or (d = e and src < dst)").select("src", "dst", "e"), "oriented")
    wedge = out.toDF("src", "u", "eu").join(out.toDF("src", "v", "ev"), "src").where("eu < ev or (eu = ev and u < v)").select("src", "u", "v")
    found = wedge.join(out.select(F.col("src").alias("u"), F.col("dst").alias("v")), ["u", "v"])
    return found.select(F.explode(F.array("src", "u", "v")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, clustering) of all nodes; 0 below two neighbours."""
    degree = undirected(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    rows = nodes.select("id").distinct().join(degree, "id", "left").join(triangles(edges), "id", "left")
    return rows.select("id", F.when(F.col("d") >= 2, 2.0 * F.coalesce("triangles", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("clustering"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (n, m, density)."""
    n, m = nodes.agg(F.count(F.lit(1)).alias("n")), edges.agg(F.count(F.lit(1)).alias("m"))
    return n.join(m, F.lit(True)).withColumn("density", F.coalesce(F.try_divide(F.col("m").cast("double"), F.col("n") * (F.col("n") - 1)), F.lit(0.0)))


def random_graph(nodes: DataFrame, p: float, seed: int = 42) -> DataFrame:
    """Each unordered pair is an edge with probability p, decided by a hash; the baseline for a few thousand nodes.

    For each node, its row of the upper triangle is drawn in one array, so only edges leave the scan.
    """
    numbered = cut(nodes.select("id").distinct().withColumn("k", F.row_number().over(Window.orderBy("id"))), "numbered")
    n = numbered.count()
    # The window leaves one partition; rows are dealt out, as those of small numbers are long.
    drawn = numbered.repartition(4 * numbered.sparkSession.sparkContext.defaultParallelism).select(F.col("id").alias("src"), "k", F.explode(F.filter(F.when(F.col("k") < n, F.sequence(F.col("k") + 1, F.lit(n))).otherwise(F.array().cast("array<int>")), lambda j: F.pmod(F.xxhash64(F.col("k"), j, F.lit(seed)), F.lit(1_000_000)) < int(p * 1_000_000))).alias("j"))
    return drawn.join(numbered.select(F.col("id").alias("dst"), F.col("k").alias("j")), "j").select("src", "dst")


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 100, tolerance: float = 1e-6, damping: float = 0.85) -> DataFrame:
    """(id, rank), weighted by `weight`; ends after `rounds`, or when the change is below n * tolerance."""
    n = nodes.select("id").distinct().count()
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    shares = cut(edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")).join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")), "shares")
    hung = cut(nodes.select("id").distinct().join(out.select(F.col("src").alias("id"), F.lit(True).alias("goes")), "id", "left").select("id", F.col("goes").isNull().alias("hangs")), "nodes")
    rank = cut(hung.select("id", "hangs", F.lit(1.0 / n).alias("rank")), "rank")
    for _ in range(rounds):
        lost = rank.where("hangs").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        got = rank.join(shares, rank["id"] == shares["src"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got")).withColumnRenamed("dst", "id")
        new = rank.join(got, "id", "left").join(F.broadcast(lost), F.lit(True))
        value = damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n) + (1 - damping) / n
        step = cut(new.select("id", "hangs", value.alias("rank"), F.abs(value - F.col("rank")).alias("moved")), "rank")
        rank = step.drop("moved")
        if tolerance and step.agg(F.sum("moved")).first()[0] < n * tolerance:
            break
    return rank.select("id", "rank")


def degree_centrality(degree: DataFrame) -> DataFrame:
    """(id, centrality) from degrees of all nodes."""
    n = degree.agg(F.count(F.lit(1)).alias("n"))
    return degree.join(F.broadcast(n), F.lit(True)).select("id", F.coalesce(F.try_divide(F.col("degree").cast("double"), F.col("n") - 1), F.lit(0.0)).alias("centrality"))


def betweenness(nodes: DataFrame, edges: DataFrame, sources: int | None = None) -> DataFrame:
    """(id, betweenness), directed and normalised, by Brandes, a source at a time in tasks that share them out.

    With a number of `sources` only ways from so many sampled nodes count, scaled to all nodes: an estimate whose work
    grows with the nodes and not with their square.
    """
    ids = cut(nodes.select("id").distinct(), "ids")
    gains = H.path_gains(edges.select("src", "dst").where("src <> dst"), sampled(ids, sources))
    n = ids.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    scale *= 1.0 if sources is None else n / max(1, min(n, sources))
    return ids.join(gains, "id", "left").select("id", (F.coalesce("gain", F.lit(0.0)) * scale).alias("betweenness"))


def modularity(edges: DataFrame, parts: DataFrame, weight: str | None = None) -> DataFrame:
    """One row: sum over communities of inner edges / m - (degrees / 2 m)^2, undirected; parts: (id, community)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    pair = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), w.alias("w"))
    pair = pair.groupBy("a", "b").agg(F.max("w").alias("w"))
    of_a, of_b = (parts.select(F.col("id").alias(x), F.col("community").alias(f"c{x}")) for x in "ab")
    met = cut(pair.join(of_a, "a").join(of_b, "b"), "met")
    inner = met.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.sum("w").alias("inner"))
    ends = met.select(F.explode(F.array("ca", "cb")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("ends"))
    m = met.agg(F.sum("w").alias("m"))
    rows = ends.join(inner, "c", "left").join(F.broadcast(m), F.lit(True))
    return rows.agg(F.sum(F.coalesce("inner", F.lit(0.0)) / F.col("m") - F.pow(F.col("ends") / (2 * F.col("m")), 2)).alias("modularity"))


def greedy_communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, community) by greedy modularity, exact: always the merge with the largest gain, smallest names on ties.

    The sequence of merges can't be split, so one task makes it, with arrays of 60 bytes an edge and tables of what lies
    beside merged communities; label_communities is an approximation by many tasks.
    """
    links = undirected(edges).where("src < dst").select("src", "dst")
    kind = nodes.schema["id"].dataType.simpleString()
    found = cut(links.repartition(1).mapInArrow(M.communities, f"id {kind}, community {kind}"), "greedy")
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def label_communities(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """An approximation of T19 for large graphs: nodes take the label most frequent among neighbours, smallest on ties."""
    both = cut(undirected(edges), "links")
    labels = cut(nodes.select("id", F.col("id").alias("l")).distinct(), "labels")
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("id").alias("src"), "l"), "src").groupBy(F.col("dst").alias("id"), "l").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("id").agg(F.max("n").alias("n")).join(votes, ["id", "n"]).groupBy("id").agg(F.min("l").alias("v"))
        new = cut(labels.join(best, "id", "left").select("id", F.col("l").alias("old"), F.coalesce("v", "l").alias("l")), "labels")
        labels = new.select("id", "l")
        if _empty(new.where("l <> old")):
            break
    return labels.withColumnRenamed("l", "community")


def community_stats(parts: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """(community, size, percent, types, top, top_people): top lists the k nodes of largest degree inside, top_people the persons of these."""
    typed = parts.join(nodes.select("id", "title", "type"), "id")
    inside = undirected(edges).join(parts.select(F.col("id").alias("src"), F.col("community").alias("c1")), "src").join(parts.select(F.col("id").alias("dst"), F.col("community").alias("c2")), "dst").where("c1 = c2")
    degree = inside.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    ranked = typed.join(degree, "id", "left").withColumn("place", F.row_number().over(Window.partitionBy("community").orderBy(F.desc(F.coalesce("d", F.lit(0))), "id")))
    top = ranked.where(F.col("place") <= k).groupBy("community").agg(F.array_sort(F.collect_list(F.struct("place", "title", "type"))).alias("t"))
    people = F.transform(F.filter("t", lambda x: x["type"] == "person"), lambda x: x["title"])
    top = top.select("community", F.transform("t", lambda x: x["title"]).alias("top"), people.alias("top_people"))
    types = typed.groupBy("community", "type").agg(F.count(F.lit(1)).alias("n"))
    sizes = types.groupBy("community").agg(F.sum("n").alias("size"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("types"))
    total = nodes.agg(F.count(F.lit(1)).alias("total"))
    return sizes.join(top, "community").join(F.broadcast(total), F.lit(True)).select("community", "size", (100.0 * F.col("size") / F.col("total")).alias("percent"), "types", "top", "top_people")


def community_label(size: Column, types: Column, top_people: Column, number: Column) -> Column:
    """A name for a community; the first rule wins. top_people: the persons among its nodes of largest degree."""

    def of(kind: str) -> Column:
        return F.coalesce(F.try_element_at(types, F.lit(kind)), F.lit(0))

    name = {k: F.lit(v) for k, v in V.COMMUNITY_NAMES.items()}
    return (
        F.when(size > 500, name["global"])
        .when(of("university") > 0.3 * of("person"), name["academic"])
        .when(F.arrays_overlap(top_people, F.array(*(F.lit(x) for x in V.US_POLITICIANS))), name["politics"])
        .when(F.exists(top_people, lambda x: F.contains(x, F.lit("Winston")) | F.contains(x, F.lit("Churchill"))), name["british"])
        .when(of("country") > 10, name["international"])
        .otherwise(F.format_string("🔗 Cộng đồng #%d", number))
    )


def hub_reason(type_: Column, degree: Column, in_degree: Column, out_degree: Column) -> Column:
    """Why a node is central; the first rule wins."""
    return F.when(type_ == "university", "institution").when(degree > 300, "hub").when(in_degree > 2 * out_degree, "cited").otherwise("connected")


def modularity_band(value: Column) -> Column:
    return F.when(value > 0.3, "strong").when(value > 0.1, "moderate").otherwise("weak")
