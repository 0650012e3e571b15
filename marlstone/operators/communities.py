"""Communities of a weighted undirected graph by modularity: local moving, refinement and contraction, each as joins.

Nodes are 64-bit keys. A node with one edge belongs to its neighbour wherever that goes, so it is folded into it first. A level holds nodes
(node, k, community) and symmetric edges (a, b, w, k of a) in buckets of a. Half of the nodes, by a hash that changes with the sweep, move
at once to the neighbouring community that gains most; a level stays only if
modularity grew. Then communities are refined (moved again from single nodes,
inside their community only) and the refined ones become the nodes of the next
level, which starts with the unrefined communities.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from marlstone.operators.graph import _keyed, bucketed, dropped, key_of, stored

#: Modularity that a sweep must gain to stay.
LEAST_GAIN = 1e-6
#: Tables of nodes up to so many rows are broadcast; two of them meet in a step.
BROADCAST_ROWS = 1_000_000


def lookup(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def modularity(pairs: DataFrame, communities: DataFrame) -> float:
    """Modularity of communities (node, community) on pairs (a, b, weight); loops count twice at their node. A graph without weight has 0."""
    own = lambda side: communities.select(F.col("node").alias(side), F.col("community").alias(f"community_{side}"))
    placed = pairs.join(own("a"), "a").join(own("b"), "b")
    inside = F.sum(F.when(F.col("community_a") == F.col("community_b"), 2 * F.col("weight"))).alias("inside")
    told = placed.agg(inside, F.sum(2 * F.col("weight")).alias("m2")).first()
    if not told["m2"]:
        return 0.0
    ends = placed.select(F.inline(F.array(F.struct(F.col("community_a").alias("community"), "weight"), F.struct(F.col("community_b").alias("community"), "weight"))))
    mass = ends.groupBy("community").agg(F.sum("weight").cast("double").alias("total")).agg(F.sum(F.col("total") * F.col("total")).alias("s")).first()["s"]
    return (told["inside"] or 0) / told["m2"] - mass / told["m2"] ** 2


def _quality(nodes: DataFrame, edges: DataFrame, m2: float, n: int) -> float:
    """Modularity of n nodes (node, k, community): what is no edge between communities is inside one."""
    own = lambda side: lookup(nodes.select(F.col("node").alias(side), F.col("community").alias(f"c_{side}")), n)
    mass = nodes.groupBy("community").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("s"))
    cut = edges.where("a != b").join(own("a"), "a").join(own("b"), "b").where("c_a != c_b").agg(F.sum("w").alias("cut"))
    told = cut.crossJoin(mass).first()
    return 1 - (told["cut"] or 0) / m2 - (told["s"] or 0) / m2**2


def _level(nodes: DataFrame, edges: DataFrame, n: int, most: int) -> tuple[DataFrame, Callable[[], None]]:
    """Edges (a, b, w) with the k of a, in buckets of a, and what deletes them. Each of the n nodes has an edge of no weight to itself, by which it may stay."""
    own = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("w"), "k")
    known = lookup(nodes.select(F.col("node").alias("a"), "k"), n)
    return bucketed(edges.join(known, "a").select("a", "b", "w", "k").unionByName(own), "a", most=most)


def _moved(nodes: DataFrame, edges: DataFrame, m2: float, turn: int, n: int) -> tuple[DataFrame, int]:
    """One half-sweep: node, k, community, and how many moved. Nodes whose turn it is not are not looked at."""
    on = lambda c: F.pmod(F.xxhash64(c, F.lit(turn // 2)), F.lit(2)) == turn % 2
    to = lookup(nodes.select(F.col("node").alias("b"), F.col("community").alias("to")), n)
    total = lookup(nodes.groupBy(F.col("community").alias("to")).agg(F.sum("k").alias("total")), n)
    around = edges.where(on("a")).join(to, "b").groupBy("a", "to").agg(F.sum("w").alias("w"), F.max("k").alias("k"), F.max(F.col("a") == F.col("b")).alias("own")).join(total, "to")
    gain = F.col("w") - F.col("k") * (F.col("total") - F.when(F.col("own"), F.col("k")).otherwise(0.0)) / m2
    # Of equal gains the least community wins; sums of one order are compared rounded.
    best = F.min(F.struct((-F.round("gain", 9)).alias("loss"), F.col("to"), F.col("gain"))).alias("best")
    chosen = around.withColumn("gain", gain).groupBy("a").agg(best, F.max("k").alias("k"), F.max(F.when(F.col("own"), F.struct("to", "gain"))).alias("here"))
    moves = F.col("best.gain") > F.col("here.gain") + 1e-9
    seen = Observation()
    turned = chosen.select(F.col("a").alias("node"), "k", F.when(moves, F.col("best.to")).otherwise(F.col("here.to")).alias("community"), moves.alias("moved"))
    new = stored(turned.unionByName(nodes.where(~on("node")).withColumn("moved", F.lit(False))).observe(seen, F.count_if("moved").alias("moved")).drop("moved"))
    return new, seen.get["moved"]


def _local_moving(nodes: DataFrame, edges: DataFrame, m2: float, n: int, *, sweeps: int, first: int) -> tuple[DataFrame, bool]:
    """Up to so many sweeps of the n nodes, numbered from ``first``, and whether less than a hundredth of them moved in the last."""
    start, settled = nodes, False
    for sweep in range(first, first + sweeps):
        moves = 0
        for turn in (2 * sweep, 2 * sweep + 1):
            new, moved = _moved(nodes, edges, m2, turn, n)
            if nodes is not start:
                dropped(nodes)
            nodes, moves = new, moves + moved
        if settled := moves <= n / 100:
            break
    return nodes, settled


def _refined(nodes: DataFrame, edges: DataFrame, m2: float, n: int, most: int, *, sweeps: int, first: int) -> DataFrame:
    """Communities from single nodes, each inside one of the given communities, as only edges inside these are left: node, k, community."""
    own = lambda side: lookup(nodes.select(F.col("node").alias(side), F.col("community").alias(f"c_{side}")), n)
    inner, drop = bucketed(edges.join(own("a"), "a").join(own("b"), "b").where("c_a = c_b").select("a", "b", "w", "k"), "a", most=most)
    fine, _ = _local_moving(stored(nodes.select("node", "k", F.col("node").alias("community"))), inner, m2, n, sweeps=sweeps, first=first)
    drop()
    return fine


def _folded(summed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with one edge put into their neighbour: places (node, at), nodes left (node, k) and the edges between different ones of them.

    Such a node gains by its neighbour's community whatever that is: w (1 - total / m2) > 0, and loses by any other. Of two nodes that have only
    each other the least stays. A loop is an edge here: a node with one is not folded.
    """
    ends = summed.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))).alias("e"), "w").select("e.*", "w")
    # Either row of a loop counts, so its weight counts twice and its node has more than one edge.
    known = stored(ends.groupBy("node").agg(F.sum("w").alias("k"), F.count("*").alias("n"), F.min("near").alias("near")))
    leaves = stored(known.where("n = 1").select("node", "near"))
    count = leaves.count()
    mutual = lookup(leaves.select(F.col("node").alias("near"), F.lit(True).alias("mutual")), count)
    at = F.when(F.col("mutual"), F.least("node", "near")).otherwise(F.col("near"))
    homes = stored(leaves.join(mutual, "near", "left").select("node", at.alias("at")))
    places = stored(known.join(lookup(homes, count), "node", "left").select("node", "k", F.coalesce("at", "node").alias("at")))
    dropped(homes)
    out = lambda side: lookup(leaves.select(F.col("node").alias(side)), count)
    edges = summed.where("a != b").join(out("a"), "a", "left_anti").join(out("b"), "b", "left_anti")
    left = stored(places.groupBy("at").agg(F.sum("k").alias("k")).withColumnRenamed("at", "node"))
    return places, left, edges


def _propagated(places: DataFrame, nodes: DataFrame, edges: DataFrame, n: int, *, rounds: int = 24) -> DataFrame:
    """``label_propagation`` of the unfolded graph, on the n nodes left and their edges: a, label, before and k, hair (of all edges and of those to folded ones).

    A folded node has the label that its neighbour had a round before, so it gives that one back two rounds after: the neighbour's
    own label of then, kept as ``before``, has the weight of all its folded nodes. In the first round they
    have labels of their own, of which only the heaviest, the least of equals, can win.
    ``before`` is at the end the label of the folded ones. Nodes that have the labels of two rounds before, twice, swap for ever.
    """
    numbered = places.join(nodes.select(F.col("key").alias("node"), "id"), "node")
    folded, whole = F.col("node") != F.col("at"), F.sum("k").alias("k")
    first = F.min(F.when(folded, F.struct((-F.col("k")).alias("w"), "id"))).alias("first")
    start = numbered.groupBy(F.col("at").alias("a")).agg(whole, F.sum(F.when(folded, F.col("k")).otherwise(0.0)).alias("hair"), first, F.max(F.when(~folded, F.col("id"))).alias("label"))
    # weight: what ``before`` weighs in the coming round.
    now = stored(start.select("a", "label", F.coalesce("first.id", "label").alias("before"), "k", "hair", F.coalesce(-F.col("first.w"), F.lit(0.0)).alias("weight")))
    steady = False
    for i in range(1, rounds + 1):
        self = F.col("a") == F.col("b")
        told = edges.select("a", "b", "w").join(lookup(now.withColumnRenamed("a", "b"), n), "b")
        votes = told.groupBy("a", F.when(self, F.col("before")).otherwise(F.col("label")).alias("vote")).agg(
            F.sum(F.when(self, F.col("weight")).otherwise(F.col("w"))).alias("w"), F.max(F.when(self, F.struct("label", "before", "k", "hair"))).alias("own")
        )
        best = votes.groupBy("a").agg(F.min(F.struct((-F.col("w")).alias("w"), "vote")).alias("best"), F.max("own").alias("own"))
        seen = Observation()
        off = F.count_if(F.col("label") != F.col("own.before")).alias("off")
        out = best.select("a", F.col("best.vote").alias("label"), F.col("own.label").alias("before"), "own.k", "own.hair", F.col("own.hair").alias("weight"), "own")
        new = stored(out.observe(seen, off).drop("own"))
        dropped(now)
        # The first round's ``before`` is of a folded node.
        same, now = i > 1 and not seen.get["off"], new
        if same and steady:
            if (rounds - i) % 2:
                now = stored(new.select("a", F.col("before").alias("label"), F.col("label").alias("before"), "k", "hair"))
            break
        steady = same
    return now.select("a", "label", "before", "k", "hair")


def _spread_quality(spread: DataFrame, edges: DataFrame, m2: float, n: int) -> float:
    """Modularity of what ``_propagated`` found: edges to folded nodes are cut where their label differs."""
    own = lambda side: lookup(spread.select(F.col("a").alias(side), F.col("label").alias(f"c_{side}")), n)
    cut = edges.where("a != b").join(own("a"), "a").join(own("b"), "b").where("c_a != c_b").agg(F.sum("w").alias("cut"))
    hairs = spread.agg(F.sum(F.when(F.col("label") != F.col("before"), 2 * F.col("hair"))).alias("hairs"))
    parts = F.array(F.struct("label", (F.col("k") - F.col("hair")).alias("t")), F.struct(F.col("before").alias("label"), F.col("hair").alias("t")))
    mass = spread.select(F.inline(parts)).groupBy("label").agg(F.sum("t").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("s"))
    told = cut.crossJoin(hairs).crossJoin(mass).first()
    return 1 - ((told["cut"] or 0) + (told["hairs"] or 0)) / m2 - (told["s"] or 0) / m2**2


def cluster(pairs: DataFrame, *, sweeps: int = 2, levels: int = 20) -> DataFrame:
    """Communities of pairs (a, b, weight) by modularity: node, community (its least node).

    Levels of local moving, refinement and contraction run until modularity
    stops growing (``levels`` is only a stop beyond what graphs
    need). A level takes ``sweeps`` sweeps, and what still moves then goes on among the fewer nodes of the
    next; one that did not grow while nodes still moved has as many again before it counts as the last. The result is then held against label propagation,
    and the better one stays, so it is never below that. Weights must
    be above 0; pairs may repeat, their weights add up. Nodes with loops only are
    alone. No node's edges and no community are gathered in one task: all steps are joins and
    sums, combined before they are shuffled.
    """
    pairs = stored(pairs.where("weight > 0").select("a", "b", F.col("weight").cast("double").alias("w")))
    nodes, salt = _keyed(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    keyed = pairs.select(key_of(F.col("a"), salt).alias("a"), key_of(F.col("b"), salt).alias("b"), "w")
    summed = stored(keyed.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w")))
    dropped(pairs)
    m2 = summed.agg(F.sum(2 * F.col("w")).alias("s")).first()["s"]
    if not m2:
        return nodes.select("node", F.col("node").alias("community"))
    places, left, apart = _folded(summed)
    # What each node of the graph is at this level.
    base, found, best = places, None, None
    now = left.withColumn("community", F.col("node"))
    n = now.count()
    most = 2 * summed.count() + n
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    here, drop = _level(now, apart.select(F.inline(ways), "w"), n, most)
    spread = _propagated(places, nodes, here, n)
    least_told = _spread_quality(spread, here, m2, n)
    for level in range(levels):
        # Other halves on each level, so that two nodes do not swap places for ever.
        first = 2 * sweeps * level
        now, settled = _local_moving(now, here, m2, n, sweeps=sweeps, first=first)
        told = _quality(now, here, m2, n)
        if best is not None and told <= best + LEAST_GAIN and not settled:
            now, _ = _local_moving(now, here, m2, n, sweeps=sweeps, first=first + sweeps)
            told = _quality(now, here, m2, n)
        if best is not None and told <= best + LEAST_GAIN:
            break
        best = told
        found = stored(places.join(lookup(now.select(F.col("node").alias("at"), "community"), n), "at").select("node", "community"))
        fine = _refined(now, here, m2, n, most, sweeps=sweeps, first=first)
        own = lambda side, fine=fine, n=n: lookup(fine.select(F.col("node").alias(side), F.col("community").alias(f"f_{side}")), n)
        places = stored(places.join(own("at"), "at").select("node", F.col("f_at").alias("at")))
        bounds = now.select("node", F.col("community").alias("bound"))
        were, now = n, stored(fine.join(lookup(bounds, n), "node").groupBy(F.col("community").alias("node")).agg(F.sum("k").alias("k"), F.min("bound").alias("community")))
        coarse = here.where("a != b").join(own("a"), "a").join(own("b"), "b").where("f_a != f_b").groupBy(F.col("f_a").alias("a"), F.col("f_b").alias("b")).agg(F.sum("w").alias("w"))
        n, wide = now.count(), drop
        if n == were:
            break
        most = min(most, n * n)
        here, drop = _level(now, coarse, n, most)
        wide()
    drop()
    if least_told > best:
        label = F.when(F.col("node") == F.col("at"), F.col("label")).otherwise(F.col("before"))
        found = base.join(spread.withColumnRenamed("a", "at"), "at").select("node", label.alias("community"))
    named = stored(found.join(nodes.select(F.col("key").alias("node"), F.col("node").alias("name")), "node").select("name", "community"))
    least = named.groupBy("community").agg(F.min("name").alias("least"))
    return named.join(least, "community").select(F.col("name").alias("node"), F.col("least").alias("community"))
