"""Hard negatives by dual-tree search over integer vectors.

Vectors are dealt into cells of a tree that is fitted on a bounded sample. The
cells are the top of both trees, of anchors and of candidates: an anchor only
travels to cells whose ball can hold a score that it still asks for. Where a
block of a cell meets a block of anchors, both get ball trees. For two nodes
with centres c, d and radii r, s all inner products lie within
c.d +- (|c| s + |d| r + r s); a pair of nodes whose interval misses all that
the anchors of its node ask for is dropped, with the whole group of anchors.
Pairs of leaves that stay are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import checkpoint_folder, checkpointed, small_batches

#: Ends of a long; scores beyond are held to them.
LOW, HIGH = -(1 << 63) + 1, (1 << 63) - 1
ROWS = "row bigint, vec_id bigint, label bigint, v array<double>"
FOUND = "row bigint, slot int, id bigint, score bigint"


def scaled(vectors: DataFrame, *, key: str = "vec_id", column: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """Rows that take part, with a number of their own: row, vec_id, label, v (components floor(scale * x) as whole doubles)."""
    x = F.transform(column, lambda c: c.cast("double"))
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(column).isNotNull()).where(~odd)
    # floor() of a double is a long and would saturate; what rounding leaves is a whole double at any size.
    down = lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c)
    return kept.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), F.transform(x, lambda c: down(c * F.lit(float(scale)))).alias("v"))


class Tree:
    """Ball tree of the rows of a matrix; a node is a run of ``order``."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.order = np.arange(len(x))
        first, last, left, centre, radius = [], [], [], [], []
        todo = [(0, len(x))]
        # Breadth first, so children stand side by side.
        for lo, hi in todo:
            own = x[self.order[lo:hi]]
            c = own.mean(axis=0)
            first.append(lo), last.append(hi), centre.append(c)
            radius.append(float(np.sqrt(((own - c) ** 2).sum(axis=1).max())))
            if hi - lo <= leaf:
                left.append(-1)
                continue
            # Halves along the line between two far rows.
            far = own[np.argmax(((own - c) ** 2).sum(axis=1))]
            other = own[np.argmax(((own - far) ** 2).sum(axis=1))]
            self.order[lo:hi] = self.order[lo:hi][np.argsort(own @ (other - far), kind="stable")]
            left.append(len(todo))
            todo += [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
        self.first, self.last, self.left = np.array(first), np.array(last), np.array(left)
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.norm = np.sqrt((self.centre**2).sum(axis=1))


def interval(c, c_norm, r, d, d_norm, s) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of rows of two balls (pairs of them), with room for rounding."""
    mid, reach = (c * d).sum(axis=-1), c_norm * s + d_norm * r + r * s
    slack = 1e-9 * (c_norm + r) * (d_norm + s) + 1e-6
    return mid - reach - slack, mid + reach + slack


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: in doubles where no partial sum can pass 2**53, else in whole numbers of any length, held to what a long takes."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.array([[max(LOW, min(HIGH, s)) for s in row] for row in whole(a) @ whole(b).T], np.int64).reshape(len(a), len(b))


class Best:
    """The k best (score, id) within each of an anchor's windows, and the least score that still helps."""

    def __init__(self, low: np.ndarray, high: np.ndarray, floor: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.need = np.maximum(low, floor)
        self.found = [[(np.zeros(0, np.int64), np.zeros(0, np.int64))] * low.shape[1] for _ in range(len(low))]

    def add(self, anchor: int, scores: np.ndarray, ids: np.ndarray) -> None:
        for j in range(self.low.shape[1]):
            at = np.flatnonzero((scores >= self.need[anchor, j]) & (scores <= self.high[anchor, j]))
            if len(at):
                s, i = (np.concatenate(x) for x in zip(self.found[anchor][j], (scores[at], ids[at]), strict=True))
                order = np.lexsort((i, -s))[: self.k]
                self.found[anchor][j] = s[order], i[order]
                if len(order) == self.k:
                    self.need[anchor, j] = max(self.need[anchor, j], s[order[-1]])


def search(a: np.ndarray, c: np.ndarray, ids: np.ndarray, best: Best, numbers: np.ndarray, skip, *, leaf_a: int = 32, leaf_c: int = 64, step: int = 16) -> None:
    """Dual-tree search: anchors ``a`` (``numbers`` in ``best``) against candidates ``c``; ``skip(anchors, candidates)`` is a mask of pairs that don't count."""
    tree_a, tree_c = Tree(a, leaf_a), Tree(c, leaf_c)

    def asked() -> tuple[np.ndarray, np.ndarray]:
        """For each anchor node the least and the largest score that one of its windows still asks for."""
        low, high = best.need[numbers][tree_a.order].min(axis=1), best.high[numbers][tree_a.order].max(axis=1)
        spans = list(zip(tree_a.first, tree_a.last, strict=True))
        return np.array([low[f:e].min() for f, e in spans]), np.array([high[f:e].max() for f, e in spans])

    low, high = asked()
    p, q = np.zeros(1, int), np.zeros(1, int)
    leaves: list[tuple] = []
    while len(p):
        least, most = interval(tree_a.centre[p], tree_a.norm[p], tree_a.radius[p], tree_c.centre[q], tree_c.norm[q], tree_c.radius[q])
        on = (most >= low[p]) & (least <= high[p])
        p, q, most = p[on], q[on], most[on]
        ends_a, ends_c = tree_a.left[p] < 0, tree_c.left[q] < 0
        done = ends_a & ends_c
        leaves.append((p[done], q[done], most[done]))
        # The wider node of a pair is split.
        split_a = ~done & ~ends_a & (ends_c | (tree_a.radius[p] >= tree_c.radius[q]))
        split_c = ~done & ~split_a
        l, m = tree_a.left[p[split_a]], tree_c.left[q[split_c]]
        p, q = np.concatenate([l, l + 1, p[split_c], p[split_c]]), np.concatenate([q[split_a], q[split_a], m, m + 1])
    p, q, most = (np.concatenate([x[i] for x in leaves]) for i in range(3))
    for leaf in np.unique(p):
        mine = tree_a.order[tree_a.first[leaf] : tree_a.last[leaf]]
        at = np.flatnonzero(p == leaf)
        at = at[np.argsort(-most[at], kind="stable")]
        i, size = 0, 2
        while i < len(at):
            # The largest bounds come first, a few at a time, so what the group asks for rises quickly.
            some = at[i : i + size]
            i, size = i + size, min(2 * size, step)
            need = best.need[numbers[mine]].min()
            some = some[most[some] >= need]
            if not len(some):
                break
            theirs = np.concatenate([tree_c.order[tree_c.first[n] : tree_c.last[n]] for n in q[some]])
            scores, masked = exact(a[mine], c[theirs]), skip(mine, theirs)
            for row, anchor in enumerate(mine):
                keep = ~masked[row]
                best.add(numbers[anchor], scores[row][keep], ids[theirs][keep])


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(flat) else flat.reshape(len(lists), 0)


def _met(k: int, same_label: bool):
    """Search of a block of anchors in a block of candidates of one length."""

    def run(key, left, right):
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            a, c = _matrix(left.column("v")), _matrix(right.column("v"))
            ids, rows = right.column("vec_id").to_numpy(), left.column("row").to_numpy()
            own, label_a, label_c = left.column("vec_id").to_numpy(), left.column("label").to_numpy(), right.column("label").to_numpy()
            windows = [left.column(n).to_pylist() for n in ("low", "high", "floor")]
            width = max(len(w) for w in windows[0])
            # A window that an anchor doesn't have asks for nothing.
            low, high, floor = (np.array([w + [fill] * (width - len(w)) for w in x], np.int64) for x, fill in zip(windows, (HIGH, LOW, HIGH), strict=True))
            best = Best(low, high, floor, k)
            if same_label:
                for label in np.intersect1d(label_a, label_c):
                    i, j = np.flatnonzero(label_a == label), np.flatnonzero(label_c == label)
                    search(a[i], c[j], ids[j], best, i, lambda x, y, i=i, j=j: own[i][x][:, None] == ids[j][y][None, :])
            else:
                search(a, c, ids, best, np.arange(len(a)), lambda x, y: label_a[x][:, None] == label_c[y][None, :])
            for n, row in enumerate(rows.tolist()):
                for slot, (scores, found) in enumerate(best.found[n]):
                    out += [(row, slot, i, s) for s, i in zip(scores.tolist(), found.tolist(), strict=True)]
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.table([pa.array(list(x), t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["row", "slot", "id", "score"])

    return run


def _cells(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of the leaves of a tree over a sample."""
    tree = Tree(sample, max(1, -(-len(sample) // cells)))
    return tree.centre[tree.left < 0]


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None, :]
    cell = d.argmin(axis=1)
    return cell, np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))


def _dealt(centres: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            size = np.array([len(v) for v in table.column("v").to_pylist()], int)
            cell, far = np.zeros(len(size), np.int32), np.zeros(len(size))
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                x = _matrix(table.column("v").take(pa.array(at)))
                cell[at], far[at] = _nearest(x, centres[int(n)]) if int(n) in centres else (0, np.inf)
            added = table.append_column("size", pa.array(size.astype(np.int32))).append_column("cell", pa.array(cell)).append_column("far", pa.array(far))
            yield from added.to_batches()

    return run


def _routed(centres: dict[int, np.ndarray], radius: dict[tuple[int, int], float], blocks: dict[tuple[int, int], int], only_own: bool, but_own: bool):
    """For each anchor the cells whose ball can hold a score within one of its windows."""

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            lows, floors, highs = (table.column(n).to_pylist() for n in ("low", "floor", "high"))
            low = np.array([min(map(max, a, b)) if a else HIGH for a, b in zip(lows, floors, strict=True)], np.float64)
            high = np.array([max(a) if a else LOW for a in highs], np.float64)
            size, cell = table.column("size").to_numpy(), table.column("cell").to_numpy()
            to: list[list[dict]] = [[] for _ in range(len(size))]
            for n in np.unique(size):
                at, known = np.flatnonzero(size == n), [k for s, k in radius if s == n]
                if only_own:
                    on = np.array([[k == cell[i] for k in known] for i in at])
                else:
                    x, r = _matrix(table.column("v").take(pa.array(at))), np.array([radius[n, k] for k in known])
                    c = centres[int(n)][known] if int(n) in centres else np.zeros((len(known), x.shape[1]))
                    norm, c_norm = np.sqrt((x**2).sum(axis=1)), np.sqrt((c**2).sum(axis=1))
                    with np.errstate(invalid="ignore"):
                        least, most = interval(x[:, None, :], norm[:, None], 0.0, c[None, :, :], c_norm[None, :], r[None, :])
                    # Of a cell without bounds nothing is known.
                    on = ~(most < low[at][:, None]) & ~(least > high[at][:, None]) & (high[at] > LOW)[:, None]
                    if but_own:
                        on &= np.array(known)[None, :] != cell[at][:, None]
                for i, row in zip(at, on, strict=True):
                    to[i] = [{"to": int(known[j]), "blocks": blocks[n, known[j]]} for j in np.flatnonzero(row)]
            kind = pa.list_(pa.struct([("to", pa.int32()), ("blocks", pa.int32())]))
            yield from table.append_column("routes", pa.array(to, kind)).to_batches()

    return run


def hard_negatives(
    vectors: DataFrame, *, anchor: str = "vec_id % 50 = 0", positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95),
    cell_rows: int = 1024, most_cells: int = 256, block_rows: int = 1 << 14, anchor_rows: int = 1 << 14, sampled: int = 20_000,
) -> DataFrame:
    """Hard negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` is (row, vec_id, label, v) as ``scaled`` makes it. A score is the
    exact inner product with the anchor, larger ones first, ties by smaller
    vec_id. An anchor's positives are its first ``positives`` rows of its label
    with another vec_id; a negative has another label and a score within
    ``share`` (per cent) of the positive's, bounds included, of which the first
    ``negatives`` are told (a negative positive score has none; of 0, scores of 0).
    Vectors of different lengths have no score. Rows of one vec_id are rows of
    their own, also as anchors, and never each other's positive. Scores beyond a
    long are held to its ends.

    Cells are fitted for each length on at most about ``sampled`` rows: one for
    ``cell_rows`` rows, ``most_cells`` at most; what the driver sees of a cell is its
    centre, radius and number of rows. Every row is in a cell (of a length that
    the sample doesn't know, in one without bounds). Cells are dealt in blocks of
    about ``block_rows`` by a hash, so one that holds a third of all rows is shared
    out, and anchors in blocks of about ``anchor_rows``. Three passes: an anchor's
    own cell, whose k-th best positive bounds the second; all other cells that
    can hold a better one; and the windows of the negatives.
    """
    spark, folder = vectors.sparkSession, checkpoint_folder(vectors.sparkSession)
    small_batches(spark, 2000)
    vectors.write.parquet(f"{folder}/vectors")
    table = spark.read.schema(ROWS).parquet(f"{folder}/vectors")
    n = table.count()
    some = table.where(F.rand(5) < min(1.0, 0.8 * sampled / max(1, n))).select("v").collect()
    by_size: dict[int, list] = {}
    for r in some:
        by_size.setdefault(len(r["v"]), []).append(r["v"])
    # Few lengths have a tree of their own; all others have one cell each.
    large = sorted(by_size, key=lambda s: -len(by_size[s]))[:8]
    centres = {s: _cells(np.array(by_size[s], np.float64).reshape(len(by_size[s]), s), max(1, min(most_cells, len(by_size[s]) * n // (cell_rows * len(some))))) for s in large}
    table.mapInArrow(_dealt(centres), f"{ROWS}, size int, cell int, far double").write.parquet(f"{folder}/cells")
    dealt = spark.read.schema(f"{ROWS}, size int, cell int, far double").parquet(f"{folder}/cells")
    told = dealt.groupBy("size", "cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()
    per_block = max(cell_rows, min(block_rows, n // most_cells))
    radius = {(r["size"], r["cell"]): r["far"] for r in told}
    blocks = {(r["size"], r["cell"]): -(-r["n"] // per_block) for r in told}
    anchors = dealt.where(anchor).drop("far")
    groups = -(-anchors.count() // anchor_rows) or 1
    spread = lambda salt, n: F.pmod(F.xxhash64("row", F.lit(salt)), n).cast("int")
    sizes = F.create_map(*[x for (s, c), b in blocks.items() for x in (F.struct(F.lit(s).alias("s"), F.lit(c).alias("c")), F.lit(b))]) if blocks else None
    candidates = dealt.select("vec_id", "label", "v", "size", F.col("cell").alias("to"), spread(1, sizes[F.struct(F.col("size").alias("s"), F.col("cell").alias("c"))] if blocks else F.lit(1)).alias("block"))

    def passed(asking: DataFrame, k: int, same_label: bool, **which) -> DataFrame:
        columns = ["row", "vec_id", "label", "v", "size", "cell", "low", "high", "floor"]
        schema = f"{ROWS}, size int, cell int, low array<bigint>, high array<bigint>, floor array<bigint>"
        routed = asking.select(*columns).mapInArrow(_routed(centres, radius, blocks, which.get("only_own", False), which.get("but_own", False)), f"{schema}, routes array<struct<to:int,blocks:int>>")
        one = routed.select("row", "vec_id", "label", "v", "low", "high", "floor", "size", spread(2, F.lit(groups)).alias("part"), F.inline("routes"))
        one = checkpointed(one.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).drop("blocks"))
        # A block of candidates goes to those blocks of anchors that ask for it.
        by = ["size", "to", "block", "part"]
        wanted = one.select(*by).distinct()
        # Aliases, as both sides come from one table.
        two = candidates.join(wanted, by[:3]).select(*[F.col(c).alias(c) for c in (*by, "vec_id", "label", "v")])
        return one.groupBy(*by).cogroup(two.groupBy(*by)).applyInArrow(_met(k, same_label), FOUND)

    def first(found: DataFrame, k: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("row", "slot").orderBy(F.col("score").desc(), "id"))
        return found.withColumn("place", place).where(F.col("place") <= k)

    one = lambda x: F.array(F.lit(x).cast("bigint"))
    asking = anchors.select("*", one(LOW).alias("low"), one(HIGH).alias("high"), one(LOW).alias("floor"))
    near = checkpointed(first(passed(asking, positives, True, only_own=True), positives))
    floors = near.where(F.col("place") == positives).select(F.col("row").alias("own"), F.array("score").alias("known"))
    asking = asking.join(floors, asking["row"] == floors["own"], "left").withColumn("floor", F.coalesce("known", "floor"))
    far = passed(asking, positives, True, but_own=True)
    best = checkpointed(first(near.drop("place").unionByName(far), positives).select("row", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # 50 p <= 100 n <= 95 p, in whole numbers: ceil and floor of the shares.
    decimal = F.col("positive_score").cast("decimal(20,0)")
    low, high = (F.ceil(decimal * share[0] / 100).cast("bigint"), F.floor(decimal * share[1] / 100).cast("bigint"))
    windows = best.where("positive_score >= 0").select("row", F.struct((F.col("place") - 1).alias("slot"), low.alias("low"), high.alias("high")).alias("w")).groupBy("row").agg(F.array_sort(F.collect_list("w")).alias("w"))
    asking = anchors.join(windows, "row").select("*", F.col("w.low").alias("low"), F.col("w.high").alias("high"), F.transform("w", lambda _: F.lit(LOW).cast("bigint")).alias("floor")).drop("w")
    chosen = first(passed(asking, negatives, False), negatives).select("row", (F.col("slot") + 1).alias("place"), F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select("row", F.col("vec_id").alias("anchor_id"))
    return chosen.join(best, ["row", "place"]).join(names, "row").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
