"""Exact top-k by inner product with M-trees: best-first search through pages with covering radii and parent distances.

Components become floor(256 * x); scores are integer inner products. One more coordinate, sqrt(M² - |x|²) with M the greatest
length, makes the nearest row in the metric the one of greatest inner product. Rows go to the nearest of a few pivots, and each
chunk of a pivot's rows is one tree; trees are dealt to units. A search takes nodes of all trees of a unit off one heap by their lower bound, the
roots too; |d(q, parent) - d(parent, child)| less the child's radius, from stored distances, rules children and entries out before their own
distance is computed. A query first searches the unit of its nearest pivot; all other units start with the bound found there.

Rows with a null vector, a null or non-finite component, another length than most, or a null id take no part; zero
vectors do. A component beyond 2**20 raises an error, and so does a vector whose integer components' squares sum to 2**60 or more, as
scores must fit 64 bits. Repeated rows are candidates each by itself; none has
its own query's id; of rows that share an id the least vector is the query. Ties go to smaller ids. Fewer candidates than `top` are all returned. Empty tables give empty results.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.steps import scratch
from tidemill.llm import vectors
from tidemill.llm.shared import kept

PIVOTS, FANOUT, PAGE, SCALE = 16, 16, 128, 256
#: Squares of lengths below it: no inner product or part of one leaves 64 bits.
LONGEST = 1 << 60
#: The score of nothing, below all others.
NONE = -(1 << 62)
#: Distances are doubles: what they may be off by, of the limit itself and of the greatest length.
_ROUNDING = (1e-7, 1e-11)


class Page:
    """A node. Its entries are rows (leaf) or pages; of each the distance to this page's own router is stored, and a radius (0 for rows)."""

    __slots__ = ("children", "from_parent", "ids", "leaf", "points", "radius")

    def __init__(self, leaf, points, from_parent, radius, ids=None, children=None):
        self.leaf, self.points, self.from_parent, self.radius, self.ids, self.children = leaf, points, from_parent, radius, ids, children


def _apart(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - p) ** 2).sum(axis=1))


def build(x: np.ndarray, ids: np.ndarray, router: np.ndarray, r: np.random.Generator) -> Page:
    """A page of all rows x under router."""
    if len(x) <= PAGE:
        return Page(True, x, _apart(x, router), np.zeros(len(x)), ids)
    pick = x[np.sort(r.choice(len(x), FANOUT, replace=False))]
    own = np.argmin(np.stack([_apart(x, p) for p in pick]), axis=0)
    if np.bincount(own).max() > 0.9 * len(x):  # many equal rows: by order instead
        own = np.arange(len(x)) * FANOUT // len(x)
    points, radius, children = [], [], []
    for j in np.unique(own):
        mine = own == j
        points.append(x[mine][0] if not (x[mine] == pick[j]).all(axis=1).any() else pick[j])
        radius.append(_apart(x[mine], points[-1]).max())
        children.append(build(x[mine], ids[mine], points[-1], r))
    points = np.stack(points)
    return Page(False, points, _apart(points, router), np.array(radius), None, children)


def lifted(x: np.ndarray, longest: int) -> np.ndarray:
    """Integer rows with the coordinate that gives all the same length."""
    return np.column_stack([x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))]).astype(np.float64)


class Block:
    """A block of queries in a unit: what is best for each so far, and what a row must reach."""

    def __init__(self, q: np.ndarray, own: np.ndarray, longest: int, top: int, least: np.ndarray | None = None):
        self.q, self.own = q, own
        self.exact = longest < 1 << 53  # products of integers are exact in doubles, whatever their order
        self.asked = q.astype(np.float64) if self.exact else q
        self.square = (q * q).sum(axis=1) + longest
        self.slack = _ROUNDING[0] + _ROUNDING[1] * np.sqrt(longest)
        self.score, self.vec = np.full((len(q), top), NONE), np.full((len(q), top), np.iinfo(np.int64).max)
        self.least = np.full(len(q), NONE) if least is None else least
        self.computed = 0
        self._reach = self.reach_of(np.arange(len(q)))

    def products(self, rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        self.computed += len(rows) * len(points)
        if self.exact:
            return (self.asked[rows] @ points[:, :-1].T).astype(np.int64)
        return self.asked[rows] @ points[:, :-1].astype(np.int64).T

    def distances(self, rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        """To rows that the added coordinate made equally long; the queries' own one is 0."""
        return np.sqrt(np.maximum(self.square[rows][:, None] - 2 * self.products(rows, points), 0))

    def reach_of(self, rows: np.ndarray) -> np.ndarray:
        need = np.maximum(self.score[rows, -1], self.least[rows])
        far = np.sqrt(np.maximum(self.square[rows] - 2 * np.maximum(need, -LONGEST), 0)) * (1 + _ROUNDING[0]) + self.slack
        return np.where(need == NONE, np.inf, far)

    def reach(self, rows: np.ndarray) -> np.ndarray:
        """The distance within which a row may still be among the best."""
        return self._reach[rows]

    def look(self, rows: np.ndarray, page: Page, cols: np.ndarray) -> None:
        """Takes the rows cols of a leaf into account."""
        score, ids = self.products(rows, page.points[cols]), page.ids[cols]
        score[self.own[rows][:, None] == ids] = NONE
        hit = (score >= np.maximum(np.maximum(self.score[rows, -1], self.least[rows]), NONE + 1)[:, None]).any(axis=1)
        if not hit.any():
            return
        rows = rows[hit]
        s = np.concatenate([self.score[rows], score[hit]], axis=1)
        v = np.concatenate([self.vec[rows], np.where(score[hit] == NONE, np.iinfo(np.int64).max, ids)], axis=1)
        order = np.lexsort((v, -s), axis=-1)[:, : self.score.shape[1]]
        self.score[rows], self.vec[rows] = np.take_along_axis(s, order, axis=1), np.take_along_axis(v, order, axis=1)
        self._reach[rows] = self.reach_of(rows)

    def found(self):
        """(row of the block, vec_id, score) of what is best."""
        row, place = np.nonzero(self.score != NONE)
        return row, self.vec[row, place], self.score[row, place]


def find(trees: list[tuple[Page, np.ndarray, float]], block: Block) -> None:
    """Finds the best rows of trees (root page, its router, its radius) for a block of queries.

    Each query first goes down to the leaf of the nearest routers, so that it has a bound. Then pages come off a heap by the least lower bound
    of any query; only queries that can't rule a page out look at it, and only at entries that the stored distances to its router don't rule out.
    """
    every = np.arange(len(block.q))
    roots = block.distances(every, np.stack([r for _, r, _ in trees]))
    seeded = np.full(len(every), -1)  # the leaf that a query has seen
    nearest = np.argmin(roots, axis=1)
    down = [(trees[t][0], every[nearest == t]) for t in np.unique(nearest)]
    while down:
        page, rows = down.pop()
        if page.leaf:
            block.look(rows, page, np.arange(len(page.ids)))
            seeded[rows] = id(page)
            continue
        child = np.argmin(block.distances(rows, page.points), axis=1)
        down += [(page.children[c], rows[child == c]) for c in np.unique(child)]
    heap, tie = [], 0

    def push(page: Page, rows: np.ndarray, d: np.ndarray, low: np.ndarray) -> None:
        nonlocal tie
        may = low <= block.reach(rows)
        if may.any():
            heapq.heappush(heap, (float(low[may].min()), tie, page, rows[may], d[may], low[may]))
            tie += 1

    for t, (page, _, radius) in enumerate(trees):
        push(page, every, roots[:, t], np.maximum(0, roots[:, t] - radius - block.slack))
    while heap:
        _, _, page, rows, d, low = heapq.heappop(heap)
        reach = block.reach(rows)
        may = low <= reach
        if page.leaf:
            may &= seeded[rows] != id(page)
        rows, d, reach = rows[may], d[may], reach[may]
        if not len(rows):
            continue
        near = np.abs(d[:, None] - page.from_parent) - page.radius <= reach[:, None]
        cols, some = np.flatnonzero(near.any(axis=0)), near.any(axis=1)
        if not len(cols):
            continue
        rows, near = rows[some], near[some]
        if page.leaf:
            block.look(rows, page, cols)
            continue
        dist = block.distances(rows, page.points[cols])
        for j, c in enumerate(cols.tolist()):
            asks = near[:, c]
            push(page.children[c], rows[asks], dist[asks, j], np.maximum(0, dist[asks, j] - page.radius[c] - block.slack))


def search(df: DataFrame, every: int, top: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the top rows for each row whose id is divisible by `every`."""
    with scratch(df.sparkSession) as last:
        rows, n = vectors.valid(df, id_col, vec_col, zero=True)
        whole = F.transform("_vec", lambda x: F.when(F.abs(x) <= float(1 << 20), F.floor(x * SCALE)).otherwise(F.raise_error(F.lit("component beyond 2**20"))))
        rows = kept(rows.select("_id", whole.cast("array<long>").alias("_vec")), "mtree-rows")
        square = F.aggregate("_vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        count, most = rows.agg(F.count("*"), F.max(square)).first()
        if most is not None and most >= LONGEST * 0.999:
            raise ValueError("a vector is too long for scores of 64 bits")
        longest = int(rows.agg(F.max(F.aggregate("_vec", F.lit(0).cast("long"), lambda s, x: s + x * x))).first()[0] or 0)
        some = vectors.sampled(rows, n) if n else np.zeros((0, 1))
        r = np.random.default_rng(5)
        pivots = lifted(some[np.sort(r.choice(len(some), min(PIVOTS, len(some)), replace=False))], longest) if len(some) else np.zeros((1, n + 1))
        units = vectors.units(df.sparkSession, count)

        def nearest(x: np.ndarray) -> np.ndarray:
            return np.argmin(np.stack([_apart(x, p) for p in pivots]), axis=0).astype(np.int32) if len(x) else np.zeros(0, np.int32)

        def assigned(batches):
            import pandas as pd

            for batch in batches:
                x = lifted(vectors.matrix(batch["_vec"], n), longest)
                yield pd.DataFrame({"grp": nearest(x), "_id": batch["_id"].to_numpy(), "_vec": batch["_vec"].to_list()})

        def pack(g):
            x = lifted(vectors.matrix(g["_vec"], n), longest)
            router = pivots[int(g["grp"].iloc[0])]
            radius = _apart(x, router).max()
            return pickle.dumps(build(x, g["_id"].to_numpy(np.int64), router, np.random.default_rng(9)), 5), router.tobytes(), np.float64(radius).tobytes()

        def asked(batches):
            import pandas as pd

            for batch in batches:
                x = vectors.matrix(batch["_vec"], n)
                yield pd.DataFrame({"grp": nearest(np.column_stack([x, np.zeros(len(x))])), "_id": batch["_id"].to_numpy(), "a": [np.asarray(v, np.int64).tobytes() for v in batch["_vec"]]})

        def opened(chunks):
            trees = [(pickle.loads(a), np.frombuffer(b, np.float64), float(np.frombuffer(c, np.float64)[0])) for _, a, b, c in chunks]

            def run(ids, a, b, c):
                q = np.frombuffer(b"".join(a), np.int64).reshape(len(ids), n)
                least = np.array([int.from_bytes(x, "big", signed=True) if x else NONE for x in b])
                block = Block(q, ids, longest, top, least)
                find(trees, block)
                row, vec, score = block.found()
                return ids[row], vec, score

            return run

        trees = last(vectors.chunked(rows.mapInPandas(assigned, "grp int, _id long, _vec array<long>"), units, pack, "mtree"))
        nothing = F.lit(b"")
        queries = rows.filter(F.col("_id") % every == 0).groupBy("_id").agg(F.min("_vec").alias("_vec")).mapInPandas(asked, "grp int, _id long, a binary")
        homes = trees.select("grp", F.col("unit").alias("home")).groupBy("grp").agg(F.min("home").alias("home"))  # a row for each pivot
        queries = last(kept(queries.join(F.broadcast(homes), "grp", "left").select("_id", "a", F.coalesce("home", F.lit(0)).alias("home")), "mtree-queries"))  # a pivot that equals an earlier one has no rows
        first = last(kept(vectors.found(queries.select(F.col("home").alias("unit"), "_id", "a", nothing.alias("b"), nothing.alias("c")), trees, units, opened, "long"), "mtree-first"))
    if units == 1:
        return vectors.ranked(first, top)
    bound = vectors.ranked(first, top).filter(F.col("rank") == top).select(F.col("query_id").alias("_qid"), F.col("score").alias("_least"))
    rest = queries.join(bound, F.col("_id") == F.col("_qid"), "left").select(F.explode(F.sequence(F.lit(0), F.lit(units - 1))).alias("unit"), "_id", "a", "home", "_least").filter("unit <> home")
    known = F.coalesce(F.unhex(F.lpad(F.hex("_least"), 16, "0")), nothing)  # big-endian; hex() of a negative long has 16 digits
    rest = rest.select("unit", "_id", "a", known.alias("b"), nothing.alias("c"))
    return vectors.ranked(first.unionAll(vectors.found(rest, trees, units, opened, "long")), top)
