"""Approximate nearest neighbours, by inner product, with an inverted multi-index.

Two codebooks (k-means on at most vectors.SAMPLE rows) quantise the halves of a vector; a cell is a pair of centroids. For a query, half a cell is
as far as its centroid's inner product with the query's half is small: what rows there can have besides, SPREAD times the query half's
length times the mean deviation of the centroid's rows, counts too, so cells of long vectors aren't missed. A query
takes pairs off a heap by the sum of the two until their cells hold `share` of all rows. Only rows of these cells are multiplied with the
query; the best by that are scored again with their original vectors. Every row is indexed. Recall is measured against brute force in the tests, for vectors of one length
and of uneven ones.

Rows without a valid vector (null, zero, a null or non-finite component, another length than most) or without an id take
no part. Repeated rows are candidates each by itself; none has its own query's id; of rows that share an id the least vector is the query. Fewer candidates than `top` are all returned.
Ties go to smaller ids. Empty tables give empty results.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.steps import scratch
from tidemill.llm import vectors
from tidemill.llm.shared import kept

#: Centroids of a half; cells are taken until they hold SHARE of all rows; deviations that count for a centroid's rows.
CENTROIDS, SHARE, SPREAD = 64, 0.45, 2.0


def codebook(x: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """k-means: at most k centroids, from distinct rows."""
    rows = np.unique(x, axis=0)
    r = np.random.default_rng(3)
    c = rows[np.sort(r.choice(len(rows), min(k, len(rows)), replace=False))].copy()
    for _ in range(steps):
        own = nearest(x, c)
        for j in range(len(c)):
            if (mine := x[own == j]).size:
                c[j] = mine.mean(axis=0)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1) - 2 * (x @ c.T), axis=1)


def far(q: np.ndarray, c: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """How far each query is from each centroid: the less the greater their inner product, and what spread allows beyond it."""
    return -(q @ c.T) - SPREAD * np.linalg.norm(q, axis=1)[:, None] * spread


def visited(first: np.ndarray, second: np.ndarray, counts: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs by the sum of distances, from a heap, until their cells hold `most` rows: how many of the second centroids each first one takes, and the rank of each second one."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    fa, sb = first[a].tolist(), second[b].tolist()
    table = counts[np.ix_(a, b)].tolist()
    taken, total = [0] * len(a), 0
    heap = [(fa[0] + sb[0], 0, 0)]
    while heap and total < most:
        _, i, j = heapq.heappop(heap)
        taken[i] = j + 1
        total += table[i][j]
        if j + 1 < len(sb) and (i == 0 or taken[i - 1] > j + 1):
            heapq.heappush(heap, (fa[i] + sb[j + 1], i, j + 1))
        if i + 1 < len(fa) and taken[i + 1] == j:
            heapq.heappush(heap, (fa[i + 1] + sb[j], i + 1, j))
    m, rank = np.zeros(len(a), np.uint16), np.zeros(len(b), np.uint16)
    m[a] = taken
    rank[b] = np.arange(len(b))
    return m, rank


def search(df: DataFrame, every: int, top: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", centroids: int = CENTROIDS, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score (inner product in double): the top rows found for each row whose id is divisible by `every`."""
    spark = df.sparkSession
    with scratch(spark) as last:
        rows, n = vectors.valid(df, id_col, vec_col, zero=False)
        half = max(1, n // 2)
        some = vectors.sampled(rows, n) if n else np.zeros((0, 1))
        books = (codebook(some[:, :half], centroids), codebook(some[:, half:], centroids) if n > 1 else np.zeros((1, 0))) if len(some) else (np.zeros((1, half)), np.zeros((1, max(0, n - half))))
        held = spark.sparkContext.broadcast(books)

        def indexed(batches):
            import pandas as pd

            for batch in batches:
                x = vectors.matrix(batch["_vec"], n)
                a, b = nearest(x[:, :half], held.value[0]), nearest(x[:, half:], held.value[1])
                off = ((x[:, :half] - held.value[0][a]) ** 2).sum(axis=1), ((x[:, half:] - held.value[1][b]) ** 2).sum(axis=1)
                yield pd.DataFrame({"grp": a.astype(np.int32), "cell": b.astype(np.int32), "off_a": off[0], "off_b": off[1], "_id": batch["_id"].to_numpy(), "_vec": list(x)})

        index = kept(rows.mapInPandas(indexed, "grp int, cell int, off_a double, off_b double, _id long, _vec array<double>"), "index-rows")
        counts = np.zeros((len(books[0]), len(books[1])), np.int64)
        off = np.zeros(counts.shape), np.zeros(counts.shape)
        for r in index.groupBy("grp", "cell").agg(F.count("*").alias("n"), F.sum("off_a").alias("a"), F.sum("off_b").alias("b")).collect():  # at most centroids squared
            counts[r["grp"], r["cell"]], off[0][r["grp"], r["cell"]], off[1][r["grp"], r["cell"]] = r["n"], r["a"], r["b"]
        spread = np.sqrt(off[0].sum(axis=1) / np.maximum(counts.sum(axis=1), 1) / half), np.sqrt(off[1].sum(axis=0) / np.maximum(counts.sum(axis=0), 1) / max(1, n - half))
        total = int(counts.sum())
        sizes = spark.sparkContext.broadcast((counts, *(np.round(s, 9) for s in spread)))  # sums of doubles may differ in their last digits
        units = vectors.units(spark, total)

        def pack(g):
            return g["_id"].to_numpy(np.int64).tobytes(), g["cell"].to_numpy(np.int32).tobytes(), vectors.matrix(g["_vec"], n).tobytes()

        def asked(batches):
            import pandas as pd

            for batch in batches:
                x = vectors.matrix(batch["_vec"], n)
                counts, *spread = sizes.value
                a, b = far(x[:, :half], held.value[0], spread[0]), far(x[:, half:], held.value[1], spread[1])
                lists = [visited(p, q, counts, max(share * total, top + own)) for p, q, own in zip(a, b, batch["own"].tolist(), strict=True)]
                yield pd.DataFrame({"_id": batch["_id"].to_numpy(), "a": [v.tobytes() for v in x], "b": [m.tobytes() for m, _ in lists], "c": [r.tobytes() for _, r in lists]})

        def opened(chunks):
            vec = np.concatenate([np.frombuffer(a, np.int64) for _, a, _, _ in chunks])
            x = np.concatenate([np.frombuffer(c, np.float64) for *_, c in chunks]).reshape(len(vec), n)
            cell = np.concatenate([np.frombuffer(b, np.int32) for _, _, b, _ in chunks])
            grp = np.concatenate([np.full(len(a) // 8, g, np.int32) for g, a, _, _ in chunks])
            cut = np.concatenate([[0], np.flatnonzero((np.diff(cell) != 0) | (np.diff(grp) != 0)) + 1, [len(vec)]])
            cells = [(int(grp[lo]), int(cell[lo]), int(lo), int(hi)) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
            some = max(1, min(vectors.BLOCK, (1 << 22) // max(1, len(vec))))  # queries at once: a few million products

            def run(ids, a, b, c):
                q = np.frombuffer(b"".join(a), np.float64).reshape(len(ids), n)
                m = np.frombuffer(b"".join(b), np.uint16).reshape(len(ids), -1)
                rank = np.frombuffer(b"".join(c), np.uint16).reshape(len(ids), -1)
                tops = vectors.Tops(ids, top, np.float64)
                for first in range(0, len(ids), some):
                    part = slice(first, first + some)
                    rough = np.full((len(ids[part]), len(vec)), -np.inf)
                    for g, j, lo, hi in cells:
                        open_ = np.flatnonzero(rank[part, j] < m[part, g])
                        if len(open_):
                            rough[open_, lo:hi] = q[part][open_] @ x[lo:hi].T
                    for i, r in enumerate(rough, first):
                        r[vec == ids[i]] = -np.inf
                        seen = np.flatnonzero(r > -np.inf)
                        if not len(seen):
                            continue
                        r = r[seen]
                        if len(r) > top:
                            seen = seen[r >= np.partition(r, -top)[-top] - 1e-9 * (1 + np.abs(r).max())]
                        tops.add(i, (q[i] * x[seen]).sum(axis=1), vec[seen])  # summed alike for equal vectors, so that ties are ties
                return tops.rows()

            return run

        # of rows with one id the least vector asks, and none of them is a candidate
        named = index.filter(F.col("_id") % every == 0).groupBy("_id").agg(F.min("_vec").alias("_vec"), F.count("*").alias("own"))
        queries = last(kept(named.mapInPandas(asked, "_id long, a binary, b binary, c binary"), "index-queries"))
        chunks = last(vectors.chunked(index.drop("off_a", "off_b"), units, pack, "index", ["cell"]))
    sent = queries.select(F.explode(F.sequence(F.lit(0), F.lit(units - 1))).alias("unit"), "_id", "a", "b", "c")
    return vectors.ranked(vectors.found(sent, chunks, units, opened, "double"), top)
