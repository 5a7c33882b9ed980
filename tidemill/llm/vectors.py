"""What the two vector searches share: valid vectors, chunks of rows by a group, and queries sent to units of chunks.

A stated set of queries meets all rows: chunks are dealt to units of about UNIT rows, one task each, and a query goes once to each unit,
which returns what is best there for it. A task holds one unit and a block of queries; no group is larger for a frequent
vector. What is shuffled are the rows once, and a query for each unit: rows are written UNIT / (bytes of a query) times more seldom than
pairs are compared.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.shared import frugal, kept, partitions, some_rows

#: Rows of a chunk (twice as many at most), rows of a unit of chunks, queries that a task holds at once.
CHUNK, UNIT, BLOCK = 4096, 65_536, 512
#: Rows from which centroids and pivots are chosen.
SAMPLE = 20_000


def valid(df: DataFrame, id_col: str, vec_col: str, zero: bool) -> tuple[DataFrame, int]:
    """(_id, _vec as doubles) of the rows that take part, and their length: the commonest (the greater of equals). zero: whether zero vectors do."""
    v = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("_id"), v.alias("_vec")).filter("_id is not null and size(_vec) > 0")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.filter(F.forall("_vec", lambda x: F.coalesce(finite(x), F.lit(False))))
    if not zero:
        rows = rows.filter(F.exists("_vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("_vec").alias("n")).count().agg(F.max(F.struct("count", "n")).alias("m")).first()["m"]
    n = sizes["n"] if sizes else 0
    return rows.filter(F.size("_vec") == n), n


def sampled(rows: DataFrame, n: int) -> np.ndarray:
    """About SAMPLE vectors, by a hash of their ids, in the order of ids and components."""
    got = some_rows(rows.select("_id", "_vec"), ["_id"], SAMPLE).toArrow()
    x = np.array(got["_vec"].combine_chunks().values.to_numpy(zero_copy_only=False) if len(got) else [], np.float64).reshape(-1, n)
    return x[np.lexsort((*x.T[::-1], got["_id"].to_numpy()))] if len(x) else x


def matrix(column, n: int) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64) if len(column) else np.zeros((0, n))


def units(spark: SparkSession, rows: int) -> int:
    """How many units `rows` rows make: one for each chunk up to the session's partitions, more once they are full."""
    return max(1, min(partitions(spark), -(-rows // CHUNK)), -(-rows // UNIT))


def unit_of(grp: Column, salt: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(grp.cast("int"), salt.cast("int")), F.lit(n)).cast("int")


def chunked(rows: DataFrame, n_units: int, pack, name: str, order: list[str] = ()) -> DataFrame:
    """rows (grp int, _id, ..) as one row for each chunk: unit, grp, a, b, c binary. pack(pandas rows of one group, by order and _id) -> (a, b, c). A group of many rows makes many chunks."""
    spark = rows.sparkSession
    counts = rows.groupBy("grp").count().select(F.col("grp").alias("_g"), F.ceil(F.col("count") / CHUNK).cast("int").alias("salts"))
    salted = rows.join(kept(counts, f"{name}-groups"), F.col("grp") == F.col("_g")).withColumn("salt", F.pmod(F.xxhash64("_id"), F.col("salts")).cast("int")).drop("_g", "salts")
    salted = salted.withColumn("unit", unit_of(F.col("grp"), F.col("salt"), n_units))

    def run(batches):
        import pandas as pd

        from tidemill.llm.ngram_join import grouped

        for g in grouped(batches, ["grp", "salt"]):
            for lo in range(0, len(g), 2 * CHUNK):
                a, b, c = pack(g.iloc[lo : lo + 2 * CHUNK])
                yield pd.DataFrame({"unit": [g["unit"].iloc[0]], "grp": [g["grp"].iloc[0]], "a": [a], "b": [b], "c": [c]})

    spread = salted.repartition(partitions(spark), "grp", "salt").sortWithinPartitions("grp", "salt", *order, "_id")
    return kept(spread.mapInPandas(frugal(run), "unit int, grp int, a binary, b binary, c binary"), f"{name}-chunks")


def found(queries: DataFrame, chunks: DataFrame, n_units: int, opened, score_type: str) -> DataFrame:
    """query_id, vec_id, score: what is best for each query in each of its units.

    queries: unit, _id, a, b, c binary. opened([(grp, a, b, c)]) takes a unit's chunks and returns search(ids, [a], [b], [c]) of a block of queries -> (query_id, vec_id, score) arrays.
    """
    q = queries.select("unit", F.lit(1).alias("kind"), F.col("_id").alias("id"), "a", "b", "c")
    c = chunks.select("unit", F.lit(0).alias("kind"), F.col("grp").cast("long").alias("id"), "a", "b", "c")

    def run(batches):
        import pandas as pd

        def out():
            ids, *columns = zip(*block, strict=True)
            return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), search(np.array(ids, np.int64), *columns), strict=True)))

        unit, held, block, search = None, [], [], None
        for batch in batches:
            for u, kind, id_, a, b, c in zip(*(batch[x].tolist() for x in ("unit", "kind", "id", "a", "b", "c")), strict=True):
                if u != unit:
                    if block:
                        yield out()
                    unit, held, block, search = u, [], [], None
                if kind == 0:
                    held.append((id_, a, b, c))
                elif held:
                    if search is None:
                        search, held = opened(held), [None]
                    block.append((id_, a, b, c))
                    if len(block) == BLOCK:
                        yield out()
                        block = []
        if block:
            yield out()

    return q.unionAll(c).repartitionById(n_units, "unit").sortWithinPartitions("unit", "kind", "id").mapInPandas(frugal(run), f"query_id long, vec_id long, score {score_type}")


def ranked(found: DataFrame, top: int) -> DataFrame:
    """query_id, rank, vec_id, score: greater scores first, ties to smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


class Tops:
    """For each query of a block the best (score, vec_id) so far: greater scores first, then smaller ids. Repeated pairs count as often as they occur."""

    def __init__(self, ids: np.ndarray, top: int, dtype):
        self.ids, self.top = ids, top
        self.score = [np.zeros(0, dtype) for _ in ids]
        self.vec = [np.zeros(0, np.int64) for _ in ids]

    def least(self, i: int):
        """The score that a row needs at least (equal ones may still win by id)."""
        return self.score[i][-1] if len(self.score[i]) == self.top else None

    def add(self, i: int, score: np.ndarray, vec: np.ndarray) -> None:
        s, v = np.concatenate([self.score[i], score]), np.concatenate([self.vec[i], vec])
        order = np.lexsort((v, -s))[: self.top]
        self.score[i], self.vec[i] = s[order], v[order]

    def rows(self):
        return np.repeat(self.ids, [len(s) for s in self.score]), np.concatenate(self.vec), np.concatenate(self.score)
