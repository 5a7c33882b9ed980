"""What several operators use: tables in the shared folder, and word hashes by whole columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tidemill.functions.steps import scratch, step

#: A query's execution drops its own shuffle files once its rows are written (a Spark setting).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of texts that a Python worker holds at once, and of numbers.
BATCH_ROWS, NUMBER_ROWS = 500, 20_000
#: Rows of numbers that a worker sends at once, a few MB: the executor holds a batch and its copy off the heap.
SENT_ROWS = 100_000


def kept(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """df as a step: a Parquet table in the shared folder.

    batch_rows: rows that Python workers get at once meanwhile, where they are short.
    """
    spark = df.sparkSession
    settings = {CLEANUP: "true"} | ({BATCH: str(batch_rows)} if batch_rows else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return step(df, name)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """df with its columns named c0, c1, .. by their places, and the new names of the given ones: whatever they were called, no name clashes with an operator's own, which begin with an underscore."""
    have = df.columns
    at = [have.index(n) if n in have else [c.lower() for c in have].index(n.lower()) for n in names]
    return df.toDF(*(f"c{i}" for i in range(len(have)))), [f"c{i}" for i in at]


def unused(name: str, df: DataFrame) -> str:
    """name, with as many underscores more as it takes not to be a column of df."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_BASE = 0x9FB21C651E98DF25
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes hashed at once; a longer document makes a slice of its own.
SLICE = 1 << 18


def slices(texts: list[bytes], most: int = SLICE):
    """(first, last) of consecutive texts whose bytes together stay under most, one text at least."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        if i > first and total + len(t) > most:
            yield first, i
            first, total = i, 0
        total += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of all texts in turn, and the offset of each text's first (one more than texts).

    lower folds A-Z. A word's hash is a polynomial in its bytes, so no Python loop runs over words.
    """
    ends = np.cumsum([len(t) + 1 for t in texts])
    b = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    inside = _IN_WORD[b]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    starts, stops = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    size = stops - starts
    packed = b[inside]
    first = np.cumsum(size) - size
    place = np.arange(len(packed)) - np.repeat(first, size)
    powers = np.empty(int(size.max()), np.uint64)
    with np.errstate(over="ignore"):
        powers[0] = 1
        powers[1:] = np.uint64(_BASE)
        powers = np.multiply.accumulate(powers)
        h = np.add.reduceat((_LOWER if lower else _BYTE)[packed] * powers[place], first)
        h = mix(h + size.astype(np.uint64) * _STEP)
    return h, np.concatenate([[0], np.searchsorted(starts, ends)])


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive word hashes (len(words) - k + 1 of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = words[:n].copy()
        for j in range(1, k):
            h *= _STEP
            h += words[j : j + n]
        return mix(h + np.uint64(k))


def as_bytes(texts) -> list[bytes]:
    """UTF-8 of a pandas column of texts; null is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def union_find():
    """find and union over any hashable items; the smaller item leads."""
    up: dict = {}

    def find(x):
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def union(x, y) -> bool:
        x, y = find(x), find(y)
        if x == y:
            return False
        up[max(x, y)] = min(x, y)
        return True

    return up, find, union


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): node, comp (the smallest node reachable), for every node of an edge.

    Each task first joins up its own edges; then rounds of hooking labels to smaller neighbours and jumping pointers, each
    written to the shared folder. A component of any size is spread over all tasks: labels are minima, combined before
    the shuffle, and joins against the few moved labels may be split by Spark where one label is frequent.
    """
    from pyspark.sql import functions as F

    def joined(batches):
        import pandas as pd

        up, find, union = union_find()
        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
                union(a, b)
                up.setdefault(a, a)
                up.setdefault(b, b)
            if len(up) > 2_000_000:  # what is known so far goes out, and memory stays bounded
                yield pd.DataFrame({"a": list(up), "b": [find(x) for x in list(up)]})
                up.clear()
        if up:
            yield pd.DataFrame({"a": list(up), "b": [find(x) for x in list(up)]})

    with scratch(edges.sparkSession) as last:
        stars = kept(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInPandas(joined, "a long, b long").distinct(), "cc-stars", NUMBER_ROWS)
        nodes = stars.select(F.col("a").alias("node"), "b").unionAll(stars.select(F.col("b").alias("node"), "b"))
        label = kept(nodes.groupBy("node").agg(F.min("b").alias("comp")), "cc-labels")
        apart = stars.filter("a <> b")
        while True:
            la, lb = label.select(F.col("node").alias("a"), F.col("comp").alias("ca")), label.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
            split = apart.join(la, "a").join(lb, "b").filter("ca <> cb").select(F.greatest("ca", "cb").alias("high"), F.least("ca", "cb").alias("low"))
            moved = kept(split.groupBy("high").agg(F.min("low").alias("low")), "cc-moved")
            if moved.isEmpty():
                return last(label)
            for _ in range(2):  # labels that move along with the label they moved to
                further = moved.select(F.col("high").alias("low"), F.col("low").alias("next"))
                moved = kept(moved.join(further, "low", "left").select("high", F.coalesce("next", "low").alias("low")), "cc-moved")
            label = kept(label.join(moved, label["comp"] == moved["high"], "left").select("node", F.coalesce("low", "comp").alias("comp")), "cc-labels")


#: Bits of the filter below; as words of 64 bits it has 131,072 rows at most, a few MB, whatever the number of ids.
FILTER_BITS = 1 << 23


def maybe_in(ids: DataFrame, id_col: str):
    """A function (df, column, anti=False) to the rows of df whose column may be among ids (anti: those that aren't for sure), by a bitmap of hashes of fixed size, which is broadcast.

    It lets rows that can't match stay out of the shuffle of a join, which then decides. With more ids than bits it
    keeps everything, and the join is as before.
    """
    from pyspark.sql import functions as F

    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(FILTER_BITS)).cast("int")
    words = ids.select(place(F.col(id_col)).alias("p")).groupBy(F.shiftright("p", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, p & 63)")).alias("_bits"))
    words = kept(words, "filter")

    def rows(df: DataFrame, column, anti: bool = False) -> DataFrame:
        p = place(column)
        hit = (F.shiftright(p, 6) == F.col("_word")) & (F.call_function("shiftright", F.col("_bits"), p.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1)
        return df.join(F.broadcast(words), hit, "left_anti" if anti else "left_semi")

    return rows


def some_rows(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """df, or where it has more than `most` rows about as many of them, those with the least hashes of keys. A filter: no task sees more than its own rows."""
    from pyspark.sql import functions as F

    n = df.count()
    return df if n <= most else df.filter(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int((1 << 30) * most / n))


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers BATCH_ROWS at a time from now on in this session, so that few long ones fit beside the executor's heap."""
    if int(spark.conf.get(BATCH)) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(BATCH, str(BATCH_ROWS))


def frugal(run, forget=None):
    """run, a function for mapInPandas, which gives the memory that it freed back to the system at its task's end: Python workers wait beside the executor's heap.

    forget: called before, to drop what the module remembers.
    """

    def wrapped(batches):
        yield from run(batches)
        if forget:
            forget()
        release()

    return wrapped


def release() -> None:
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
