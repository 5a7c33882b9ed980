"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

A word's vector is its own sparse random index plus the normalised sum of the indexes of its neighbours in the training texts.
Words are hashed to ROWS rows, so the vectors have a fixed size and no word is unknown. Tokens for the case of a word, for a
word that repeats the one before it, and for a line that came before in the text, are words too. A document is the mean of its
tokens' vectors. The network (numpy, on the driver) and the vectors are fitted on about SAMPLE labelled rows, picked by a hash
of their ids; its probabilities are calibrated by a temperature on a tenth of these that training doesn't see. Every document
is scored, whole.

Null and empty texts pool to zeros and get the score that the network gives these. Labels: null ones are left out, of several for
one id the lowest counts; without any label, or with one class only, every score is that class's share (0.5 without). Repeated rows are
scored each by itself; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.steps import scratch
from tidemill.llm.shared import frugal, kept, numbered, small_batches, some_rows, unused

SAMPLE = 12_000
ROWS, WIDTH, NONZERO, NEAR = 1 << 14, 64, 6, 2
HIDDEN, EPOCHS, BATCH, DECAY = 32, 40, 128, 1e-4
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_BLOCKS = 64


class _Rows(dict):
    """Row of a token; remembers a bounded number of them."""

    def __missing__(self, token: str) -> int:
        if len(self) > 150_000:
            self.clear()
        row = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass")) % ROWS
        return row


_rows = _Rows()


def forget() -> None:
    """A worker that waits holds no memory."""
    _rows.clear()


def _case(word: str) -> str:
    if not word[0].isalpha():
        return "<digit>" if word[0].isdigit() else "<sign>"
    if word.islower():
        return "<lower>"
    if word.isupper():
        return "<upper>" if len(word) > 1 else "<initial>"
    return "<title>" if word.istitle() else "<mixed>"


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text) if isinstance(text, str) else []


def marks(text: str | None, words: list[str]) -> Counter:
    """How often the tokens that stand for form and repetition occur."""
    out: Counter = Counter()
    if not words:
        return out
    for w, n in Counter(words).items():
        out[_case(w)] += n
    again = sum(map(str.__eq__, words[1:], words))
    if again:
        out["<again>"] = again
    lines: set[str] = set()
    for line in text.split("\n"):
        if line in lines:
            out["<line again>"] += 1 + len(line) // 6
        elif line:
            lines.add(line)
    return out


def random_indexes() -> np.ndarray:
    """The sparse index of each row: NONZERO places of +1 or -1."""
    r = np.random.default_rng(7)
    out = np.zeros((ROWS, WIDTH), np.float32)
    place = np.argsort(r.random((ROWS, WIDTH)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, place, r.choice(np.array([-1, 1], np.float32), (ROWS, NONZERO)), axis=1)
    return out / np.sqrt(NONZERO)


def neighbour_sums(texts, index: np.ndarray) -> np.ndarray:
    """For each row the sum of its neighbours' indexes."""
    out = np.zeros_like(index)
    for text in texts:
        words = tokens(text)
        extra = marks(text, words)
        ids = np.array([_rows[w] for w in words], np.int64)
        for d in range(1, NEAR + 1):
            if len(ids) > d:
                np.add.at(out, ids[d:], index[ids[:-d]])
                np.add.at(out, ids[:-d], index[ids[d:]])
        if words:
            mean = index[ids].mean(axis=0)
            for m, n in extra.items():
                out[_rows[m]] += n * mean
    return out


def word_vectors(sums: np.ndarray, index: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(sums, axis=1, keepdims=True)
    return (index + sums / np.where(size > 0, size, 1)).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of the text's words, then of its marks for each word: 2 * WIDTH numbers."""
    words = tokens(text)
    if not words:
        return np.zeros(2 * WIDTH, np.float32)
    counts = Counter(words)
    ids = np.array([_rows[w] for w in counts], np.int64)
    weight = np.fromiter(counts.values(), np.float32, len(counts))
    extra = marks(text, words)
    form = np.array([_rows[m] for m in extra], np.int64)
    share = np.fromiter(extra.values(), np.float32, len(extra))
    return np.concatenate([weight @ vectors[ids], share @ vectors[form]]) / np.float32(len(words))


class Network:
    """WIDTH * 2 inputs, one hidden layer, one logit."""

    def __init__(self, prior: float = 0.5):
        self.mean, self.scale = np.zeros(2 * WIDTH), np.ones(2 * WIDTH)
        self.w1, self.b1 = np.zeros((2 * WIDTH, HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = np.zeros(HIDDEN), float(np.log(prior / (1 - prior))) if 0 < prior < 1 else (40.0 if prior else -40.0)
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    @staticmethod
    def gradients(params: list[np.ndarray], z: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss and half of DECAY times the squared weights."""
        w1, b1, w2, b2 = params
        h = np.maximum(z @ w1 + b1, 0)
        d = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -40, 40))) - y) / len(y)
        back = np.outer(d, w2) * (h > 0)
        return [z.T @ back + DECAY * w1, back.sum(axis=0), h.T @ d + DECAY * w2, np.array([d.sum()])]

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        """Adam on the log loss; then the temperature of least log loss on every tenth row, which Adam doesn't see."""
        r = np.random.default_rng(11)
        held = np.arange(len(x)) % 10 == 9
        if y[~held].min() == y[~held].max():
            held[:] = False
        train, truth = x[~held], y[~held]
        self.mean, self.scale = train.mean(axis=0), train.std(axis=0) + 1e-4
        z = (train - self.mean) / self.scale
        self.w1 = r.normal(0, np.sqrt(2 / z.shape[1]), self.w1.shape)
        self.w2 = r.normal(0, np.sqrt(1 / HIDDEN), HIDDEN)
        params = [self.w1, self.b1, self.w2, np.array([self.b2])]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(EPOCHS):
            rate = 3e-3 * (1 - epoch / EPOCHS) + 1e-4
            order = r.permutation(len(z))
            for lo in range(0, len(order), BATCH):
                i = order[lo : lo + BATCH]
                grads = self.gradients(params, z[i], truth[i])
                t += 1
                for p, g, a, b in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        self.w1, self.b1, self.w2, self.b2 = params[0], params[1], params[2], float(params[3][0])
        if held.any():
            logits, want = self.logits(x[held]), y[held]

            def loss(temperature: float) -> float:
                s = logits / temperature
                return float(np.mean(np.logaddexp(0, s) - want * s))

            self.temperature = float(min(np.geomspace(0.5, 8, 60), key=loss))
        return self


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str) -> tuple[np.ndarray, Network]:
    """The word vectors and the network, from about SAMPLE labelled rows for which learn (over docs) holds."""
    spark = docs.sparkSession
    index = random_indexes()
    marked = labels.select(F.col(id_col).alias("_lid"), F.col(label_col).alias("_label")).filter("_lid is not null and _label is not null").groupBy("_lid").agg(F.min("_label").cast("double").alias("_label"))
    rows = docs.filter(learn).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    some = some_rows(kept(marked.join(rows.select("_id").distinct(), F.col("_lid") == F.col("_id"), "left_semi"), "quality-labels"), ["_lid"], SAMPLE)
    chosen = spark.createDataFrame(some.toArrow())  # about SAMPLE ids and labels
    sample = rows.join(F.broadcast(chosen), F.col("_id") == F.col("_lid")).select("_id", "_text", "_label")

    def sums(batches):
        import pandas as pd

        total, index = np.zeros((ROWS, WIDTH), np.float32), random_indexes()
        for batch in batches:
            total += neighbour_sums(batch["_text"], index)
        yield pd.DataFrame({"block": range(_BLOCKS), "sums": [b.tobytes() for b in np.split(total, _BLOCKS)]})

    def added(key, batch):
        import pandas as pd

        total = np.zeros(ROWS // _BLOCKS * WIDTH, np.float64)
        for b in sorted(batch["sums"]):  # in one order, so that reruns agree
            total += np.frombuffer(b, np.float32)
        return pd.DataFrame({"block": [key[0]], "sums": [total.astype(np.float32).tobytes()]})

    # the sample is bounded, so a few tasks count it, by a hash of the ids so that reruns agree
    parts = sample.repartition(8, "_id").sortWithinPartitions("_id").mapInPandas(frugal(sums, forget), "block int, sums binary").groupBy("block").applyInPandas(added, "block int, sums binary")
    blocks = {r["block"]: r["sums"] for r in parts.collect()}
    total = np.concatenate([np.frombuffer(blocks[b], np.float32) for b in range(_BLOCKS)]).reshape(ROWS, WIDTH) if blocks else np.zeros_like(index)
    vectors = word_vectors(total, index)
    held = spark.sparkContext.broadcast(vectors)

    def pool(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"id": batch["_id"].reset_index(drop=True), "label": batch["_label"].reset_index(drop=True), "x": [pooled(t, held.value) for t in batch["_text"]]})

    got = sample.mapInPandas(frugal(pool, forget), f"id {docs.schema[id_col].dataType.simpleString()}, label double, x array<float>").toArrow().to_pandas()
    y = (got["label"].to_numpy() >= 1).astype(np.float64)
    if not len(y) or y.min() == y.max():
        return vectors, Network(float(y.mean()) if len(y) else 0.5)
    x = np.stack(got["x"].to_list()).astype(np.float64)
    order = np.array(sorted(range(len(y)), key=lambda i: (zlib.crc32(str(got["id"].iloc[i]).encode()), str(got["id"].iloc[i]), x[i].tobytes())))
    return vectors, Network().fit(x[order], y[order])


def classify(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", carry: bool = False) -> DataFrame:
    """One row for each row of docs: its id, held_out (not learn), score (of label 1) and predicted (score >= threshold).

    carry: all columns of docs instead, whatever their names, and the score as the last one, `_score` (with more underscores where docs has that).
    """
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        vectors, network = train(docs, labels, learn, id_col, text_col, label_col)
    held = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def scores(texts) -> np.ndarray:
        vectors, network = held.value
        return np.concatenate([network.scores(np.stack([pooled(t, vectors) for t in texts[lo : lo + 512]]).astype(np.float64)) for lo in range(0, len(texts), 512)] or [np.zeros(0)])

    if carry:
        plain, (text,) = numbered(docs, text_col)

        def beside(batches):
            import pyarrow as pa

            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(batch.column(text).to_pylist()), pa.float64())], [*batch.schema.names, "_score"])

        schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in plain.schema), T.StructField("_score", T.DoubleType())])
        return plain.mapInArrow(frugal(beside, forget), schema).toDF(*docs.columns, unused("_score", docs))

    def run(batches):
        for batch in batches:
            yield batch.drop(columns="_text").assign(_score=scores(batch["_text"].tolist()))

    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(~learn, F.lit(True)).alias("_held"), F.col(text_col).alias("_text"))
    out = rows.mapInPandas(frugal(run, forget), f"_id {docs.schema[id_col].dataType.simpleString()}, _held boolean, _score double")
    return out.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))
