"""Language identification by interpolated Kneser-Ney character models, one for each language.

All training rows are counted, in the tasks, as runs of `order` characters; Spark sums them and derives the continuation
counts of the lower orders. Up to MODEL_CELLS, the driver turns the counts into probabilities of all languages for each run, in
arrays sorted by the runs' hashes, and broadcasts them. Beyond that the tables stay in Spark (Wide): only frequent runs are
broadcast, to be added up in the tasks, and all other runs of the documents are joined with the tables; no run is dropped, and both
ways give the same numbers. The language of least cross-entropy per character wins.

The score is calibrated, and so is each language's limit of cross-entropy beyond which `accepted` is false, on training rows that aren't counted:
about CALIBRATION, as many of each language, but a twentieth of its rows at most, picked by a hash of their texts, so that copies go
together. The score's exponent of the number of characters and its temperature are those of least log loss. Languages of under 20 rows are
counted whole and take the greatest limit of the others.

Letters are folded to lower case, everything else is one blank. Null texts, and those without a letter, are `und` with score
0. So is all if nothing can be learned (no training rows). Ties go to the language first in code point order. Repeated rows are
learned and predicted each by itself; texts of any length are taken whole; other columns don't matter.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.steps import scratch
from tidemill.llm.shared import frugal, kept, mix, small_batches

ORDER = 4
MODEL_CELLS = 4_000_000
CALIBRATION = 4_000
#: Characters that are treated at once.
PIECE = 400_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def codes(text: str) -> np.ndarray:
    """Code points of the folded text, runs of other than letters as one blank, a blank at the end; empty if it has no letter."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[x]
    if not letter.any():
        return np.zeros(0, np.uint32)
    x = np.where(letter, x, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first blank after a letter
    x = x[keep]
    return x if x[-1] == 32 else np.append(x, np.uint32(32))


def run_codes(columns: list[np.ndarray]) -> np.ndarray:
    """Hashes of runs of characters, given as columns."""
    with np.errstate(over="ignore"):
        h = columns[0].astype(np.uint64) + np.uint64(1)
        for c in columns[1:]:
            h = h * _STEP + c + np.uint64(1)
    return mix(h)


def padded(texts: list[np.ndarray], order: int):
    """Pieces of joined texts: characters, and for each text in them its number and where its own characters begin and end. order - 1 characters come before."""
    pad = np.full(order - 1, 32, np.uint32)
    part, spans, at = [], [], 0
    for i, x in enumerate(texts):
        for lo in range(0, len(x), PIECE):
            before = pad if lo == 0 else x[max(0, lo - order + 1) : lo]
            if len(before) < order - 1:
                before = np.concatenate([pad[len(before) :], before])
            own = x[lo : lo + PIECE]
            part += [before, own]
            spans.append((i, at + order - 1, at + order - 1 + len(own)))
            at += order - 1 + len(own)
            if at > PIECE:
                yield np.concatenate(part), spans
                part, spans, at = [], [], 0
    if part:
        yield np.concatenate(part), spans


def _inside(n: int, spans) -> np.ndarray:
    flag = np.zeros(n + 1, np.int8)
    for _, lo, hi in spans:
        flag[lo] += 1
        flag[hi] -= 1
    return np.cumsum(flag[:-1]) > 0


class Model:
    """Probabilities by language: for each order the hashes of its runs (sorted), a matrix of logs, and the same for its contexts' weights."""

    def __init__(self, langs: list[str], order: int):
        self.langs, self.order = langs, order
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.weights: list[tuple[np.ndarray, np.ndarray]] = []
        self.floor = np.zeros(len(langs), np.float32)
        self.temperature, self.power, self.limits = 0.1, 0.0, np.full(len(langs), np.inf)

    @staticmethod
    def _find(table, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = table[0]
        if not len(hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        return at, hashes[at] == h

    def logs(self, columns: list[np.ndarray]) -> np.ndarray:
        """log P(last character | those before), a row for each run of len(columns) characters."""
        k = len(columns)
        if k == 0:
            return self.floor[None, :]
        at, hit = self._find(self.runs[k - 1], run_codes(columns))
        table = self.runs[k - 1][1]
        if hit.all() and len(hit):
            return table[at]
        out = np.empty((len(hit), len(self.langs)), np.float32)
        out[hit] = table[at[hit]] if hit.any() else 0
        miss = ~hit
        lower = [c[miss] for c in columns]
        weight = self.weights[k - 1]
        rest = np.broadcast_to(self.logs(lower[1:]), (int(miss.sum()), len(self.langs)))
        if k > 1:
            at, known = self._find(weight, run_codes(lower[:-1]))
            rest = rest + np.where(known[:, None], weight[1][at] if len(weight[0]) else 0, 0)
        else:
            rest = rest + weight[1]
        out[miss] = rest
        return out

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean -log P per character, a row for each text, NaN for texts without letters; and the numbers of characters."""
        xs = [codes(t) if isinstance(t, str) else np.zeros(0, np.uint32) for t in texts]
        total, n = np.zeros((len(xs), len(self.langs))), np.zeros(len(xs))
        for x, spans in padded(xs, self.order):
            m = len(x) - self.order + 1
            logs = self.logs([x[j : j + m] for j in range(self.order)])
            cut = np.array([(lo - self.order + 1, hi - self.order + 1) for _, lo, hi in spans]).ravel()
            sums = np.add.reduceat(np.concatenate([logs, np.zeros((1, logs.shape[1]), np.float32)]).astype(np.float64), cut, axis=0)[::2]
            for (i, lo, hi), s in zip(spans, sums, strict=True):
                total[i] -= s
                n[i] += hi - lo
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(n[:, None] > 0, total / n[:, None], np.nan), n

    def predict(self, texts: list[str | None]):
        """(language or und, score, accepted) for each text."""
        if not self.langs:
            return [("und", 0.0, False)] * len(texts)
        return decided(*self.cross_entropies(texts), self.langs, self.temperature, self.power, self.limits)


def decided(ce, chars, langs: list[str], temperature: float, power: float, limits: np.ndarray):
    """(language or und, score, accepted) for each row of cross-entropies."""
    out = []
    for row, n in zip(ce, chars, strict=True):
        if np.isnan(row[0]):
            out.append(("und", 0.0, False))
            continue
        best = int(np.argmin(row))
        p = 1 / np.exp((row[best] - row) * n**power / temperature).sum()
        out.append((langs[best], float(p), bool(row[best] <= limits[best])))
    return out


def _spread(places, values, width: int, missing: float) -> np.ndarray:
    """Rows of `width` numbers from columns of (places, values), either null where there are none."""
    out = np.full((len(places), width), missing)
    sizes = [0 if p is None else len(p) for p in places]
    if sum(sizes):
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.concatenate([p for p in places if p is not None])] = np.concatenate([v for v in values if v is not None])
    return out


class Wide:
    """The same models where they are too large for a broadcast: tables by order of the runs' own shares and the contexts' weights, in sparse rows over languages."""

    def __init__(self, langs: list[str], order: int):
        self.langs, self.order = langs, order
        self.runs: dict[int, DataFrame] = {}
        self.weights: dict[int, DataFrame] = {}
        self.base = np.zeros(len(langs))
        self.often = None
        self.temperature, self.power, self.limits = 0.1, 0.0, np.full(len(langs), np.inf)

    def probabilities(self, need: DataFrame, k: int) -> DataFrame:
        """g, p (P(last character | those before) by language) for the distinct runs g of k characters in need."""
        width, base = len(self.langs), self.base
        df = need.join(self.runs[k], "g", "left")
        if k > 1:
            lower = self.probabilities(need.select(F.expr("substr(g, 2)").alias("g")).distinct(), k - 1).select(F.col("g").alias("_low"), F.col("p").alias("_p"))
            weights = self.weights[k].select(F.col("g").alias("_context"), F.col("at").alias("_wat"), F.col("v").alias("_w"))
            df = df.join(weights, F.expr(f"substr(g, 1, {k - 1})") == F.col("_context"), "left").join(lower, F.expr("substr(g, 2)") == F.col("_low"))
        df = df.select("g", "at", "v", *(["_wat", "_w", "_p"] if k > 1 else []))

        def run(batches):
            import pandas as pd

            for batch in batches:
                for lo in range(0, len(batch), 1_000):
                    part = batch.iloc[lo : lo + 1_000]
                    rest = _spread(part["_wat"], part["_w"], width, 1.0) * np.stack(part["_p"].tolist()) if k > 1 else base
                    yield pd.DataFrame({"g": part["g"].reset_index(drop=True), "p": list(_spread(part["at"], part["v"], width, 0.0) + rest)})

        return df.mapInPandas(run, "g string, p array<double>")

    def keep_often(self, counts: DataFrame, most: int) -> None:
        """Broadcasts the exact logs of frequent runs, about `most` at best: these needn't be joined, so no key of the join is frequent."""
        got = self.probabilities(_frequent(counts.groupBy("g").agg(F.sum("c").alias("c")), most).select("g"), self.order).toArrow().to_pandas()
        logs = np.log(np.stack(got["p"].tolist())) if len(got) else np.zeros((0, len(self.langs)))
        self.often = counts.sparkSession.sparkContext.broadcast(_sorted(got["g"].tolist(), logs, self.order))

    def cross_entropies(self, rows: DataFrame, kind: str) -> DataFrame:
        """_id, _held, n (characters) and ce (mean -log P per character by language; null for texts without letters) for each row of rows (_id of type kind, _held, _text)."""
        order, width, often = self.order, len(self.langs), self.often

        def run(batches):
            import pandas as pd

            columns = ["row", "_id", "_held", "n", "g", "part"]
            row, out = TaskContext.get().partitionId() << 40, []
            for batch in batches:
                for id_, held, text in zip(batch["_id"].tolist(), batch["_held"].tolist(), batch["_text"].tolist(), strict=True):
                    n, part = 0, np.zeros(width)
                    for x, spans in padded([codes(text) if isinstance(text, str) else np.zeros(0, np.uint32)], order):
                        m = len(x) - order + 1
                        cols = [x[j : j + m] for j in range(order)]
                        own = np.flatnonzero(_inside(len(x), spans)[order - 1 :])
                        h, at, c = np.unique(run_codes(cols)[own], return_index=True, return_counts=True)
                        place, hit = Model._find(often.value, h)
                        part += c[hit] @ often.value[1][place[hit]].astype(np.float64)
                        n += len(own)
                        out += [(row, None, None, int(c_), "".join(map(chr, x[p : p + order].tolist())), None) for p, c_ in zip(own[at[~hit]].tolist(), c[~hit].tolist(), strict=True)]
                    out.append((row, id_, held, n, None, part))
                    row += 1
                    if len(out) > 50_000:
                        yield pd.DataFrame(out, columns=columns, dtype=object)  # no long becomes a float beside nulls
                        out = []
            if out:
                yield pd.DataFrame(out, columns=columns, dtype=object)  # no long becomes a float beside nulls

        # rows get their numbers here and only here, so the table is written before it is read twice
        parts = kept(rows.select("_id", "_held", "_text").mapInPandas(frugal(run), f"row long, _id {kind}, _held boolean, n long, g string, part array<double>"), "lang-parts")
        heads, rest = parts.filter("g is null"), parts.filter("g is not null").select("row", "n", "g")
        logs = rest.join(self.probabilities(rest.select("g").distinct(), order), "g").select("row", F.expr("transform(p, x -> n * ln(x))").alias("part"))
        sums = heads.select("row", "part").unionAll(logs).select("row", F.posexplode("part").alias("at", "s")).groupBy("row", "at").agg(F.sum("s").alias("s"))
        sums = sums.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("sums"))
        ce = F.when(F.col("n") > 0, F.expr("transform(sums, x -> -x.s / n)"))
        return heads.select("row", "_id", "_held", "n").join(sums, "row").select("_id", "_held", "n", ce.alias("ce"))


def _frequent(df: DataFrame, most: int) -> DataFrame:
    """The rows of df (.., c), the most frequent ones should there be over `most`."""
    levels = sorted(((r["level"], r["count"]) for r in df.groupBy(F.floor(F.log2("c")).alias("level")).count().collect()), reverse=True)
    total, least = 0, 0
    for level, n in levels:
        total += n
        if total > most:
            least = 2 ** (level + 1)
            break
    return df.filter(F.col("c") >= least)


def _matrix(t, langs: list[str], value: np.ndarray, missing: float) -> tuple[np.ndarray, list[str]]:
    """A row for each distinct text of t.g, a column for each language."""
    grams, row = np.unique(t["g"].to_numpy(dtype=object).astype(str), return_inverse=True) if len(t) else (np.zeros(0, str), np.zeros(0, int))
    col = t["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=int) if len(t) else np.zeros(0, int)
    out = np.full((len(grams), len(langs)), missing)
    out[row, col] = value
    return out, grams.tolist()


def train(rows: DataFrame, text_col: str, lang_col: str, order: int = ORDER) -> Model | Wide:
    """Kneser-Ney models from all rows with a text and a language; Wide, if they are too large for a broadcast."""
    rows = rows.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).filter("_text is not null and _lang is not null")

    def counted(batches):
        import pandas as pd

        for batch in batches:
            for lang, g in batch.groupby("_lang"):
                grams: dict[int, list] = {}
                for x, spans in padded([codes(t) for t in g["_text"]], order):
                    m = len(x) - order + 1
                    cols = [x[j : j + m] for j in range(order)]
                    own = np.flatnonzero(_inside(len(x), spans)[order - 1 :])
                    h, at, c = np.unique(run_codes(cols)[own], return_index=True, return_counts=True)
                    for hash_, p, n in zip(h.tolist(), own[at].tolist(), c.tolist(), strict=True):
                        if (e := grams.get(hash_)) is not None:
                            e[1] += n
                        else:
                            grams[hash_] = ["".join(map(chr, x[p : p + order].tolist())), n]
                    if len(grams) > 1_000_000:
                        yield pd.DataFrame({"lang": lang, "g": [e[0] for e in grams.values()], "c": [e[1] for e in grams.values()]})
                        grams = {}
                if grams:
                    yield pd.DataFrame({"lang": lang, "g": [e[0] for e in grams.values()], "c": [e[1] for e in grams.values()]})

    top = kept(rows.mapInPandas(frugal(counted), "lang string, g string, c long").groupBy("lang", "g").agg(F.sum("c").alias("c")), "lang-counts")
    langs = sorted((r[0] for r in top.select("lang").distinct().collect()), key=lambda s: s.encode())
    model = Model(langs, order)
    if not langs:
        return model
    most = max(10_000, MODEL_CELLS // len(langs))
    if top.count() > most:  # no other table has more rows than this one
        return _wide(top, langs, order, most)
    tables = {order: top.toArrow().to_pandas()}
    for k in range(order - 1, 0, -1):  # how many characters are seen before each run
        tables[k] = tables[k + 1].assign(g=tables[k + 1]["g"].str[1:]).groupby(["lang", "g"], sort=False).size().rename("c").reset_index()
    column = {x: i for i, x in enumerate(langs)}
    for k in range(1, order + 1):
        t = tables[k]
        context = t.assign(g=t["g"].str[: k - 1]).groupby(["lang", "g"], sort=False)["c"].agg(["sum", "size"]).reset_index()
        ones = {x: ((c == 1).sum(), (c == 2).sum()) for x, c in t.groupby("lang")["c"]}
        discount = _discounts(ones, langs)
        if k == 1:
            model.floor = np.log(np.full(len(langs), 1.0 / (t["g"].nunique() + 1))).astype(np.float32)
        col = context["lang"].map(column).to_numpy(dtype=int)
        weight, grams = _matrix(context, langs, discount[col] * context["size"].to_numpy() / context["sum"].to_numpy(), 1.0)
        model.weights.append(_sorted(grams, np.log(weight), k - 1) if k > 1 else (np.zeros(0, np.uint64), np.log(weight)[:1].astype(np.float32)))
        model.runs.append((np.zeros(0, np.uint64), np.zeros((0, len(langs)), np.float32)))
        col = t["lang"].map(column).to_numpy(dtype=int)
        total = t.assign(context=t["g"].str[: k - 1]).groupby(["lang", "context"])["c"].transform("sum").to_numpy()
        own, grams = _matrix(t, langs, np.maximum(t["c"].to_numpy() - discount[col], 0) / total, 0.0)
        if grams:
            columns = np.array([[ord(c) for c in g] for g in grams], np.uint32).reshape(len(grams), k).T
            model.runs[-1] = _sorted(grams, np.log(own + np.exp(model.logs(list(columns)).astype(np.float64))), k)
    return model


def _discounts(ones: dict, langs: list[str]) -> np.ndarray:
    """Of each language, from how many runs occur once and twice."""
    return np.array([n1 / (n1 + 2 * n2) if n1 and n2 else 0.5 for n1, n2 in (ones.get(x, (0, 0)) for x in langs)])


def _wide(top: DataFrame, langs: list[str], order: int, most: int) -> Wide:
    """The models from the counts (lang, g, c) of the longest runs, by tables."""
    wide, tables = Wide(langs, order), {order: top}
    for k in range(order - 1, 0, -1):
        tables[k] = tables[k + 1].groupBy("lang", F.expr("substr(g, 2)").alias("g")).agg(F.count("*").alias("c"))
    for k in range(1, order + 1):
        t = tables[k]
        context = t.groupBy("lang", F.expr(f"substr(g, 1, {k - 1})").alias("g")).agg(F.sum("c").alias("c"), F.count("*").alias("types"))
        ones = {r["lang"]: (r["n1"], r["n2"]) for r in t.groupBy("lang").agg(F.count_if(F.expr("c = 1")).alias("n1"), F.count_if(F.expr("c = 2")).alias("n2")).collect()}
        _widen(wide, k, t, context, _discounts(ones, langs))
    wide.keep_often(top, most)
    return wide


def _widen(wide: Wide, k: int, t: DataFrame, context: DataFrame, discount: np.ndarray) -> None:
    """Sets wide's tables of order k from the counts (lang, g, c) of its runs and (lang, g, c, types) of their contexts."""
    known = t.sparkSession.createDataFrame([(x, i, float(d)) for i, (x, d) in enumerate(zip(wide.langs, discount, strict=True))], "lang string, at int, d double")
    rows = lambda df: df.groupBy("g").agg(F.collect_list(F.struct("at", "v")).alias("_l")).select("g", F.col("_l.at").alias("at"), F.col("_l.v").alias("v"))
    context = kept(context.join(F.broadcast(known), "lang"), "lang-contexts")
    weights = context.select("g", "at", F.expr("d * types / c").alias("v"))
    if k == 1:
        weight = {r["at"]: r["v"] for r in weights.collect()}  # a row for each language
        wide.base = np.array([weight[i] for i in range(len(wide.langs))]) / (t.select("g").distinct().count() + 1)
    else:
        wide.weights[k] = kept(rows(weights), "lang-weights")
    total = context.select("lang", "at", "d", F.col("g").alias("_context"), F.col("c").alias("_total"))
    own = t.withColumn("_context", F.expr(f"substr(g, 1, {k - 1})")).join(total, ["lang", "_context"])
    wide.runs[k] = kept(rows(own.select("g", "at", F.expr("greatest(c - d, 0D) / _total").alias("v"))), "lang-runs")


def _sorted(grams: list[str], logs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if not grams:
        return np.zeros(0, np.uint64), np.zeros((0, logs.shape[1]), np.float32)
    h = run_codes(list(np.array([[ord(c) for c in g] for g in grams], np.uint32).reshape(len(grams), k).T))
    order = np.argsort(h)
    return h[order], logs[order].astype(np.float32)


def apart(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (_text, _lang) to be counted, and those to calibrate on. One count of rows for each language goes to the driver."""
    spark, whole = rows.sparkSession, 1 << 30
    n = [(r["_lang"], r["count"]) for r in rows.groupBy("_lang").count().collect()]
    each = max(20, CALIBRATION // max(1, len(n)))
    cuts = spark.createDataFrame([(x, int(whole * min(0.05, each / c)) if c >= 20 else 0) for x, c in n], "_cut_lang string, _cut long")
    marked = rows.join(F.broadcast(cuts), F.col("_lang") == F.col("_cut_lang"))
    picked = F.pmod(F.xxhash64("_text"), F.lit(whole)) < F.col("_cut")
    return marked.filter(~picked).select("_text", "_lang"), marked.filter(picked).select("_text", "_lang")


def calibrate(model: Model | Wide, rows: DataFrame) -> Model | Wide:
    """The score's exponent and temperature of least log loss over rows (_text, _lang), and for each language the cross-entropy that 99.5 % of its texts keep, with a tenth to spare."""
    if not model.langs:
        return model
    held = None if isinstance(model, Wide) else rows.sparkSession.sparkContext.broadcast(model)
    some = rows.groupBy(F.xxhash64("_text").alias("_h"), "_lang").agg(F.first("_text").alias("_text"))  # copies count once

    def scored(batches):
        import pandas as pd

        for batch in batches:
            ce, n = held.value.cross_entropies(batch["_text"].tolist())
            yield pd.DataFrame({"lang": batch["_lang"].reset_index(drop=True), "n": n.astype(np.int64), "ce": list(ce)})

    if isinstance(model, Wide):
        every = model.cross_entropies(some.select(F.col("_lang").alias("_id"), F.lit(True).alias("_held"), "_text"), "string").select(F.col("_id").alias("lang"), "n", "ce")
    else:
        every = some.mapInPandas(frugal(scored), "lang string, n long, ce array<double>")
    known = set(model.langs)
    got = [r for r in every.collect() if r["n"] and r["lang"] in known]
    if not got:
        return model
    truth = np.array([model.langs.index(r["lang"]) for r in got])
    ce, n = np.array([r["ce"] for r in got]), np.array([r["n"] for r in got], float)
    own = ce[np.arange(len(ce)), truth]
    doubt = 1 / (len(got) + 2)  # no sample shows that there are no mistakes at all

    def loss(power: float, temperature: float) -> float:
        z = -(ce - ce.min(axis=1, keepdims=True)) * (n**power)[:, None] / temperature
        logs = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        right = logs[np.arange(len(z)), truth]
        others = (logs.sum(axis=1) - right) / max(1, len(model.langs) - 1)
        return float(np.mean(-(1 - doubt) * right - doubt * np.maximum(others, -700)))

    model.power, model.temperature = min(((p, t) for p in (0.0, 0.25, 0.5, 0.75, 1.0) for t in np.geomspace(0.01, 1000, 60)), key=lambda x: loss(*x))
    for i in range(len(model.langs)):
        if (truth == i).any():
            model.limits[i] = 1.1 * np.quantile(own[truth == i], 0.995)
    finite = np.isfinite(model.limits)
    model.limits[~finite] = model.limits[finite].max(initial=-np.inf) if finite.any() else np.inf
    return model


def identify(docs: DataFrame, learn: Column, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row of docs: its id, held_out (not learn), lang_pred, score (0 to 1) and accepted. learn: which rows to learn from."""
    small_batches(docs.sparkSession)
    counted, spared = apart(docs.filter(learn).select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).filter("_text is not null and _lang is not null"))
    with scratch(docs.sparkSession) as last:
        model = train(counted, "_text", "_lang", order)
        if isinstance(model, Wide):
            for df in [*model.runs.values(), *model.weights.values()]:
                last(df)
        model = calibrate(model, spared)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(~learn, F.lit(True)).alias("_held"))
    schema = f"_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean"
    if isinstance(model, Wide):
        langs, temperature, power, limits = model.langs, model.temperature, model.power, model.limits

        def decide(batches):
            import pandas as pd

            for batch in batches:
                ce = [np.full(len(langs), np.nan) if x is None else x for x in batch["ce"]]
                lang, score, accepted = zip(*decided(ce, batch["n"].tolist(), langs, temperature, power, limits), strict=True) if len(ce) else ((), (), ())
                yield pd.DataFrame({"_id": batch["_id"], "held_out": batch["_held"], "lang_pred": lang, "score": score, "accepted": accepted})

        return model.cross_entropies(rows, kind).mapInPandas(decide, schema).withColumnRenamed("_id", id_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pandas as pd

        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                lang, score, accepted = zip(*held.value.predict(part["_text"].tolist()), strict=True)
                yield pd.DataFrame({"_id": part["_id"].reset_index(drop=True), "held_out": part["_held"].reset_index(drop=True), "lang_pred": lang, "score": score, "accepted": accepted})

    return rows.mapInPandas(frugal(run), schema).withColumnRenamed("_id", id_col)
