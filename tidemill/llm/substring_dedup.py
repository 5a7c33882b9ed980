"""Substring dedup with suffix automata: a word goes if a window of `window` words over it also starts earlier in the corpus.

Every run of windows is owned by one anchor, the least of the hashes of its ANCHOR-word runs, so equal windows share
their anchor. Anchors seen in two texts, or twice in one, mark candidate passages; only these are compared. Passages of one
anchor are a reference shard: a task builds the suffix automaton of its distinct passages, earliest first, streams them
through it for matching statistics, and so learns where each window starts first. What a document has of candidate
windows, less the windows that start first there, is removed in maximal spans.

An automaton of the whole corpus grows with it and can't be broadcast; hence shards by anchor, and passages are
shuffled to them. A given reference (bounded, see `matched`) is broadcast as automata. The passages of a frequent anchor make several shards
of about SHARD each: they are sent as single windows, each to the shard of its hash, equal ones reduced to the first before the shuffle. All
shards go through automata, which compare words (by 64-bit hashes of each); 96 bits tell texts apart until then.

Null and empty texts have no words. Equal texts (repeated rows too) are told apart by doc_id; rows that repeat a doc_id are one
document to the rule, and each is returned. Texts of any length are taken whole; other columns don't matter, whatever their names. Rows
whose id is null are left whole and make no other row a later one.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.steps import scratch
from tidemill.llm.shared import NUMBER_ROWS, SENT_ROWS, as_bytes, frugal, kept, maybe_in, mix, numbered, partitions, run_hashes, slices, small_batches, word_hashes

#: Words of an anchor; windows of 20 words then have about one anchor in eight words.
ANCHOR = 7
#: Passages of a shard, about; more passages of one anchor make more shards.
SHARD = 256
#: Words of one automaton; beyond that a new one begins at the next anchor.
AUTOMATON_WORDS = 60_000
_SALT = np.uint64(0xA0761D6478BD642F)


class Automaton:
    """The suffix automaton of sequences of integers, added in turn. first: where each state's substrings end first, as a running position over all that was added."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.first = [-1], [0], [-1]
        self.last, self.at = 0, 0

    def add(self, sequence: list[int]) -> None:
        """A sequence by itself: matches don't run over its ends."""
        self.last = 0
        for c in sequence:
            self._extend(c)
            self.at += 1

    def _new(self, length: int, first: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.len.append(length)
        self.first.append(first)
        self.link.append(link)
        return len(self.len) - 1

    def _extend(self, c: int) -> None:
        nxt, link, length = self.next, self.link, self.len
        p = self.last
        q = nxt[p].get(c)
        if q is not None:  # the sequence so far is in an earlier one
            self.last = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            return
        cur = self._new(length[p] + 1, self.at, {}, 0)
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        self.last = cur

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.len[p] + 1, self.first[q], dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def matching(self, sequence: list[int], least: int):
        """For each end in sequence where the longest match has `least` items or more: (end, length of the match, where its last `least` items end first)."""
        nxt, link, length, first = self.next, self.link, self.len, self.first
        s, n = 0, 0
        for i, c in enumerate(sequence):
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            if (t := nxt[s].get(c)) is not None:
                s, n = t, n + 1
            if n >= least:
                u = s
                while length[link[u]] >= least:
                    u = link[u]
                yield i, n, first[u]


def anchored(words: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share their anchor: its hash, the first and the last start of each run. One document's words."""
    grams = run_hashes(words, anchor)
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    span = window - anchor + 1
    order = mix(grams ^ _SALT)
    least, place = order[:n].copy(), np.arange(n)
    for j in range(1, span):  # the leftmost of equals
        less = order[j : j + n] < least
        least[less] = order[j : j + n][less]
        place[less] = np.flatnonzero(less) + j
    cut = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    return grams[place[cut]], cut, np.concatenate([cut[1:], [n]]) - 1


def _each(column):
    """Word hashes of each text in turn."""
    texts = as_bytes(column)
    for lo, hi in slices(texts):
        words, first = word_hashes(texts[lo:hi])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield words[a:b]


def _spans(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending integers as runs: first and last of each."""
    cut = np.concatenate([[0], np.flatnonzero(np.diff(starts) != 1) + 1])
    return starts[cut], starts[np.concatenate([cut[1:], [len(starts)]]) - 1]


def first_in_shard(rows: list[tuple[int, int, bytes]], window: int):
    """rows: (doc, start, word hashes) of the passages of one shard. Yields (doc, first, last): runs of windows that start first there."""
    once: dict[bytes, tuple[int, int]] = {}
    for doc, start, words in rows:
        if (seen := once.get(words)) is None or (doc, start) < seen:
            once[words] = (doc, start)
    if len(once) == 1:
        ((words, (doc, start)),) = once.items()
        yield doc, start, start + len(words) // 8 - window
        return
    passages = sorted((at, words) for words, at in once.items())
    auto, begins = Automaton(), []
    for _, words in passages:
        begins.append(auto.at)
        auto.add(np.frombuffer(words, np.uint64).tolist())
    for ((doc, start), words), begin in zip(passages, begins, strict=True):
        own = [i - window + 1 for i, _, first in auto.matching(np.frombuffer(words, np.uint64).tolist(), window) if first == begin + i]
        if own:
            for a, b in zip(*_spans(np.array(own)), strict=True):
                yield doc, start + int(a), start + int(b)


def removed_runs(docs: DataFrame, window: int) -> DataFrame:
    """doc, gone: first and last + 1 of each run of words that goes, flat, for the documents (_id, _text) that lose any; all of a later copy."""
    spark = docs.sparkSession
    n = partitions(spark)
    named = docs.filter("_id is not null and _text is not null")
    prints = [F.xxhash64("_text").alias("fp"), F.hash("_text").alias("fp2")]
    own = kept(named.select("_id", *prints, F.md5("_text").alias("md5")), "dedup-prints")
    reps = kept(own.groupBy("fp", "fp2", "md5").agg(F.min("_id").alias("rep")), "dedup-texts")

    def anchors(batches):
        import pandas as pd

        names = ("a", "fp", "fp2", "lo", "more", "again")
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            new = [f not in seen and not seen.add(f) for f in zip(batch["fp"].tolist(), batch["fp2"].tolist(), strict=True)]
            part, total = [], 0
            for fp, fp2, words in zip(batch["fp"][new].tolist(), batch["fp2"][new].tolist(), _each(batch["_text"][new]), strict=True):
                a, lo, hi = anchored(words, window, ANCHOR)
                if not len(a):
                    continue
                _, one = np.unique(a, return_index=True)
                again = np.ones(len(a), bool)
                again[one] = False
                part.append((a.view(np.int64), np.full(len(a), fp, np.int64), np.full(len(a), fp2, np.int32), lo.astype(np.int32), (hi - lo).astype(np.int16), again))
                total += len(a)
                if total > SENT_ROWS:
                    yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*part, strict=True)), strict=True)))
                    part, total = [], 0
            if part:
                yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*part, strict=True)), strict=True)))

    seen = named.select(*prints, "_text").mapInPandas(frugal(anchors), "a long, fp long, fp2 int, lo int, more short, again boolean")
    found = kept(seen, "dedup-anchors")
    repeated = found.groupBy("a").agg(*[f(x).alias(f"{n}{x}") for x in ("fp", "fp2") for n, f in (("low", F.min), ("high", F.max))], F.max("again").alias("again"), F.count("*").alias("n"))
    repeated = kept(repeated.filter("lowfp <> highfp or lowfp2 <> highfp2 or again").select("a", F.ceil(F.col("n") / SHARD).cast("int").alias("shards")), "dedup-repeated")
    places = found.join(repeated, "a").select("fp", "fp2", F.struct("lo", "more", "a", "shards").alias("run"))
    runs = kept(places.groupBy("fp", "fp2").agg(F.sort_array(F.collect_set("run")).alias("runs")), "dedup-runs")  # of one text each
    candidates = kept(reps.join(runs, ["fp", "fp2"]).select("rep", "runs"), "dedup-candidates")
    routed = maybe_in(candidates, "rep")(docs.select("_id", "_text"), F.col("_id")).join(candidates, F.col("_id") == F.col("rep"))

    def passages(batches):
        import pandas as pd

        columns = ["key", "shard", "doc", "start", "words"]
        for batch in batches:
            rows = []
            for i, runs, words in zip(batch["rep"].tolist(), batch["runs"], _each(batch["_text"]), strict=True):
                whole = mix(run_hashes(words, window)) if any(r["shards"] > 1 for r in runs) else None
                for r in runs:
                    lo, hi, n = r["lo"], r["lo"] + r["more"], r["shards"]
                    if n == 1:
                        rows.append((r["a"], -1, i, lo, words[lo : hi + window].tobytes()))
                    else:
                        rows += [(r["a"], s, i, p, words[p : p + window].tobytes()) for p, s in enumerate((whole[lo : hi + 1] % np.uint64(n)).tolist(), lo)]
                if len(rows) > SENT_ROWS // 5:  # 160 bytes each at least
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    sent = kept(routed.select("rep", "runs", "_text").mapInPandas(frugal(passages), "key long, shard int, doc long, start int, words binary"), "dedup-passages")

    def shards(batches):
        import pandas as pd

        def done(groups):
            rows = [x for g in groups for x in first_in_shard(g, window)]
            return pd.DataFrame(rows, columns=["doc", "lo", "hi"])

        key, rows, groups, total = None, [], [], 0
        for batch in batches:
            for k, d, s, w in zip(zip(batch["key"].tolist(), batch["shard"].tolist(), strict=True), batch["doc"].tolist(), batch["start"].tolist(), batch["words"], strict=True):
                if k != key:
                    if rows:
                        groups.append(rows)
                    if total > AUTOMATON_WORDS:
                        yield done(groups)
                        groups, total = [], 0
                    key, rows = k, []
                rows.append((d, s, w))
                total += len(w) // 8
        if rows:
            groups.append(rows)
        if groups:
            yield done(groups)

    single = sent.filter("shard >= 0").groupBy("key", "shard", "words").agg(F.min(F.struct("doc", "start")).alias("one")).select("key", "shard", "one.doc", "one.start", "words")
    every = sent.filter("shard < 0").unionAll(single.select("key", "shard", "doc", "start", "words"))
    first = every.repartition(n, "key", "shard").sortWithinPartitions("key", "shard").mapInPandas(frugal(shards), "doc long, lo int, hi int")
    firsts = kept(first.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("firsts")), "dedup-firsts", NUMBER_ROWS)  # of one document each

    # what is removed of a document, as runs of words; nothing for most
    def removed(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for runs, firsts in zip(batch["runs"], batch["firsts"], strict=True):
                top = max(r["lo"] + r["more"] for r in runs) + window + 1
                step = np.zeros(top + 1, np.int32)
                for r in runs:
                    step[r["lo"]] += 1
                    step[r["lo"] + r["more"] + 1] -= 1
                at = np.cumsum(step) > 0
                for f in firsts if firsts is not None else ():
                    at[f["lo"] : f["hi"] + 1] = False
                starts = np.flatnonzero(at)
                cover = np.zeros(top + window + 1, np.int32)
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + window, -1)
                gone = np.flatnonzero(np.cumsum(cover) > 0)
                lo, hi = _spans(gone) if len(gone) else (gone, gone)
                out.append(np.stack([lo, hi + 1], axis=1).astype(np.int32).ravel())
            yield pd.DataFrame({"doc": batch["rep"].reset_index(drop=True), "gone": out})

    gone = candidates.join(firsts, candidates["rep"] == firsts["doc"], "left").select("rep", "runs", "firsts").mapInPandas(frugal(removed), "doc long, gone array<int>").filter("size(gone) > 0")
    copies = own.join(reps, ["fp", "fp2", "md5"]).filter("_id > rep").select(F.col("_id").alias("doc"), F.array(F.lit(0), F.lit(2147483647)).alias("gone"))
    return gone.unionAll(copies.distinct()).groupBy("doc").agg(F.max("gone").alias("gone"))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def without(text: str, gone: list[int]) -> str:
    """text without the given runs of words (first, last + 1, flat) and the space after each; all else stays as it was written."""
    starts = [m.start() for m in _WORD.finditer(text)]
    out, at = [], 0
    for lo, hi in zip(gone[0::2], gone[1::2], strict=True):
        out.append(text[at : starts[lo]])
        at = starts[hi] if hi < len(starts) else len(text)
    left = "".join(out) + text[at:]
    return left if _WORD.search(left) else ""


def dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, carry: bool = False) -> DataFrame:
    """One row for each row of docs: its id, n_words, n_removed, spans (first and last + 1 of each removed run of words, flat) and kept (the words left, joined by a space; null for a null text).

    digests: kept_sha256 stands for spans and kept. carry: all columns of docs instead, whatever their names, and of texts that lose words what is left, its white space as it was.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    with scratch(docs.sparkSession) as last:
        gone = last(kept(removed_runs(base, window), "dedup-gone"))
    loses = maybe_in(gone, "doc")
    plain, (own, text) = numbered(docs, id_col, text_col)
    rows = plain.withColumn("_id", F.col(own).cast("long")) if carry else base
    whole = loses(rows, F.col("_id"), anti=True)
    some = loses(rows, F.col("_id")).join(gone, F.col("_id") == F.col("doc"), "left").drop("doc")
    if carry:

        def cut(batches):
            import pyarrow as pa

            for batch in batches:
                at = batch.schema.names.index(text)
                texts = [t if t is None or not g or len(_WORD.findall(t)) < window else without(t, [min(x, len(t)) for x in g]) for t, g in zip(batch.column(at).to_pylist(), batch.column("gone").to_pylist(), strict=True)]
                columns = batch.columns[: len(plain_names)]
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, plain_names)

        plain_names = plain.columns
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in plain.schema])
        return some.select(*plain_names, "gone").mapInArrow(frugal(cut), schema).unionAll(whole.select(*plain_names)).toDF(*docs.columns)
    tail = "n_words bigint, n_removed bigint, " + ("kept_sha256 string" if digests else "spans array<int>, kept string")

    def run(batches):
        for batch in batches:
            n_words, n_removed, spans, texts = [], [], [], []
            for whole, gone in zip(batch["_text"], batch["gone"], strict=True):
                words = whole.encode("utf-8", "surrogatepass").split() if isinstance(whole, str) else []
                left, at, out = [], 0, []
                if gone is not None and len(words) >= window:
                    for lo, hi in zip(gone[0::2].tolist(), gone[1::2].tolist(), strict=True):
                        left += words[at:lo]
                        at = min(hi, len(words))
                        out += [lo, at]
                left += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                spans.append(np.array(out, np.int32))
                texts.append(b" ".join(left))
            out = batch[["_id"]].reset_index(drop=True)
            out["n_words"], out["n_removed"] = n_words, n_removed
            if digests:
                out["kept_sha256"] = [hashlib.sha256(t).hexdigest() for t in texts]
            else:
                out["spans"] = spans
                out["kept"] = [t.decode("utf-8", "surrogatepass") if isinstance(x, str) else None for t, x in zip(texts, batch["_text"], strict=True)]
            yield out

    every = some.select("_id", "_text", "gone").unionAll(whole.select("_id", "_text", F.lit(None).cast("array<int>")))
    return every.mapInPandas(frugal(run), f"_id bigint, {tail}").withColumnRenamed("_id", id_col)


def matched(docs: DataFrame, reference: DataFrame, window: int = 20, text_col: str = "text", most_words: int = 200_000) -> DataFrame:
    """docs with `spans`: maximal runs of words (first, last + 1, flat) whose windows all occur in the reference texts.

    The reference is held to most_words, so its automata, one for each AUTOMATON_WORDS words, can be broadcast.
    """
    texts = reference.select(F.col(text_col).alias("_text")).filter("_text is not null").distinct()
    total = texts.select(F.sum(F.regexp_count("_text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    if total > most_words:
        raise ValueError(f"the reference has {total} words; {most_words} are broadcast at most: use dedup()")
    shards = [Automaton()]
    for words in _each([r[0] for r in texts.collect()]):
        if shards[-1].at > AUTOMATON_WORDS:
            shards.append(Automaton())
        shards[-1].add(words.tolist())
    held = docs.sparkSession.sparkContext.broadcast(shards)

    def run(batches):
        for batch in batches:
            spans = []
            for words in _each(batch[text_col]):
                starts = sorted({i - window + 1 for a in held.value for i, _, _ in a.matching(words.tolist(), window)})
                covered = np.array(sorted({j for i in starts for j in range(i, i + window)}), np.int64)
                lo, hi = _spans(covered) if len(covered) else (covered, covered)
                spans.append(np.stack([lo, hi + 1], axis=1).astype(np.int32).ravel())
            yield batch.assign(spans=spans)

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    return docs.mapInPandas(frugal(run), f"{head}spans array<int>")
