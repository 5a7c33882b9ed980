"""Byte-level BPE: a minimal perfect hash resolves pre-tokens that are in the vocabulary, a heap over linked bytes merges the others.

Null texts count as empty; an empty text has no ids and decodes to no bytes. Texts of any length are taken whole.
Repeated rows are encoded each by itself; other columns of the input don't matter, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.shared import frugal, mix, small_batches

#: Pre-tokens that one Python worker remembers, in a younger and an older half; a full younger half replaces the older one, so memory stays bounded.
MEMO = 400_000


class PerfectHash:
    """A minimal perfect hash over distinct byte strings: buckets by one hash, and per bucket the first displacement that puts all its keys into free slots. A bucket with one key names its slot itself."""

    def __init__(self, keys: list[bytes], values: list[int], load: int = 2):
        self.n = max(1, len(keys))
        self.buckets = max(1, self.n // load)
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        self.shift = np.zeros(self.buckets, np.int64)  # below 0: minus one minus the slot
        self.keys: list[bytes | None] = [None] * self.n
        self.values = np.full(self.n, -1, np.int64)
        taken = np.zeros(self.n, bool)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in np.argsort(-(np.diff(first)), kind="stable"):
            own = order[first[b] : first[b + 1]]
            if len(own) <= 1:
                break
            d, good = 0, []
            while not len(good):
                tried = self.slots(h[own][None, :], np.arange(d, d + 32)[:, None])
                good = np.flatnonzero(~taken[tried].any(axis=1) & (np.diff(np.sort(tried, axis=1), axis=1) > 0).all(axis=1))
                d += 32
            at = tried[good[0]]
            self.shift[b] = d - 32 + good[0]
            taken[at] = True
            for i, s in zip(own, at, strict=True):
                self.keys[s], self.values[s] = keys[i], values[i]
        free = iter(np.flatnonzero(~taken).tolist())
        for b in np.flatnonzero(np.diff(first) == 1):
            i, s = order[first[b]], next(free)
            self.shift[b] = -1 - s
            self.keys[s], self.values[s] = keys[i], values[i]

    def slots(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            moved = (mix(h + (d.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)
        return np.where(d < 0, -1 - d, moved)

    def find(self, keys: list[bytes]) -> list[int]:
        """The value of each key, -1 for strangers: a slot's own key is compared."""
        if not keys:
            return []
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        at = self.slots(h, self.shift[(h % np.uint64(self.buckets)).astype(np.int64)])
        values = self.values[at].tolist()
        own = self.keys
        return [v if own[s] == k else -1 for s, v, k in zip(at.tolist(), values, keys, strict=True)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: of all adjacent pairs the one of lowest rank merges first, of equals the leftmost."""
    n = len(piece)
    after = list(range(1, n + 1))  # each part's end, which is where the next one starts
    before = list(range(-1, n - 1))
    alive = bytearray(b"\x01") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or after[j] != end:
            continue
        alive[j] = 0
        after[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    return [ranks[piece[i : after[i]]] for i in range(n) if alive[i]]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Coder:
    """Encodes and decodes texts; remembers the ids of pre-tokens that it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find_all = ranks, regex.compile(pattern).findall
        self.whole = PerfectHash(list(ranks), list(ranks.values()))
        self.pieces: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            self.pieces[v] = k
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, tokens: set[str]) -> None:
        """First tier for all new pre-tokens at once, second tier for those it misses."""
        memo, older = self.memo, self.older
        if len(memo) + len(tokens) > MEMO // 2:
            self.memo, self.older = memo, older = {}, memo
        new = []
        for t in tokens:
            if t not in memo:
                if t in older:
                    memo[t] = older[t]
                else:
                    new.append(t)
        raw = [t.encode("utf-8", "surrogatepass") for t in new]
        for t, b, v in zip(new, raw, self.whole.find(raw), strict=True):
            memo[t] = v.to_bytes(4, "little") if v >= 0 else np.array(merge(b, self.ranks), "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        tokens = self.find_all(text) if isinstance(text, str) else []
        if not tokens:
            return b""
        try:
            return b"".join([self.memo[t] for t in tokens])
        except KeyError:
            self.learn(set(tokens))
            return b"".join([self.memo[t] for t in tokens])

    def decode(self, ids: bytes) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


@functools.lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    """One for each Python worker and vocabulary."""
    return Coder(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row for each row of docs: its id, n_tokens, ids (array of int) and decoded (the bytes of those ids).

    path names a rank file that every executor has, as installed vocabularies do. With digests, sha-256 of the
    ids (little-endian, 32 bits) and of the decoded bytes stand for them: ids_sha256, decoded_sha256.
    A map over rows without a shuffle: a lost executor costs its own tasks only.
    """
    small_batches(docs.sparkSession)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary")

    def run(batches):
        import pandas as pd

        c = coder(path, pattern)
        for batch in batches:
            for lo in range(0, len(batch), 512):
                ids = [c.encode(t) for t in batch["_text"].iloc[lo : lo + 512]]
                back = [c.decode(x) for x in ids]
                out = {id_col: batch["_id"].iloc[lo : lo + 512].reset_index(drop=True), "n_tokens": [len(x) // 4 for x in ids]}
                if digests:
                    out |= {"ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back]}
                else:
                    out |= {"ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in ids], "decoded": back}
                yield pd.DataFrame(out)
        c.memo, c.older = {}, {}  # a worker that waits holds no memory

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInPandas(frugal(run), schema)
