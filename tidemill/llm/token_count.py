"""Token counts under a unigram vocabulary, by dynamic programming shared along a trie of pre-tokens.

The vocabulary and its scores are given, not learned: token r of a public rank file scores -ln((r + 1) H), H the harmonic number
of the vocabulary (a Zipf law over ranks), in whole micro-nats so that sums are exact. A pre-token's best segmentation has the
greatest sum of scores; of equals the one with fewest tokens counts.

Distinct pre-tokens go to one trie in each Python worker. The forward score of a node, best over all tokens that end there,
depends on its prefix alone, so it is computed once for all pre-tokens below it; the node where a pre-token ends gives its count.
Which tokens end at a node is read off an automaton over the vocabulary, whose state a node keeps: no length is tried in vain.

The vocabulary holds all single bytes, so every text has a segmentation. Null and empty texts have 0 tokens. Repeated rows are counted
each by itself; texts are taken whole; other columns don't matter. A map over rows, without a shuffle.
"""

from __future__ import annotations

import functools
import math
from collections import deque

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.byte_bpe import read_ranks
from tidemill.llm.shared import frugal, small_batches

#: Nodes of the trie in one Python worker; beyond that it starts anew. Bytes of one pre-token that become nodes; the rest is computed without.
NODES, DEEP = 500_000, 1_000
#: Pre-tokens whose counts a worker remembers, in a younger and an older half, apart from the trie.
MEMO = 400_000
#: A segmentation is one number: its score times UNIT, less its tokens. The greater number is the better one.
UNIT = 1 << 40


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, int]:
    h = sum(1 / (r + 1) for r in ranks.values())
    return {t: -round(1e6 * math.log((r + 1) * h)) for t, r in ranks.items()}


class Endings:
    """Which tokens end at each place of a byte string: the suffix-linked trie of the vocabulary. ends: for each state (length, value) of the tokens that end in it."""

    def __init__(self, scores: dict[bytes, int]):
        self.next: dict[int, int] = {}
        ends: list[list] = [[]]
        for token in sorted(scores):
            state = 0
            for byte in token:
                key = state << 8 | byte
                child = self.next.get(key)
                if child is None:
                    child = self.next[key] = len(ends)
                    ends.append([])
                state = child
            ends[state].append((len(token), scores[token] * UNIT - 1))
        self.link = [0] * len(ends)
        children: list[list[tuple[int, int]]] = [[] for _ in ends]
        for key, child in self.next.items():
            children[key >> 8].append((key & 255, child))
        queue = deque([0])
        while queue:  # a state after all shorter ones
            state = queue.popleft()
            for byte, child in children[state]:
                if state:
                    self.link[child] = self.step(self.link[state], byte)
                    ends[child] += ends[self.link[child]]
                queue.append(child)
        self.ends = [tuple(e) for e in ends]
        self.longest = max(map(len, scores), default=1)

    def step(self, state: int, byte: int) -> int:
        while (to := self.next.get(state << 8 | byte)) is None:
            if not state:
                return 0
            state = self.link[state]
        return to


class Counter:
    """Counts tokens; keeps the trie of the pre-tokens it has met, by node: child by byte, best value, state."""

    def __init__(self, scores: dict[bytes, int], pattern: str):
        self.find_all = regex.compile(pattern).findall
        self.endings = Endings(scores)
        self.clear()

    def clear(self) -> None:
        self._plant()
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def _plant(self) -> None:
        self.children: dict[int, int] = {}
        self.best, self.state = [0], [0]

    @property
    def nodes(self) -> int:
        return len(self.best) - 1

    def insert(self, piece: bytes) -> int:
        """Walks piece down the trie, adds what is missing with its forward scores, and returns its number of tokens."""
        children, best, states = self.children, self.best, self.state
        node, values = 0, [0]  # the best value of each prefix
        for byte in piece:
            child = children.get(node << 8 | byte)
            if child is None:
                break
            values.append(best[child])
            node = child
        rest = piece[len(values) - 1 :]
        if rest:
            follow, link, ends, longest = self.endings.next.get, self.endings.link, self.endings.ends, self.endings.longest
            state, room = states[node], DEEP - len(values)
            for i, byte in enumerate(rest):
                while (to := follow(state << 8 | byte)) is None and state:
                    state = link[state]
                state = to or 0
                value = None
                for n, v in ends[state]:
                    v += values[-n]
                    if value is None or v > value:
                        value = v
                values.append(value)
                if i <= room:
                    child = children[node << 8 | byte] = len(best)
                    best.append(value)
                    states.append(state)
                    node = child
                elif len(values) > 100_000:
                    del values[:-longest]
        return -values[-1] & (UNIT - 1)

    def learn(self, tokens: set[str]) -> None:
        if len(self.known) + len(tokens) > MEMO // 2:
            self.known, self.older = {}, self.known
        if self.nodes > NODES:
            self._plant()
        known, older = self.known, self.older
        for t in tokens:
            if t not in known:
                known[t] = older[t] if t in older else self.insert(t.encode("utf-8", "surrogatepass"))

    def count(self, text: str | None) -> tuple[int, int]:
        """Numbers of pre-tokens and of tokens."""
        tokens = self.find_all(text) if isinstance(text, str) else []
        try:
            return len(tokens), sum(map(self.known.__getitem__, tokens))
        except KeyError:
            self.learn(set(tokens))
            return len(tokens), sum(map(self.known.__getitem__, tokens))


@functools.lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    """One for each Python worker and vocabulary."""
    return Counter(zipf_scores(read_ranks(path)), pattern)


def count(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, n_pretokens and n_tokens. path names a rank file that every executor has."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pandas as pd

        c = counter(path, pattern)
        for batch in batches:
            pairs = [c.count(t) for t in batch["_text"]]
            yield pd.DataFrame({"_id": batch["_id"], "n_pretokens": [p for p, _ in pairs], "n_tokens": [n for _, n in pairs]})
        c.clear()  # a worker that waits holds no memory

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInPandas(frugal(run), f"_id {kind}, n_pretokens bigint, n_tokens bigint").withColumnRenamed("_id", id_col)
