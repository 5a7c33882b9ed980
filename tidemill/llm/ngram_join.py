"""N-gram Jaccard self-join by prefix trees: documents linked by their shingle sets, and the components of the links.

Documents with equal sets are one class. Classes that can link share at least m of their first |s| - ceil(0.8 |s|) + m
shingles in one global order (rarest first; ties by hash). Candidate clusters are made of pairs that share enough of the
shingles that at most GROUP have, and, among documents with enough shingles that more have, of each with the first of like size
that has the same: linked pairs are within a cluster, and no group's pairs are listed but those of at most GROUP. Each cluster's sets go to one trie (large clusters: to shards of bounded size, each with the
cluster's pivot; where many don't join the pivot the cluster is split anew by its own exact counts, and the few that
remain are held against all shards in blocks). A document is looked up in the trie:
subtrees share the overlap so far, and fall away when the shingles left can't reach the needed overlap, or
when all below is linked to the document already.

A null text, or one without words, has an empty set and no links; nor has a row without an id. Fewer than k words are one shingle. Rows that repeat an id must repeat its text. Repeated rows and equal
texts are one class. Texts of any length are taken whole; other columns don't matter. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.steps import scratch
from tidemill.llm.shared import NUMBER_ROWS, SENT_ROWS, as_bytes, components, frugal, kept, maybe_in, mix, partitions, run_hashes, slices, small_batches, union_find, word_hashes

#: Frequent shingles whose counts are broadcast for the order; a hint only, results don't depend on it. 9 bytes each.
FREQUENT = 400_000
#: Shingles that a task counts together.
COUNTED = 4_000_000
#: Sets and shingles of one trie.
TRIE_SETS, TRIE_SHINGLES = 500, 1_000_000
#: Documents of a shingle among which all pairs are counted.
GROUP = 8
#: A shingle counted over 2 ** HOT times is sorted in salted parts.
HOT = 13
#: Times that clusters of many unlike sets are clustered anew, by exact counts, before all is held against all in blocks.
ROUNDS = 3
#: Comparisons of a shard with a block up to which a cluster isn't clustered anew: they cost less than another round.
ANEW = 16
_SALT = np.uint64(0x2545F4914F6CDD1D)
#: Bounds of sixteenths of the hashes.
_PARTS = np.array([*(i << 60 for i in range(16)), (1 << 64) - 1], np.uint64)


def shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the k-word shingles of each text, A-Z folded."""
    words, first = word_hashes(texts, lower=True)
    runs = run_hashes(words, k)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= k:
            own = np.sort(runs[lo : hi - k + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif hi > lo:
            out.append(run_hashes(words[lo:hi], hi - lo))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def all_shingles(column, k: int):
    texts = as_bytes(column)
    for lo, hi in slices(texts):
        yield from shingles(texts[lo:hi], k)


def prints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set, from sums that don't depend on an order."""
    with np.errstate(over="ignore"):
        a = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
        b = np.array([mix(s ^ _SALT).sum(dtype=np.uint64) for s in sets], np.uint64)
    return mix(a).view(np.int64), mix(b).view(np.int64)


def need(x: int, t: int) -> int:
    """ceil(t x / 100)."""
    return -(-t * x // 100)


def extra(n):
    """How much longer the looked-at beginning of a set of n shingles is than what one shared shingle takes."""
    return 1 + n // 50


def shared_least(x, y, t: int):
    """How many shingles the beginnings of two linked sets share at least.

    One of the beginnings ends first in the order, say that of x: its shared shingles are all in y's, and at most the rest
    of x, ceil(t x) - extra(x), can be shared besides.
    """
    overlap = -(-t * (x + y) // (100 + t))
    return np.minimum(overlap - (-(-t * x // 100)) + extra(x), overlap - (-(-t * y // 100)) + extra(y))


def _edges(rows, going: bool, last: bool, t: int):
    """Of rows sorted by (token, salt, n, doc), as a, b, c, least: pairs of documents with how many tokens they share here and how many they must share; and of tokens that more than GROUP documents have (token, document, 0, size).

    Then the rows of a token that may go on, and whether it has more than GROUP already.
    """
    import pandas as pd

    token, n, doc = (rows[x].to_numpy().astype(np.int64) for x in ("token", "n", "doc"))
    salt = rows["salt"].to_numpy() if "salt" in rows else np.zeros(len(token), np.int8)
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])])
    start = np.flatnonzero(new)
    large = np.diff(np.append(start, len(token))) > GROUP
    large[0] |= going
    if "hot" in rows:  # its other parts aren't counted here
        large |= rows["hot"].to_numpy()[start]
    end, rest, on = len(token), None, False
    if not last:
        on = bool(large[-1])
        end = len(token) - 1 if on else int(start[-1])
        rest = rows.iloc[end:]
    group = np.cumsum(new) - 1
    many = np.flatnonzero(large[group[:end]])
    found = [(token[many], doc[many], np.zeros(len(many), np.int64), n[many])]
    for d in range(1, GROUP):
        if end <= d:
            break
        i, j = np.arange(d, end), np.arange(end - d)
        ok = (group[i] == group[j]) & ~large[group[i]] & (doc[i] != doc[j]) & (100 * n[j] >= t * n[i])
        i, j = i[ok], j[ok]
        found.append((np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j]), np.ones(len(i), np.int64), shared_least(n[j], n[i], t)))
    return pd.DataFrame(dict(zip(("a", "b", "c", "least"), map(np.concatenate, zip(*found, strict=True)), strict=True))), rest, on


class Trie:
    """Sets as paths of ranks, ascending; edges hold runs of ranks. A node: [ranks, children by first rank, sets that end here, least size, greatest size, a set below, all below linked]."""

    def __init__(self, t: int, find):
        self.t, self.find = t, find
        self.root = [np.zeros(0, np.int64), {}, [], 1 << 60, 0, None, True]

    def add(self, key, ranks: np.ndarray) -> None:
        node, n, at = self.root, len(ranks), 0
        self._seen(node, key, n)
        while at < n:
            child = node[1].get(int(ranks[at]))
            if child is None:
                node[1][int(ranks[at])] = [ranks[at:], {}, [(key, n)], n, n, key, True]
                return
            edge = child[0]
            m = min(len(edge), n - at)
            same = edge[:m] == ranks[at : at + m]
            m = m if same.all() else int(np.argmin(same))
            if m < len(edge):
                upper = [edge[:m], {int(edge[m]): child}, [], *child[3:]]
                child[0] = edge[m:]
                node[1][int(ranks[at])] = child = upper
            self._seen(child, key, n)
            node, at = child, at + m
        node[2].append((key, n))

    def _seen(self, node, key, n: int) -> None:
        node[3], node[4] = min(node[3], n), max(node[4], n)
        node[6] = node[6] and (node[5] is None or self.find(node[5]) == self.find(key))
        node[5] = key if node[5] is None else node[5]

    def links(self, key, ranks: np.ndarray, mark: np.ndarray):
        """Sets that link with key and weren't joined to it yet. mark: a zeroed flag for each rank."""
        t, find, n = self.t, self.find, len(ranks)
        mark[ranks] = 1
        stack = [(c, 0, 0) for c in self.root[1].values()]
        while stack:
            (edge, children, ends, least, most, one, alike), depth, shared = stack.pop()
            if alike and find(one) == find(key):
                continue
            shared += int(mark[edge].sum())
            depth += len(edge)
            left = n - int(np.searchsorted(ranks, edge[-1], side="right"))
            size = min(most, max(least, depth + left))  # the size below for which the bound is best
            if (100 + t) * (shared + min(left, size - depth)) < t * (n + size):
                continue
            for other, m in ends:
                if (100 + t) * shared >= t * (n + m) and find(other) != find(key):
                    yield other
            stack.extend((c, depth, shared) for c in children.values())
        mark[ranks] = 0


def ranked(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Ranks in one order for all sets: frequent first, so that paths are shared; ties by hash."""
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -counts))] = np.arange(len(values))
    r, cut = rank[inverse], np.cumsum([len(s) for s in sets])[:-1]
    return [np.sort(x) for x in np.split(r, cut)], len(values)


def joined(keys: list, sets: list[np.ndarray], t: int, roots: list | None = None, probes: list | None = None):
    """The components of links among sets: find, and the links used. roots: what is known to be joined. probes: flags of the sets to look up (else all)."""
    up, find, union = union_find()
    for k, r in zip(keys, roots or keys, strict=True):
        union(k, r)
    trie, used = Trie(t, find), []
    ranks, n = ranked(sets)
    mark = np.zeros(n, np.int8)
    order = range(len(keys)) if probes is None else sorted(range(len(keys)), key=lambda i: bool(probes[i]))
    for i in order:
        if probes is None or probes[i]:
            for other in trie.links(keys[i], ranks[i], mark):
                if union(keys[i], other):
                    used.append((keys[i], other))
        trie.add(keys[i], ranks[i])
    return find, used


def grouped(batches, keys: list[str]):
    """Consecutive rows of equal keys, together, from sorted batches."""
    import pandas as pd

    rest = None
    for batch in batches:
        if not len(batch):
            continue
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        key = batch[keys].to_numpy()
        cut = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1])
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            yield batch.iloc[lo:hi]
        rest = batch.iloc[cut[-1] :]
    if rest is not None:
        yield rest


def surveyed(docs: DataFrame, k: int, exact: bool = False) -> DataFrame:
    """One reading of the texts: a row for each document (_id, n, fp, fp2), and rows of shingles (h, c: documents with it among those counted together; only those with two or more, unless exact)."""

    def counted(sets):
        import pandas as pd

        edges = [np.searchsorted(s, _PARTS) for s in sets]  # a sixteenth of the hashes at a time, to stay small
        for q in range(len(_PARTS) - 1 if sets else 0):
            values, counts = np.unique(np.concatenate([s[e[q] : e[q + 1]] for s, e in zip(sets, edges, strict=True)]), return_counts=True)
            if not exact:
                values, counts = values[counts > 1], counts[counts > 1]
            yield pd.DataFrame({"_id": None, "n": None, "fp": None, "fp2": None, "h": values.view(np.int64), "c": counts})

    def run(batches):
        import pandas as pd

        held, total, seen = [], 0, set()
        for batch in batches:
            sets = list(all_shingles(batch["_text"], k))
            a, b = prints(sets)
            if not exact:
                yield pd.DataFrame({"_id": batch["_id"].astype("Int64").reset_index(drop=True), "n": [len(s) for s in sets], "fp": a, "fp2": b, "h": None, "c": None})
            for s, fp in zip(sets, zip(a.tolist(), b.tolist(), strict=True), strict=True):
                if fp not in seen:  # of equal sets one counts
                    seen.add(fp)
                    held.append(s)
                    total += len(s)
            if total > COUNTED:
                yield from counted(held)
                held, total, seen = [], 0, set()
        yield from counted(held)

    return docs.mapInPandas(frugal(run), "_id long, n long, fp long, fp2 long, h long, c long")


def candidate_clusters(docs: DataFrame, counted: DataFrame, k: int, t: int) -> DataFrame:
    """node (a document; of equal sets in a task the first), comp: documents that may link are in one cluster. Others are left out. counted: h, c as surveyed."""
    spark = docs.sparkSession
    texts = docs.filter("_id is not null").select("_id", "_text")
    counts = kept(counted.groupBy("h").agg(F.sum("c").alias("c")).filter("c > 1").select("h", F.floor(F.log2("c")).cast("int").alias("level")), "ngram-counts")
    total, least = 0, 99
    for level, n in sorted(((r["level"], r["count"]) for r in counts.groupBy("level").count().collect()), reverse=True):
        total += n
        if total > FREQUENT:
            break
        least = level
    top = counts.filter(F.col("level") >= least).toArrow()
    h = top["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    known = spark.sparkContext.broadcast((h[order], top["level"].to_numpy().astype(np.int8)[order]))

    def prefixes(batches):
        import pandas as pd

        h, levels = known.value
        rough = np.zeros(1 << 22, bool)  # most shingles aren't frequent: a look at their top bits tells
        rough[h >> np.uint64(42)] = True
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            tokens, owner, sizes, heat = [], [], [], []
            sets = list(all_shingles(batch["_text"], k))
            for i, s, *fp in zip(batch["_id"].tolist(), sets, *(x.tolist() for x in prints(sets)), strict=True):
                fp = tuple(fp)
                if not len(s) or fp in seen:
                    continue
                seen.add(fp)
                level = np.zeros(len(s), np.int8)
                if len(h):
                    maybe = np.flatnonzero(rough[s >> np.uint64(42)])
                    at = np.minimum(np.searchsorted(h, s[maybe]), len(h) - 1)
                    level[maybe] = np.where(h[at] == s[maybe], levels[at], 0)
                first = min(len(s), len(s) - need(len(s), t) + extra(len(s)))
                pick = np.argsort(level, kind="stable")[:first]  # s is in the order of hashes
                tokens.append(s[pick] >> np.uint64(16))  # 48 bits are enough to find candidates
                heat.append(level[pick])
                owner.append(np.full(first, i, np.int64))
                sizes.append(np.full(first, len(s), np.int32))
                if sum(map(len, tokens)) > SENT_ROWS:
                    yield pd.DataFrame({"token": np.concatenate(tokens).view(np.int64), "doc": np.concatenate(owner), "n": np.concatenate(sizes), "heat": np.concatenate(heat)})
                    tokens, owner, sizes, heat = [], [], [], []
            if tokens:
                yield pd.DataFrame({"token": np.concatenate(tokens).view(np.int64), "doc": np.concatenate(owner), "n": np.concatenate(sizes), "heat": np.concatenate(heat)})

    hot = bool(len(top)) and int(np.max(top["level"].to_numpy())) > HOT
    rows = texts.mapInPandas(frugal(prefixes), "token long, doc long, n int, heat byte")
    if hot:
        parts = F.expr(f"1 << greatest(0, heat - {HOT})")
        rows = rows.select("token", F.pmod(F.xxhash64("doc"), parts).cast("int").alias("salt"), "n", "doc", (F.col("heat") > HOT).alias("hot"))
    key = ["token", "salt"] if hot else ["token"]
    rows = rows.drop("heat")

    def neighbours(batches):
        import pandas as pd

        rest, going = None, False
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            edges, rest, going = _edges(rows, going, False, t)
            yield edges
        if rest is not None:
            yield _edges(rest, going, True, t)[0]

    sorted_rows = rows.repartition(partitions(spark), *key).sortWithinPartitions(*key, "n", "doc")
    found = kept(sorted_rows.mapInPandas(frugal(neighbours), "a long, b long, c long, least long"), "ngram-pairs", NUMBER_ROWS)
    large = found.filter("c = 0").select(F.col("a").alias("token"), F.col("b").alias("doc"), F.floor(F.log(F.col("least").cast("double")) / np.log(1.1)).alias("tenth"), F.col("least").alias("n"))
    # of the shingles that two documents share, those that many have aren't counted: as many as the one with fewer of these has, at most
    held = kept(large.groupBy("doc").agg(F.count("*").alias("held"), F.max("n").alias("n")), "ngram-held")
    ha, hb = held.select(F.col("doc").alias("a"), F.col("held").alias("ha")), held.select(F.col("doc").alias("b"), F.col("held").alias("hb"))
    pairs = found.filter("c > 0").groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("least").alias("least")).join(ha, "a", "left").join(hb, "b", "left")
    pairs = pairs.filter(F.col("c") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))) >= F.col("least")).select("a", "b")
    # documents with enough of them to link by them alone: each with the first one of its size that has the shingle, and these with each other
    enough = held.filter(F.col("held") >= F.greatest(F.lit(1), F.floor(F.col("n") / 50))).select("doc")
    large = kept(large.join(enough, "doc").select("token", "tenth", "doc"), "ngram-large")
    heads = kept(large.groupBy("token", "tenth").agg(F.min("doc").alias("head")), "ngram-heads")
    star = large.join(heads, ["token", "tenth"]).filter("doc <> head").select(F.col("head").alias("a"), F.col("doc").alias("b"))
    other = heads.select("token", F.col("tenth").alias("_t"), F.col("head").alias("_h"))
    across = heads.join(other, "token").filter(F.col("_t").between(F.col("tenth") + 1, F.col("tenth") + 3) & (F.col("head") != F.col("_h"))).select(F.col("head").alias("a"), F.col("_h").alias("b"))
    return components(pairs.unionAll(star).unionAll(across).distinct())


def link(docs: DataFrame, k: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, n_shingles and component_id (the smallest id reachable by links, itself included). threshold: per cent of the union."""
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as last:
        own, comps = _linked(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")), k, threshold, last)
    out = own.join(comps, F.col("rep") == F.col("node"), "left")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("comp", "rep", "_id").alias("component_id"))


def _linked(docs: DataFrame, k: int, threshold: int, last) -> tuple[DataFrame, DataFrame]:
    """(_id, n, rep (of its class) for each row; node, comp for each class that has links)."""
    survey = kept(surveyed(docs, k), "ngram-survey")
    own = survey.filter("n is not null").select("_id", "n", "fp", "fp2")
    # a table of its own, so that the join below reads both sides from shuffles, and Spark splits that of a frequent class
    classes = kept(own.filter("n > 0").groupBy("n", "fp", "fp2").agg(F.min("_id").alias("rep")), "ngram-classes")
    classes = classes.select(F.col("n").alias("_n"), F.col("fp").alias("_fp"), F.col("fp2").alias("_fp2"), "rep")
    same = (F.col("n") == F.col("_n")) & (F.col("fp") == F.col("_fp")) & (F.col("fp2") == F.col("_fp2"))
    own = kept(own.join(classes, same, "left").select("_id", "n", F.when(F.col("_id").isNotNull(), F.col("rep")).alias("rep")), "ngram-own")
    clusters = candidate_clusters(docs, survey.filter("h is not null").select("h", "c"), k, threshold)
    links = None
    for again in range(1, ROUNDS + 1):
        local = _joined_in_clusters(clusters, own, docs, k, threshold)
        found = local.select(F.col("rep").alias("a"), F.col("root").alias("b"))
        links = found if links is None else links.unionAll(found)
        strays = local.filter("stray").groupBy("comp").agg(F.count("*").alias("strays"), F.ceil(F.count("*") / TRIE_SETS).cast("int").alias("blocks"), F.max("shards").alias("of"))
        strays = kept(strays, "ngram-strays")
        if strays.isEmpty():
            break
        final = again == ROUNDS
        links = links.unionAll(_held_against_all(local, strays.filter(F.lit(final) | (F.col("blocks") * F.col("of") <= ANEW)), docs, k, threshold))
        many = strays.filter(F.col("blocks") * F.col("of") > ANEW)
        if final or many.isEmpty():
            break
        # clusters that hold many unlike sets: their own exact counts order their shingles better
        unlike = kept(local.join(many.select("comp"), "comp").select("rep").distinct(), "ngram-unlike-ids")
        part = kept(maybe_in(unlike, "rep")(docs, F.col("_id")).join(unlike, F.col("_id") == F.col("rep")).select("_id", "_text"), "ngram-unlike")
        clusters = candidate_clusters(part, surveyed(part, k, exact=True).select("h", "c"), k, threshold)
    return last(own), last(components(links))


def _joined_in_clusters(clusters: DataFrame, own: DataFrame, docs: DataFrame, k: int, t: int) -> DataFrame:
    """comp, shard, shards, rep, root (the least id of those it is joined with in its shard), stray (its shard's pivot isn't among them, and there are other shards)."""
    member = kept(own.join(clusters, F.col("_id") == F.col("node")).select("rep", "comp", F.col("n").alias("size")).distinct(), "ngram-candidates")
    size = member.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / TRIE_SETS), F.ceil(F.sum("size") / TRIE_SHINGLES)).cast("int").alias("shards"), F.min("rep").alias("pivot"), F.count("*").alias("members"))
    size = size.filter("members > 1").drop("members")
    shard = F.when(F.col("shards") == 1, F.array(F.lit(0))).when(F.col("rep") == F.col("pivot"), F.sequence(F.lit(0), F.col("shards") - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int")))
    member = kept(member.join(size, "comp").select("comp", "shards", "pivot", "rep", F.explode(shard).alias("shard")), "ngram-members")
    docs = maybe_in(member, "rep")(docs, F.col("_id"))
    routed = member.join(docs, F.col("rep") == F.col("_id")).select("comp", "shard", "shards", "pivot", "rep", "_text")

    def trees(batches):
        import pandas as pd

        for g in grouped(batches, ["comp", "shard"]):
            g = g.drop_duplicates("rep")
            find, _ = joined(g["rep"].tolist(), list(all_shingles(g["_text"], k)), t)
            root = [find(x) for x in g["rep"].tolist()]
            out = pd.DataFrame({"comp": g["comp"], "shard": g["shard"], "shards": g["shards"], "rep": g["rep"], "root": root})
            out["stray"] = (g["shards"] > 1) & (out["root"] != find(g["pivot"].iloc[0]))
            yield out

    spread = routed.repartition(partitions(docs.sparkSession), "comp", "shard").sortWithinPartitions("comp", "shard", "rep")
    return kept(spread.mapInPandas(frugal(trees), "comp long, shard int, shards int, rep long, root long, stray boolean"), "ngram-local")


def _held_against_all(local: DataFrame, blocks: DataFrame, docs: DataFrame, k: int, t: int) -> DataFrame:
    """Links of the sets that didn't join their cluster's pivot, in blocks, against all shards of their cluster."""
    n = partitions(docs.sparkSession)
    every = local.join(blocks.select("comp", "blocks"), "comp").select("comp", "shards", "blocks", "shard", "rep", "root", "stray")
    stored = every.select("comp", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rep", "root", F.lit(False).alias("probe"))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    probes = every.filter("stray").select("comp", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), block.alias("block"), "rep", "root", F.lit(True).alias("probe"))
    routed = kept(stored.unionAll(probes).groupBy("comp", "shard", "block", "rep").agg(F.min("root").alias("root"), F.max("probe").alias("probe")), "ngram-blocks")
    docs = maybe_in(routed, "rep")(docs, F.col("_id"))
    routed = routed.join(docs, F.col("rep") == F.col("_id")).select("comp", "shard", "block", "rep", "root", "probe", "_text")

    def trees(batches):
        import pandas as pd

        for g in grouped(batches, ["comp", "shard", "block"]):
            g = g.drop_duplicates("rep")
            _, used = joined(g["rep"].tolist(), list(all_shingles(g["_text"], k)), t, g["root"].tolist(), g["probe"].tolist())
            if used:
                yield pd.DataFrame(used, columns=["a", "b"])

    return routed.repartition(n, "comp", "shard", "block").sortWithinPartitions("comp", "shard", "block", "rep").mapInPandas(frugal(trees), "a long, b long")
