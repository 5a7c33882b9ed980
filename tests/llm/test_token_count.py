import random

import public_tokenizers
import regex

from tidemill.llm import token_count
from tidemill.llm.byte_bpe import read_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute(piece, scores):
    best = [(0, 0)] + [None] * len(piece)  # (score, -tokens)
    for i in range(1, len(piece) + 1):
        best[i] = max((best[j][0] + scores[piece[j:i]], best[j][1] - 1) for j in range(i) if piece[j:i] in scores)
    return -best[-1][1]


def test_counts(spark, monkeypatch):
    scores = token_count.zipf_scores(read_ranks(PATH))
    r = random.Random(4)
    texts = ["".join(r.choice("abcdethionrs  \n0123üß,.!") for _ in range(r.randint(0, 300))) for _ in range(60)] + [None, "", "the theology of theories", "😀 x", "a" * 3000, "word " * 20000]
    want = [sum(brute(p.encode(), scores) for p in regex.findall(public_tokenizers.PATTERN, t or "")) for t in texts]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    assert [x.n_tokens for x in sorted(token_count.count(docs, PATH, public_tokenizers.PATTERN).collect(), key=lambda x: x.doc_id)] == want
    assert token_count.count(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    monkeypatch.setattr(token_count, "NODES", 50)
    c = token_count.Counter(scores, public_tokenizers.PATTERN)
    assert [c.count(t)[1] for t in texts] == want


def test_trie_shares_prefixes():
    c = token_count.Counter({bytes([b]): -1 for b in range(256)} | {b"ab": -1}, r"\S+")
    assert c.count("abc abd ab") == (3, 2 + 2 + 1) and c.nodes == 4
