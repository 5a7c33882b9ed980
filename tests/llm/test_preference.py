from tidemill.llm import preference


def render(turns):
    return "".join(f"<|{r or ''}|>\n{t or ''}\n<|end|>\n" for r, t in turns)


def brute(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    prompt = render(a[:n])

    def spans(turns):
        at, out = len(prompt), []
        for r, t in turns:
            whole = len(render([(r, t)]))
            if r == "assistant":
                out.append((at + len(f"<|{r}|>\n"), at + whole))
            at += whole
        return out

    return n, prompt, render(a[n:]), render(b[n:]), spans(a[n:]), spans(b[n:])


CONVS = {
    0: [("user", "hi"), ("assistant", "good"), ("user", "more"), ("assistant", "yes")], 1: [("user", "hi"), ("assistant", "bad")],
    2: [("user", "a")], 3: [("user", "a")], 4: [("system", None), ("user", "ü😀")], 5: [("system", None), ("user", "ü😀"), ("assistant", "ok")],
    6: [("user", "x")], 7: [("user", "y"), (None, "z"), ("assistant", "")], 8: [("user", "alone")], 10: [("user", "long " * 20000), ("assistant", "b")], 11: [("user", "long " * 20000), ("assistant", "c")],
}


def rows():
    return [(c, i, r, t, "q") for c, turns in CONVS.items() for i, (r, t) in enumerate(turns)] + [(None, 0, "user", "x", "q")]


def same(r, want):
    assert (r.prompt_turns, r.prompt, r.chosen, r.rejected) == want[:4]
    assert [tuple(s) for s in r.chosen_spans] == want[4] and [tuple(s) for s in r.rejected_spans] == want[5]


def test_adjacent(spark):
    turns = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string, prompt string").repartition(4)
    got = {r.pair_id: r for r in preference.adjacent(turns).collect()}
    assert set(got) == {0, 1, 2, 3, 5}
    for p, r in got.items():
        same(r, brute(CONVS[2 * p], CONVS[2 * p + 1]))
    assert preference.adjacent(turns.limit(0)).count() == 0


def test_paired(spark):
    turns = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string, prompt string")
    pairs = spark.createDataFrame([(1, 0, 1, 5), (2, 5, 4, 5), (2, 5, 4, 5), (3, 0, 99, 5), (4, None, 1, 5)], "pair_id long, chosen long, rejected long, text int")
    got = sorted(preference.paired(pairs, turns).collect(), key=lambda r: r.pair_id)
    assert [r.pair_id for r in got] == [1, 2, 2]
    same(got[0], brute(CONVS[0], CONVS[1]))
    same(got[1], brute(CONVS[5], CONVS[4]))
