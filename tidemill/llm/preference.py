"""Preference formatting: the longest common prefix of turns of a chosen and a rejected conversation becomes the prompt, the rest two completions.

Conversations come as rows of turns, pairs as rows (pair, chosen, rejected). A turn is rendered as `<|role|>` newline text newline
`<|end|>` newline. Both turns at one place are common if their roles and texts are equal (null equals null; a null
is rendered as nothing). If one conversation is a prefix of the other, its completion is empty; without any common turn the
prompt is. Masks are spans of characters of prompt + completion on which a loss counts: the assistant's turns of the completion,
less their `<|role|>` line.

All is DataFrame functions: turns meet in one aggregation by (conversation), whose turns are a conversation's own; a first turn
that many share is not a key. Turns are ordered by `turn`, nulls first, then role and text; turns that repeat a number stay, in
that order. Pairs whose conversations aren't both there, or null, are left out, as are rows without a conversation. Repeated pair rows
are kept. Other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>"


def rendered(turn: Column) -> Column:
    return F.concat(_head(turn), F.coalesce(turn["text"], F.lit("")), F.lit(f"\n{END}\n"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"))


def _spans(turns: Column, offset: Column, role: str) -> Column:
    """(start, end) of what of the turns counts, by characters, the first of them starting at offset."""
    start = F.struct(offset.cast("long").alias("at"), F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head, whole = F.length(_head(t)).cast("long"), F.length(rendered(t)).cast("long")
        mine = F.struct((acc["at"] + head).alias("start"), (acc["at"] + whole).alias("end"))
        return F.struct((acc["at"] + whole).alias("at"), F.when(t["role"] == role, F.concat(acc["spans"], F.array(mine))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """_conv, _turns: a row for each conversation, its turns in order."""
    one = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return turns.select(F.col(conv_col).alias("_conv"), one.alias("_turn")).filter("_conv is not null").groupBy("_conv").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))


def paired(pairs: DataFrame, turns: DataFrame, role: str = "assistant", **columns: str) -> DataFrame:
    """pair_id, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans for each row of pairs (pair_id, chosen, rejected)."""
    convs = conversations(turns, **columns)
    a, b = convs.select(F.col("_conv").alias("_a"), F.col("_turns").alias("_left")), convs.select(F.col("_conv").alias("_b"), F.col("_turns").alias("_right"))
    both = pairs.select("pair_id", F.col("chosen").alias("_ca"), F.col("rejected").alias("_cb")).join(a, F.col("_ca") == F.col("_a")).join(b, F.col("_cb") == F.col("_b"))
    return _formatted(both, role)


def adjacent(turns: DataFrame, role: str = "assistant", conv_col: str = "conv_id", **columns: str) -> DataFrame:
    """The same where conversation 2 p is chosen and 2 p + 1 is rejected: one shuffle, by the pair, brings both together."""
    p = F.shiftright(F.col(conv_col).cast("long"), 1)
    one = F.struct((F.col(conv_col) % 2 != 0).alias("second"), F.col(columns.get("turn_col", "turn")).alias("turn"), F.col(columns.get("role_col", "role")).alias("role"), F.col(columns.get("text_col", "text")).alias("text"))
    all_ = turns.select(p.alias("pair_id"), one.alias("_turn")).filter("pair_id is not null").groupBy("pair_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    side = lambda second: F.transform(F.filter("_turns", lambda t: t["second"] == second), lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text")))
    both = all_.select("pair_id", side(False).alias("_left"), side(True).alias("_right")).filter("size(_left) > 0 and size(_right) > 0")
    return _formatted(both, role)


def _formatted(both: DataFrame, role: str) -> DataFrame:
    same = F.zip_with("_left", "_right", lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    places = F.transform(F.filter(F.transform(same, lambda s, i: F.struct((~s).alias("no"), i.alias("i"))), lambda s: s["no"]), lambda s: s["i"])
    shortest = F.least(F.size("_left"), F.size("_right"))
    both = both.withColumn("_n", F.least(F.coalesce(F.get(places, F.lit(0)), shortest), shortest))
    text = lambda turns: F.array_join(F.transform(turns, rendered), "")
    rest = lambda c: F.slice(c, F.col("_n") + 1, F.greatest(F.size(c) - F.col("_n"), F.lit(0)))
    both = both.withColumn("prompt", text(F.slice("_left", F.lit(1), F.col("_n"))))
    return both.select(
        "pair_id", F.col("_n").alias("prompt_turns"), "prompt", text(rest("_left")).alias("chosen"), text(rest("_right")).alias("rejected"),
        _spans(rest("_left"), F.length("prompt"), role).alias("chosen_spans"), _spans(rest("_right"), F.length("prompt"), role).alias("rejected_spans"),
    )
