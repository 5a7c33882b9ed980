"""Mixing sources to target weights by entropy balancing.

Every document gets a rate exp(lambda * size), at most `most`, with one lambda per source: the rates nearest to 1 in
relative entropy whose words meet the source's target. Newton steps solve the convex dual: each is a Spark job over counts by (source, size)
that gives the words and their slope at several lambdas of a source at once, among them the Newton points of both ends of the bracket, which
so shrinks to the tightest pair around the target. Rates become whole copies by systematic rounding
along (source, size); what a source then lacks or has too much is made up from one size of each class, the largest first, and from the size
nearest to what is left, up to FILL_ROUNDS times: each time less is left, at last less than half of the smallest document that could still be taken or left.

Nulls: a null text has size 0; null sources are one source, the last. Documents of size 0 get rate 1, hence a copy, and take
no words. Empty tables give empty results. Repeated rows are documents of their own; those with one id and size get their copies in the order of their texts' hashes. Columns besides may have any name. All sums are decimals, so
reruns agree whatever the order of tasks. No step needs all rows of a source or size in one task, nor all sources: equal sizes are counted
first, and ranked in salted groups of about GROUP rows; running sums go by classes of sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.steps import in_order, scratch
from tidemill.llm.shared import kept, numbered, unused

#: Rows of one (source, size) that are ranked together, about.
GROUP = 512
NEWTON_STEPS = 60
FILL_ROUNDS = 6
_EXACT = "decimal(28,6)"


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weighted_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """sizes (_source, _n, _size: one row each source) with _sid (1.. by code point, null last) and _target.

    Targets share `share` of all sizes by the repeating weights; none is above `most` times its source's size: what is
    over goes to the others by weight, until none is above. Each of these rounds is one aggregate over the sources.
    """
    w = F.element_at(F.array(*[F.lit(float(x)).cast("decimal(18,6)") for x in weights]), ((F.col("_sid") - 1) % len(weights) + 1).cast("int"))
    t = in_order(sizes, [F.asc_nulls_last("_source")], "_sid", "mix-sources").withColumn("_w", w).withColumn("_cap", (F.lit(most).cast("decimal(12,6)") * F.col("_size").cast("decimal(18,0)")).cast(_EXACT))
    level = None
    while True:
        over = F.lit(False) if level is None else F.col("_cap") <= F.col("_w") * F.lit(level)
        words, caps, open_ = t.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.sum(F.when(over, F.col("_cap"))), F.sum(F.when(~over, F.col("_w")))).first()
        if open_ is None:  # all at their caps
            level = None
            break
        raised = (share * float(words) - float(caps or 0)) / float(open_)
        if level is not None and raised <= level:
            break
        level = raised
    target = F.col("_cap").cast("double") if level is None else F.least(F.col("_cap").cast("double"), F.col("_w").cast("double") * level)
    return t.select("_sid", "_source", "_n", "_size", target.alias("_target"))


def _rate(lam: Column, size: Column, mean: Column, most: float) -> Column:
    """exp(lambda * size / mean), at most `most`; the exponent is cut first, so it never overflows."""
    return F.least(F.lit(most), F.exp(F.least(lam * size / mean, F.lit(2.0 + most))))


#: Places of the first lambdas between the ends of the bracket and 0, as parts of either, and of later ones within it.
_FIRST = (1.0, 0.3, 0.1, 0.03, 0.01, 3e-3, 1e-3, 1e-4)
_LATER = (0.02, 0.1, 0.3, 0.5, 0.7, 0.9, 0.98)


def solve(cells: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """targets with _lam and _mean: sum(_n * size * rate) over a source's cells equals its target."""
    least = cells.filter("_size > 0").groupBy("_sid").agg(F.min("_size").alias("_least"))
    t = targets.join(least, "_sid", "left").selectExpr("*", "greatest(_size / _n, 1e-9D) as _mean", "greatest(_size / _n, 1e-9D) / coalesce(_least, 1) as _unit")
    # at _lo even the smallest documents have a rate of about 0, at _hi all have the greatest
    names = ["_sid", "_source", "_size", "_target", "_n", "_mean"]
    first = ", ".join(f"_lo * {x}D, _hi * {x}D" for x in _FIRST)
    t = t.selectExpr(*names, "-700 * _unit as _lo", f"ln({most}D) * _unit as _hi").selectExpr("*", "0D as _lam", "false as _done", f"array(0D, {first}) as _try")
    state = kept(t, "mix-state")
    cells = cells.select("_sid", F.col("_size").alias("_s"), "_cell_n")
    newton = ", ".join(f"if({n} + {e}D * w > _lo and {n} + {e}D * w < _hi, {n} + {e}D * w, null)" for n in ("_below._newton", "_above._newton") for e in (0.0, -1e-3, 1e-3))
    later = ", ".join(f"_lo + {x}D * w" for x in _LATER)
    for _ in range(NEWTON_STEPS):
        tried = cells.join(state.filter("not _done").selectExpr("_sid", "_mean", "_target", "explode(_try) as _l"), "_sid").withColumn("_r", _rate(F.col("_l"), F.col("_s"), F.col("_mean"), most))
        exact = f"cast(cast(sum(cast(round(_cell_n * _s * {{}}, 6) as {_EXACT})) as {_EXACT}) as double)"
        sums = tried.groupBy("_sid", "_target", "_l").agg(F.expr(exact.format("_r")).alias("_got"), F.expr(exact.format(f"if(_r < {most}D, _s / _mean * _r, 0D)")).alias("_slope"))
        point = sums.selectExpr("_sid", "_target", "_l", "_got - _target as _gap", "if(_slope > 0, _l - (_got - _target) / _slope, null) as _newton")
        ends = point.groupBy("_sid").agg(*[F.expr(x) for x in ("max(if(_gap < 0, struct(_l, _newton), null)) as _below", "min(if(_gap >= 0, struct(_l, _newton), null)) as _above", "min(struct(abs(_gap) as off, _l as lam)) as _best")])
        met = "(_done or _best is null or _best.off <= greatest(1e-3D, 1e-9D * _target)) as _done"
        after = state.join(ends, "_sid", "left").selectExpr(*names, "greatest(_lo, _below._l) as _lo", "least(_hi, _above._l) as _hi", "_below", "_above", "coalesce(_best.lam, _lam) as _lam", met).withColumn("w", F.expr("_hi - _lo"))
        state = kept(after.selectExpr(*names, "_lo", "_hi", "_lam", "_done", f"array_distinct(array_compact(array({newton}, {later}))) as _try"), "mix-state")
        if state.filter("not _done").isEmpty():
            return state
    raise RuntimeError("Newton's steps didn't meet the targets")


def _class(size: Column) -> Column:
    """Sizes by eighths of powers of two: few for each source, and few sizes in each."""
    return F.when(size > 0, F.floor(8 * F.log2(size.cast("double"))) + 1).otherwise(0).cast("int")


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """One row for each document: its id, size, source_size, target, rate, copies and taken (copies * size).

    carry keeps all columns of docs instead, whatever their names, and adds the copies as the last one, `_copies` (with more underscores where docs has that).
    """
    plain, (id_, text, source) = numbered(docs, id_col, text_col, source_col)
    base = plain if carry else plain.select(F.col(id_), F.col(source), F.col(text))
    own = base.columns if carry else [id_]
    pick = base.select(*own, F.xxhash64(id_).alias("_h"), (F.xxhash64(text) if carry else F.lit(0).cast("long")).alias("_t"), F.col(source).alias("_src"), word_count(F.col(text)).alias("_len"))
    with scratch(docs.sparkSession) as last:
        if not carry:
            pick = last(kept(pick, "mix-sizes"))  # so that texts are read once
        counts = kept(pick.groupBy(F.col("_src").alias("_source"), F.col("_len").alias("_size")).agg(F.count("*").alias("_cell_n")), "mix-counts")
        sources = counts.groupBy("_source").agg(F.sum("_cell_n").alias("_n"), F.sum(F.col("_size") * F.col("_cell_n")).alias("_size"))
        targets = kept(weighted_targets(sources, weights, share, float(most)), "mix-targets")
        named = targets.select("_sid", F.col("_source").alias("_name"))
        cells = counts.join(named, F.col("_source").eqNullSafe(F.col("_name"))).select("_sid", "_source", "_size", "_cell_n")
        state = solve(cells, targets, float(most))

        # whole copies for each (source, size, salt), then their sum for each source brought to the target
        s = state.select("_sid", F.col("_size").alias("_total"), "_target", "_lam", "_mean")
        groups = F.ceil(F.col("_cell_n") / GROUP).cast("int")
        salted = cells.withColumn("_salts", groups).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
        many = last(kept(cells.filter(F.col("_cell_n") > GROUP).select(F.col("_source").alias("_msrc"), F.col("_size").alias("_mlen"), groups.alias("_salts")), "mix-salts"))
        rows = pick.join(many, F.col("_src").eqNullSafe(F.col("_msrc")) & (F.col("_len") == F.col("_mlen")), "left").drop("_msrc", "_mlen").withColumn("_salt", F.coalesce(F.pmod("_h", F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
        sizes = rows.groupBy("_src", "_len", "_salt").agg(F.count("*").alias("_rows"))
        salted = salted.select("_sid", F.col("_source").alias("_name"), "_size", F.col("_salt").alias("_cell_salt"))
        rate = F.when(F.col("_target") >= most * F.col("_total") * (1 - 1e-12), F.lit(float(most))).otherwise(_rate(F.col("_lam"), F.col("_size"), F.col("_mean"), float(most)))
        plan = salted.join(sizes, F.col("_name").eqNullSafe(F.col("_src")) & (F.col("_size") == F.col("_len")) & (F.col("_cell_salt") == F.col("_salt"))).join(s, "_sid")
        plan = plan.withColumn("_rate", F.round(F.when(F.col("_size") > 0, rate).otherwise(1.0), 9).cast("decimal(12,9)"))
        part = (F.col("_rate") * F.col("_rows").cast("decimal(15,0)")).cast("decimal(30,9)")
        plan = kept(plan.select("_sid", "_name", "_size", "_cell_salt", "_rows", "_rate", "_target", "_total", part.alias("_part"), _class(F.col("_size")).alias("_class")), "mix-rates")
        # running sums: of classes of a source, then within a class
        classes = plan.groupBy(F.col("_sid").alias("_csid"), F.col("_class").alias("_cclass")).agg(F.sum("_part").cast("decimal(30,9)").alias("_csum"))
        classes = classes.withColumn("_before", F.sum("_csum").over(Window.partitionBy("_csid").orderBy("_cclass").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_csum")).drop("_csum")
        upto = Window.partitionBy("_sid", "_class").orderBy("_size", "_cell_salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        plan = plan.withColumn("_within", F.sum("_part").over(upto)).join(classes, (F.col("_sid") == F.col("_csid")) & (F.col("_class") == F.col("_cclass"))).withColumn("_end", (F.col("_before") + F.col("_within")).cast("decimal(32,9)"))
        half = F.lit(0.5).cast("decimal(2,1)")
        whole = (F.floor(F.col("_end") + half) - F.floor(F.col("_end") - F.col("_part") + half)).cast("long")
        plan = kept(plan.select("_sid", "_name", "_size", "_cell_salt", "_rows", "_rate", "_target", "_total", whole.alias("_m")), "mix-plan")
        # what is left of each source's gap: first from one cell of each class of sizes, the largest first, then from the cell nearest to it
        for again in range(FILL_ROUNDS):
            gaps = plan.groupBy("_sid").agg(F.expr("cast(round(max(_target) - sum(_m * _size)) as long) as _gap"))
            room = plan.join(gaps, "_sid").filter("_size > 0 and _gap <> 0").selectExpr("_sid", "_gap", "_size", "_cell_salt", f"if(_gap > 0, {most} * _rows - _m, _m) as _room").filter("_room > 0 and _size < 2 * abs(_gap)")
            if again == 0:
                one = room.groupBy("_sid", _class(F.col("_size"))).agg(F.max("_gap").alias("_gap"), F.expr("max(struct(_size as size, -_cell_salt as salt, _room as room)) as cell"))
                each = one.groupBy("_sid").agg(F.max("_gap").alias("_gap"), F.sort_array(F.collect_list("cell"), asc=False).alias("cells"))  # a cell of each class
                take = "least(c.room, a.rest div c.size)"
                fold = f"aggregate(cells, struct(abs(_gap) as rest, cast(array() as array<struct<size:bigint,salt:int,n:bigint>>) as taken), (a, c) -> struct(a.rest - c.size * {take} as rest, array_append(a.taken, struct(c.size as size, -c.salt as salt, {take} as n)) as taken))"
                fill = each.selectExpr("_sid", "signum(_gap) as way", f"explode({fold}.taken) as t").selectExpr("_sid as _bid", "t.size as _bsize", "t.salt as _bsalt", "cast(way * t.n as long) as _more").filter("_more <> 0")
            else:
                near = room.groupBy("_sid").agg(F.expr("min(struct(abs(_size - abs(_gap)) as off, _size, _cell_salt, _room, _gap)) as b"))
                fill = near.selectExpr("_sid as _bid", "b._size as _bsize", "b._cell_salt as _bsalt", "cast(signum(b._gap) * least(greatest(abs(b._gap) div b._size, 1L), b._room) as long) as _more")
            fill = kept(fill, "mix-fill")
            if again and fill.isEmpty():
                break
            here = (F.col("_sid") == F.col("_bid")) & (F.col("_size") == F.col("_bsize")) & (F.col("_cell_salt") == F.col("_bsalt"))
            plan = kept(plan.join(fill, here, "left").withColumn("_m", F.col("_m") + F.coalesce("_more", F.lit(0))).drop("_bid", "_bsize", "_bsalt", "_more"), "mix-plan")
        last(plan)

    # the copies of a group go to its rows in the order of a hash of their ids
    rank = F.row_number().over(Window.partitionBy("_src", "_len", "_salt").orderBy("_h", id_, "_t"))
    out = rows.withColumn("_rank", rank).join(plan, F.col("_src").eqNullSafe(F.col("_name")) & (F.col("_len") == F.col("_size")) & (F.col("_salt") == F.col("_cell_salt")))
    copies = F.floor(F.col("_m") / F.col("_rows")).cast("long") + F.when(F.col("_rank") <= F.col("_m") % F.col("_rows"), 1).otherwise(0)
    out = out.withColumn("_copies", copies.cast("long"))
    if carry:
        return out.select(*own, "_copies").toDF(*docs.columns, unused("_copies", docs))
    return out.select(F.col(id_).alias(id_col), F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_copies").alias("copies"), F.col("_rate").cast("double").alias("rate"))
