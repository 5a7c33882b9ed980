"""Shards over nodes: the shard map, routing, migration, and the checks on both.

The shard map has SHARDS rows (shard, producer, consumer, next): small by construction, so it is broadcast.
A shard is stable (producer = consumer, no next) or migrating (producer = next, no consumer).
"""

from __future__ import annotations

import random
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions.ids import BUCKETS
from tidemill.functions.values import at, random_text
from tidemill.operators import consume, mutate
from tidemill.plans.spec import SHARDS, QueueSpec, check


def distinct_buckets(buckets: dict[str, int]) -> dict[str, int]:
    """Nodes' buckets, moved on to the next free one where two share one; the node least by name keeps it."""
    out, taken = {}, set()
    for node in sorted(buckets):
        b = buckets[node] % BUCKETS
        check(len(taken) < BUCKETS, "more nodes than buckets")
        while b in taken:
            b = (b + 1) % BUCKETS
        out[node] = b
        taken.add(b)
    return out


def seeded_shards(spark: SparkSession, nodes: list[str], seed: int) -> DataFrame:
    """Every shard on some node."""
    r = random.Random(seed)
    owner = [(s, n, n, None) for s, n in ((s, r.choice(sorted(nodes))) for s in range(SHARDS))]
    return spark.createDataFrame(owner, "shard int, producer string, consumer string, next string")


def known_shards(shards: DataFrame) -> DataFrame:
    """Rows of shards that exist, in order."""
    return shards.filter(F.col("shard").between(0, SHARDS - 1)).orderBy("shard")


def bounded(shards: DataFrame) -> DataFrame:
    """The map as a broadcast: shards that exist, each once, so SHARDS rows at most whatever the table holds."""
    return F.broadcast(shards.filter(F.col("shard").between(0, SHARDS - 1)).dropDuplicates(["shard"]))


def broken_shards(shards: DataFrame) -> DataFrame:
    """Rows that are neither stable nor migrating."""
    stable = F.col("producer").eqNullSafe(F.col("consumer")) & F.col("next").isNull()
    migrating = F.col("producer").eqNullSafe(F.col("next")) & F.col("consumer").isNull()
    return shards.filter(~(stable | migrating))


def route_produce(messages: DataFrame, shards: DataFrame, nodes: DataFrame) -> DataFrame:
    """messages with `node`: their shard's producer; where that isn't a known node, the least active one by name (else the least known)."""
    active = shards.select(F.col("producer").alias("node")).distinct().join(nodes, "node", "left_semi").agg(F.min("node").alias("_active"))
    any_ = nodes.agg(F.min("node").alias("_any"))
    known = shards.select("shard", F.col("producer").alias("_p")).join(nodes.select(F.col("node").alias("_p")), "_p", "left_semi")
    m = bounded(known).select(F.col("shard").alias("_s"), "_p")
    fallback = F.broadcast(active.join(any_, F.lit(True)))
    out = messages.join(m, F.col("shard") == F.col("_s"), "left").join(fallback, F.lit(True))
    return out.select(*messages.columns, F.coalesce("_p", "_active", "_any").alias("node"))


def consumers(shards: DataFrame) -> DataFrame:
    """node, shards: what each active consumer may receive from."""
    return shards.filter("consumer is not null").groupBy(F.col("consumer").alias("node")).agg(F.sort_array(F.collect_list("shard")).alias("shards"))  # SHARDS items at most


def choose_consumer(shards: DataFrame, choose=min) -> tuple[str, list[int]] | None:
    """A node that consumes and its shards; None if there is none. choose: picks one of the sorted names, say random.Random(seed).choice. SHARDS rows at most go to the driver."""
    found = {r["node"]: r["shards"] for r in consumers(shards).collect()}
    return (node := choose(sorted(found)), found[node]) if found else None


def receive_routed(queue: DataFrame, shards: DataFrame, spec: QueueSpec, now: datetime, limit: int = 1, choose=min, **options) -> tuple[DataFrame, DataFrame]:
    """consume.receive of one node's shards: (all nodes' rows with the claims, the messages claimed with their node). queue: the rows of all nodes, with `node`. No consumer, no messages."""
    chosen = choose_consumer(shards, choose)
    node, own = chosen if chosen else (None, [])
    here = F.col("node").eqNullSafe(F.lit(node)) if chosen else F.lit(False)
    after, messages = consume.receive(queue.filter(here).drop("node"), spec, now, limit, shards=own or None, **options)
    named = F.lit(node).cast("string").alias("node")
    return queue.filter(~here).unionByName(after.withColumn("node", named)), messages.withColumn("node", named)


def mutate_ids_routed(queue: DataFrame, shards: DataFrame, mutations: list, ids: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """mutate.by_ids over nodes: each id (ord, id, shard) goes to the node that consumes its shard; ids that none consumes are not found. queue: the rows of all nodes, with `node`."""
    changes = mutate.changes(mutations, now)
    asked = route_ids(ids.select("id", "shard").distinct(), shards).select(F.col("id").alias("_id"), F.col("shard").alias("_shard"), F.col("node").alias("_node"))
    same = (F.col("id") == F.col("_id")) & (F.col("shard") == F.col("_shard"))
    marked = queue.join(asked, same & (F.col("node") == F.col("_node")), "left")
    after = marked.withColumns({c: F.when(F.col("_id").isNotNull(), v).otherwise(F.col(c)) for c, v in changes.items()}).select(*queue.columns)
    changed = queue.join(asked, same & (F.col("node") == F.col("_node")), "left_semi").withColumns(changes).select(F.col("id").alias("_id"), F.col("shard").alias("_shard"), F.col("node").alias("node"), "scheduled_at", "remaining_attempts")
    return after, ids.join(changed, same, "left").select("ord", "id", "shard", "node", F.col("_id").isNotNull().alias("found"), "scheduled_at", "remaining_attempts")


def mutate_over_nodes(queue: DataFrame, mutations: list, condition: Column, now: datetime, most: int) -> tuple[DataFrame, DataFrame]:
    """mutate.by_condition on every node: (all rows after it, the first `most` changed rows by node and id, with how many changed and whether that is more than most). queue: with `node`."""
    changes = mutate.changes(mutations, now)
    hit = F.coalesce(condition, F.lit(False))
    after = queue.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})
    changed = queue.filter(hit).withColumns(changes).select("node", "id", "shard", "scheduled_at", "remaining_attempts")
    total = changed.agg(F.count("*").alias("mutated"))
    return after, changed.orderBy("node", "id", "shard").limit(most).join(F.broadcast(total.withColumn("truncated", F.col("mutated") > most)), F.lit(True))  # one row of totals


def duplicate_nodes(nodes: DataFrame) -> DataFrame:
    """node, n of the ids that more than one node goes by."""
    return nodes.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")


def node_rows(spark: SparkSession, buckets: dict[str | None, int], now: datetime, seed: int | None = None) -> DataFrame:
    """id, status, created_at, identifiers_bucket of nodes: a random id for one without, and buckets that differ."""
    named = {name or random_text(16, None if seed is None else seed + i): b for i, (name, b) in enumerate(buckets.items())}
    rows = [(n, "active", b) for n, b in sorted(distinct_buckets(named).items())]
    return spark.createDataFrame(rows, "id string, status string, identifiers_bucket int").select("id", "status", at(now).alias("created_at"), "identifiers_bucket")


def bootstrap(spark: SparkSession, nodes: dict[str | None, int], shards: DataFrame | None, now: datetime, seed: int) -> tuple[DataFrame, DataFrame]:
    """(node rows, shard map) of a cluster: buckets are healed; a map that isn't there yet is seeded, one that is keeps its shards. Called again, it is a refresh: the caller decides when."""
    rows = node_rows(spark, nodes, now, seed)
    names = [r["id"] for r in rows.select("id").collect()]
    return rows, known_shards(shards) if shards is not None else seeded_shards(spark, names, seed)


def route_ids(ids: DataFrame, shards: DataFrame) -> DataFrame:
    """ids with the `node` that owns their shard; null while none consumes it: they go to every node."""
    m = bounded(shards).select(F.col("shard").alias("_s"), F.col("consumer").alias("node"))
    return ids.join(m, F.col("shard") == F.col("_s"), "left").drop("_s")


def prepare_migration(shards: DataFrame, moving: list[int], target: str) -> DataFrame:
    """The map while shards move to target: produced there, consumed nowhere. Shards that target owns stay."""
    mine = F.col("shard").isin(sorted(set(moving))) & ~F.col("producer").eqNullSafe(F.lit(target))
    return shards.select("shard", F.when(mine, F.lit(target)).otherwise(F.col("producer")).alias("producer"), F.when(mine, F.lit(None)).otherwise(F.col("consumer")).alias("consumer"), F.when(mine, F.lit(target)).otherwise(F.col("next")).alias("next"))


def finalize_migration(shards: DataFrame) -> DataFrame:
    return shards.select("shard", "producer", F.coalesce("consumer", "next").alias("consumer"), F.lit(None).cast("string").alias("next"))


def changed_shards(before: DataFrame, after: DataFrame) -> DataFrame:
    b, a = before.select("shard", *[F.col(c).alias(f"{c}_before") for c in ("producer", "consumer", "next")]), after.select("shard", *[F.col(c).alias(f"{c}_after") for c in ("producer", "consumer", "next")])
    same = [F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_after")) for c in ("producer", "consumer", "next")]
    return b.join(bounded(a), "shard").filter(~(same[0] & same[1] & same[2]))


def move_rows(source: DataFrame, target: DataFrame, shards: list[int], unique: list[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(source after, target after, rows that stay): rows of the shards go to target unless it holds their id or a unique value; those stay and are reported."""
    mine = F.col("shard").isin(sorted(set(shards)))
    going = source.filter(mine)
    fresh = going
    for c in ("id", *unique):
        held = target.filter(F.col(c).isNotNull()).select(F.col(c).alias("_held")).distinct()
        fresh = fresh.join(held, F.col(c) == F.col("_held"), "left_anti")
    moved = fresh.select(F.col("id").alias("_id"))
    stay = going.join(moved, F.col("id") == F.col("_id"), "left_anti")
    return source.filter(~mine).unionAll(stay), target.unionAll(fresh.select(*target.columns)), stay


def shard_histogram(shards: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n: shards that each known node produces, 0 for none."""
    n = shards.groupBy(F.col("producer").alias("_p")).agg(F.count("*").alias("_n"))
    return nodes.join(n, F.col("node") == F.col("_p"), "left").select("node", F.coalesce("_n", F.lit(0)).alias("n"))


def balance_moves(shards: DataFrame, nodes: DataFrame) -> DataFrame:
    """shard, source, target: moves after which nodes differ by one shard at most; the heaviest nodes keep one more, lowest shards move first.

    Both windows run over the shard map alone, SHARDS rows.
    """
    have = shard_histogram(shards, nodes)
    everything = Window.partitionBy()
    heavy = Window.orderBy(F.desc("n"), "node")
    goal = have.withColumn("_all", F.sum("n").over(everything)).withColumn("_k", F.count("*").over(everything)).withColumn("_r", F.row_number().over(heavy))
    goal = goal.select("node", "n", (F.floor(F.col("_all") / F.col("_k")) + F.when(F.col("_r") <= F.col("_all") % F.col("_k"), 1).otherwise(0)).alias("goal"))
    own = shards.join(F.broadcast(goal), F.col("producer") == F.col("node"))
    surplus = own.withColumn("_i", F.row_number().over(Window.partitionBy("node").orderBy("shard"))).filter(F.col("_i") <= F.col("n") - F.col("goal"))
    surplus = surplus.select("shard", F.col("node").alias("source"), F.row_number().over(Window.orderBy("shard")).alias("_m"))
    short = goal.filter("n < goal").withColumn("_i", F.explode(F.sequence(F.lit(1), (F.col("goal") - F.col("n")).cast("int"))))
    short = short.select(F.col("node").alias("target"), F.row_number().over(Window.orderBy("node", "_i")).alias("_t"))
    return surplus.join(short, F.col("_m") == F.col("_t")).select("shard", "source", "target")


def migrating_shards(shards: DataFrame) -> DataFrame:
    """target, n, shards of what is on its way."""
    return shards.filter("consumer is null").groupBy(F.col("producer").alias("target")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("shard")), lambda s: s.cast("string")), ",").alias("shards"))


def orphans(tables: DataFrame) -> DataFrame:
    """node, table of companions whose main queue isn't on their node. tables: node, table."""
    main = F.regexp_replace("table", "_(dlq|arc)$", "")
    side = tables.filter(F.col("table").rlike("^q_.*_(dlq|arc)$")).withColumn("_main", main)
    mains = tables.select(F.col("node").alias("_n"), F.col("table").alias("_t"))
    return side.join(mains, (F.col("node") == F.col("_n")) & (F.col("_main") == F.col("_t")), "left_anti").select("node", "table")


def majority_shape(columns: DataFrame) -> DataFrame:
    """table, node: a node with the shape that most nodes have; of equally frequent shapes the one of the least node. columns: node, table, column, type."""
    shape = columns.groupBy("table", "node").agg(F.md5(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "column", "type"))), ",")).alias("shape"))
    by_shape = shape.groupBy("table", "shape").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    return by_shape.groupBy("table").agg(F.min_by("node", F.struct(-F.col("n"), "node")).alias("node"))


def shape_differences(columns: DataFrame) -> DataFrame:
    """table, node, column, problem (missing, unexpected, type) against the majority's shape."""
    model = majority_shape(columns).select("table", F.col("node").alias("_model"))
    want = columns.join(model, "table").filter(F.col("node") == F.col("_model")).select("table", "column", F.col("type").alias("_want"))
    nodes = columns.select("table", "node").distinct().join(model, "table").filter(F.col("node") != F.col("_model")).select("table", "node")
    want = nodes.join(want, "table")
    have = columns.join(nodes, ["table", "node"], "left_semi").select("table", "node", "column", F.col("type").alias("_have"))
    both = want.join(have, ["table", "node", "column"], "full_outer")
    problem = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "unexpected").when(F.col("_have") != F.col("_want"), "type")
    return both.select("table", "node", "column", problem.alias("problem")).filter("problem is not null")
