from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.functions import ids, names, values
from tidemill.operators import cluster, conditions as c, consume, inspect, mutate, produce, states
from tidemill.plans.spec import MAX_INT, Companion, MetaField, QueueSpec, Role, Unique, evolved, is_queue_table, missing_columns, resolve
from tidemill.sources.tables import QueueStore

NOW = datetime(2024, 5, 1, 12)
SPEC = QueueSpec("jobs", fields=(MetaField("jobKey", "long", Unique.ALL_LIVE), MetaField("note", "string")), attempts=3, dlq=Companion(), archive=Companion())


def messages(spark, rows):
    return spark.createDataFrame(rows, "ord long, meta_job_key long, meta_note string, data string")


def empty(spark, spec=SPEC):
    return spark.createDataFrame([], spec.schema)


def sent(spark, n, now=NOW, **options):
    return produce.send(empty(spark), SPEC, messages(spark, [(i + 1, i, None, f"d{i}") for i in range(n)]), produce.SendOptions(**options), now)[0]


def test_spec_checks():
    for bad in ("", "q_x", "a" * 58, "x-y", "x_dlq", "x_arc"):
        with pytest.raises(ValueError):
            QueueSpec(bad)
    with pytest.raises(ValueError):
        QueueSpec("x", fields=(MetaField("aB", "int"), MetaField("a_b", "int")))
    with pytest.raises(ValueError):
        Companion(timedelta(minutes=1))
    with pytest.raises(ValueError):
        produce.SendOptions(producer="a;b")
    with pytest.raises(ValueError):
        SPEC.dlq_spec().dlq_spec()
    assert [q.name for q in SPEC.queues()] == ["jobs", "jobs_dlq", "jobs_arc"] and SPEC.dlq_spec().role is Role.DLQ and SPEC.dlq_spec().attempts == MAX_INT
    assert all(f.unique is Unique.NONE for f in SPEC.archive_spec().fields) and names.snake_case("someBigName") == "some_big_name"
    assert resolve(None, 0, 5) == 0 and resolve(None, default=7) == 7


def test_schema_grows(spark):
    old = spark.createDataFrame([], QueueSpec("jobs").schema)
    assert [f.name for f in missing_columns(SPEC, old.schema)] == ["meta_job_key", "meta_note"]
    assert is_queue_table(evolved(old, SPEC).schema) and not is_queue_table(spark.range(1).schema)


def test_states_cover_all_but_the_gap(spark):
    rows = [(i, s, p, a) for i, (s, p, a) in enumerate((s, p, a) for s in (-1, 0, 1) for p in (None, -5) for a in (0, 1))]
    times = [(i, NOW + timedelta(hours=s), None if p is None else NOW + timedelta(hours=p), a) for i, s, p, a in rows]
    df = spark.createDataFrame(times, "id long, scheduled_at timestamp_ntz, processing_at timestamp_ntz, remaining_attempts int")
    got = {r.id: (r.s, r.n) for r in df.select("id", states.state(NOW).alias("s"), sum((p.cast("int") for p in states.predicates(NOW).values()), F.lit(0)).alias("n")).collect()}
    for i, s, p, a in rows:
        gap = s > 0 and p is None and a <= 0
        assert got[i][1] == (0 if gap else 1) and (got[i][0] is None) == gap


def test_partial_inserts(spark):
    """15 messages in batches of 5, the eighth fails: 0, 5 or 10 are stored."""
    m = messages(spark, [(i, i, None, "x") for i in range(1, 16)])
    for mode, stored, failed, untried in ((produce.PROHIBITED, 0, 15, 0), (produce.UNTIL_FIRST_FAILURE, 5, 5, 5), (produce.AS_MANY, 10, 5, 0)):
        queue, results = produce.send(empty(spark), SPEC, m, produce.SendOptions(batch_size=5, partial=mode), NOW, bad=F.col("ord") == 8)
        n = {r.outcome: r["count"] for r in results.groupBy("outcome").count().collect()}
        assert (n.get("stored", 0), n.get("failed", 0), n.get("not_tried", 0)) == (stored, failed, untried) and queue.count() == stored
        if mode == produce.AS_MANY:
            assert queue.agg(F.max("id")).first()[0] == 14  # the failed batch used up its ids


def test_long_text_fails_its_batch(spark):
    m = messages(spark, [(1, 1, "x" * 8193, "a"), (2, 2, "ok", "b")])
    assert produce.send(empty(spark), SPEC, m, produce.SendOptions(batch_size=1, partial=produce.AS_MANY), NOW)[0].count() == 1


def test_duplicates(spark):
    queue = sent(spark, 1)
    m = messages(spark, [(i + 1, i % 5 if i < 10 else None, None, "x") for i in range(12)])
    after, results = produce.send(queue, SPEC, m, produce.SendOptions(dedup=produce.IGNORE), NOW)
    out = {r.ord: r.outcome for r in results.collect()}
    assert [o for o, x in sorted(out.items()) if x == "stored"] == [2, 3, 4, 5, 11, 12] and after.count() == 7
    assert [r.uc for r in after.filter("uc is not null").orderBy("id").collect()] == [1, 2, 3, 4, 10, 11]
    failed = produce.send(queue, SPEC, m, produce.SendOptions(), NOW)[1]
    assert {r.outcome for r in failed.collect()} == {"failed"}
    # a key is free again once its holder is out of attempts
    free = queue.withColumn("remaining_attempts", F.lit(0))
    assert produce.send(free, SPEC, messages(spark, [(1, 0, None, "x")]), produce.SendOptions(), NOW)[0].count() == 2


def test_failed_batches_hold_no_keys(spark):
    out = lambda rows, **o: [r.outcome for r in produce.send(empty(spark), SPEC, messages(spark, [(i + 1, k, None, "x") for i, k in enumerate(rows)]), produce.SendOptions(batch_size=2, partial=produce.AS_MANY, **o), NOW, bad=F.col("ord") == 1)[1].orderBy("ord").collect()]
    # batch 1 is bad; 2 repeats its key and is stored; 3 clashes with 2, 4 only with 3, 5 with 4, 6 with itself, 7 only with 6
    keys = [1, 2, 1, 3, 3, 4, 4, 5, 5, 6, 7, 7, 7, 8]
    assert out(keys)[::2] == out(keys)[1::2] == ["failed", "stored", "failed", "stored", "failed", "failed", "stored"]
    assert out([1, 2, 1, 3, 2, 3], dedup=produce.IGNORE) == ["failed", "failed", "stored", "stored", "stored", "duplicate"]


def greedy(rows, held=None):
    """Which rows of values, one for each unique field, find one held when they are stored in turn: only stored rows hold values."""
    held, out = [set() for _ in rows[0]] if held is None else held, []
    for row in rows:
        clash = any(v is not None and v in h for v, h in zip(row, held, strict=True))
        out.append(clash)
        if not clash:
            for v, h in zip(row, held, strict=True):
                h.add(v)
    return out


def test_send_over_several_fields(spark):
    spec = QueueSpec("pairs", fields=(MetaField("a", "long", Unique.ALL_LIVE), MetaField("b", "long", Unique.ALL_LIVE)))
    rows = [(1, 1, 1), (2, 1, 2), (3, 3, 2), (4, None, None), (5, 3, 4), (6, 5, 4)]
    m = spark.createDataFrame([(*r, "x") for r in rows], "ord long, meta_a long, meta_b long, data string")
    want = greedy([(a, b) for _, a, b in rows])
    got = produce.send(empty(spark, spec), spec, m, produce.SendOptions(dedup=produce.IGNORE), NOW)[1].orderBy("ord").collect()
    assert [r.outcome == "duplicate" for r in got] == want == [False, True, False, False, True, False]


def test_send_says_why(spark):
    m = messages(spark, [(1, 1, None, "x"), (2, 2, "y" * 9000, "x"), (3, 1, None, "x"), (4, 4, None, "x"), (5, 5, None, "x"), (6, 6, None, "x")])
    _, results = produce.send(empty(spark), SPEC, m, produce.SendOptions(batch_size=1, partial=produce.AS_MANY), NOW, bad=F.col("ord") == 5)
    assert {r.ord: r.error for r in results.collect()} == {1: None, 2: "text too long", 3: "duplicate key", 4: None, 5: "insert failed", 6: None}
    assert sorted(r.ord for r in produce.to_send_again(results, m).collect()) == [2, 3, 5] and produce.only(results, "stored").count() == 3
    with pytest.raises(RuntimeError, match="text too long"):
        produce.raise_if_failed(results)
    produce.raise_if_failed(produce.only(results, "stored"))
    _, all_failed = produce.send(empty(spark), SPEC, m, produce.SendOptions(batch_size=1, partial=produce.PROHIBITED), NOW)
    assert {r.ord: r.error for r in all_failed.collect()}[6] == "another batch failed"


def test_messages_without_keys_or_order(spark):
    m = spark.createDataFrame([(None, f"d{i}") for i in range(40)] + [(7, "a"), (7, "b")], "meta_job_key long, data string")
    m = produce.numbered(m, [F.asc("data")])
    assert sorted(r.ord for r in m.collect()) == list(range(1, 43))
    _, results = produce.send(empty(spark), SPEC, m, produce.SendOptions(dedup=produce.IGNORE), NOW)
    assert results.filter("outcome = 'stored'").count() == 41 and [r.ord for r in results.filter("outcome = 'duplicate'").collect()] == [2]


def test_tables_follow_the_spec(spark):
    from tidemill.plans import tables

    run = lambda statements: tables.execute(spark, statements)
    small = QueueSpec("orders", fields=(MetaField("a", "int"),), dlq=Companion())
    large = QueueSpec("orders", fields=(MetaField("a", "int"), MetaField("b", "string")), dlq=Companion(), archive=Companion())
    spark.sql("create table q_other (x int) using parquet")
    assert run(tables.to_create(spark, [small])) == 2 and tables.to_create(spark, [small]) == []
    assert run(tables.to_create(spark, [large])) == 3 and tables.to_create(spark, [large]) == []
    assert is_queue_table(spark.table("q_orders_arc").schema) and "meta_b" in spark.table("q_orders_dlq").columns
    assert run(tables.to_rename(spark, [large], lambda q: "bills")) == 3 and tables.to_rename(spark, [large], lambda q: "bills") == []
    assert sorted(t.name for t in spark.catalog.listTables() if t.name.startswith("q_")) == ["q_bills", "q_bills_arc", "q_bills_dlq", "q_other"]
    gone = tables.to_delete(spark, [QueueSpec("bills", dlq=Companion(), archive=Companion()), QueueSpec("other")])
    assert gone[-1].endswith("`q_bills`") and run(gone) == 3  # a table that is no queue stays
    spark.sql("drop table q_other")
    with pytest.raises(ValueError):
        tables.to_delete(spark, [small.dlq_spec()])


def test_steps_are_deleted(spark, tmp_path, monkeypatch):
    import os

    from tidemill.functions import steps

    steps.clean(spark)
    monkeypatch.setattr(steps, "shared_dir", lambda spark: f"file://{tmp_path}")
    with steps.scratch(spark) as last:
        one = steps.step(spark.range(5), "one")
        two = last(steps.step(one.filter("id > 1"), "two"))
    assert [x.split("-")[0] for x in os.listdir(tmp_path)] == ["two"] and two.count() == 3
    assert sorted(r.n for r in steps.in_order(spark.range(50).repartition(5), [F.desc("id")], "n", "order").collect()) == list(range(1, 51))
    steps.clean(spark)
    assert os.listdir(tmp_path) == []


def test_a_cluster_must_name_its_folder(monkeypatch):
    from types import SimpleNamespace as N

    from tidemill.functions import steps

    session = lambda master, at: N(conf=N(get=lambda *a: at), sparkContext=N(master=master, applicationId="x"))
    assert steps.shared_dir(session("spark://host", "hdfs://h/dir/")) == "hdfs://h/dir"
    own = steps.shared_dir(session("local[2]", None))
    assert own.startswith("file:///") and steps.shared_dir(session("local[2]", None)) == own
    with pytest.raises(RuntimeError, match="checkpoint"):
        steps.shared_dir(session("spark://host", None))


def test_background(spark):
    from tidemill.functions.session import in_background

    assert in_background(lambda n: sent(spark, n).count(), 3).result(60) == 3


def test_nodes(spark):
    rows, shards = cluster.bootstrap(spark, {"a": 5, None: 5}, None, NOW, 1)
    made = {r.id: r.identifiers_bucket for r in rows.collect()}
    assert len(made) == 2 and set(made.values()) == {5, 6} and len(next(n for n in made if n != "a")) == 16
    assert shards.count() == 1024 and cluster.bootstrap(spark, {"a": 5}, shards, NOW, 2)[1].count() == 1024
    none = shards.withColumn("consumer", F.lit(None).cast("string"))
    queue = sent(spark, 3).withColumn("node", F.lit("a"))
    after, got = cluster.receive_routed(queue, none, SPEC, NOW + timedelta(seconds=1), 5)
    assert got.count() == 0 and after.count() == 3


def test_claims_are_disjoint_and_come_back(spark):
    queue = sent(spark, 10, now=NOW)
    later = NOW + timedelta(seconds=1)
    one, first = consume.receive(queue, SPEC, later, 4, consumer="w")
    two, second = consume.receive(one, SPEC, later, 4)
    a, b = {r.id for r in first.collect()}, {r.id for r in second.collect()}
    assert a == {0, 1, 2, 3} and b == {4, 5, 6, 7}
    back = {r.id for r in consume.receive(two, SPEC, later + timedelta(seconds=60), 10)[1].collect()}
    assert back == set(range(10))
    counts = inspect.count(two, later).first()
    assert (counts.ready, counts.in_flight, counts.total) == (2, 8, 10)


def test_sweep_to_dlq_and_retention(spark):
    m = messages(spark, [(i, i, None, "x") for i in range(1, 101)]).withColumn("attempts", F.when(F.col("ord") <= 70, 1).otherwise(2))
    queue = produce.send(empty(spark), SPEC, m, produce.SendOptions(), NOW)[0]
    later = NOW + timedelta(seconds=1)
    claimed, _ = consume.receive(queue, SPEC, later, 100, visibility=timedelta(0))
    left, dead = consume.sweep(claimed, later, 1, 10_000)
    assert left.count() == 30 and dead.count() == 70
    dlq = consume.to_dlq(dead, SPEC, later)
    assert {f for f in SPEC.dlq_spec().meta_columns} <= set(dlq.columns)
    old = dlq.withColumn("id", F.col("meta_original_id"))
    assert consume.expired(old, later + timedelta(hours=2), timedelta(hours=1), 10_000).count() == 70
    assert consume.surplus(old, 50, 15).count() == 15 and consume.surplus(old, 100, 15).count() == 0
    dice = spark.range(4000).select(*[consume.sweeps(p, 5).alias(n) for p, n in ((0, "never"), (1, "always"), (0.25, "some"))]).agg(*[F.count_if(n).alias(n) for n in ("never", "always", "some")]).first()
    assert dice.never == 0 and dice.always == 4000 and 850 < dice.some < 1150
    with pytest.raises(ValueError):
        consume.sweeps(1.5)


def test_mutations(spark):
    queue = sent(spark, 100)
    cond = c.any_of(c.less_eq("jobKey", 66), c.eq("jobKey", 98))
    after, changed = mutate.by_condition(queue, [mutate.add_attempts(1), mutate.set_schedule(timedelta(hours=1))], cond, NOW)
    kept = mutate.kept_results(changed, 20).collect()
    assert len(kept) == 20 and kept[0].mutated == 68 and kept[0].truncated and after.filter("remaining_attempts = 4").count() == 68
    with pytest.raises(ValueError):
        mutate.by_condition(queue, [mutate.add_attempts(1), mutate.set_attempts(2)], cond, NOW)
    asked = spark.createDataFrame([(1, 5, 0), (2, 5000, 0), (3, 5, 1)], "ord long, id long, shard int")
    _, results = mutate.by_ids(queue, [mutate.set_attempts(9)], asked, NOW)
    assert [(r.found, r.remaining_attempts) for r in results.orderBy("ord").collect()] == [(True, 9), (False, None), (False, None)]


def test_conditions(spark):
    df = spark.createDataFrame([(1, "it's"), (None, "b_c"), (3, None)], "meta_job_key long, meta_note string")
    n = lambda x: df.filter(x).count()
    assert n(c.native_sql("{0} > 0 and {1} = ''it''''s''", "jobKey", "note")) == 1
    assert n(c.like("note", "b\\_%")) == 1 and n(c.negate(c.eq("jobKey", 1))) == 1 and n(c.isin("jobKey", [])) == 0 and n(c.eq("note", None)) == 0
    assert c.in_shards(list(range(1024))) is None


def test_inspection(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,), (2,), (None,), (None,)], "meta_job_key long")
    assert [(r.value, r.n) for r in inspect.distinct_values(df, "jobKey", 9).collect()] == [(1, 3), (2, 2), (None, 2)]
    dead = sent(spark, 3).withColumn("remaining_attempts", F.lit(0))
    e = inspect.emptiness(dead, NOW + timedelta(days=1)).first()
    assert not e.is_empty and e.is_dead_or_empty
    assert inspect.message_age(empty(spark), NOW).first().oldest is None
    assert [inspect.sample_percent(p * 8192) for p in (0, 99, 200, 50_000, 10**8)] == [100.0, 100.0, 50.0, 1.0, 0.001]


def test_ids_and_values(spark):
    spans = [ids.id_range(b) for b in range(1024)]
    assert all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[-1][1] == (1 << 63) - 1
    r = spark.range(1).select(ids.shard_of(F.lit(-10000)).alias("a"), ids.shard_of(F.lit(-2147483648)).alias("b"), values.flat_map(F.array(F.lit("k"), F.lit("v"))).alias("m"), values.flat_map(F.expr("cast(array() as array<string>)")).alias("e")).first()
    assert (r.a, r.b, r.m, r.e) == (784, 0, {"k": "v"}, {})
    with pytest.raises(Exception, match="odd"):
        spark.range(1).select(values.flat_map(F.array(F.lit("k")))).collect()


def balanced(spark, per_node):
    rows, s = [], 0
    for node, n in per_node.items():
        for _ in range(n):
            rows.append((s, node, node, None))
            s += 1
    return spark.createDataFrame(rows, "shard int, producer string, consumer string, next string")


@pytest.mark.parametrize(("layout", "moves"), [({"a": 1024, "b": 0, "c": 0, "d": 0}, 768), ({"a": 1024, "b": 0, "c": 0}, 682), ({"a": 342, "b": 341, "c": 341}, 0)])
def test_shard_balance(spark, layout, moves):
    nodes = spark.createDataFrame([(n,) for n in layout], "node string")
    got = cluster.balance_moves(balanced(spark, layout), nodes).collect()
    assert len(got) == moves
    after = dict(layout)
    for m in got:
        after[m.source] -= 1
        after[m.target] += 1
    assert max(after.values()) - min(after.values()) <= 1


def test_migration_keeps_what_clashes(spark):
    shards = balanced(spark, {"a": 4, "b": 4})
    during = cluster.prepare_migration(shards, [1, 2], "b")
    assert cluster.broken_shards(during).count() == 0 and cluster.changed_shards(shards, during).count() == 2
    assert cluster.broken_shards(cluster.finalize_migration(during)).count() == 0
    s = spark.createDataFrame([(1, 1, 10), (2, 2, 20), (3, 3, 30), (4, 1, 40)], "id long, shard int, k long")
    t = spark.createDataFrame([(1, 5, 99), (9, 5, 20)], "id long, shard int, k long")
    source, target, stay = cluster.move_rows(s, t, [1, 2], ["k"])
    assert {r.id for r in stay.collect()} == {1, 2} and {r.id for r in source.collect()} == {1, 2, 3} and target.count() == 3
    assert cluster.distinct_buckets({"a": 5, "b": 5, "c": 6}) == {"a": 5, "b": 6, "c": 7}


def test_store_lets_one_writer_win(spark, tmp_path):
    store = QueueStore(spark, f"file://{tmp_path}/store")
    assert store.version() == 0 and store.load("jobs") is None
    assert store.commit(0, {"jobs": sent(spark, 5)}, {"jobs": 5})
    assert not store.commit(0, {"jobs": sent(spark, 3)})
    taken = []

    def claim(s, version):
        if not taken:  # another writer comes in between
            taken.append(1)
            other, _ = consume.receive(s.load("jobs"), SPEC, NOW + timedelta(seconds=1), 2)
            assert s.commit(version, {"jobs": other})
        after, got = consume.receive(s.load("jobs"), SPEC, NOW + timedelta(seconds=1), 2)
        return {"jobs": after}, {}, [r.id for r in got.collect()]

    assert store.update(claim) == [2, 3] and store.version() == 3 and store.counter("jobs") == 5
    assert store.commit(3, {"jobs": None}) and store.load("jobs") is None and store.load("jobs", 1).count() == 5


def test_streams(spark, tmp_path):
    from tidemill.streaming import leases

    t = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [(1, "send", t(0)), (1, "claim", t(1)), (1, "claim", t(2)), (1, "claim", t(70)), (1, "claim", t(120)), (1, "ack", t(121)), (2, "claim", t(5))]
    rows += [(3, "send", t(0)), (3, "claim", t(30)), (4, "send", t(0)), (4, "claim", t(1)), (4, "claim", t(65)), (5, "send", t(300))]  # 3 and 4 are never acknowledged
    path = str(tmp_path / "events")
    spark.createDataFrame(rows, "id long, kind string, at timestamp").write.parquet(path)
    stream = lambda: spark.readStream.schema("id long, kind string, at timestamp").parquet(path)

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    got = sorted((r.id, r.at, r.outcome) for r in run(leases.leases(stream(), timedelta(seconds=60), 2), "leases"))
    assert [o for i, _, o in got if i == 1] == ["sent", "claimed", "refused", "expired", "claimed", "refused", "acked"] and [o for i, _, o in got if i == 2] == ["unknown"]
    # their leases run out on the timer, without an event of their own
    assert [o for i, _, o in got if i == 3] == ["sent", "claimed", "expired"] and [o for i, _, o in got if i == 4] == ["sent", "claimed", "expired", "claimed", "dead"]
    assert [x for i, x, _ in got if i == 3][-1] == t(90)
    assert len(run(leases.unique_within(stream(), "id", "at", timedelta(minutes=10)), "uniq")) == 5
