"""What larger tables showed: ties and what queries hold, send and write."""

from pyspark.sql import functions as F

from graphloom.operators import catalog as K


def test_merged_edges_of_one_seq_are_the_smallest_id_in_any_order(spark):
    rows = [(1, "b", "f", "Uses", "Exact"), (1, "a", "f", "Uses", "Heuristic"), (2, "0", "f", "Uses", "Semantic")]
    for given in (rows, rows[::-1]):
        edges = spark.createDataFrame(given, "seq long, id string, source string, type string, confidence string").coalesce(1)
        assert [tuple(r) for r in K.merge_edges(edges, ["source", "type"]).collect()] == [("f", "Uses", "a", "Exact", 3)]


def test_tasks_of_a_graph_stay_small_whatever_its_size(spark, tmp_path):
    from graphloom.functions import session

    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.range(200_000).selectExpr("id", "uuid() AS x").write.parquet(f"{tmp_path}/large")
    large, kept = spark.read.parquet(f"{tmp_path}/large"), session.TASK_BYTES
    try:
        session.TASK_BYTES = 1 << 19
        session.task_sizes(spark, [large])
        assert int(spark.conf.get(initial)) > 8 and large.rdd.getNumPartitions() > 8
        session.TASK_BYTES = kept
        session.task_sizes(spark, [large])
        assert spark.conf.get(initial, None) is None
    finally:
        session.TASK_BYTES = kept


def test_containment_meets_no_changed_ids_and_relations_leave_at_once(spark):
    from graphloom.operators import views as V

    nodes = spark.createDataFrame([("a", "File", "x"), ("b", "Function", "x"), ("c", "Function", "y"), ("d", "Function", None)], "id string, type string, file string")
    rows = [("1", "a", "b", "Contains", "Exact"), ("2", "b", "c", "Calls", "Exact"), ("3", "c", "a", "Uses", "Exact"), ("4", "c", "d", "Calls", None), ("5", "c", "d", "ApiCall", "Heuristic"), ("6", "d", None, "Uses", "Exact"), ("7", "c", "d", "ApiCall", None)]
    edges = spark.createDataFrame(rows, "id string, source string, target string, type string, confidence string")
    changed = spark.createDataFrame([("x",)], "file string")
    left = V.without_relations(nodes, edges, changed, True)
    assert {r["id"] for r in left.collect()} == {"1", "4", "6"}
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftOuter" not in plan


def test_steps_of_a_large_graph_move_once_for_all_hops(spark):
    from graphloom.functions import session
    from graphloom.operators import traverse as T

    steps = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(6)] + [("n0", "n1"), ("n6", "n0")], "a string, b string")
    start = spark.createDataFrame([("n2",)], "id string")
    join, want = "spark.sql.autoBroadcastJoinThreshold", {(f"n{k}", (k - 2) % 7) for k in range(7)}
    kept = spark.conf.get(join)
    assert {tuple(r) for r in T.spread(steps, start).collect()} == want
    try:
        spark.conf.set(join, "-1")
        spark.conf.set(session.INITIAL, "12")
        met = start.select(F.col("id").alias("a")).join(session.bucketed(steps, "a"), "a")
        assert met._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1 and met.count() == 1
        assert {tuple(r) for r in T.spread(steps, start).collect()} == want
        assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]
    finally:
        spark.conf.set(join, kept)
        spark.conf.unset(session.INITIAL)


def test_hierarchy_reads_its_nodes_once(spark):
    from graphloom.operators import traverse as T

    read = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    kind = "id string, seq long, type string, file string, visibility string, signature string, connections long"
    nodes = spark.createDataFrame([("m", 1, "Module", None, None, None, 0), ("f", 2, "File", "x", None, None, 1), ("s", 3, "Function", "x", "pub", None, 1)], kind).mapInArrow(told, kind)
    edges = spark.createDataFrame([("m", "f", "Contains"), ("f", "s", "Contains"), ("s", "f", "Calls")], "source string, target string, type string")
    assert {tuple(r) for r in T.hierarchy(nodes, edges, 2).collect()} == {("m", "Module", 0), ("f", "File", 1)}
    assert read.value == 3


def test_stored_tables_are_as_large_as_their_rows(spark):
    """Files of repeated text are small; by their size such a table was sent whole to the driver."""
    from graphloom.functions import session

    rows = spark.range(400_000).selectExpr("id % 7 AS k", "repeat('x', 90) AS `a.b`", "CAST(NULL AS STRING) AS n")
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    large, none = session.stored(rows), session.stored(rows.where("false"))
    assert large.columns == none.columns == rows.columns and none.count() == 0
    assert large.count() == 400_000 and size(large) > 20_000_000
    plan = spark.range(10_000_000).selectExpr("id AS k").join(large, "k")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not [t for t in spark.catalog.listTables() if t.name.startswith("stored_")]
    assert "Broadcast" in spark.range(10_000_000).selectExpr("id AS k").join(session.stored(rows.limit(9)), "k")._jdf.queryExecution().executedPlan().toString()


def test_relations_do_not_send_a_large_table_of_symbols_everywhere(spark):
    from graphloom.functions import session
    from graphloom.operators import relations as L

    made = spark.range(600_000).selectExpr("concat('src/some_folder/file_', id DIV 100, '.rs') AS path", "concat('fn_', id % 500) AS name", "'Function' AS type", "CAST(id % 100 AS INT) AS line_no")
    symbols = session.stored(made)
    mentioned = session.stored(made.selectExpr("path", "concat(path, '::', name, '@', line_no) AS source", "'call' AS rule", "name", "CAST(NULL AS STRING) AS receiver", "CAST(NULL AS STRING) AS qualified"))
    calls = L.keyed(mentioned, L.symbol_nodes(symbols)).where("type = 'Calls'")
    plan = calls._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
