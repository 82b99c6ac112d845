"""Joins of tables whose size is underestimated: the driver must not hold them."""

import pytest

from graphtide import runtime
from graphtide.operators import frontends as fe
from graphtide.plans import catalog, graph_queries, match_queries, source_queries, update_queries  # noqa: F401  the modules register their queries
from graphtide.runtime import LONG_ROWS, measured

SF = "/root/testdata/sf0.001"


def _static_broadcasts(df) -> int:
    """Broadcasts that the plan has before anything is measured."""
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


@pytest.mark.parametrize("name", ["edge_changes", "edge_matches", "changed_tree_ranges", "changed_ranges_met"])
def test_trees_are_not_broadcast_by_estimate(spark, name):
    assert _static_broadcasts(catalog.QUERIES[name](spark, SF)) == 0


def test_measured_session_follows_the_caller(spark):
    own = measured(spark)
    assert own is measured(spark) and own is measured(own) and own is not spark
    assert own.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1" != spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert measured(spark).conf.get("spark.sql.shuffle.partitions") == "7"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_parser_holds_the_rows_of_few_files():
    held = []

    def files():
        for k in range(200):
            held.append(k)
            yield [(str(k), i, None if i == 0 else 0) for i in range(fe.ROWS_HELD // 10)]

    first = next(frames := fe.framed(files(), ["graph_id", "node_id", "parent_id"]))
    assert len(held) == 10 and len(first) == fe.ROWS_HELD
    assert len(first) + sum(len(f) for f in frames) == 20 * fe.ROWS_HELD


@pytest.mark.parametrize("name", ["source_data_dependence", "source_function_returns", "source_dot", "node_repairing", "surgical_operations"])
def test_parsed_nodes_are_not_broadcast_by_estimate(spark, name):
    assert _static_broadcasts(catalog.QUERIES[name](spark, SF)) == 0


@pytest.mark.parametrize("name", ["child_alignment", "sexp_round_trip"])
def test_small_groups_share_batches(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan


@pytest.mark.parametrize("name", ["canonical_ids", "only_in_one", "range_within", "dyadic_cover", "subtree_removal_edges"])
def test_the_tree_is_dealt_by_graph_once(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Bucketed: true" in plan


def test_parts_follow_the_input(spark, tmp_path):
    for k, size in enumerate((0, 10 * runtime.PART_BYTES, 20 * runtime.PART_BYTES)):
        with (tmp_path / str(k)).open("wb") as f:
            f.truncate(size)
    few, more, most = (runtime.parts_of(spark, [str(tmp_path / str(k))]) for k in range(3))
    assert (few, more, most) == (spark.sparkContext.defaultParallelism, 10, 20)


@pytest.mark.parametrize("name", ["structural_path", "changed_tree_ranges"])
def test_paths_and_their_sweep_stay_where_the_tree_is(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_pairs_of_nodes_neither_move_nor_are_sorted(spark):
    plan = catalog.QUERIES["node_matches"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "partial_max(struct(score, score#" in plan and plan.count("HashAggregate") == 4


def test_buckets_of_the_store_follow_the_input(spark, monkeypatch):
    monkeypatch.setattr(update_queries, "_STORED", {})
    monkeypatch.setattr(update_queries, "tree_parts", lambda *_: 5)
    store = update_queries._store(spark, SF)
    assert store.buckets == 10 == 2 * 5 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    store.drop()


def test_long_texts_are_written_by_few_rows(spark, tmp_path):
    """Megabytes in a row: whoever writes or reads the result holds few of them at a time; the nodes that they are made from stay as they are."""
    import glob

    import pyarrow.parquet as pq

    found = catalog.QUERIES["source_sexp"](spark, SF)
    own = found.sparkSession
    assert own is measured(spark, LONG_ROWS) and own is not measured(spark) and own.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "4"
    assert measured(spark).conf.get("parquet.block.row.count.limit", None) is None
    found.crossJoin(own.range(40)).coalesce(1).write.parquet(str(tmp_path / "out"))
    meta = pq.ParquetFile(glob.glob(f"{tmp_path}/out/*.parquet")[0]).metadata
    assert meta.num_rows > 100 and max(meta.row_group(k).num_rows for k in range(meta.num_row_groups)) <= 16


def test_versions_of_parsed_nodes_are_merged_where_they_lie(spark):
    """Nodes of both versions move neither for their paths nor to meet; only the counts by graph are dealt."""
    plan = catalog.QUERIES["surgical_operations"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1


def test_paths_by_one_window_are_those_by_levels(spark):
    from graphtide.operators.tree import child_paths

    deep = "int f(int a) {\n" + "  if (a > 1) { " * 9 + "a = 2;" + " }" * 9 + "\n  return a;\n}\nint t;\n"
    nodes = fe.build(spark.createDataFrame([("a", deep), ("b", ""), ("c", "int x;\n" * 12)], "graph_id string, text string")).cache()
    one, other = ({(r["graph_id"], r["node_id"]): r["path"] for r in child_paths(nodes, most).collect()} for most in (64, 0))
    assert one == other and len(one) == nodes.count()
