"""Plan shapes that the scale of the data depends on."""

import re

import pytest

from skyledger.operators import dashboards as d
from skyledger.operators import normalize as n
from skyledger.plans import QUERIES
from skyledger.plans.adapters import table, view


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_and_filters_reach_the_scan(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    plan = physical(d.kpi_count(events, events.event_type == "error"))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan
    assert re.search(r"ReadSchema: struct<event_type:string>", plan)


def test_normalisation_has_no_shuffle(spark, sf_dir):
    from skyledger.plans.normalize_queries import raw

    plan = physical(n.normalise(raw(spark, sf_dir)))
    assert "Exchange" not in plan and plan.count("FileScan") == 1


def test_top_list_is_a_distributed_top_k(spark, sf_dir):
    assert "TakeOrderedAndProject" in physical(d.top_n_by(view(spark, sf_dir, "logs"), ["src_ip"], 10))


def test_all_rules_share_one_scan(spark, sf_dir):
    plan = physical(QUERIES["d00_all_rules_one_pass"](spark, sf_dir))
    assert plan.count("FileScan") == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join(spark, sf_dir, name):
    if name.startswith(("r", "s", "a14")):
        pytest.skip("reads back what it wrote")
    plan = physical(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["n36_native_metrics"])
def test_inputs_are_read_once(spark, sf_dir, name):
    found = [n for n in QUERIES if n.startswith(name[:4])]
    assert found and all(physical(QUERIES[n](spark, sf_dir)).count("FileScan") == 1 for n in found)


def test_keyword_search_reads_the_texts_once(spark, sf_dir, monkeypatch):
    """The plan before its lineage is cut has the only scan, and nothing after it has one."""
    from skyledger.operators import knowledge

    cut, plans = knowledge.cut_lineage, []
    monkeypatch.setattr(knowledge, "cut_lineage", lambda df: plans.append(physical(df)) or cut(df))
    after = physical(QUERIES["k06_keyword_search"](spark, sf_dir))
    assert [p.count("FileScan") for p in plans] == [1] and "Exchange" not in plans[0] and "FileScan" not in after


def streamed(df, folder):
    """The physical plan of the last batch of a stream that has run to its end."""
    from skyledger.streaming import jobs

    query = jobs.run_available(df, str(folder / "out"), str(folder / "cp"))
    return query._jsq.streamingQuery().lastExecution().executedPlan().toString()


def test_stream_plans(spark, sf_dir, tmp_path):
    """One state operator answers alerts, panes are merged by a second aggregate, and de-duplication shuffles once."""
    from skyledger.operators.detections import RULE_BY_ID
    from skyledger.plans.streaming_queries import rule_stream, stream_of
    from skyledger.streaming import jobs, state

    plan = streamed(state.alerts_with_latest_event(stream_of(spark, sf_dir, "alerts"), stream_of(spark, sf_dir, "logs")), tmp_path / "a")
    assert plan.count("TransformWithState") == 1 and "SymmetricHashJoin" not in plan
    plan = streamed(jobs.detect_stream(rule_stream(spark, sf_dir), RULE_BY_ID["D01"], window="1 day", slide="8 hours"), tmp_path / "b")
    assert plan.count("StateStoreSave") == 2 and plan.index("Expand") < plan.rindex("StateStoreSave")
    plan = streamed(jobs.deduplicated(stream_of(spark, sf_dir, "logs").select("id", "ts")), tmp_path / "c")
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "StreamingDeduplicateWithinWatermark" in plan


def test_routed_writes_spread_busy_streams(spark, sf_dir, monkeypatch):
    """Rows are clustered by a rebalance that adaptive execution may split, and sized units never sort by their texts."""
    from skyledger.sources import sinks

    plans = []
    writer = type(spark.range(1).write)
    monkeypatch.setattr(writer, "parquet", lambda self, path, *a, **k: plans.append(self._df._jdf.queryExecution().executedPlan().toString()))
    monkeypatch.setattr(writer, "text", lambda self, path, *a, **k: plans.append(self._df._jdf.queryExecution().executedPlan().toString()))
    rows = view(spark, sf_dir, "logs").selectExpr("id", "ts", "'logs-aws.x-default' AS target")
    sinks.write_by_stream(rows, "nowhere")
    assert "REBALANCE_PARTITIONS_BY_COL" in plans[-1] and "Sort " not in plans[-1]
    sinks.size_capped_write(table(spark, sf_dir, "documents").select("doc_id", "text"), "nowhere", "doc_id")
    assert plans[-1].count("FileScan") == 2 and "Sort [value" not in plans[-1] and len(re.findall(r"Exchange hashpartitioning", plans[-1])) == 1


def test_scratch_tables_have_an_owner(spark):
    from skyledger.session import scratch_path

    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0] and spark.sparkContext.applicationId in first
