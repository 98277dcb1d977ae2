"""Plan assertions: the physical plans are the ones intended."""

from conftest import SF01
from lendflow.operators import ledger, privacy
from lendflow.plans import queries as Q
from lendflow.sources import derived as D


def explain(df) -> str:
    """Static (non-adaptive) formatted plan, so codegen stages and join choices are visible."""
    import contextlib
    import io
    spark = df.sparkSession
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        return buf.getvalue()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_core_metrics_stay_in_jvm(spark):
    p = explain(Q.app_metrics(spark, SF01))
    assert "Python" not in p and "ArrowEval" not in p
    assert "* Project" in p  # whole-stage codegen marker in formatted plans


def test_scan_prunes_columns(spark):
    p = explain(Q.dashboard_scan(spark, SF01))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in p


def test_point_lookup_pushes_filter_and_take_ordered(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger.append(D.ledger(spark, SF01), path, 1)
    p = explain(ledger.point(ledger.read_ledger(spark, path), "APP-42"))
    assert "TakeOrderedAndProject" in p
    assert "PushedFilters: [IsNotNull(application_id), EqualTo(application_id,APP-42)]" in p


def test_latest_uses_window_group_limit(spark):
    p = explain(ledger.latest(D.ledger(spark, SF01)))
    assert "WindowGroupLimit" in p


def final_plan(df) -> str:
    """The adaptive plan's final part, after the query has run."""
    import contextlib
    import io
    df.collect()
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    text = buf.getvalue()
    assert "isFinalPlan=true" in text
    return text.split("== Initial Plan ==")[0]


def test_directory_join_becomes_broadcast_at_runtime(spark):
    # Statically the directory (a join itself) is estimated large and planned as a sort-merge
    # join; AQE measures both sides and broadcasts the small one.  No hint is involved.
    def build():
        return privacy.reidentify(ledger.latest(D.ledger(spark, SF01)), D.directory(spark, SF01))
    assert "SortMergeJoin" in explain(build())
    fin = final_plan(build())
    assert "SortMergeJoin" not in fin and "BroadcastHashJoin" in fin


def test_stress_grid_is_one_pass_without_join(spark):
    p = explain(Q.stress_grid(spark, SF01))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_latest_agg_is_partial_aggregate(spark):
    p = explain(ledger.latest_agg(D.ledger(spark, SF01)))
    assert "partial_max_by" in p


def test_console_queries_read_narrow_and_once(spark):
    for q in (Q.dashboard_counts, Q.hidden_decisions, Q.REGISTRY["queue_pending"]):
        p = explain(q(spark, SF01))
        assert "props" not in p and "value" not in p.split("ReadSchema", 1)[1].split("\n", 1)[0]
        assert p.count("ReadSchema") == 1 and "WindowGroupLimit" in p
