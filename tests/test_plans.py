"""Plan-shape guards: no bar-level window partitioned by the instrument alone; scans prune."""

import re

from candlewick.operators import features as FE
from candlewick.operators import signals as SG
from candlewick.operators.series import number_bars
from candlewick.session import cut_lineage
from candlewick.sources.bars import lineitem_bars
from conftest import SF_SMALL

# windows over per-chunk / per-block summary tables may partition by the key alone
SMALL_TABLE_ORDER = ("_chunk", "_sb", "_g")


def _windows(plan: str):
    for m in re.finditer(r"windowspecdefinition\(([^)]*?)(?:,\s*specifiedwindowframe|\))", plan):
        yield [p.strip() for p in m.group(1).split(",")]


def test_feature_pipeline_windows_are_blocked(spark):
    df = FE.build_features(number_bars(lineitem_bars(spark, SF_SMALL)), "v11")
    plan = df._jdf.queryExecution().executedPlan().toString()
    seen = 0
    for parts in _windows(plan):
        clean = [re.sub(r"#\d+L?", "", p) for p in parts]
        keys = [c for c in clean if " ASC" not in c and " DESC" not in c]
        order = [c.split(" ")[0] for c in clean if " ASC" in c or " DESC" in c]
        seen += 1
        if any(o in SMALL_TABLE_ORDER for o in order):
            continue
        assert set(keys) - {"symbol", "tf"}, f"window partitioned by the instrument alone: {parts}"
    assert seen > 5


def _executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_ticks_are_read_once_and_features_shuffle_little(spark):
    bars = lineitem_bars(spark, SF_SMALL)
    assert _executed(bars).count("FileScan parquet") == 1
    written = cut_lineage(number_bars(bars), "bars")
    for df in (FE.build_features(written, "v11"), SG.strategy_signals(written)):
        plan = _executed(df)
        assert "lineitem.parquet" not in plan
        assert len(re.findall(r"[^d]Exchange hashpartitioning", plan)) <= 10
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_building_features_runs_no_job(spark):
    written = cut_lineage(number_bars(lineitem_bars(spark, SF_SMALL)), "bars")
    tracker, group = spark.sparkContext.statusTracker(), "features-lazy"
    spark.sparkContext.setJobGroup(group, group)
    FE.build_features(written, "v11")
    assert not tracker.getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("", "")


def test_bar_scan_prunes_columns(spark):
    plan = lineitem_bars(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.split("\n") if "FileScan parquet" in line][0]
    assert "l_comment" not in scan and "l_suppkey" not in scan and "l_tax" not in scan
    assert "ReadSchema" in scan
