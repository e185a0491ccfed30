"""What the physical plans must and must not contain."""

import re

import pytest

import __spark_entry__ as contract
from commlens.operators import anomaly, cleaning, features, quality, reports, scoring, splitting
from commlens.sources.feeds import communications, raw_feed
from commlens.sources.tables import write_table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def stored(spark, cases):
    write_table(cases, "stored_cases", partition_by="sent_date")
    return spark.table("stored_cases")


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_no_python_and_no_cross_joins(spark, small, name):
    text = plan(contract.queries()[name](spark, small))
    for word in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text


def test_single_partitions_see_only_aggregates(spark, stored):
    """Every exchange to one partition is fed by an aggregate, never by base rows; windows only for days, classes."""
    for df, windowed in (
        (anomaly.campaign_scorecard(stored), False),
        (anomaly.segment_weeks(stored), False),
        (anomaly.complaint_days(stored), True),
        (splitting.class_weights(stored), True),
    ):
        text = plan(df)
        assert "SinglePartition" in text and ("Window" in text) == windowed
        for below in text.split("Exchange SinglePartition")[1:]:
            operators = [o for o in re.findall(r"[+:]- (?:\*\(\d+\) )?(\w+)", below)]
            operators = [o for o in operators if o not in ("Project", "Filter")]
            assert operators[0] in ("HashAggregate", "ObjectHashAggregate"), below[:400]


def test_one_last_day_subquery_runs(spark, stored):
    text = final_plan(anomaly.segment_weeks(stored))
    assert len(re.findall(r"[^d]Subquery subquery", text.replace("ReusedSubquery Subquery", ""))) <= 2


def test_columns_are_pruned(stored):
    text = plan(reports.segment_rate(stored))
    assert re.search(r"ReadSchema: struct<segment:string,needs_intervention:int>", text)
    text = plan(anomaly.campaign_scorecard(stored))
    assert "tenure_months" not in text and "channel" not in text


def test_filters_are_pushed(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(reports.filter_cases(stored, ["Basic"], ["SMS"], 1))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(needs_intervention,1)" in pushed and "segment" in pushed and "channel" in pushed


def test_weekly_drop_reads_fourteen_days(stored):
    df = anomaly.segment_weeks(stored)
    assert "PartitionFilters: [isnotnull(sent_date" in plan(df)
    df.collect()
    read = []

    def visit(node):
        if "FileScan" in node.nodeName() or node.nodeName().startswith("Scan parquet"):
            read.append(node.metrics().apply("numPartitions").value())
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i))
        if "QueryStage" in node.nodeName():
            visit(node.plan())
        if node.nodeName() == "AdaptiveSparkPlan":
            visit(node.executedPlan())

    visit(df._jdf.queryExecution().executedPlan())
    assert 14 in read and stored.select("sent_date").distinct().count() == 30


def test_all_detectors_read_the_table_once(spark, small):
    text = final_plan(anomaly.detector_status(communications(spark, small)))
    # the rollup is a checkpoint: the table was read once to write it
    assert text.count("events.parquet") == 0


def test_quality_report_is_one_scan(spark, small):
    assert final_plan(quality.report(raw_feed(spark, small))).count("events.parquet") == 1


def test_duplicates_are_limited_before_the_shuffle(stored):
    text = plan(cleaning.keep_first(stored))
    assert text.count("WindowGroupLimit") == 2
    before_shuffle = text.split("Exchange hashpartitioning(customer_id")[1]
    assert "WindowGroupLimit" in before_shuffle


def test_split_does_not_move_the_rows(stored):
    text = plan(splitting.stratified_split(stored))
    # every hash exchange below the final join carries a hash or a histogram, not the table's columns
    for exchange in text.split("Exchange hashpartitioning")[1:]:
        assert "tenure_months" not in exchange.split("Exchange")[0]


def test_features_and_scores_need_no_shuffle(stored, forest):
    assert "Exchange" not in plan(features.build_features(stored, features.DECLARED_LEVELS))
    assert "Exchange" not in plan(scoring.score_batch(stored, forest))


def test_forest_runs_once_per_row(stored, forest):
    text = plan(scoring.score_batch(stored, forest))
    assert len(re.findall(r"UDF\(UDF\(", text)) == 1


def test_top_n_does_not_sort_everything(stored):
    assert "TakeOrderedAndProject" in plan(reports.candidate_cases(stored))
