"""A third of all rows in one key: right results, and nothing unbounded in one task."""

from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from commlens.operators import anomaly, cleaning, evaluation, quality, splitting
from commlens.sources.feeds import communications
from frames import case, frame


@pytest.fixture(scope="module")
def hot(spark):
    """3,000 rows, a third of them one customer, one campaign and one day."""
    rows = [
        case(
            customer_id="HOT" if i % 3 == 0 else f"C{i:05d}",
            campaign_id="CAMP_001" if i % 3 == 0 else f"CAMP_{i % 50:03d}",
            sent_date=date(2024, 1, 15) if i % 3 == 0 else date(2024, 1, 1) + timedelta(days=i % 30),
            opened=int(i % 7 == 0),
            complaint_flag=int(i % 11 == 0),
            needs_intervention=int(i % 5 == 0),
            tenure_months=1 + i % 120,
        )
        for i in range(3000)
    ]
    return frame(spark, *rows).repartition(6).cache()


def test_a_repeated_id_sends_one_row_per_task_to_the_shuffle(spark, hot):
    kept = cleaning.keep_first(hot)
    assert kept.count() == hot.select("customer_id").distinct().count()
    first = kept.where(F.col("customer_id") == "HOT").first()
    expected = min(
        (r for r in hot.collect() if r["customer_id"] == "HOT"),
        key=lambda r: (r["sent_date"], r["campaign_id"], r["opened"], r["complaint_flag"], r["tenure_months"]),
    )
    assert first["sent_date"] == expected["sent_date"] and first["opened"] == expected["opened"]

    kept.collect()
    written = []

    def visit(node):
        if node.nodeName() == "Exchange":
            written.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i))
        if "QueryStage" in node.nodeName():
            visit(node.plan())
        if node.nodeName() == "AdaptiveSparkPlan":
            visit(node.executedPlan())

    visit(kept._jdf.queryExecution().executedPlan())
    # 2,000 single rows and at most one row of the hot id per task
    assert written and max(written) <= 2000 + 6


def shuffled_bytes(df):
    """Bytes that all exchanges of a collected plan wrote."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    written = []

    def visit(node):
        if node.nodeName() == "Exchange":
            written.append(node.metrics().apply("shuffleBytesWritten").value())
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i))
        if "QueryStage" in node.nodeName():
            visit(node.plan())
        if node.nodeName() == "AdaptiveSparkPlan":
            visit(node.executedPlan())

    visit(df._jdf.queryExecution().executedPlan())
    return sum(written)


@pytest.mark.parametrize("most", [1 << 19, 3])
def test_few_repeated_ids_leave_the_rest_where_it_is(spark, hot, most):
    rows = hot.where(F.col("customer_id") != "HOT").unionByName(hot.where("customer_id = 'HOT'").limit(5))
    rows = rows.unionByName(rows.where("customer_id like 'C0000%'").withColumn("sent_date", F.lit(date(2023, 12, 31))))
    rows = rows.unionByName(rows.limit(2).withColumn("customer_id", F.lit(None).cast("string")))
    general, few = cleaning.keep_first(rows), cleaning.keep_first_of_few(rows, most=most)
    assert sorted(map(str, few.collect())) == sorted(map(str, general.collect()))


def test_few_repeated_ids_shuffle_few_bytes(spark, tmp_path):
    """One id in a thousand repeated: hashes and the repeated rows are shuffled, the wide rows are not."""
    columns = [F.md5(F.concat(F.col("id").cast("string"), F.lit(str(i)))).alias(f"text{i}") for i in range(5)]
    ids = F.when(F.col("id") % 1000 == 1, F.col("id") - 1).otherwise(F.col("id"))
    wide = spark.range(0, 200_000, 1, 4).select(ids.cast("string").alias("customer_id"), *columns)
    wide.write.parquet(str(tmp_path / "wide"))
    wide = spark.read.parquet(str(tmp_path / "wide"))
    few = cleaning.keep_first_of_few(wide)
    assert few.count() == 199_800
    hashes = wide.select(F.xxhash64("customer_id").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    general, counted = shuffled_bytes(cleaning.keep_first(wide)), shuffled_bytes(hashes.where("n > 1"))
    assert shuffled_bytes(few) + counted < 0.1 * general


def test_groups_agree_with_brute_force(hot):
    rows = hot.collect()
    sent, opened = Counter(), Counter()
    for r in rows:
        sent[r["campaign_id"]] += 1
        opened[r["campaign_id"]] += r["opened"]
    found = {r["campaign_id"]: r for r in anomaly.campaign_scorecard(hot).collect()}
    assert {c: r["total_sent"] for c, r in found.items()} == dict(sent)
    rates = sorted(round(opened[c] / sent[c], 4) for c in sent)
    middle = len(rates) // 2
    median = rates[middle] if len(rates) % 2 else (rates[middle - 1] + rates[middle]) / 2
    assert found["CAMP_001"]["median_open_rate"] == pytest.approx(median, abs=1e-4)

    complaints = Counter()
    for r in rows:
        complaints[r["sent_date"]] += r["complaint_flag"]
    days = {r["date"]: r["complaints"] for r in anomaly.complaint_days(hot).collect()}
    assert days == dict(complaints)


def test_a_repeated_id_stays_on_one_side_of_the_split(hot):
    split = splitting.stratified_split(hot)
    assert split.count() == hot.count()
    per_id = split.groupBy("customer_id", "needs_intervention").agg(F.count_distinct("slot").alias("n"))
    assert per_id.where(F.col("n") > 1).count() == 0


def test_a_frequent_score_and_a_frequent_bad_value(spark, hot):
    scored = hot.withColumn("score", F.when(F.col("customer_id") == "HOT", 0.5).otherwise(F.rand(7)))
    local = [(r["score"], r["needs_intervention"]) for r in scored.select("score", "needs_intervention").collect()]
    positive = [s for s, y in local if y == 1]
    negative = sorted(s for s, y in local if y == 0)
    from bisect import bisect_left, bisect_right

    wins = sum((bisect_left(negative, s) + bisect_right(negative, s)) / 2 for s in positive)
    frozen = spark.createDataFrame(local, "score double, label int")
    assert evaluation.roc_auc(frozen, "score", "label") == pytest.approx(wins / (len(positive) * len(negative)))

    bad = hot.withColumn("segment", F.when(F.col("customer_id") == "HOT", "Gold").otherwise(F.col("segment")))
    assert [r.asDict() for r in quality.unexpected_values(bad).collect()] == [
        {"column_name": "segment", "value": "Gold", "failures": 1000}
    ]


def test_a_hot_user_joins_without_a_hint(spark, tiny):
    """Beyond the broadcast threshold the feed falls back to a shuffled join, whose skew AQE handles."""
    usual = communications(spark, tiny).agg(F.sum("engagement_score"), F.count("*")).first()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = communications(spark, tiny)
        assert "SortMergeJoin" in shuffled._jdf.queryExecution().executedPlan().toString()
        found = shuffled.agg(F.sum("engagement_score"), F.count("*")).first()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert found[1] == usual[1] and found[0] == pytest.approx(usual[0])


def test_a_hot_day_is_written_by_several_tasks(spark, hot, tmp_path):
    from pathlib import Path

    from commlens.sources.tables import write_table

    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8k")
    try:
        write_table(hot, "hot_days", partition_by="sent_date")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    paths = [Path(f) for f in spark.table("hot_days").inputFiles()]
    files = Counter(p.parent.name for p in paths)
    assert files.pop("sent_date=2024-01-15") > 1
    assert spark.table("hot_days").count() == hot.count()
