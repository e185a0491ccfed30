import pytest
from pyspark.sql import functions as F

from commlens.operators import anomaly, quality, reports
from commlens.plans.ingest import ingest
from commlens.plans.run import run, sample_texts
from commlens.settings import Settings
from commlens.sources import files, tables
from commlens.sources.feeds import communications, raw_feed


def test_table_round_trip(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, t string")
    assert not tables.table_exists(spark, "trip")
    tables.write_table(df, "trip")
    tables.write_table(df, "trip", if_exists="append")
    assert tables.table_exists(spark, "trip") and tables.row_count(spark, "trip") == 4
    tables.write_table(df, "trip")
    assert tables.row_count(spark, "trip") == 2
    tables.write_table(df, "fresh", if_exists="append")
    assert tables.row_count(spark, "fresh") == 2
    with pytest.raises(ValueError, match="if_exists"):
        tables.write_table(df, "trip", if_exists="merge")
    tables.execute(spark, "DROP TABLE trip")
    assert not tables.table_exists(spark, "trip")


def test_append_keeps_the_partitioning(spark, cases):
    tables.write_table(cases, "grown", partition_by="sent_date")
    tables.write_table(cases.limit(10), "grown", if_exists="append")
    assert tables.row_count(spark, "grown") == cases.count() + 10
    assert [c.name for c in spark.catalog.listColumns("grown") if c.isPartition] == ["sent_date"]
    grown = tables.read_table(spark, "grown").select(cases.columns)
    assert grown.exceptAll(cases).count() == 10


def test_query_with_parameters(spark, cases):
    found = tables.query(spark, "SELECT count(*) AS n FROM {c} WHERE segment = ?", ["Basic"], c=cases).first()["n"]
    assert found == cases.where(F.col("segment") == "Basic").count()


def test_csv(spark, cases, tmp_path):
    path = files.write_csv(cases.limit(20), str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(path)
    assert back.columns == cases.columns and back.count() == 20
    assert back.where(~F.col("sent_date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")).count() == 0


def test_json_records(spark, cases, tmp_path):
    cases.limit(5).write.json(str(tmp_path / "in"))
    assert files.read_records(spark, str(tmp_path / "in")).count() == 5


def test_ingest_rejects_a_bad_feed(spark, small):
    settings = Settings(table_name="rejected")
    with pytest.raises(ValueError, match="Validation FAILED"):
        ingest(raw_feed(spark, small), settings)
    assert not tables.table_exists(spark, "rejected")


def test_a_rejected_feed_leaves_the_old_table(spark, small, cases):
    settings = Settings(table_name="kept")
    ingest(cases, settings)
    with pytest.raises(ValueError, match="Validation FAILED"):
        ingest(raw_feed(spark, small), settings)
    assert tables.row_count(spark, "kept") == cases.count()
    with pytest.raises(ValueError, match="Missing required columns"):
        ingest(cases.drop("segment"), settings)


def test_observed_checks_equal_the_checks_of_a_pass(spark, small):
    feed = raw_feed(spark, small)
    watched, judge = quality.observed(feed)
    watched.write.format("noop").mode("overwrite").save()
    assert judge() == quality.validate(feed)


def test_ingest_reads_the_feed_once(spark, small, tmp_path):
    """The feed counts the rows that are read from it."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    cases = communications(spark, small)
    feed = cases.mapInArrow(counted, cases.schema)
    table = ingest(feed, Settings(table_name="read_once"), raw_csv=str(tmp_path / "raw"))
    assert read.value == table.count() == cases.count()


def test_a_batch_is_appended_once(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, t string")
    for batch in ("x", "y", "x"):
        tables.append_batch(df, "batched", batch)
    assert tables.row_count(spark, "batched") == 4
    tables.append_batch(df.select("t", "n").limit(1), "batched", "it's")
    tables.append_batch(df.limit(0), "batched", "y")
    found = {r["batch"]: r["n"] for r in spark.table("batched").groupBy("batch").agg(F.sum("n").alias("n")).collect()}
    assert found == {"x": 3, "it's": 1}


def test_a_stored_rollup_follows_its_days(spark, cases):
    day = F.dayofmonth("sent_date")
    anomaly.store_rollup(cases.where(day <= 20).withColumn("complaint_flag", F.lit(1)), "rolled")
    anomaly.store_rollup(cases.where(day > 10), "rolled")
    anomaly.store_rollup(cases.where(day <= 10), "rolled")
    assert anomaly.status_of(spark.table("rolled")).collect() == anomaly.detector_status(cases).collect()


def test_a_lookup_reads_one_bucket(spark, cases):
    tables.write_bucketed(cases, "looked_up", "customer_id", 8)
    wanted = cases.select("customer_id").first()[0]
    found = reports.case_lookup(spark.table("looked_up"), wanted)
    found = reports.case_lookup(spark.table("looked_up"), wanted)
    assert found.collect()[0]["customer_id"] == wanted
    read = []

    def visit(node):
        if node.nodeName().startswith("Scan"):
            read.append((node.metrics().apply("numFiles").value(), node.metrics().apply("numOutputRows").value()))
        for i in range(node.children().size()):
            visit(node.children().apply(i))
        if node.nodeName() == "AdaptiveSparkPlan":
            visit(node.executedPlan())

    visit(found._jdf.queryExecution().executedPlan())
    assert [rows < cases.count() / 4 for _, rows in read] == [True], read
    assert found.count() == 1
    assert len(spark.table("looked_up").inputFiles()) == 8


def test_a_run_goes_on_where_it_stopped(spark, cases, tmp_path, monkeypatch):
    from commlens.plans import run as plan

    settings, model, started = Settings(table_name="resumed", trees=5, depth=3), str(tmp_path / "model"), []
    for name in ("ingest", "train", "detector_status", "score_batch", "case_summaries"):
        work = getattr(plan, name)
        monkeypatch.setattr(plan, name, lambda *a, _n=name, _w=work, **k: (started.append(_n), _w(*a, **k))[1])

    def lost(*a, **k):
        raise RuntimeError("executor lost")

    working = plan.score_batch
    monkeypatch.setattr(plan, "score_batch", lost)
    with pytest.raises(RuntimeError, match="executor lost"):
        run(cases, model, settings, run_id="night", parallelism=5)
    monkeypatch.setattr(plan, "score_batch", working)
    assert started == ["ingest", "train", "detector_status"]
    summary = run(cases, model, settings, run_id="night", parallelism=5)
    assert started == ["ingest", "train", "detector_status", "score_batch", "case_summaries"]
    assert summary.rows == cases.count() and summary.detectors_flagged == 3 and "FLAGGED" in summary.anomaly_text
    assert run(cases, model, settings, run_id="night") == summary and len(started) == 5
    assert tables.row_count(spark, "resumed_texts") == summary.rows


def test_ingest_can_skip_the_checks(spark, small):
    table = ingest(raw_feed(spark, small), Settings(table_name="unchecked"), skip_validation=True)
    assert table.count() == table.select("customer_id").distinct().count()


def test_whole_run(spark, cases, tmp_path):
    settings = Settings(table_name="whole", trees=10, depth=4)
    summary = run(
        cases,
        str(tmp_path / "model"),
        settings,
        parallelism=5,
        raw_csv=str(tmp_path / "raw"),
        processed_csv=str(tmp_path / "processed"),
    )
    assert summary.rows == cases.count() and summary.detectors_flagged == 3
    assert summary.metrics["roc_auc"] > 0.9
    assert tables.row_count(spark, "whole_texts") == summary.rows
    assert spark.table("whole_detectors").count() == 3
    assert "FLAGGED" in summary.anomaly_text
    samples = sample_texts(spark.table("whole_scores"), summary.anomaly_text)
    assert samples.count() == 2 and samples.select("summary").distinct().count() == 2


def test_settings(tmp_path):
    assert Settings().override(seed=0, trees=None).seed == 0
    assert Settings().override(trees=None).trees == 100
    with pytest.raises(ValueError, match="nonsense"):
        Settings.from_mapping({"nonsense": 1})
    (tmp_path / "s.json").write_text('{"trees": 7}')
    assert Settings.load(str(tmp_path / "s.json")).trees == 7


def test_requests(spark, cases, forest):
    from commlens.plans.requests import detect, score_requests, summarise_requests
    from frames import RISKY, SAFE

    feed = files.from_records(spark, [RISKY, SAFE, {**SAFE, "customer_id": "BAD", "engagement_score": 1.5}])
    untyped = files.from_records(spark, [{**SAFE, "opened": "maybe"}, RISKY], typed=False)
    assert [r["reasons"] for r in score_requests(untyped, forest).quarantined.collect()] == [["opened: not an integer"]]
    answers = score_requests(feed, forest)
    scored = {r["customer_id"]: r for r in answers.answered.collect()}
    assert set(scored) == {"CASE_SEVERAL", "CASE_CALM"}
    assert scored["CASE_SEVERAL"]["needs_intervention"] == 1 and scored["CASE_CALM"]["needs_intervention"] == 0
    assert [r["reasons"] for r in answers.quarantined.collect()] == [["engagement_score: above 1"]]

    texts = {r["customer_id"]: r["summary"] for r in summarise_requests(feed, forest).answered.collect()}
    assert "elevated intervention risk" in texts["CASE_SEVERAL"] and "has declined to 0.90" in texts["CASE_CALM"]
    unscored = {r["customer_id"]: r["summary"] for r in summarise_requests(feed).answered.collect()}
    assert "(score: 0.00)" in unscored["CASE_SEVERAL"]

    status, totals = detect(cases, "complaint_spike")
    assert status.count() == 1 and totals.first()["total_flagged"] == 1
    with pytest.raises(ValueError):
        detect(cases, "other")
