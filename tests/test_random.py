"""Random frames with missing values everywhere, against plain-Python brute force."""

import math
import random
from collections import defaultdict
from datetime import date, timedelta
from statistics import fmean, median, stdev

import pytest

from commlens.operators import anomaly, reports
from commlens.schema import DOMAINS
from frames import case, frame

START = date(2024, 1, 1)


def rounded(x, digits=4):
    """Half even after scaling, as NumPy rounds."""
    scaled = x * 10**digits
    low = math.floor(scaled)
    if scaled - low == 0.5:
        return (low if low % 2 == 0 else low + 1) / 10**digits
    return round(scaled) / 10**digits


def maybe(rng, value, chance=0.15):
    return None if rng.random() < chance else value


def random_rows(seed, n=300, days=24):
    rng = random.Random(seed)
    return [
        dict(
            customer_id=f"C{i:05d}",
            segment=maybe(rng, rng.choice(DOMAINS["segment"])),
            campaign_id=maybe(rng, f"CAMP_{rng.randrange(7):03d}"),
            sent_date=maybe(rng, START + timedelta(days=int(days * rng.random() ** 2))),
            opened=maybe(rng, int(rng.random() < 0.6)),
            complaint_flag=maybe(rng, int(rng.random() < 0.2)),
            engagement_score=maybe(rng, rng.randrange(0, 10_001) / 10_000),
            needs_intervention=maybe(rng, int(rng.random() < 0.3)),
        )
        for i in range(n)
    ]


def groups(rows, key):
    found = defaultdict(list)
    for row in rows:
        if row[key] is not None:
            found[row[key]].append(row)
    return found


def known(rows, name):
    return [r[name] for r in rows if r[name] is not None]


@pytest.fixture(scope="module", params=range(4))
def data(request, spark):
    rows = random_rows(request.param)
    return rows, frame(spark, *[case(**r) for r in rows]).repartition(3).cache()


def test_campaigns(data):
    rows, df = data
    expected = {}
    for campaign, members in groups(rows, "campaign_id").items():
        opened = known(members, "opened")
        expected[campaign] = rounded(sum(opened) / len(opened)) if opened else 0.0
    middle = median(expected.values())
    found = {r["campaign_id"]: r for r in anomaly.campaign_scorecard(df, 0.9).collect()}
    assert {c: r["open_rate"] for c, r in found.items()} == expected
    for campaign, row in found.items():
        members = groups(rows, "campaign_id")[campaign]
        assert row["flagged"] == (expected[campaign] < middle * 0.9)
        assert row["total_sent"] == len(known(members, "opened"))
        assert row["complaint_count"] == sum(known(members, "complaint_flag"))
        assert row["avg_engagement"] == pytest.approx(fmean(known(members, "engagement_score")), abs=6e-5)
        assert row["pct_of_median"] == rounded(expected[campaign] / middle)


def test_complaint_days(data):
    rows, df = data
    days = groups(rows, "sent_date")
    counts = {d: sum(known(m, "complaint_flag")) for d, m in days.items()}
    mean, deviation = fmean(counts.values()), stdev(counts.values())
    found = {r["date"]: r for r in anomaly.complaint_days(df, 1.0).collect()}
    assert {d: r["complaints"] for d, r in found.items()} == counts
    for day, row in found.items():
        z = (counts[day] - mean) / deviation
        assert row["total_sent"] == len(days[day])
        assert row["zscore"] == pytest.approx(z, abs=6e-5)
        assert row["flagged"] == (z > 1.0)


def test_segment_weeks(data):
    rows, df = data
    today = max(known(rows, "sent_date"))
    expected = {}
    for segment, members in groups(rows, "segment").items():
        ages = [((today - m["sent_date"]).days, m["engagement_score"]) for m in members if m["sent_date"]]
        now = [s for age, s in ages if age <= 6 and s is not None]
        before = [s for age, s in ages if 7 <= age <= 13 and s is not None]
        if now and before and fmean(before) != 0:
            expected[segment] = (fmean(now), fmean(before))
    found = {r["segment"]: r for r in anomaly.segment_weeks(df, 0.0).collect()}
    assert set(expected) <= set(found)
    for segment, (now, before) in expected.items():
        assert found[segment]["current_week_avg"] == pytest.approx(now, abs=6e-5)
        assert found[segment]["drop_pct"] == pytest.approx((before - now) / before, abs=6e-5)
        assert found[segment]["flagged"] == (now < before)


def test_reports(data):
    rows, df = data
    daily = {r["date"]: r for r in reports.daily_complaints(df).collect()}
    for day, members in groups(rows, "sent_date").items():
        flags = known(members, "complaint_flag")
        assert (daily[day]["complaints"], daily[day]["total"]) == (sum(flags), len(flags))
    assert len(daily) == len(groups(rows, "sent_date"))

    heatmap = {r["campaign_id"]: r.asDict() for r in reports.open_rate_heatmap(df).collect()}
    for campaign, members in groups(rows, "campaign_id").items():
        for segment, cell in groups(members, "segment").items():
            opened = known(cell, "opened")
            assert heatmap[campaign][segment] == (rounded(sum(opened) / len(opened)) if opened else None)

    kpis = reports.kpis(df).first()
    assert kpis["total_records"] == len(rows)
    assert kpis["intervention_rate"] == rounded(fmean(known(rows, "needs_intervention")))

    counts = {r["bin"]: r["n"] for r in reports.engagement_histogram(df).collect()}
    assert sum(counts.values()) == len(known(rows, "engagement_score"))


def test_status_agrees_with_the_rows(data):
    _, df = data
    status = {r["detector"]: r for r in anomaly.detector_status(df).collect()}
    items = anomaly.detector_items(df).orderBy("detector", "position").collect()
    for detector, rows in (
        (anomaly.SEGMENT_DROP, anomaly.segment_drop(df)),
        (anomaly.COMPLAINT_SPIKE, anomaly.complaint_spike(df)),
        (anomaly.CAMPAIGN, anomaly.campaign_underperformance(df)),
    ):
        found = [r.asDict() for r in rows.collect()]
        assert status[detector]["flagged"] == bool(found)
        own = [r for r in items if r["detector"] == detector]
        assert [r["fields"] for r in own] == [{k: str(v) for k, v in r.items()} for r in found]
        assert [r["position"] for r in own] == list(range(1, status[detector]["n_flagged"] + 1))
