"""Near duplicates on the driver: its memory goes by the size of the plans."""

import random

import pytest

from commlens.llm import graph, minhash

#: Exchanges in one plan at most, broadcasts included.
EXCHANGES = 16


def text(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def corpus():
    """Chains of near copies and texts with a passage in common, so that buckets are dealt anew."""
    rng, rows = random.Random(3), []
    for _ in range(12):
        base = text(rng, 150)
        for k in range(10):
            base = base[:-6] + text(rng, 6)
            rows.append(" ".join(base))
            rows.append(" ".join(base[:70] + text(rng, 40 + k)))
    return list(enumerate(rows))


@pytest.fixture
def plans(monkeypatch):
    """(name, exchanges) of the plan of each table that is stored."""
    found = []

    def stored(df, name, store=minhash.stored):
        found.append((name, exchanges(df)))
        return store(df, name)

    monkeypatch.setattr(minhash, "stored", stored)
    monkeypatch.setattr(graph, "stored", stored)
    return found


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_every_plan_is_small(spark, plans):
    rows = minhash.near_duplicates(spark.createDataFrame(corpus(), "doc_id long, text string"))
    plans.append(("result", exchanges(rows)))
    assert {"buckets", "sets", "components", "beyond"} <= {name for name, _ in plans}
    assert max(n for _, n in plans) <= EXCHANGES, sorted(plans, key=lambda p: -p[1])[:5]
