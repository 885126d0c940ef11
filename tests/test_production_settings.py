"""Queries run with the operators' production settings."""

import pytest

from terrazone.operators import experiment, zoning
from terrazone.plans import catalog


@pytest.mark.parametrize("name", ["kmeans_zones", "select_k", "zone_summary"])
def test_twenty_restarts(spark, data, monkeypatch, name):
    fit, runs = zoning.fit, []
    monkeypatch.setattr(zoning, "fit", lambda *a, **b: runs.append(fit(*a, **b)) or runs[-1])
    catalog.queries()[name](spark, data)
    assert {r["count"] for r in runs[0].groupBy("k").count().collect()} == {20}


def test_whole_experiment(spark, data, monkeypatch):
    asked = []
    monkeypatch.setattr(experiment, "run", lambda _, seeds, blocks=None: asked.append((seeds, blocks)))
    catalog.queries()["controlled_experiment"](spark, data)
    assert asked == [(list(range(20)), None)]
