"""The ready-made flows reach the published accuracies."""

import pytest

from oreflow.plans import examples


def _accuracy(rows, **where):
    found = {r["accuracy"] for r in rows if all(r[k] == v for k, v in where.items())}
    assert len(found) == 1
    return found.pop()


def test_network_and_surrogate(spark):
    rows = examples.surrogate(spark).collect()
    for compared in ("network with truth", "tree with network"):
        assert _accuracy(rows, compared=compared, part="2_Testing") > 0.85


def test_margins(spark):
    assert _accuracy(examples.margins(spark).collect(), part="2_Testing") > 0.85


def test_flowers(spark):
    rows = examples.classify_flowers(spark).collect()
    assert all(_accuracy(rows, model=m, part="2_Testing") > 0.85 for m in ("KNN", "R", "CH"))


@pytest.mark.parametrize("name", ["example_churn", "example_house_prices", "example_clusters", "example_anomalies", "example_market_basket", "example_basket_flags"])
def test_flows_run(spark, name):
    rows = examples.EXAMPLES[name](spark).collect()
    assert rows
    if name == "example_anomalies":
        assert len(rows) == 150 and sum(r["$KMA-K-Means"] == "anomaly" for r in rows) == 8
    if name == "example_house_prices":
        assert all(r["r2"] > 0.8 for r in rows)
