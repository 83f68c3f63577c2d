"""The registered fitted plans cover all their spans, windows, grains and folds."""

from gateflow.operators import trailing
from gateflow.plans import anchor_windows
from gateflow.queries import models
from gateflow.queries.registry import QUERIES
from tests.conftest import SF


def test_anchor_plan_is_whole(spark, monkeypatch):
    seen = []

    def span_forecast(rows, cells, span, test_index, setting, folds, windows, spec):
        seen.append((span, folds, tuple(windows), spec))
        out = cells.selectExpr("stationID", "day", "slot", "1.0D AS inNums", "1.0D AS outNums")
        return out, spark.createDataFrame([(0, 1.0, "inNums", span)], "fold int, mae double, label string, span int")

    monkeypatch.setattr(anchor_windows, "span_forecast", span_forecast)
    monkeypatch.setattr(models, "_runs", {})
    errors = QUERIES["gbt_anchor_errors"](spark, SF).collect()
    assert sorted(r.span for r in errors) == [2, 3, 5, 7]
    QUERIES["gbt_anchor_windows"](spark, SF)
    assert sorted(s[0] for s in seen) == [2, 3, 5, 7]  # one run serves both queries
    assert all(s[1:] == (10, (1, 3, 5, 10, 15), trailing.DEFAULT_SPEC) for s in seen)


def test_wide_errors_per_fold(spark):
    got = QUERIES["gbt_wide_errors"](spark, SF).collect()
    assert sorted((r.label, r.fold) for r in got) == [(c, k) for c in ("labelin", "labelout") for k in range(5)]


def test_rolling_forecast(spark):
    rows = QUERIES["gbt_rolling_forecast"](spark, SF).collect()
    assert rows and min(min(r.inNums, r.outNums) for r in rows) >= 0
