import datetime as dt

from pyspark.sql import functions as F

from gateflow.operators import flow, grid
from tests.conftest import rows

DAY = dt.date(2024, 1, 1)


def test_counts_use_half_open_slots(make_swipes):
    sw = make_swipes([("2024-01-01 00:09:59", 1, 1, 1, "u", 0), ("2024-01-01 00:10:00", 1, 1, 1, "u", 0),
                      ("2024-01-01 00:19:59", 1, 2, 0, "v", 1)])
    assert rows(flow.slot_flow(sw)) == [(1, DAY, 0, 1, 0), (1, DAY, 1, 1, 1)]
    closed = flow.windowed_counts(sw, closed=True)
    assert rows(closed, "startTime", "inNums", "outNums") == [
        (dt.datetime(2024, 1, 1), 2, 0), (dt.datetime(2024, 1, 1, 0, 10), 1, 1)]


def test_entries_only_slot_is_kept(make_swipes):
    sw = make_swipes([("2024-01-01 08:00:00", 1, 1, 1, "u", 0)] * 3)
    assert rows(flow.slot_flow(sw), "inNums", "outNums") == [(3, 0)]
    assert rows(flow.status_pivot(sw), "inNums", "outNums") == [(3, 0)]


def test_null_station_is_left_out(make_swipes, spark):
    sw = make_swipes([("2024-01-01 08:00:00", 1, 1, 1, "u", 0)])
    hole = sw.withColumn("stationID", F.lit(None).cast("int"))
    assert flow.slot_flow(sw.unionByName(hole)).count() == 1


def test_top_is_maximum_and_mode(make_swipes):
    sw = make_swipes([("2024-01-01 08:00:00", 1, d, 1, "u", p) for d, p in ((9, 0), (1, 2), (1, 2))])
    got = flow.top_values(flow.with_grain_fields(sw), ["deviceID", "payType"], ["stationID"])
    assert rows(got) == [(1, 9, 1, 2, 2)]
    many = flow.largest_n(sw, ["stationID"], "deviceID", 2)
    assert rows(many, "rank", "deviceID") == [(1, 9), (2, 1)]
    repeated = flow.largest_n(make_swipes([("2024-01-01 08:00:00", 1, 9, 1, "u", 0)] * 3), ["stationID"], "deviceID", 2)
    assert rows(repeated, "rank", "deviceID") == [(1, 9), (2, 9)]


def test_distinct_counts_agree_with_brute_force(make_swipes):
    data = [("2024-01-0%d %02d:%02d:00" % (1 + i % 3, i % 24, i % 60), 0 if i % 3 else i % 5, i * 7 % 11, i % 2, "u", 0)
            for i in range(300)]
    sw = flow.with_grain_fields(make_swipes(data))
    grains = {"s": ["stationID"], "sh": ["stationID", "hour"]}
    got = flow.distinct_counts(sw, "deviceID", grains)
    by_station = {}
    for _, s, d, *_ in data:
        by_station.setdefault(s, set()).add(d)
    assert rows(got.filter("grain = 's'"), "stationID", "n") == sorted((s, len(v)) for s, v in by_station.items())
    near = flow.distinct_counts(sw, "deviceID", grains, approximate=True)
    assert near.count() == got.count()


def test_device_load(make_swipes):
    sw = make_swipes([("2024-01-01 08:00:00", 1, 1, 1, "u", 0)] * 3 + [("2024-01-01 08:30:00", 1, 2, 0, "u", 0)])
    got = flow.device_load(flow.with_grain_fields(sw)).first()
    assert (got.inDID_h_max, got.inDID_h_min, got.inDID_h_mean, got.outDID_h_max) == (3, 0, 1.5, 1)


def test_dense_grid_and_totals(make_swipes):
    sw = make_swipes([("2024-01-01 08:00:00", 1, 1, 1, "u", 0), ("2024-01-02 09:00:00", 5, 1, 0, "u", 0)])
    dense = grid.densify(flow.slot_flow(sw), grid.grid(sw, DAY, dt.date(2024, 1, 3)))
    assert dense.count() == 2 * 144 * 3
    assert dense.agg(F.sum("inNums") + F.sum("outNums")).first()[0] == sw.count()


def test_per_pay_type_repeats_rows(make_flow):
    rows_ = make_flow([(1, DAY, 0, 1, 1)])
    assert grid.per_pay_type(rows_).count() == 4


def test_in_service(make_flow):
    rows_ = make_flow([(1, DAY, 31, 1, 1), (1, DAY, 32, 1, 1), (54, DAY, 60, 1, 1)])
    assert rows(grid.in_service(rows_, [54]), "stationID", "slot") == [(1, 32)]


def test_mask_labels(make_flow):
    rows_ = make_flow([(1, DAY, 0, 1, 1), (1, dt.date(2024, 1, 2), 0, 5, 5)])
    assert [r.inNums for r in grid.mask_labels(rows_, dt.date(2024, 1, 2)).orderBy("day").collect()] == [1, None]
