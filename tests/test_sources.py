import datetime as dt

import pytest
from pyspark.sql import functions as F

from gateflow import session
from gateflow.sources import dimensions, forecasts, swipes


def test_daily_files_round_trip(spark, make_swipes, tmp_path):
    sw = make_swipes([("2024-01-0%d 08:00:00" % d, d, 1, 1, "u", 0) for d in (1, 2, 2, 3)])
    folder = str(tmp_path / "swipes")
    swipes.write_swipe_files(sw, folder)
    back = swipes.read_swipe_files(spark, folder, dt.date(2024, 1, 2))
    assert {r.fileDate.day: r["rows"] for r in swipes.rows_per_file(back).collect()} == {2: 2, 3: 1}
    skipped = swipes.read_swipe_files(spark, folder, skip=[dt.date(2024, 1, 2)])
    assert skipped.count() == 2
    assert skipped.filter("stationID = 3").first().time == dt.datetime(2024, 1, 3, 8)


def test_date_in_plain_file_names_and_other_files(spark, tmp_path):
    header = "time,lineID,stationID,deviceID,status,userID,payType\n"
    for d in (1, 2):
        (tmp_path / f"record_2019-01-0{d}.csv").write_text(header + f"2019-01-0{d} 00:00:05,B,27,1354,0,abc,1\n")
    (tmp_path / "notes_2019-01-03.txt").write_text("not a table")
    got = swipes.read_swipe_files(spark, str(tmp_path))
    assert sorted(str(r.fileDate) for r in got.collect()) == ["2019-01-01", "2019-01-02"]
    one = got.orderBy("time").first()
    assert (one.time, one.lineID, one.stationID, one.userID) == (dt.datetime(2019, 1, 1, 0, 0, 5), "B", 27, "abc")


def test_skipped_files_are_not_read(spark, make_swipes, tmp_path):
    folder = str(tmp_path / "swipes")
    swipes.write_swipe_files(make_swipes([("2024-01-0%d 08:00:00" % d, d, 1, 1, "u", 0) for d in (1, 2, 3)]), folder)
    kept = swipes.read_swipe_files(spark, folder, dt.date(2024, 1, 3))
    files = kept.select("_metadata.file_path") if "_metadata" in kept.columns else kept.select("fileName")
    assert files.distinct().count() == 1


def test_adjacency_matrix(spark, tmp_path):
    path = tmp_path / "road.csv"
    path.write_text(",0,1,2\n0,0,1,0\n1,1,0,1\n2,0,1,0\n")
    got = dimensions.read_adjacency(spark, str(path))
    assert sorted((r.src, r.dst) for r in got.collect()) == [(0, 1), (1, 0), (1, 2), (2, 1)]


def test_weather_holidays_template(spark, tmp_path):
    (tmp_path / "w.csv").write_text("日期,天气状况,气温,风力风向\n2019年01月01日,阴/多云,4/2,北风/北风\n", encoding="utf-8")
    got = dimensions.read_weather(spark, str(tmp_path / "w.csv")).first()
    assert (str(got.day), got.weatNight, got.tempLow) == ("2019-01-01", "多云", 2.0)
    (tmp_path / "h.csv").write_text("day,holi\n0,1\n1,0\n")
    flags = dimensions.read_holiday_flags(spark, str(tmp_path / "h.csv"), dt.date(2019, 1, 1))
    assert [(str(r.day), r.holi) for r in flags.orderBy("day").collect()] == [("2019-01-01", 1), ("2019-01-02", 0)]
    (tmp_path / "t.csv").write_text("stationID,startTime,endTime,inNums,outNums\n"
                                    "0,2019-01-29 00:00:00,2019-01-29 00:10:00,,\n")
    row = dimensions.read_template(spark, str(tmp_path / "t.csv")).first()
    assert row.endTime == dt.datetime(2019, 1, 29, 0, 10) and row.inNums is None


def test_forecast_files(spark, tmp_path):
    day = dt.datetime(2024, 1, 30)
    df = spark.createDataFrame([(2, day, day, 1.0, 2.0), (1, day, day, 3.0, 4.0)], dimensions.TEMPLATE_SCHEMA)
    for run in ("a", "b"):
        forecasts.write_forecast(df, str(tmp_path / "out"), run)
    got = forecasts.read_forecasts(spark, str(tmp_path / "out"))
    assert got.count() == 4 and {r.run for r in got.collect()} == {"a", "b"}
    assert forecasts.run_stamp(dt.datetime(2019, 3, 28, 9, 10)) == "2019_03_28_09_10"


def test_features_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1))], "k INT, day DATE")
    forecasts.write_features(df, str(tmp_path / "f"))
    assert forecasts.read_features(spark, str(tmp_path / "f")).filter(F.col("day") == "2024-01-01").count() == 1


def test_shared_folder_comes_from_the_session(spark):
    before = session.shared_folder(spark)
    assert session.run_folder(spark, "x").startswith(before)
    a, b = session.run_folder(spark, "x"), session.run_folder(spark, "x")
    assert a != b
    assert session.materialise(spark.range(3), "t").count() == 3
    assert session.cut_lineage(spark.range(3)).count() == 3


def test_no_local_checkpoint_in_the_package():
    import pathlib
    for path in pathlib.Path("gateflow").rglob("*.py"):
        assert "localCheckpoint" not in path.read_text() and "crossJoin" not in path.read_text(), path


def test_bad_share_is_refused(spark):
    from gateflow.operators import selection
    with pytest.raises(ValueError):
        selection.dominant_values(spark.range(3), share=0.3)
