import datetime as dt

import pytest

from tideledger.sources import scan, sinks


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_header_aliases_and_bad_values(spark, tmp_path):
    p = put(tmp_path / "a.csv", "fecha,sea_wave_height\n2020-01-01 05:00:00,1.5\n2020-01-01 06:00:00,NaN\n"
            "2020-01-02 00:00:00,\n2020-01-03 00:00:00,oops\n")
    rows = scan.scan_series_csv(spark, p).collect()
    assert [(r.date, r.swh) for r in rows] == [(dt.date(2020, 1, 1), 1.5)]
    with pytest.raises(ValueError):
        scan.scan_series_csv(spark, put(tmp_path / "b.csv", "when,swh\n1,2\n"))


def test_year_files_outside_the_range_are_left(spark, tmp_path):
    head = "port_name,datetime,swh,swell_height,latitude,longitude,nearest_latitude,nearest_longitude\n"
    for year in (2017, 2018, 2020):
        put(tmp_path / f"waves_{year}.csv", f"{head}P,{year}-05-01 00:00:00,1,NaN,0,0,0,0\n")
    rows = scan.scan_yearly_series(spark, str(tmp_path), 2018, 2021).collect()
    assert sorted(r.year for r in rows) == [2018, 2020]
    assert {r.swell_height for r in rows} == {None}


def test_closure_log(spark, tmp_path):
    p = put(tmp_path / "c.csv", "port_name,capitania,date,year,duracion,event_dummy_1\n"
            "PUERTO PIMENTEL X,Q,2020-02-01,2020,2,1\nOTHER,Q,2020-02-02,2020,bad,1\n")
    rows = {r.port_name: r for r in scan.scan_closures(spark, p, "PIMENTEL", "PUERTO_PIMENTEL").collect()}
    assert rows["PUERTO_PIMENTEL"].duracion == 2.0 and rows["PUERTO_PIMENTEL"].capitania == "PUERTO_PIMENTEL"
    assert rows["OTHER"].duracion is None and rows["OTHER"].date == dt.date(2020, 2, 2)


def test_latest_artifact_goes_by_stamp_within_a_family(spark, tmp_path):
    for name, v in [("aep_summary_20250101_000000", 1), ("aep_summary_20250301_000000", 2),
                    ("aep_summary_p75_20250401_000000", 3)]:
        put(tmp_path / "run=g1" / f"{name}.csv", f"mean_loss\n{v}\n")
    put(tmp_path / "run=g2" / "aep_summary_20240101_000000.csv", "mean_loss\n9\n")
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("mean_loss", T.DoubleType())])
    rows = scan.scan_latest(spark, str(tmp_path), schema, "aep_summary").collect()
    assert sorted((r.run, r.mean_loss) for r in rows) == [("g1", 2.0), ("g2", 9.0)]
    both = scan.scan_latest(spark, str(tmp_path), schema).collect()
    assert sorted((r.run, r.family) for r in both) == [("g1", "aep_summary"), ("g1", "aep_summary_p75"),
                                                       ("g2", "aep_summary")]


def test_feature_cache_is_made_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.createDataFrame([("a",)], "feature string")
    for _ in range(2):
        assert sinks.cached_features(spark, str(tmp_path / "f"), make).first().feature == "a"
    assert len(calls) == 1


def test_threshold_default(spark):
    rows = spark.createDataFrame([("g1",), ("g2",)], "run string")
    stored = spark.createDataFrame([("g1", 0.089)], "run string, threshold double")
    got = {r.run: r.threshold for r in sinks.with_model_threshold(rows, stored).collect()}
    assert got == {"g1": 0.089, "g2": 0.5}


def test_tables_are_partitioned_by_run(spark, tmp_path):
    df = spark.createDataFrame([("g1", 1), ("g2", 2)], "run string, v int")
    sinks.write_table(df, str(tmp_path / "t"))
    assert (tmp_path / "t" / "run=g1").is_dir()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_columns_go_by_header_name(spark, tmp_path):
    put(tmp_path / "x" / "waves_2019.csv", "datetime,swh,port_name\n2019-05-01 00:00:00,1.5,P\n")
    rows = scan.scan_yearly_series(spark, str(tmp_path / "x"), 2018, 2021).collect()
    assert [(r.port_name, r.datetime, r.swh, r.swell_height) for r in rows] == [("P", dt.datetime(2019, 5, 1), 1.5, None)]
    p = put(tmp_path / "w.csv", "w_p50,port_name,fishermen_province,caleta\n7,P,3,C\n")
    assert [tuple(r) for r in scan.scan_wages(spark, p).collect()] == [("C", "P", 7.0, 3.0)]
    with pytest.raises(ValueError):
        scan.scan_closures(spark, put(tmp_path / "c.csv", "capitania,date\nQ,2020-01-01\n"))


def test_a_time_that_does_not_parse_stops_the_job(spark, tmp_path):
    p = put(tmp_path / "t.csv", "date,swh\nnot a date,1\n")
    with pytest.raises(Exception, match="not a time"):
        scan.scan_series_csv(spark, p).collect()
