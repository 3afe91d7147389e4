import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideledger.functions import scalars as S
from tideledger.operators import exposure, labels

D = dt.date(2020, 2, 27)


def days(spark, n=6, port="P"):
    return spark.createDataFrame([(port, D + dt.timedelta(days=i)) for i in range(n)],
                                 "port_name string, date date")


def closures(spark, rows):
    return spark.createDataFrame(rows, "port_name string, date date, duracion double")


def test_overlapping_zero_and_null_durations(spark):
    log = closures(spark, [("P", D, 2.0), ("P", D + dt.timedelta(days=1), 2.0),
                           ("P", D + dt.timedelta(days=4), 0.0), ("P", D + dt.timedelta(days=5), None)])
    rows = labels.label_days(days(spark), log).orderBy("date").collect()
    assert [r.event_dummy_1 for r in rows] == [1, 1, 1, 0, 0, 0]


def test_no_closures_still_label(spark):
    rows = labels.label_days(days(spark), closures(spark, [])).collect()
    assert len(rows) == 6 and {r.event_dummy_1 for r in rows} == {0}


def test_only_colliding_columns_get_suffixes(spark):
    a = days(spark).withColumns({"v": F.lit(1), "only_a": F.lit(2)})
    b = days(spark).withColumns({"v": F.lit(3)})
    got = labels.join_sources(a, b, ["port_name", "date"], ("_x", "_y"))
    assert set(got.columns) == {"port_name", "date", "v_x", "v_y", "only_a"}


def test_port_names_are_replaced_literally(spark):
    names = ["caleta lobitos (talara)", "Caleta San Andrés", "DPA Callao", "puerto matarani (muelle ocean fish)",
             "CALETA EL CHACO", "callao"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(S.canonical_port(F.col("n"), exposure.PORT_NAME_REPAIRS)).collect()]
    assert got == ["CALETA_LOBITOS", "CALETA_SAN_ANDRES", "DPA_DPA_CALLAO", "MUELLE_OCEAN_FISH",
                   "CALETA_EL_CHACHO", "DPA_CALLAO"]


def test_wages_round_half_even_and_group_divisor(spark):
    wages = spark.createDataFrame(
        [("a", "a,b", 300.0, 5.0), ("b", "b", 600.0, 7.0), ("puerto supe", "x", 1.0, 1.0)],
        "caleta string, port_name string, w_p50 double, fishermen_province double")
    params = exposure.wage_params(wages)
    rows = {r.port_name: r for r in params.collect()}
    assert set(rows) == {"A", "B"}
    assert rows["A"].n_workers == 2.0 and rows["A"].daily_wage == 10.0 and rows["A"].daily_loss == 20.0
    ports = spark.createDataFrame([("g1", "A"), ("g1", "B"), ("g1", "MISSING"), ("g2", "NONE")],
                                  "run string, port_name string")
    got = {r.run: r for r in exposure.group_exposure(params, ports).collect()}
    assert got["g1"].n_workers == 9.0
    assert got["g1"].daily_wage == pytest.approx(30.0 / 3 / 3.5)
    assert (got["g2"].n_workers, got["g2"].daily_wage) == (1.0, 1.0)


def test_yearly_loss_cuts_runs_at_new_year(spark):
    start = dt.date(2019, 12, 30)
    rows = [("P", start + dt.timedelta(days=i), f) for i, f in enumerate([0, 1, 1, 1, 0])]
    df = spark.createDataFrame(rows, "port_name string, date date, event_dummy_1 int")
    money = spark.createDataFrame([("P", 10, 2.0)], "port_name string, n_workers int, daily_wage double")
    loss = lambda k: {r.year: r.observed_loss for r in exposure.yearly_observed_loss(
        df, ["port_name"], money, min_days=k).collect()}
    assert loss(1) == {2019: 20.0, 2020: 40.0}
    assert loss(2) == {2019: 0.0, 2020: 40.0}


def test_list_and_rule_text(spark):
    df = spark.createDataFrame([("[np.float64(1.5), 2, np.float64(-3e-1)]", "a_1 > t1 AND b <= t2 OR c > t3")],
                               "l string, r string")
    parts = S.rule_parts(F.col("r"))
    row = df.select(S.parse_number_list(F.col("l")).alias("v"), *[c.alias(k) for k, c in parts.items()]).first()
    assert row.v == [1.5, 2.0, -0.3]
    assert row.features == ["a_1", "b", "c"] and row.operators == [">", "<=", ">"] and row.logic == ["AND", "OR"]


def test_nan_never_fires(spark):
    df = S.nan_to_null(spark.createDataFrame([(float("nan"),), (2.0,)], "v double"), ["v"])
    from tideledger.operators.rules import fires
    assert sorted(r[0] for r in df.select(fires(F.col("v"), F.lit(1.0))).collect()) == [False, True]
