"""Exact cases of the operators' semantics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import core
from quillon.operators import cells, design, inference, metrics, models, residuals, sampling


def one(spark, column, **values):
    from pyspark.sql import Row

    return spark.createDataFrame([Row(**values)]).select(column.alias("v")).first()["v"]


def dose(spark, value, unit):
    df = spark.createDataFrame([(value, unit)], "v string, u string")
    return df.select(design.dose(F.col("v"), F.col("u")).alias("d")).first()["d"]


@pytest.mark.parametrize("unit", ["uM", "µM", "μM"])
def test_dose_to_molar(spark, unit):
    assert dose(spark, "0.05", unit).molar == pytest.approx(5e-8)


def test_dose_keys_meet_across_units(spark):
    df = spark.createDataFrame([("1000", "nM"), ("1", "uM")], "v string, u string")
    assert df.select(core.dose_key(design.dose(F.col("v"), F.col("u"))["molar"]).alias("k")).distinct().count() == 1


def test_unknown_doses_are_null_with_a_reason_and_zero_is_a_dose(spark):
    for v, u in ((None, "uM"), ("unknown", "uM"), ("", "uM"), ("n/a", "uM"), ("0.05", None), ("garbage", "uM"), ("10", "mg/mL"), ("1", "zz")):
        d = dose(spark, v, u)
        assert d.molar is None and d.reason
    assert "molecular weight" in dose(spark, "10", "mg/mL").reason
    assert dose(spark, "0.0", "uM").molar == 0.0 and dose(spark, "0.0", "uM").reason is None


def test_treatment_lists(spark):
    df = spark.createDataFrame([("[('A', 0.05, 'uM'), ('B', 1.0, 'nM')]",), ("[('DMSO_TF', 0.0, 'uM')]",)], "t string").withColumn("p", design.treatments(F.col("t")))
    a, b = df.select(F.size("p"), design.primary(F.col("p")), design.is_combination(F.col("p")), design.is_control(F.col("p"))).collect()
    assert tuple(a) == (2, None, True, False) and tuple(b) == (1, "DMSO_TF", False, True)


def test_holm_and_bh(spark):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate((0.01, 0.02, 0.03, 0.04, 0.05))], "f string, i int, p double")
    got = [(r.holm, r.bh) for r in inference.adjusted(df, "p", ["f"], "i").orderBy("i").collect()]
    assert got[0][0] == pytest.approx(0.05) and got[-1][1] == pytest.approx(0.05) and all(b <= h + 1e-12 for h, b in got)


def test_energy_shares(spark):
    e = one(spark, core.energy_shares("r", "g"), r=[3.0, 0.0], g=[0.0, 4.0])
    assert (e.residual, e.generic, e.cross) == pytest.approx((9 / 25, 16 / 25, 0.0))


def test_reliability_formulas(spark):
    assert one(spark, core.spearman_brown("r"), r=0.5) == pytest.approx(2 / 3)
    for r in (0.0, 1.0, -0.2):
        assert one(spark, core.spearman_brown("r"), r=r) is None
    assert one(spark, core.disattenuate("o", "a", "b"), o=0.95, a=0.5, b=0.5) is None


def test_tost_verdicts(spark):
    for lo, hi, said in ((-0.01, 0.01, "equivalent"), (0.01, 0.02, "equivalent and excludes zero"), (-0.4, 0.4, "inconclusive")):
        assert one(spark, core.tost("lo", "hi", 0.05), lo=lo, hi=hi) == said


def test_one_node_in_every_dyad_is_undefined(spark):
    df = spark.createDataFrame([(i, float(i), ["x", f"n{i}"]) for i in range(5)], "i int, v double, nodes array<string>")
    assert inference.multiway_variance(df, "i", "v", "nodes").first()["variance"] is None


def test_signed_sentence(spark):
    values = {3: 5.0, 7: 3.0, 11: -4.0, 15: -2.0}
    df = spark.createDataFrame([("k", f"G{i}", i, values.get(i, 0.0)) for i in range(20)], "k string, feature string, idx int, value double")
    assert cells.signed_sentence(df, ["k"], 5, 5).first()["sentence"] == "G3 G7 [DOWN] G11 G15 [END]"


def test_generic_weighs_treatments_equally(spark):
    df = spark.createDataFrame([("g", "X", [6.0]), ("g", "X", [6.0]), ("g", "Y", [0.0]), ("g", "Z", [9.0])], "g string, t string, s array<double>")
    got = residuals.generic(df, F.col("t") != "Z", ["g"], ["g"], "t", "s", 1).where("t = 'Z'").first()["generic"]
    assert got == [3.0]


def test_lone_treatment_is_null_but_shrinks_to_coarse(spark):
    df = spark.createDataFrame([("a", "p", "X", [2.0]), ("a", "q", "Y", [4.0])], "l string, b string, t string, s array<double>")
    fine = residuals.generic(df, F.lit(True), ["l", "b"], ["l"], "t", "s", 1).where("t = 'X'").first()["generic"]
    blend = residuals.generic(df, F.lit(True), ["l", "b"], ["l"], "t", "s", 1, 5.0).where("t = 'X'").first()["generic"]
    assert fine is None and blend == [4.0]


def test_held_out_rows_never_enter_a_fit(spark):
    rows = [("g", t, "train" if t != "H" else "held", [float(i)]) for i, t in enumerate("ABH")]
    fit = lambda rs: [r["generic"] for r in residuals.generic(spark.createDataFrame(rs, "g string, t string, split string, s array<double>"), F.col("split") == "train", ["g"], ["g"], "t", "s", 1).orderBy("t").collect()]
    poisoned = [(g, t, sp, [1e6] if sp == "held" else s) for g, t, sp, s in rows]
    assert fit(rows) == fit(poisoned)
    assert fit(rows) != fit([(g, t, sp, [s[0] + 1] if sp == "train" else s) for g, t, sp, s in rows])


def test_identification_ties_count_half(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.5, 0.1)], "o double, s double")
    assert df.agg(metrics.identification_rate("o", "s").alias("v")).first()["v"] == 0.75
    assert df.agg(metrics.identification_rate("o", "s", strict=True).alias("v")).first()["v"] == 0.5


def test_kendall_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 6, 15).tolist(), rng.integers(0, 6, 15).tolist()
    s = [(np.sign(x[i] - x[j]), np.sign(y[i] - y[j])) for i in range(15) for j in range(i)]
    want = sum(a * b for a, b in s) / np.sqrt(sum(a != 0 for a, _ in s) * sum(b != 0 for _, b in s))
    assert one(spark, metrics.kendall_tau("x", "y"), x=x, y=y) == pytest.approx(want)


def test_rank_correlations_of_flat_input_are_null(spark):
    assert one(spark, core.pearson("x", "y"), x=[1.0, 1.0], y=[1.0, 2.0]) is None
    assert one(spark, core.average_ranks("x"), x=[3.0, 1.0, 3.0]) == [2.5, 1.0, 2.5]
    assert one(spark, core.cosine("x", "y"), x=[0.0], y=[1.0]) == 0.0


def test_unit_audit_and_coverage(spark):
    df = spark.createDataFrame([("u1", "A", 1), ("u1", "B", 1), ("u2", "A", 1)], "u string, drug string, batch int")
    assert [r.u for r in design.unit_audit(df, "u", ["drug", "batch"]).collect()] == ["u1"]


def test_t_quantile():
    assert inference.t_quantile(0.975, 5) == pytest.approx(2.570582, abs=1e-5)
    assert inference.t_quantile(0.975, 1e6) == pytest.approx(1.959966, abs=1e-4)


def test_sinkhorn_margins_and_small_epsilon():
    rng = np.random.default_rng(1)
    for eps in (0.5, 0.01):
        p = models.sinkhorn(rng.random((4, 6)) * 9, eps, 2000)
        assert np.isfinite(p).all() and np.allclose(p.sum(0), 1 / 6, atol=1e-6)


def test_caps_and_draws_replay(spark):
    df = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 99)], "k string, i int")
    draw = lambda: sorted(map(tuple, sampling.filled_draw(df, ["k"], 12, "s", "i").collect()))
    assert draw() == draw() and len(draw()) == 24


def test_json_lines_round_trip_and_checked_write(spark, tmp_path):
    from quillon.sources import files

    df = spark.createDataFrame([(1, "a"), (2, "b")], "i long, s string")
    files.write_examples(df, str(tmp_path / "j"), "s")
    assert files.read_json_lines(spark, str(tmp_path / "j" / "s=a"), "i long").collect()[0].i == 1
    with pytest.raises(ValueError, match="positive"):
        files.write_checked(df, str(tmp_path / "p"), 1, positive="i > 1")
    files.write_checked(df, str(tmp_path / "p"), 2, positive="i > 0")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    (tmp_path / "bad.json").write_text('{"i": 1}\n{broken\n')
    assert files.read_json_lines(spark, str(tmp_path / "bad.json"), "i long", tolerant=True).collect()[0].i == 1
    (tmp_path / "list.txt").write_text("B\n\nA\nB\n")
    assert {(r.tok, r.idx) for r in files.ordered_tokens(spark, str(tmp_path / "list.txt")).collect()} == {("B", 0), ("A", 1)}
