"""Exact cases of protocol operators, sources and scores, against plain loops."""

import gzip
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import design, inference, matching, metrics, models, protocols, resampling, sampling
from quillon.sources import files
from quillon.streaming import bounded


def test_tau_of_random_arrays_equals_a_loop():
    rng = np.random.default_rng(1)
    for n in (2, 5, 63, 200):
        x, y = rng.integers(0, max(2, n // 2), n).astype(float), rng.integers(0, max(2, n // 3), n).astype(float)
        c = d = tx = ty = 0
        for i, j in itertools.combinations(range(n), 2):
            s = np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
            c, d, tx, ty = c + (s > 0), d + (s < 0), tx + (y[i] == y[j] and x[i] != x[j]), ty + (x[i] == x[j] and y[i] != y[j])
        root = math.sqrt((c + d + tx) * (c + d + ty))
        assert metrics.tau_b(x, y) == (pytest.approx((c - d) / root) if root else None)


def test_greedy_matching_takes_each_control_once(spark):
    rng = np.random.default_rng(2)
    rows = [(0, i, float(v)) for i, v in enumerate(rng.integers(0, 30, 40))]
    pool = [(0, 100 + i, float(v)) for i, v in enumerate(rng.integers(0, 30, 25))]
    make = lambda r: spark.createDataFrame(r, "g long, id long, v double")
    got = {r.id: r.other for r in matching.matched_once(make(rows), make(pool), "g", "id", "v").collect()}
    left, want = list(pool), {}
    for _, i, v in rows:
        if left:
            best = min(left, key=lambda p: (abs(p[2] - v), p[1]))
            want[i] = best[1]
            left.remove(best)
    assert got == want and len(set(got.values())) == 25


def test_energy_distance_in_blocks_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(metrics, "DISTANCE_BLOCK", 7)
    rng = np.random.default_rng(3)
    x, s = rng.normal(size=(40, 3)), rng.integers(0, 2, 40)
    df = spark.createDataFrame([(1, i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(s, x, strict=True))], "g long, id long, s int, x array<double>")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    within = lambda m: d[np.ix_(m, m)][np.triu_indices(m.sum(), 1)].mean()
    a = s == 1
    assert metrics.energy_distance(df, ["g"], "s", "x").first().energy == pytest.approx(2 * d[np.ix_(a, ~a)].mean() - within(a) - within(~a))


def test_running_totals(spark):
    rng = np.random.default_rng(4)
    rows = [(float(v), int(n)) for v, n in zip(rng.integers(0, 400, 3000), rng.integers(1, 5, 3000), strict=True)]
    got = sampling.running_total(spark.createDataFrame(rows, "o double, n long"), "o", "n", "t").collect()
    assert all(r.t == sum(n for o, n in rows if o <= r.o) for r in got[::97])


def test_moments_and_leave_one_out_ridge(spark):
    rng = np.random.default_rng(5)
    x, y, k = rng.normal(size=(60, 3)), rng.normal(size=(60, 3)), rng.integers(0, 3, 60)
    df = spark.createDataFrame([(int(c), a.tolist(), b.tolist()) for c, a, b in zip(k, x, y, strict=True)], "k long, x array<double>, y array<double>")
    m = models.moments(df, "x", "y").toPandas().pivot(index="i", columns="j", values="sxy").to_numpy()
    assert np.allclose(m, x.T @ y)
    for r in resampling.leave_one_out_ridge(df, "k", "x", "y", 1.0).collect():
        u, v = x[k != r.k], y[k != r.k]
        uc, vc = u - u.mean(0), v - v.mean(0)
        want = np.linalg.solve(uc.T @ uc + (np.trace(uc.T @ uc) / 3 + 1e-9) * np.eye(3), uc.T @ vc)
        assert r.n == len(u) and np.allclose(r.weights, want)
    w, mx, my = models.fit_ridge(df, "x", "y")
    got = np.array([r.predicted for r in models.predict_linear(df, "x", w, mx, my).collect()])
    assert np.allclose(got, my + (x - mx) @ w)


def test_multiway_variance_counts_each_pair_once(spark):
    rng = np.random.default_rng(6)
    nodes = [tuple(f"{p}{rng.integers(0, 4)}" for p in "abcd") for _ in range(50)]
    v = rng.normal(size=50)
    df = spark.createDataFrame([(float(x), list(n)) for x, n in zip(v, nodes, strict=True)], "v double, n array<string>")
    e = v - v.mean()
    want = sum(e[i] * e[j] for i in range(50) for j in range(50) if set(nodes[i]) & set(nodes[j])) / 50**2
    assert protocols.multiway_variance(df, "v", "n").first().variance == pytest.approx(want)
    one = spark.createDataFrame([(1.0, ["x", "y"]), (2.0, ["x", "z"])], "v double, n array<string>")
    assert protocols.multiway_variance(one, "v", "n").first().variance is None


def test_nested_json_records(spark):
    text = '{"a": {"effect": 0.5, "p": 0.01, "ci": [1, 2]}, "b": {"c": {"effect": 1, "p": 0.2}, "d": 3}, "e": [1]}'
    df = spark.createDataFrame([(text,), ("not json",), (None,)], "t string")
    got = [(z.path, z.effect, z.p) for r in df.select(protocols.json_records(F.col("t")).alias("z")).collect() for z in r.z or []]
    assert sorted(got) == [("a", 0.5, 0.01), ("b.c", 1.0, 0.2)]


def test_signed_sentences_keep_first_occurrences(spark):
    panel = spark.createDataFrame([("A", 0), ("B", 1), ("C", 2)], "tok string, idx long")
    df = spark.createDataFrame([(1, "A zz A B [DOWN] A C [END] B")], "id long, sentence string")
    got = {r.idx: r.code for r in protocols.signed_vector(df, ["id"], panel, 5).collect()}
    assert got == {0: pytest.approx(1.0), 1: pytest.approx(1 / math.log2(3)), 2: pytest.approx(-1.0)}


def test_refusals(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "i long")
    assert protocols.require_share(df, F.col("i") < 5, 0.5, "half") == 0.5
    with pytest.raises(ValueError):
        protocols.require_share(df, F.col("i") < 4, 0.5, "half")
    ids = spark.createDataFrame([("smp_1",), ("smp_2",), ("0.5",)], "dose string")
    assert design.looks_like_unit_ids(ids, "dose") and not design.looks_like_unit_ids(ids.where("dose = '0.5'"), "dose")


def test_units_and_controls(spark):
    df = spark.createDataFrame([("2", "NM"), ("2", "fM"), ("2", "v/v"), ("2", "M")], "v string, u string")
    got = [r.m for r in df.select(design.dose(F.col("v"), F.col("u"))["molar"].alias("m")).collect()]
    assert got[0] == pytest.approx(2e-9) and got[1] == pytest.approx(2e-15) and got[2] is None and got[3] == 2.0
    lists = spark.createDataFrame([("[]",), ("[('', 0.0, 'uM')]",), ("[('untreated', 0.0, 'uM'), ('A', 1.0, 'uM')]",)], "t string")
    assert [r.c for r in lists.select(design.is_control(design.treatments(F.col("t"))).alias("c")).collect()] == [True, True, False]


def test_files(spark, tmp_path):
    for part in ("data/a", "data/b", "metadata/c"):
        spark.range(3).write.parquet(str(tmp_path / "all" / part))
    found = files.shards(spark, str(tmp_path / "all"))
    assert found and not any("/metadata/" in f for f in found)
    names = [f"x/{i}" for i in range(9)]
    assert len(files.pick_shards(names, 4, "s")) == 4 and files.pick_shards(names, 4, "s") == files.pick_shards(names[::-1], 4, "s") and files.pick_shards(names, 99, "s") == names
    with gzip.open(tmp_path / "genes.tsv.gz", "wt") as f:
        f.write("sym\tlm\nB\t1\nA\t0\nC\t1\nB\t1\n")
    assert [(r.tok, r.idx) for r in files.flagged_symbols(spark, str(tmp_path / "genes.tsv.gz"), "sym", "lm").orderBy("idx").collect()] == [("B", 0), ("C", 1)]


def test_annotation_falls_back_to_the_coarse_table(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "t long, c string")
    fine, coarse = spark.createDataFrame([(1, "x", ["f"])], "t long, c string, g array<string>"), spark.createDataFrame([(1, ["k"])], "t long, g array<string>")
    assert sorted((r.t, r.c, r.g) for r in matching.annotated(rows, fine, coarse, ["t", "c"], ["t"], "g").collect()) == [(1, "x", ["f"]), (1, "y", ["k"]), (2, "x", [])]


def test_stream_drops_repeats_within_the_watermark(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")], "k long, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in.parquet"))
    s = bounded.distinct_within(bounded.stream_of(spark, str(tmp_path / "in.parquet")), "ts", ["k"], "1 hour")
    assert sorted(r.k for r in bounded.run_to_end(s, "file://" + str(tmp_path)).collect()) == [1, 2]


def test_t_quantiles():
    assert inference.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5) and inference.t_cdf(2.228139, 10) == pytest.approx(0.975, abs=1e-6)
