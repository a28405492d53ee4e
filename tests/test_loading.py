"""Loaders, keys, nested results and writers on small exact cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import loading as L
from quillon.operators import models as MO
from quillon.operators import residuals as R
from quillon.sources import files as SRC
from tests.compare import rows_of


def test_two_passes_keep_only_needed_controls(spark):
    rows = spark.createDataFrame([(i, "t" if i < 6 else "c", 0 if i % 2 else 1) for i in range(10)] + [(10, "c", 7)], "id long, treatment string, batch long")
    got = L.two_passes(rows, F.col("treatment") == "c", ["treatment", "batch"], ["batch"], 2, 1, ["id"])
    assert sorted((r.id, r.is_control) for r in got.collect()) == [(0, False), (1, False), (2, False), (3, False), (6, True), (7, True)]
    assert L.two_passes(rows.limit(0), F.col("treatment") == "c", ["treatment"], ["batch"], 2, 1, ["id"]).isEmpty()


def test_tier_rows(spark):
    prompt = lambda c: f"Context: a\nTreatment: b\nControl cell sentence: {c}\nPerturbed cell sentence:"
    rows = spark.createDataFrame([(0, "x", 1, "t", prompt("A B")), (1, "x", None, "t", prompt("A")), (2, None, 1, "t", prompt("A")), (3, "x", 1, None, prompt("A")), (4, "x", 1, "t", prompt("")), (5, "x", 1, "t", None), (6, "x", 2, "t", prompt("C"))], "line long, context string, batch long, treatment string, prompt string")
    out = spark.createDataFrame([(6,)], "line long")
    assert [tuple(r) for r in L.tier_rows(rows, True, out).select("line", "group_batch", "control").collect()] == [(0, 1, "A B")]
    assert sorted(tuple(r) for r in L.tier_rows(rows, False, out).select("line", "group_batch").collect()) == [(0, None), (1, None)]


def test_train_selection_and_harvest(spark):
    train = spark.createDataFrame([(i, "g", "t" if i % 2 else "u", f"c{i // 2}") for i in range(8)] + [(8, "g", "t", ""), (9, "h", "t", "c")], "id long, context string, treatment string, control string")
    held = spark.createDataFrame([("one", "g", "t"), ("two", "g", "t"), ("two", "g", "t"), ("one", "z", "t")], "tier string, context string, treatment string")
    cells, controls = L.train_selection(train, held, ["context", "treatment"], ["context"], 3, ["id"])
    assert sorted((r.tier, r.id) for r in cells.collect()) == [(t, i) for t in ("one", "two") for i in (1, 3, 5, 7, 8)]
    assert sorted((r.tier, r.control) for r in controls.collect()) == [(t, f"c{i}") for t in ("one", "two") for i in range(3)]
    got = L.harvested_controls(train, ["context", "treatment"], "context", 1, 2, ["id"])
    assert sorted((r.level, r.id) for r in got.collect()) == [("context", 0), ("context", 1), ("context", 9), ("key", 0), ("key", 1), ("key", 9)]


def test_fixed_contexts_differ_by_header_only(spark):
    make = lambda t, c: f"Treatment: {t}\nControl cell sentence: {c}\nPerturbed cell sentence:"
    rows = spark.createDataFrame([(0, "a", "t0", make("t0", "")), (1, "a", "t1", make("t1", "K")), (2, "a", "t2", make("t2", "L")), (3, "b", "t0", make("t0", "M"))], "id long, context string, treatment string, prompt string")
    got = L.fixed_contexts(rows, 5, 3, 2, "s", ["id"]).collect()
    assert sorted((r.context, r.prompt) for r in got) == [("a", make(f"t{i}", "K")) for i in range(3)]


def test_keys_and_codes(spark):
    one = spark.createDataFrame([(c, ["p", None]) for c in (None, -1, 0, 1, 2)], "code long, names array<string>")
    assert [r[0] for r in one.select(L.decoded("code", "names")).collect()] == ["NA", "NA", "p", "NA", "NA"]
    rows = spark.createDataFrame([("x", "nan"), (None, "m"), ("x", None)], "c string, m string")
    assert [tuple(r) for r in rows.select(*[L.baseline_key(k, "c", "m") for k in ("global", "context", "mechanism", "mechanism_context")]).collect()] == [(None, "x", "unclear", "unclear||x"), (None, None, "m", "m||None"), (None, "x", "unclear", "unclear||x")]
    with pytest.raises(ValueError):
        L.baseline_key("other", "c", "m")


def test_swap_verdicts(spark):
    cases = [(None, 1.0, 0.1, "too few clusters"), (float("nan"), 1.0, 0.1, "too few clusters"), (0.1, 0.2, None, "toward"), (-0.2, -0.1, 0.0, "away"), (-1.0, 1.0, -1.0, "no margin"), (-1.0, 1.0, 0.4, "margin below resolution"), (0.6, 1.0, 0.5, "toward"), (-1.0, -0.6, 0.5, "away"), (-0.1, 0.1, 0.5, "equivalent"), (0.1, 0.2, 0.5, "directional, below margin"), (0.1, 0.9, 0.5, "inconclusive")]
    got = spark.createDataFrame(cases, "lo double, hi double, margin double, want string").select("want", L.swap_verdict("lo", "hi", "margin").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_nested_results(spark):
    doc = {"tiers": {"a": {"rows": [{"context": "x", "treatment": "t", "n": 3, "model": {"rate": 0.5}, "ceiling": None}, {"context": "x", "treatment": "u", "model": "none", "other": {"rate": 1}}, {"tier": "own", "ceiling": {"rate": 2, "more": 1}}]}, "b": {}}}
    docs = spark.createDataFrame([(json.dumps(doc),), ("{}",), (None,), ("not json",)], "doc string")
    got = L.result_rows(docs, "doc", "rate", ["model", "ceiling", "other"], ["model", "ceiling"]).collect()
    assert sorted(tuple(r) for r in got) == [("a", "x", "t", 3, 0.5, None, None), ("own", None, None, None, None, 2.0, None)]


def test_plain_ridge_is_the_normal_equations(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(30, 4)), rng.normal(size=(30, 4))
    rows = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "x array<double>, y array<double>")
    assert np.allclose(MO.fit_plain_ridge(rows, "x", "y", 2.0), np.linalg.solve(x.T @ x + 2 * np.eye(4), x.T @ y))
    assert all(abs(sum(r[0])) < 1e-12 for r in rows.select(MO.row_centred("x")).collect())


def test_csv_and_reconstruction(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "a,b"), (2, "", 'q"')], "id long, empty string, text string")
    SRC.write_csv(rows, str(tmp_path / "c"), ["text", "absent", "id", "empty"])
    back = spark.read.csv(str(tmp_path / "c"), header=True, escape='"', quote='"')
    assert back.columns == ["text", "absent", "id", "empty"] and sorted((r.id, r.text, r.empty, r.absent) for r in back.collect()) == [("1", "a,b", None, None), ("2", 'q"', None, None)]
    shifts = spark.createDataFrame([("g", b, t, [float(t), float(b)]) for b in (0, 1) for t in (1, 2, 3)], "context string, batch long, treatment long, shift array<double>")
    generic = R.generic_by_group(shifts, F.lit(True), ["context", "batch"], ["context"], "treatment", "shift", 5.0)
    SRC.write_reconstruction(generic, ["context", "batch"], str(tmp_path / "r"))
    got = {r.group_key: r.generic for r in spark.read.parquet(str(tmp_path / "r")).collect()}
    assert set(got) == {"g|0", "g|1"} and np.allclose(got["g|1"], [2.0, 3 / 8 + 5 / 8 * 0.5])


def test_rank_ridge_query_predicts_every_pair(spark):
    from quillon.plans.registry import QUERIES

    got = QUERIES["ml04_rank_ridge"](spark, "/root/testdata/sf0.001")
    assert len(rows_of(got)[1]) > 100 and got.where(F.size("predicted") != 40).isEmpty()
