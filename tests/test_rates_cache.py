"""Predicted costs against numpy, and stored results against the number of calls of the model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.functions import cache, hooks
from glimmer.operators import rates


def test_fit_predict_and_fall_back(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(40):
        x = float(rng.integers(1, 90))
        rows.append(("plain", x, x * x, None if i % 5 == 0 else 3.0 * x + 0.25 * x * x + float(rng.normal())))
        rows.append(("units", x, float(rng.integers(1, 30)), None if i % 7 == 0 else float(rng.uniform(0, 50))))
        rows.append(("singular", x, 2 * x, None if i % 4 == 0 else 5.0 * x))
        rows.append(("fixed", None, None, None if i % 3 == 0 else float(i)))
        rows.append(("unmeasured", x, 1.0, None))
    rows += [("once", 4.0, 16.0, 8.0), ("once", 10.0, 100.0, None), ("zero", 0.0, 0.0, 6.0), ("zero", 0.0, 0.0, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, stage string, x double, y double, cost double")
    got = {r.i: (r.spent, r.known) for r in rates.filled(df, ["stage"], "x", "y", "cost").collect()}
    for stage in {r[0] for r in rows}:
        own = [(i, *r[1:]) for i, r in enumerate(rows) if r[0] == stage]
        known = [r for r in own if r[3] is not None]
        coef = np.linalg.lstsq(np.array([[r[1], r[2]] for r in known]), np.array([r[3] for r in known]), rcond=None)[0] if stage in ("plain", "units") else None
        for i, x, y, c in own:
            if c is not None:
                want = c
            elif coef is not None:
                want = coef[0] * x + coef[1] * y
            else:
                want = {"singular": lambda: 5.0 * x, "once": lambda: 2.0 * x, "fixed": lambda: np.mean([r[3] for r in known]), "zero": lambda: 6.0, "unmeasured": lambda: None}[stage]()
            assert got[i] == (want if want is None else pytest.approx(want, rel=1e-6), c is not None), (stage, i)


def test_second_run_calls_the_model_for_nothing(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def load():
        def model(frame):
            with open(calls, "a") as f:
                f.write("x")
            return {b"a": "Title", b"b": "", b"cropped b": " small print ", b"c": None}.get(frame, "")

        return model

    def n_calls():
        try:
            return len(open(calls).read())
        except FileNotFoundError:
            return 0

    rows = [(i, b) for i, b in enumerate([b"a", b"a", b"b", b"c", None, b"a", b""])]
    df = spark.createDataFrame(rows, "frame long, content binary").repartition(3)
    run = lambda d, settings="": {r.frame: r.text for r in cache.cached(d, str(tmp_path / "store"), hooks.screen_reader(load, lambda b: b"cropped " + b), "content", "text", "string", "reader", settings).collect()}
    want = {0: "Title", 1: "Title", 5: "Title", 2: "small print", 3: "", 4: None, 6: ""}
    assert run(df) == want
    first = n_calls()
    assert first == 1 + 2 + 2 + 2  # a once, the others with their crops
    assert run(df) == want and n_calls() == first
    more = df.unionByName(spark.createDataFrame([(7, b"a"), (8, b"b")], "frame long, content binary"))
    assert run(more) == want | {7: "Title", 8: "small print"} and n_calls() == first
    assert run(df.filter(F.col("frame") == 0), "large") == {0: "Title"} and n_calls() == first + 1  # other settings, other result
