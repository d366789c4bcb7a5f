import datetime as dt
import os
import subprocess
import sys

import numpy as np
import pandas as pd

from panelwise.operators.rollup import BANDS_OF

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_clean_core_and_validate_from_the_command_line(spark, tmp_path):
    rng = np.random.default_rng(1)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=20 * k) for k in range(40)]
    for feed, bands in BANDS_OF.items():
        rows = [(d.strftime("%d-%m-%Y"), f"Entity {e}", f"area{e}", f"site{e}", *rng.integers(1, 90, len(bands)).tolist()) for d in days for e in "ABCD"]
        (tmp_path / "raw" / feed).mkdir(parents=True)
        pd.DataFrame(rows + rows[:5], columns=["date", "entity", "area", "site", *bands]).to_csv(tmp_path / "raw" / feed / "x.csv", index=False)
    # the shared folder comes by configuration, and the working folder isn't the repository
    env = os.environ | {"PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=2 --conf spark.ui.enabled=false pyspark-shell"}
    for job, source, target in (("clean", "raw", "clean"), ("core", "clean", "core"), ("validate", "clean", "report")):
        args = [sys.executable, "-m", "panelwise.jobs", job, "--in", str(tmp_path / source), "--out", str(tmp_path / target), "--run-date", "2022-12-31"]
        done = subprocess.run(args, env=env, cwd=tmp_path, capture_output=True, text=True, timeout=600)
        assert done.returncode == 0, done.stderr[-3000:]
    assert {f: spark.read.parquet(str(tmp_path / "clean" / f)).count() for f in BANDS_OF} == dict.fromkeys(BANDS_OF, 160)
    core = {p.name for p in (tmp_path / "core").iterdir()}
    assert {"panel", "profile", "anomalies", "focus_summary", "pareto", "label_view", "action_view", "priority_view", "a_ready", "b_ready", "c_ready"} <= core and len(core) == 18
    assert spark.read.parquet(str(tmp_path / "core" / "panel")).select("entity").distinct().count() == 4
    assert spark.read.parquet(str(tmp_path / "report" / "validation")).where("NOT success").count() == 0
