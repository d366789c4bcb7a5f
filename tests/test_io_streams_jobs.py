import datetime as dt
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.operators import drift
from panelwise.plans import jobs
from panelwise.session import shared_dir
from panelwise.sources import readers, sinks
from panelwise.streaming import jobs as streams

HEADER = "date,entity,area,site,a_1,a_2,a_3\n"
LINES = ["01-02-2025, west  bengal ,north,700001,1,2,3", "01-02-2025, west  bengal ,north,700001,1,2,3", "02/02/2025,100000,x,1,1,1,1", "2025-02-03,Orissa,south,070002,4,0,-1", "03-02-2025,orissa,south,070002,4,0,1"]
BANDS = ["a_1", "a_2", "a_3"]


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "feed" / "deep").mkdir(parents=True)
    (tmp_path / "feed" / "one.csv").write_text(HEADER + "\n".join(LINES[:3]) + "\n")
    (tmp_path / "feed" / "deep" / "two.csv").write_text(HEADER + "\n".join(LINES[3:]) + "\nbroken,line\n")
    with zipfile.ZipFile(tmp_path / "feed" / "a.zip", "w") as z:
        z.writestr("x/part.csv", HEADER + "\n".join(LINES[:2]))
        z.writestr("x/more.csv", HEADER + "\n".join(LINES[2:]))
        z.writestr("notes.txt", "skip me")
    return tmp_path


def test_csv_folder_and_clean_job(spark, folder):
    raw = readers.read_csv_feed(spark, str(folder / "feed"), readers.feed_schema(BANDS))
    assert raw.count() == 6 and raw.cache().where(F.col(readers.BAD_RECORD).isNotNull()).count() == 1
    out = jobs.clean_job({"a": raw})["a"].orderBy("date").collect()
    assert [(r["date"], r["entity"], r["site"], r["a_3"]) for r in out] == [
        (dt.date(2025, 2, 1), "West Bengal", "700001", 3), (dt.date(2025, 2, 3), "Odisha", "070002", 1)]


def test_other_feeds_keep_only_known_entities(spark, folder):
    raw = readers.read_csv_feed(spark, str(folder / "feed"), readers.feed_schema(BANDS))
    other = spark.createDataFrame(
        [("01-02-2025", " ORISSA", "n", "1", 1, 2), ("01-02-2025", "kerala", "n", "1", 1, 2)], "date string, entity string, area string, site string, b_1 long, b_2 long"
    )
    out = jobs.clean_job({"a": raw, "b": other})
    assert [r["entity"] for r in out["b"].collect()] == ["Odisha"] and out["a"].count() == 2


def test_archives(spark, folder):
    rows = readers.read_archives(spark, str(folder / "feed"), readers.feed_schema(BANDS))
    assert rows.count() == 5 and {r["site"] for r in rows.collect()} == {"700001", "1", "070002"}


def test_audit_names_every_missing_feed(spark, folder):
    need = {"a": ["feed/*.csv"], "b": ["b*.zip", "b*.csv"], "c": ["c*.csv"]}
    with pytest.raises(FileNotFoundError, match="b, c"):
        readers.require_inputs(spark, str(folder), need)
    got = {r["feed"]: (r["files"], r["missing"]) for r in readers.audit_inputs(spark, str(folder), need).collect()}
    assert got == {"a": (1, False), "b": (0, True), "c": (0, True)}


def test_artefact_round_trip(spark, tmp_path):
    root = str(tmp_path / "params")
    assert sinks.save_artefact(spark, root, "scale", {"mean": 1.5}) == 1
    assert sinks.save_artefact(spark, root, "scale", {"mean": 2.5}) == 2
    sinks.save_artefact(spark, root, "other", {"k": 3})
    assert sinks.load_artefact(spark, root, "scale") == {"mean": 2.5}
    assert [r[0] for r in sinks.list_artefacts(spark, root).collect()] == ["other", "scale"]
    with pytest.raises(FileNotFoundError):
        sinks.load_artefact(spark, root, "absent")


def test_outputs_and_views(spark, tmp_path):
    focus = spark.createDataFrame([("e", "L", "S", "A", 0.5, 1)], "entity string, label string, status string, action string, priority double, flag_count long")
    paths = sinks.write_outputs({"focus_summary": focus}, str(tmp_path), csv=True)
    assert set(paths) == {"focus_summary", "label_view", "action_view", "priority_view"}
    assert spark.read.option("header", True).csv(paths["action_view"]).columns == ["entity", "status", "action"]


def test_late_rows_are_dropped_once_the_watermark_has_passed(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("v", T.LongType())])
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    day = lambda d, h=0: dt.datetime(2025, 1, d, h)
    for batch in ([("a", day(1), 1), ("a", day(1, 5), 2), ("a", day(5), 3)], [("a", day(1, 6), 100), ("a", day(9), 4)], [("a", day(20), 5)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        stream = streams.rollup_stream(streams.parquet_stream(spark, src, schema), ["k"], ["v"])
        streams.run_to_table(stream, out, ck)
    got = {r["window_start"].day: r["v"] for r in spark.read.parquet(out).collect()}
    assert got == {1: 3, 5: 3, 9: 4}


def test_windows_lose_no_row(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("v", T.LongType())])
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    day = lambda d, h=0: dt.datetime(2025, 1, d, h)
    batches = [[("a", day(1), 1), ("a", day(5), 3), (None, day(5, 1), None)], [("a", day(1, 6), 100), ("a", day(5, 23), 4), ("b", None, 7)], [("a", day(2), 8), ("a", day(6), 16)], []]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        streams.run_windows(streams.parquet_stream(spark, src, schema), out, ck, ["k"], ["v"])
    got = {(r["window_start"].day, r["k"]): (r["v"], r["rows"], r["closed"]) for r in streams.window_sums(spark, out, ["k"], ["v"]).collect()}
    assert got == {(1, "a"): (1, 1, True), (5, "a"): (7, 2, False), (5, None): (None, 1, False), (6, "a"): (16, 1, False)}
    assert sorted(r["v"] for r in streams.late_rows(spark, out).collect()) == [7, 8, 100]
    # a batch that runs again replaces what it wrote
    again = streams.window_sink(out, ["k"], ["v"])
    again(spark.createDataFrame(batches[1], schema), 1)
    assert streams.window_sums(spark, out, ["k"], ["v"]).agg(F.sum("rows")).first()[0] + streams.late_rows(spark, out).count() == sum(map(len, batches))


def test_the_closing_row_ends_the_last_window(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("v", T.LongType())])
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    rows = spark.createDataFrame([("a", dt.datetime(2025, 1, d), d) for d in (1, 2, 9)], schema)
    for batch in (rows, streams.closing_row(spark, schema)):
        batch.coalesce(1).write.mode("append").parquet(src)
        streams.run_to_table(streams.rollup_stream(streams.parquet_stream(spark, src, schema), ["k"], ["v"]), out, ck)
    assert {r["window_start"].day: r["v"] for r in spark.read.parquet(out).collect()} == {1: 1, 2: 2, 9: 9}


def test_drift_of_several_batches_equals_one(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = spark.createDataFrame([(float(x), 1.0) for x in rng.normal(size=400)], "x double, same double")
    rows = [(float(x), None if k % 9 else 2.0) for k, x in enumerate(rng.normal(0.6, 1, size=300))] + [(float("nan"), None)]
    cur = spark.createDataFrame(rows, "x double, same double")
    bins = drift.baseline_bins(base, ["x", "same"])
    assert [r["feature"] for r in bins.collect()] == ["x"]  # one value alone has no bins
    folder = str(tmp_path / "state")
    sink = streams.total_drift_sink(bins, ["x", "same"], folder)
    for k, lo in enumerate((0, 40, 40, 200)):
        sink(spark.createDataFrame(rows[lo : (40, 40, 200, 301)[k]], "x double, same double"), k)
    sink(spark.createDataFrame(rows[200:], "x double, same double"), 3)
    got = spark.read.parquet(f"{folder}/history").orderBy(F.desc("batch")).first()
    want = {r["feature"]: r["psi"] for r in drift.psi_quantile(drift.pooled(base, cur, ["x", "same"])).collect()}
    assert got["n_cur"] == 300 and got["psi"] == pytest.approx(want["x"], rel=1e-9) and want["same"] is None


def test_stream_dedupe_across_batches(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("ts", T.TimestampType())])
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    for keys in ([1, 2, 2], [2, 3]):
        spark.createDataFrame([(k, dt.datetime(2025, 1, 1, 0, k)) for k in keys], schema).write.mode("append").parquet(src)
        streams.run_to_table(streams.dedupe_stream(streams.parquet_stream(spark, src, schema), ["k"]), out, ck)
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_core_job_outputs_and_module_isolation(spark, monkeypatch):
    rng = np.random.default_rng(7)
    def feed(bands):
        rows = [(e, dt.date(2025, m, 1), *[int(v) for v in rng.integers(1, 90, len(bands))]) for e in "ABCDEF" for m in range(1, 9)]
        return spark.createDataFrame(rows, "entity string, date date, " + ", ".join(f"{x} long" for x in bands))

    core = jobs.core_job(feed(BANDS), feed(["b_1", "b_2"]), feed(["c_1", "c_2"]))
    assert len(core) == 15
    assert core["profile"].count() == 6 and core["pareto"].agg(F.max("cum_share")).first()[0] == pytest.approx(1)

    def broken(*_a, **_k):
        raise RuntimeError("boom")

    for module in ("cluster", "attribution", "anomaly"):
        monkeypatch.setattr(getattr(jobs, module), "detect" if module == "anomaly" else "run", broken)
    done, failed = jobs.advanced_job(core)
    assert set(failed) == {"cluster", "attribution", "anomaly"} and {"robust", "granger", "cusum", "forecast"} <= set(done)


class FakeSession:
    """Just the two settings the folder lookup reads."""

    def __init__(self, folder, master, app="app-1"):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": app})()


def test_shared_folder_comes_from_the_session():
    assert shared_dir(FakeSession("hdfs:///shared/", "spark://host:7077")) == "hdfs:///shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(FakeSession(None, "spark://host:7077"))
    local = FakeSession(None, "local[2]", "app-2")
    assert shared_dir(local) == shared_dir(local)
