"""Paged sources, joined loads, archives, exports, as-of joins, sketches and streamed scores."""

import io
import json
import random
import re
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shockwell.functions import sketches
from shockwell.operators import har
from shockwell.operators.asof import asof_join
from shockwell.plans import ingest
from shockwell.sources import archives, pages, payloads, sinks
from shockwell.sources.candles import positioned
from shockwell.streaming import scores

CANDLE = "asset string, begin timestamp_ntz, open double, high double, low double, close double, volume double, value double"


@pytest.fixture(scope="module")
def candles(spark):
    r = random.Random(1)
    start = datetime(2020, 1, 1)
    rows = []
    for asset, n in (("AA", 250), ("B/C", 40), ("D", 1)):
        for k in range(n):
            o = 10 + r.random()
            rows.append((asset, start + timedelta(days=k), o, o + 1, o - 1, o + r.random() - 0.5, float(k) if k % 7 else None, None))
    return positioned(spark.createDataFrame(rows, CANDLE)).persist()


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert sorted(map(str, a.select(columns).collect())) == sorted(map(str, b.select(columns).collect()))


@pytest.fixture(scope="module")
def listing(spark, candles, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('listing')}/pages"
    pages.write_pages(candles, path, 24, 30)
    return path


def test_pages_read_back_to_the_same_candles(spark, candles, listing):
    same(pages.load_candles(spark, listing, "2020-01-01", "2030-01-01"), candles.drop("pos"))
    same(pages.load_candles(spark, listing, "2020-02-01", "2020-03-05", assets=["AA", "B/C"]), candles.where("begin >= '2020-02-01' and begin < '2020-03-06' and asset <> 'D'").drop("pos"))
    assert pages.load_candles(spark, listing, "2020-02-01", "2020-03-05", interval=60).count() == 0
    with pytest.raises(ValueError):
        pages.load_candles(spark, listing, "2020-02-01", "2020-03-05", interval=5)


def test_filters_keep_pages_from_being_read(spark, listing):
    reader = pages.CandlePageReader({"path": listing, "pagespertask": "1"}, pages.T._parse_datatype_string("asset string, close double"))
    assert sum(len(p.files) for p in reader.partitions()) == 9 + 2 + 1
    left = list(reader.pushFilters([pages.EqualTo(("asset",), "AA"), pages.GreaterThanOrEqual(("begin",), datetime(2020, 2, 1)), pages.LessThan(("begin",), datetime(2020, 3, 1)), pages.EqualTo(("interval",), 24), pages.GreaterThan(("close",), 3.0)]))
    assert [type(f).__name__ for f in left] == ["GreaterThan"] and left[0].attribute == ("close",)
    parts = reader.partitions()
    assert [p.files[0][0] for p in parts] == [30]  # the page of 31 January to 29 February
    rows = [b.to_pydict() for p in parts for b in reader.read(p)]
    assert list(rows[0]) == ["asset", "close"] and sum(len(x["asset"]) for x in rows) == 29
    plan = pages.read_pages(spark, listing).where("interval = 24 and asset = 'AA' and begin >= timestamp_ntz'2020-02-01'")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan candle_pages" in plan and "= 24" not in plan and "2020-02-01" not in plan


def test_pages_that_cannot_be_read(spark, tmp_path):
    folder = tmp_path / "asset=A/interval=24/start=0/first=20200101000000/last=20200102000000"
    folder.mkdir(parents=True)
    (folder / "part-0.txt").write_text(json.dumps({"candles": {"columns": ["BEGIN", "open", "CLOSE"], "data": [["2020-01-01 00:00:00", "x", 2], ["?", 1, "3.5"], ["2020-01-01 00:00:00", 4, 5]]}}))
    rows = pages.read_pages(spark, f"file://{tmp_path}").collect()
    assert [(r["begin"], r["open"], r["close"], r["volume"], r["load"]) for r in rows] == [(datetime(2020, 1, 1), None, 2.0, None, 0), (None, 1.0, 3.5, None, 1), (datetime(2020, 1, 1), 4.0, 5.0, None, 2)]
    kept = pages.load_candles(spark, f"file://{tmp_path}", "2020-01-01", "2020-01-02").collect()
    assert [(r["asset"], r["open"], r["close"]) for r in kept] == [("A", 4.0, 5.0)]
    (folder / "part-0.txt").write_text(json.dumps({"history": {}}))
    with pytest.raises(Exception, match="no table 'candles'"):
        pages.read_pages(spark, f"file://{tmp_path}").collect()
    assert pages.read_pages(spark, f"file://{tmp_path}/asset=A/nothing").count() == 0


def test_market_data_takes_the_board(spark, listing):
    symbols = spark.createDataFrame([(" aa ",), ("AA",), ("d",), ("nobody",), (None,)], "symbol string")
    boards = spark.createDataFrame([("AA", "X", "stock", "shares", 0, 1), ("AA", "Y", "stock", "shares", 1, 2), ("D", "X", None, "shares", 1, 1), ("B/C", "X", "stock", "shares", 1, 1)], "secid string, boardid string, engine string, market string, is_primary int, turn int")
    found = pages.load_market_data(symbols, boards, listing, "2020-01-01", "2020-01-10")
    assert {(r["secid"], r["board"], r["n"]) for r in found.groupBy("secid", "board").agg(F.count("*").alias("n")).collect()} == {("AA", "Y", 10)}
    assert {r["board"] for r in pages.load_market_data(symbols, boards, listing, "2020-01-01", "2020-01-10", preferred=" x").collect()} == {"X"}


def test_payload_tables(spark):
    rows = spark.createDataFrame([(1, '{"t": {"columns": ["A", "b"], "data": [[1, "x"], [null, "y"]]}}'), (2, '{"t": {"columns": [], "data": []}, "u": 1}')], "id int, payload string")
    assert [tuple(r) for r in payloads.payload_columns(rows, "t", ["a", "B", "c"]).collect()] == [(1, 0, "1", "x", None), (1, 1, None, "y", None)]
    for bad in ('{"u": {}}', '{"t": {"columns": ["a"]}}', "[1]", '{"t": {"columns": ["a"], "data": [[1, 2]]}}', None):
        with pytest.raises(Exception, match="no table 't'|another length"):
            payloads.payload_tables(spark.createDataFrame([(1, bad)], "id int, payload string"), "t").collect()


def test_archives_are_read_by_member(spark, candles, tmp_path):
    plain = candles.where("asset <> 'B/C'")
    done = archives.write_candle_archives(plain, f"file://{tmp_path}", F.month("begin"))
    assert done.count() == 9 and all(r["bytes"] > 0 for r in done.collect())
    same(archives.read_candle_archives(spark, f"file://{tmp_path}/*.zip"), plain.drop("pos"))
    assert {r["asset"] for r in archives.read_candle_archives(spark, f"file://{tmp_path}/*.zip", ["d"]).collect()} == {"D"}


def test_members_of_one_archive_go_to_several_tasks(spark, tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for k in range(40):
            archive.writestr(f"x/candles/s{k}.CSV", "Begin,open,high,low,close,volume\n2020-01-01,1,2,0.5,1,3\n2020-01-01,9,9,9,9,9\n")
        archive.writestr("x/candles/gone.csv", "a,b\n1,2\n")
        archive.writestr("x/other/s.csv", "begin,open,high,low,close,volume\n")
        archive.writestr("candles/broken.csv.gz", b"no gzip")
        archive.writestr("candles/empty.csv", b"")
    (tmp_path / "a.zip").write_bytes(held.getvalue())
    assert archives.archive_members(spark, str(tmp_path)).count() == 43
    found = archives.read_candle_archives(spark, str(tmp_path), task_bytes=100)
    assert sorted((r["asset"], r["open"]) for r in found.collect()) == sorted((f"S{k}", 1.0) for k in range(40))
    members = archives.archive_members(spark, str(tmp_path)).repartition(4, "path", "member")
    assert len([n for n in members.rdd.glom().map(len).collect() if n]) > 1


@pytest.mark.parametrize("form", sinks.FORMATS)
def test_exports_rewrite_one_asset(spark, candles, tmp_path, form):
    path = f"file://{tmp_path}/{form}"
    sinks.write_panel(candles, path, form)
    same(sinks.read_panel(spark, path, candles.schema, form), candles)
    sinks.write_panel(candles.where("asset = 'AA' and pos < 5"), path, form, file_rows=2)
    same(sinks.read_panel(spark, path, candles.schema, form), candles.where("asset <> 'AA' or pos < 5"))
    one = sinks.read_panel(spark, path, candles.schema, form, assets=["D"])
    assert one.count() == 1 and re.search(r"PartitionFilters: \[[^\]]*asset", one._jdf.queryExecution().executedPlan().toString())
    with pytest.raises(ValueError):
        sinks.write_panel(candles, path, "xls")


def slow_asof(left, right, direction, exact, tolerance):
    out = []
    for i, key, t in left:
        inside = [(u, j) for j, k, u in right if k is not None and k == key and t is not None and u is not None and (u < t or exact and u == t if direction == "backward" else u > t or exact and u == t)]
        if direction == "backward":
            best = max(inside, default=None)
        else:
            best = min(inside, key=lambda x: (x[0], -x[1]), default=None)
        if best and tolerance is not None and abs(best[0] - t) > tolerance:
            best = None
        out.append((i, best[1] if best else None))
    return sorted(out)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("tolerance", [None, 3])
def test_asof_join_equals_brute_force(spark, direction, exact, tolerance):
    r = random.Random(7)
    draw = lambda n, first: [(first + k, r.choice(["a", "a", "a", "b", None]), r.choice([None, *range(60)])) for k in range(n)]
    left, right = draw(150, 0), draw(80, 1000)
    one, two = spark.createDataFrame(left, "i int, key string, t int"), spark.createDataFrame(right, "j int, key string, t int")
    for rows in (1_000_000, 9):
        found = asof_join(one, two, "t", ["key"], ["j"], tolerance, direction, exact, order=["j"], prefix="r_", stretch_rows=rows)
        assert sorted((x["i"], x["r_j"]) for x in found.collect()) == slow_asof(left, right, direction, exact, tolerance)
        inner = asof_join(one, two, "t", ["key"], ["j"], tolerance, direction, exact, order=["j"], prefix="r_", inner=True, stretch_rows=rows)
        assert inner.count() == sum(j is not None for _, j in slow_asof(left, right, direction, exact, tolerance))


def test_asof_join_odd_input(spark):
    left = spark.createDataFrame([(1, "a", datetime(2020, 1, 1)), (1, "a", datetime(2020, 1, 1)), (2, None, None)], "i int, _held string, t timestamp_ntz")
    right = spark.createDataFrame([("a", datetime(2019, 12, 31), None)], "_held string, t timestamp_ntz, v int")
    found = asof_join(left, right, "t", ["_held"], ["v"])
    assert found.columns == ["i", "_held", "t", "matched_t", "v"]
    assert sorted((r["i"], r["matched_t"], r["v"]) for r in found.collect() if r["i"] == 1) == [(1, datetime(2019, 12, 31), None)] * 2
    assert asof_join(left, right, "t", ["_held"], ["v"], tolerance=3600).where("matched_t is not null").count() == 0
    assert asof_join(left, right.limit(0), "t", ["_held"], ["v"]).count() == 3 and asof_join(left.limit(0), right, "t", ["_held"], ["v"]).count() == 0
    with pytest.raises(ValueError):
        asof_join(left, right.withColumn("i", F.lit(1)), "t", ["_held"], ["i"])


def test_sketches_keep_their_rank_error(spark):
    values = np.random.default_rng(3).normal(size=200_000)
    rows = spark.createDataFrame([(float(v), k % 9, "g") for k, v in enumerate(values.tolist())], "v double, slice int, g string").persist()
    ordered = np.sort(values)
    for size in (200, 4096):
        for q in (0.01, 0.5, 0.99):
            for slices in (None, "slice"):
                found = sketches.sketched_thresholds(rows, "v", ["g"], q, size, slices).first()
                assert found["n"] == len(values) and abs(np.searchsorted(ordered, found["threshold"]) / len(values) - q) <= 2 * sketches.rank_error(size)
    assert sketches.sketched_thresholds(rows.where("v > 1e9"), "v", ["g"], 0.5).count() == 0
    small = spark.createDataFrame([(1, v) for v in [3.0, 1.0, None, 2.0, float("nan"), 4.0]], "g int, v double")
    assert [tuple(r) for r in sketches.median_absolute_deviation(small, "v", ["g"]).collect()] == [(1, 4, 2.0, 1.0)]
    with pytest.raises(ValueError):
        sketches.sketch_by(small, "v", ["g"], 4)


def test_streamed_scores_equal_the_batch(spark, tmp_path):
    r = random.Random(9)
    rows = [(a, k, datetime(2020, 1, 1) + timedelta(days=k), None if k % 50 == 7 else 0.0 if k % 41 == 3 else float(np.exp(r.gauss(-9, 0.7)))) for a in ("x", "y") for k in range(330)]
    bars = spark.createDataFrame(rows, "asset string, pos int, begin timestamp_ntz, q double").persist()
    fixed = {"har_const": -0.5, "har_daily": 0.2, "har_weekly": 0.3, "har_monthly": 0.4, "har_smearing": 1.3}
    for low, high in ((0, 140), (100, 230), (230, 330)):  # the second file repeats bars, which are dropped
        bars.where(f"pos >= {low} and pos < {high}").coalesce(1).orderBy(F.desc("pos")).write.mode("append").parquet(f"{tmp_path}/bars")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    scores.use_state_store(spark)
    try:
        stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/bars")
        scored = scores.stream_shock_scores(stream, fixed, "q", initial=120, mad_window=60)
        scored.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    finally:
        spark.conf.set(name, before)
    columns = ["asset", "pos", "forecast_log_variance", "innovation", "innovation_scale", "shock_score"]
    got = {(x[0], x[1]): x[2:] for x in spark.read.parquet(f"{tmp_path}/out").select(columns).collect()}
    want = {(x[0], x[1]): x[2:] for x in har.innovations(bars, "q", 120, 20, 60, coefficients=fixed).select(columns).collect()}
    assert got.keys() == want.keys() and sum(v[-1] is not None for v in want.values()) > 200
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9) if None not in v else [x is None for x in got[k]] == [x is None for x in v]


def test_payloads_stay_small(spark, tmp_path, monkeypatch):
    """All orders in one month and priority: payloads are pages of them, and no row is lost or doubled."""
    rows = spark.range(0, 12_000, 1, 2).selectExpr("id AS o_orderkey", "id / 8D AS o_totalprice", "'O' AS o_orderstatus", "'1-URGENT' AS o_orderpriority", "timestamp_ntz'1995-01-02' AS o_orderdate")
    rows.write.parquet(f"file://{tmp_path}/orders.parquet")
    sizes, read = [], payloads.payload_columns

    def kept(given, *args):
        sizes.extend(r.n for r in given.select(F.size(F.from_json("payload", "history struct<data: array<array<string>>>")["history"]["data"]).alias("n")).collect())
        return read(given, *args)

    monkeypatch.setattr(payloads, "payload_columns", kept)
    got = ingest.payload_rows(spark, f"file://{tmp_path}").collect()
    assert sorted((r.orderkey, r.price) for r in got) == [(k, k / 8) for k in range(12_000)]
    assert sum(sizes) == 12_000 and max(sizes) <= 5000


def test_rows_leave_their_payload_behind(spark):
    """What goes with each row of a payload's table: names, not the table."""
    rows = spark.createDataFrame([(1, json.dumps({"t": {"columns": ["a"], "data": [[k] for k in range(3000)]}}))], "id int, payload string")
    got = payloads.payload_columns(rows, "t", ["a"])
    assert [(r.id, r.turn, r.a) for r in got.collect()] == [(1, k, str(k)) for k in range(3000)]
    carried = re.search(r"Generate posexplode\(.*?\), \[(.*?)\]", got._jdf.queryExecution().executedPlan().toString()).group(1)
    assert {c.split("#")[0] for c in carried.split(", ")} == {"id", "_names"}
