"""Versions, snapshots, supplier reads, membership files, reports."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessaro.operators import gates, membership, quality
from tessaro.schemas import TABLES, conform, row_digest, schema
from tessaro.sources import catalog, identity, membership_file, raw_store, report, supplier

DAY = dt.date(2020, 1, 2)
BAR = (DAY, "600000.SH", 1.0, 1.0, 1.0, 1.0, 100, 100.0, "unadjusted", "tushare", dt.datetime(2020, 1, 3))


def bars(spark, n=3):
    return spark.createDataFrame([(DAY + dt.timedelta(days=k), *BAR[1:]) for k in range(n)], schema("daily_bar"))


def test_versions_are_content_addressed_and_current_moves(spark, tmp_path):
    root = str(tmp_path / "catalog")
    one = catalog.publish(spark, root, {"daily_bar": bars(spark)})
    assert catalog.publish(spark, root, {"daily_bar": bars(spark).repartition(3)}) == one
    two = catalog.publish(spark, root, {"daily_bar": bars(spark, 4)})
    assert two != one and catalog.Dataset(spark, root).version == two
    old = catalog.Dataset(spark, root, one)
    assert old.read("daily_bar").count() == 3 and old.verify() == []
    assert old.query("SELECT count(*) AS n FROM {daily_bar} WHERE symbol = :s", s="600000.SH").first().n == 3
    with pytest.raises(ValueError):
        old.read("adjusted_bar")


def test_a_blocked_publication_leaves_current(spark, tmp_path):
    root = str(tmp_path / "catalog")
    one = catalog.publish(spark, root, {"daily_bar": bars(spark)})
    issues = spark.createDataFrame([("WARNING", "invalid_ohlc")], "severity string, code string")
    with pytest.raises(catalog.PublicationBlocked):
        catalog.publish(spark, root, {"daily_bar": bars(spark, 5)}, issues)
    assert catalog.Dataset(spark, root).version == one
    with pytest.raises(ValueError):
        conform(bars(spark).select("symbol", "trade_date"), "daily_bar")


def test_bootstrap_has_all_tables(spark, tmp_path):
    root = str(tmp_path / "catalog")
    days = spark.createDataFrame([(DAY, True)], schema("trading_calendar"))
    master = spark.createDataFrame([("600000.SH", "x", "SH", "sh_main", DAY, None, "L")], schema("security_master"))
    catalog.bootstrap(spark, root, days, master)
    d = catalog.Dataset(spark, root)
    assert set(d.manifest["tables"]) == set(TABLES) and d.read("daily_bar").count() == 0 and d.read("security_master").count() == 1


def test_raw_snapshots_verify_and_hide_secrets(spark, tmp_path):
    root = str(tmp_path / "raw")
    key = raw_store.request_key("daily", ["b", "a"], "2020", "2021", {"token": "x"})
    assert key == raw_store.request_key("daily", ["a", "b"], "2020", "2021", {"token": "y"}) != raw_store.request_key("daily", ["a"], "2020", "2021")
    m = raw_store.save(spark, root, bars(spark), "tushare", "daily", key, {"token": "x", "adj": 1})
    assert m["params"] == {"token": "***", "adj": 1} and raw_store.verify(spark, m) == []
    bars(spark, 1).write.mode("overwrite").parquet(m["path"] + "/data.parquet")
    assert raw_store.verify(spark, m) == ["content_differs"]
    path = str(tmp_path / "a.json")
    raw_store.write_once(spark, path, {"b": 1, "a": 2})
    raw_store.write_once(spark, path, {"a": 2, "b": 1})
    with pytest.raises(FileExistsError):
        raw_store.write_once(spark, path, {"a": 3})


def test_response_contract(spark):
    b = bars(spark).select("symbol", "trade_date")
    assert raw_store.response_faults(b, ["600000.SH"], "2020-01-01", "2020-01-31") == []
    assert raw_store.response_faults(b, ["600000.SH", "000001.SZ"], "2020-01-03", "2020-01-31", limit=3) == ["truncated", "missing_symbols", "outside_window"]
    assert raw_store.response_faults(b.limit(0), ["600000.SH"], "2020-01-01", "2020-01-31") == ["empty"]


def test_windows_and_retries():
    assert supplier.windows(dt.date(2001, 3, 1), dt.date(2011, 1, 5)) == [(dt.date(2001, 3, 1), dt.date(2005, 12, 31)), (dt.date(2006, 1, 1), dt.date(2010, 12, 31)), (dt.date(2011, 1, 1), dt.date(2011, 1, 5))]
    tried, slept = [], []

    def passing():
        tried.append(1)
        if len(tried) < 3:
            raise supplier.TransientError
        return "ok"

    assert supplier.with_retry(passing, sleep=slept.append) == "ok" and slept == [1.0, 2.0]
    with pytest.raises(ZeroDivisionError):
        supplier.with_retry(lambda: 1 / 0, sleep=slept.append)
    empty = lambda *a: []
    full = lambda *a: [(1,)]
    assert supplier.first_available(empty, full)("e", "s", DAY, DAY) == [(1,)]
    with pytest.raises(supplier.EmptyResponse):
        supplier.first_available(empty)("e", "s", DAY, DAY)


def test_membership_file(spark, tmp_path):
    path = tmp_path / "members.csv"
    path.write_text("symbol,effective_from,effective_to,announcement_date,reason\n600000.SH,20200101,,20191220,\nbad,2020-01-01,2020-02-01,2019-12-20,x\n000001.SZ,20200201,20200101,20191220,y\n")
    f = membership_file.facts(membership_file.read_rows(spark, str(path)), "U", "file", "http://x", "0" * 64)
    assert f.columns == schema("universe_membership").names
    found = {(r.symbol, p) for r in membership_file.fact_issues(f).collect() for p in r.problems}
    assert found == {("600000.SH", "unknown_reason"), (None, "non_canonical_symbol"), (None, "unknown_reason"), ("000001.SZ", "unknown_reason"), ("000001.SZ", "end_precedes_start")}
    assert [r.code for r in membership_file.fact_issues(f.drop("source")).collect()] == ["UNIVERSE_SCHEMA_MISMATCH"]
    with pytest.raises(ValueError):
        membership_file.read_rows(spark, "x.xls")


def test_reports_refuse_unbounded_tables(spark):
    small = spark.createDataFrame([(1, 0.5), (2, None)], "a int, b double")
    html = report.report("t <x>", {"Table": report.table_html(small), "Curve": report.curve_svg(small.na.fill(1.0), "a", "b")}, {"n": 1})
    assert "&lt;x&gt;" in html and "<table>" in html and "<polyline" in html
    with pytest.raises(ValueError):
        report.table_html(spark.range(10), most=5)


def test_current_is_replaced_at_once(spark, tmp_path, monkeypatch):
    """A publication that stops before the pointer's rename leaves the old version readable, and one after it the new."""
    from tessaro.sources import catalog

    root = f"file://{tmp_path}/c"
    files = catalog.Files(spark, root)
    files.write(f"{root}/CURRENT", "one")

    class Stop(Exception):
        pass

    def stopped(self, new, path):
        raise Stop

    with monkeypatch.context() as m:
        m.setattr(catalog.Files, "replace", stopped)
        with pytest.raises(Stop):
            files.write(f"{root}/CURRENT", "two")
    assert files.read(f"{root}/CURRENT") == "one"
    files.write(f"{root}/CURRENT", "three")
    assert files.read(f"{root}/CURRENT") == "three"


def test_repairs_of_unknown_symbols_and_stale_drops(spark):
    from tessaro.operators import membership

    history = spark.createDataFrame([("U", "A", "2020-01-01", None), ("U", "B", "2020-01-01", "2020-05-01"), ("U", "B", "2020-06-01", None)], "universe_id string, symbol string, raw_from string, raw_to string")
    shape = "seq int, action string, universe_id string, symbol string, field string, old_value string, new_value string, row map<string, string>"
    fix = lambda *rows: spark.createDataFrame(list(rows), shape)
    apply = lambda *rows: sorted((r.symbol, r.raw_from, r.raw_to) for r in membership.apply_repairs(history, fix(*rows), ["universe_id", "symbol"]).collect())
    stale = (1, "drop_row", "U", "A", "raw_to", "2019-01-01", None, None)
    assert apply(stale) == [("A", "2020-01-01", None), ("B", "2020-01-01", "2020-05-01"), ("B", "2020-06-01", None)]
    assert apply((1, "drop_row", "U", "B", "raw_from", "2020-06-01", None, None)) == [("A", "2020-01-01", None), ("B", "2020-01-01", "2020-05-01")]
    twice = [(1, "set_field", "U", "A", "raw_to", "", "2021-01-01", None), (2, "set_field", "U", "A", "raw_to", "2021-01-01", "2022-01-01", None)]
    assert apply(*twice)[0] == ("A", "2020-01-01", "2022-01-01")
    with pytest.raises(ValueError, match="Z"):
        apply((1, "set_field", "U", "Z", "raw_to", "", "2021-01-01", None))


def test_native_layouts(spark):
    from tessaro.sources import layouts

    with pytest.raises(ValueError, match="missing columns"):
        layouts.dividends(spark.createDataFrame([("a",)], "`分红方案说明` string"), "600000.SH")
    with pytest.raises(ValueError, match="missing columns"):
        layouts.index_history(spark.createDataFrame([("a",)], "date string"), "X")
    with pytest.raises(ValueError, match="volume"):
        layouts.daily_bars(spark.createDataFrame([("a",)], "code string"), "baostock", "2024-01-01")
    rows = [("sz.000001", "2024-01-02", "1", "2", "1", "2", "100", "5"), ("sz.000001", "2024-01-02", "1", "2", "1", "2", "100", "5"), ("sz.000001", "2024-01-03", "1", "2", "1", "2", "0.5", "5"), ("x", "2024-01-03", "1", "2", "1", "2", "1", "5")]
    c = layouts.daily_bars(spark.createDataFrame(rows, "code string, date string, open string, high string, low string, close string, volume string, amount string"), "baostock", "2024-01-01")
    assert [(r.symbol, r.volume, r.amount, r.source) for r in c.valid.collect()] == [("000001.SZ", 100, 5.0, "baostock")]
    assert sorted(r.reason for r in c.rejected.collect()) == ["invalid_symbol", "invalid_volume"] and c.rejected.columns == ["code", "date", "open", "high", "low", "close", "volume", "amount", "reason"]
    assert [(r.rule, r.action) for r in c.audit.collect()] == [("duplicate_row_collapse", "collapsed")]


def test_throttle_waits_by_headers_alone():
    now, slept = [100.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    answers = iter([{}, {"X-RateLimit-IP-Remaining": "50"}, {"x-ratelimit-ip-remaining": "9"}, {"Retry-After": "7"}, {}, {"x-ratelimit-ip-remaining": "many"}, {}])
    fetch = supplier.throttled(lambda *request: ([request], next(answers)), supplier.Throttle(lambda: now[0], sleep))
    for _ in range(7):
        fetch("daily", "S1", dt.date(2020, 1, 1), dt.date(2020, 2, 1))
    # nothing said, enough left, little left, told to wait, said nothing, said no number
    assert slept == [1.0, 7.0, 1.0, 1.0]


def test_rows_outside_the_range_are_dropped():
    rows = [("S1", "20191231"), ("S1", "2020-01-01"), ("S1", dt.date(2020, 2, 1)), ("S1", "20200202"), ("S1", None)]
    window = dt.date(2020, 1, 1), dt.date(2020, 2, 1)
    assert list(supplier.within(rows, 1, *window)) == rows[1:3]
    assert list(supplier.within(rows, None, *window)) == rows


def test_experiment_identity(spark, tmp_path):
    days = spark.sql("SELECT DATE '2020-01-02' AS calendar_date, true AS is_trading_day")
    master = spark.createDataFrame([], schema("security_master"))
    version = catalog.Dataset(spark, str(tmp_path), catalog.bootstrap(spark, str(tmp_path), days, master))
    bundle = identity.snapshots(version, {"name": "m60"}, {"band": "0.02"})
    assert all(bundle["data_environment"].values()) and all(bundle["experiment"]["tables"].values())
    spec = {"dataset_version": version.version, "universe_version": "u", "data_acceptance_id": "a", "top": 10}
    one = identity.experiment_id(spec, bundle)
    assert one == identity.experiment_id(dict(reversed(spec.items())), dict(reversed(bundle.items())))
    assert one != identity.experiment_id(spec | {"top": 11}, bundle)
    assert one != identity.experiment_id(spec, identity.snapshots(version, {"name": "m60"}, {"band": "0.03"}))
    for floating in ({"dataset_version": "CURRENT"}, {"data_acceptance_id": "CURRENT_ACCEPTED"}, {"universe_version": None}):
        with pytest.raises(identity.NotFrozen):
            identity.experiment_id(spec | floating, bundle)


def test_registry_index_is_sorted(spark, tmp_path):
    for name, created in (("b", "2020-01-02"), ("a", "2020-01-02"), ("c", "2020-01-01")):
        raw_store.write_once(spark, f"{tmp_path}/runs/{name}/manifest.json", {"run_id": name, "created_at": created})
    (tmp_path / "runs" / "a" / "other.json").write_text('{"run_id": "x"}')
    assert [r.run_id for r in raw_store.registry_index(spark, f"{tmp_path}/runs", ["created_at", "run_id"]).collect()] == ["c", "a", "b"]


def test_schema_faults_name_order_and_types(spark):
    wanted = schema("trading_calendar")
    good = spark.createDataFrame([], wanted)
    assert quality.schema_faults(good, wanted) == []
    assert quality.schema_faults(good.select(*reversed(good.columns)), wanted)
    assert quality.schema_faults(good.select(*[good[c].cast("string") for c in good.columns]), wanted)


def test_delisting_needs_a_last_day(spark):
    facts = spark.createDataFrame([("A", "delisting"), ("B", "delisting"), ("C", "regular_rebalance"), ("D", "delisting")], "symbol string, reason string")
    listing = spark.createDataFrame([("A", dt.date(2020, 1, 1)), ("B", None), ("C", None)], "symbol string, delist_date date")
    assert sorted(r.symbol for r in membership.delisted_without_end(facts, listing).collect()) == ["B", "D"]


def test_gates_take_nulls_and_empty_tables(spark):
    fetches = spark.createDataFrame([("a", True, None, True), ("b", None, True, None), ("c", False, False, False), ("d", True, True, None)], "source string, required boolean, enabled boolean, ok boolean")
    assert {(r.code, r.subject) for r in gates.source_issues(fetches).collect()} == {("required_source_disabled", "a"), ("optional_source_failure", "b"), ("source_fetch_failed", "d")}
    none = spark.createDataFrame([], "trade_date date, symbol string, rank double, signal_price double, target_weight double, target_quantity long, selection_reason string")
    assert quality.portfolio_frame_faults(none).isEmpty()
    nulls = spark.createDataFrame([(dt.date(2020, 1, 1), None, None, None, None, None, None)], none.schema)
    assert {r.fault for r in quality.portfolio_frame_faults(nulls).collect()} == {"rank_not_positive_integer", "quantity_not_positive_integer", "price_not_positive", "weight_outside_unit", "reason_blank"}
    days = spark.createDataFrame([(dt.date(2020, 1, 2),)], "day date")
    listed = spark.createDataFrame([(dt.date(2020, 1, 2), True), (dt.date(2020, 1, 2), False), (dt.date(2020, 1, 3), False)], "day date, is_open boolean")
    assert [r.difference for r in gates.calendar_excerpt_differences(days, listed).collect()] == ["official_closed_dataset_open"]


def test_published_rows_are_in_order_and_a_symbol_lies_in_few_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    names = [f"{600000 + k}.SH" for k in range(40)]
    rows = [(DAY + dt.timedelta(days=k % 50), names[(k * 7) % 40], *BAR[2:]) for k in range(4000)]
    rows += [(DAY + dt.timedelta(days=k), names[3], *BAR[2:]) for k in range(4000)]  # half of the rows
    root = str(tmp_path / "catalog")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        catalog.publish(spark, root, {"daily_bar": spark.createDataFrame(rows, schema("daily_bar")).repartition(5)})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    path = f"{catalog.Dataset(spark, root).path}/daily_bar.parquet"
    assert tuple(catalog.out_of_order(spark, path, "daily_bar").first()) == (8000, 0)
    sizes, hit = [], {n: 0 for n in names}
    for file in sorted((tmp_path / "catalog").rglob("*.parquet")):
        if file.is_file() and file.name.startswith("part-"):
            meta = pq.read_metadata(file)
            for g in range(meta.num_row_groups):
                sizes.append(meta.row_group(g).num_rows)
                s = meta.row_group(g).column(1).statistics
                for n in names:
                    hit[n] += s.min <= n <= s.max
    assert len(sizes) >= 8 and max(sizes) < 2500  # the hot symbol is spread over several files
    assert all(hit[n] <= 2 for n in names if n != names[3])
    shuffled = str(tmp_path / "shuffled")
    spark.createDataFrame(rows, schema("daily_bar")).coalesce(1).write.parquet(shuffled)
    backwards = sum((b[1], b[0]) < (a[1], a[0]) for a, b in zip(rows, rows[1:], strict=False))
    assert catalog.out_of_order(spark, shuffled, "daily_bar").first().n_out_of_order == backwards > 0


def test_versions_as_views_are_read_only(spark, tmp_path):
    root = str(tmp_path / "catalog")
    one = catalog.Dataset(spark, root, catalog.publish(spark, root, {"daily_bar": bars(spark)}))
    two = catalog.Dataset(spark, root, catalog.publish(spark, root, {"daily_bar": bars(spark, 4)}))
    assert one.sql("SELECT count(*) AS n FROM daily_bar WHERE symbol = :s", s="600000.SH").first().n == 3
    assert two.sql(f"WITH o AS (SELECT trade_date FROM {one.attach()}.daily_bar) SELECT count(*) AS n FROM daily_bar LEFT ANTI JOIN o USING (trade_date)").first().n == 1
    assert spark.catalog.currentDatabase() == "default"
    for sql in ("INSERT INTO daily_bar VALUES (1)", "DROP TABLE daily_bar", "DROP DATABASE default", "TRUNCATE TABLE daily_bar", "FROM daily_bar INSERT OVERWRITE TABLE daily_bar SELECT *", "CREATE VIEW v AS SELECT 1", "DELETE FROM daily_bar", "SET a = b", "ALTER TABLE daily_bar RENAME TO x"):
        with pytest.raises(catalog.WritesRefused):
            one.sql(sql)
    assert one.read("daily_bar").count() == 3


def test_membership_files_are_imported_whole_or_not_at_all(spark, tmp_path):
    evidence = {"source": "file", "url": "http://x", "digest": "0" * 64, "effective_date": "2020-01-01", "announcement_date": "2019-12-20", "reason": "initial_constituent"}
    good = tmp_path / "good.csv"
    good.write_text("symbol,raw_effective_from,raw_effective_to,announcement_date,reason\n600000.SH,,,,\n000001.SZ,2020-03-01,2020-05-01,2020-02-01,regular_rebalance\n 600001.sh ,,,,\n")
    hashes = set()
    for kind in ("csv", "parquet"):
        written, digest = membership_file.import_file(spark, str(good), str(tmp_path / f"out.{kind}"), "csi300", **evidence)
        hashes.add(digest)
        assert [tuple(map(str, r[:7])) for r in written.orderBy("symbol").collect()] == [
            ("csi300", "000001.SZ", "2020-03-01", "2020-05-01", "2020-02-01", "removed", "regular_rebalance"),
            ("csi300", "600000.SH", "2020-01-01", "None", "2019-12-20", "active", "initial_constituent"),
            ("csi300", "600001.SH", "2020-01-01", "None", "2019-12-20", "active", "initial_constituent"),
        ]
    assert len(hashes) == 1  # the same facts, whatever the format
    bad = tmp_path / "bad.csv"
    bad.write_text('symbol,raw_effective_from,raw_effective_to,announcement_date,reason\n600000.SH,,,,\n600002.SH,2020-01-01\n600003.SH,2020-01-01,,,x,y,z\n600004.SH,soon,,,\nx,,,,\n')
    facts, rejected = membership_file.split_import(membership_file.read_rows(spark, str(bad)), "csi300", **evidence)
    assert [r.symbol for r in facts.collect()] == ["600000.SH"]
    assert sorted((str(r.symbol), r.problems) for r in rejected.collect()) == [("600004.SH", ["raw_effective_from_missing"]), ("None", ["corrupt_record"]), ("None", ["corrupt_record"]), ("None", ["non_canonical_symbol"])]
    with pytest.raises(membership_file.ImportRejected):
        membership_file.import_file(spark, str(bad), str(tmp_path / "none.parquet"), "csi300", **evidence)
    overlapping = tmp_path / "overlap.csv"
    overlapping.write_text("symbol,raw_effective_from,raw_effective_to,announcement_date,reason\n600000.SH,,,,\n600000.SH,2020-02-01,,,\n")
    with pytest.raises(membership_file.ImportRejected):
        membership_file.import_file(spark, str(overlapping), str(tmp_path / "none.parquet"), "csi300", **evidence)
    assert not (tmp_path / "none.parquet").exists()


def test_checks_don_t_break_each_other(spark, tmp_path):
    from tessaro.operators import acceptance

    days = spark.createDataFrame([(DAY + dt.timedelta(days=k),) for k in range(3)], "day date")
    spans = spark.createDataFrame([(DAY, DAY + dt.timedelta(days=9))], "start date, end date")
    issues = spark.createDataFrame([], "severity string, code string")
    names = spark.createDataFrame([("600000.SH",)], "symbol string")
    gone = str(tmp_path / "gone")
    bars(spark).write.parquet(gone)
    lost = spark.read.parquet(gone)
    for f in (tmp_path / "gone").glob("*.parquet"):
        f.unlink()
    end = (DAY + dt.timedelta(days=2)).isoformat()
    run = lambda tables: {r.code: (r.n_failures, r.passed, r.error) for r in acceptance.run_checks(tables, issues, days, names, DAY.isoformat(), end, spans).collect()}
    nothing = run({})
    assert list(nothing) == list(acceptance.CHECKS) and nothing["required_table_coverage"] == (9, False, None)
    assert nothing["calendar_coverage_evidence"] == (0, True, None) and nothing["source_role_health"] == (None, False, "KeyError")
    unread = run({"daily_bar": lost})
    assert unread["source_role_health"][:2] == (None, False) and unread["source_role_health"][2] != "KeyError"
    assert run({"daily_bar": bars(spark)})["source_role_health"] == (0, True, None)


def test_a_supplier_stream_goes_on_where_it_stopped(spark, tmp_path):
    """Two endpoints, one without a name; corrections within the overlap are taken over, older ones aren't read again."""

    def land(price):
        rows = [(n, DAY + dt.timedelta(days=k), price + k, k) for n in ("A", "B") for k in range(120)]
        df = spark.createDataFrame(rows, "symbol string, trade_date date, close double, volume long")
        df.filter("symbol = 'A'").coalesce(1).write.mode("overwrite").partitionBy("symbol").parquet(str(tmp_path / "land/first"))
        df.filter("symbol = 'B'").coalesce(1).write.mode("overwrite").partitionBy("symbol").parquet(str(tmp_path / "land/second"))

    out, at = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    options = {
        "connector": "tessaro.plans.streams:landed_first,tessaro.plans.streams:landed_second", "endpoint": f"file://{tmp_path}/land", "symbols": "A,B,C", "headers": "true", "addresses": "2",
        "columns": "symbol string, trade_date date, close double, volume long", "start": DAY.isoformat(), "overlap": "10",
    }
    first, second = DAY + dt.timedelta(days=49), DAY + dt.timedelta(days=99)
    assert supplier.latest_version(spark, out, options["columns"]).count() == 0
    land(100.0)
    supplier.read_on(spark, options | {"end": first.isoformat()}, out, at)
    supplier.read_on(spark, options | {"end": first.isoformat()}, out, at)  # nothing new
    assert supplier.latest_version(spark, out, options["columns"]).count() == 100
    land(200.0)  # the supplier corrects everything
    supplier.read_on(spark, options | {"end": second.isoformat()}, out, at)
    got = {(r.symbol, (r.trade_date - DAY).days): r.close for r in supplier.latest_version(spark, out, options["columns"]).collect()}
    assert got == {(n, k): (100.0 if k < 40 else 200.0) + k for n in ("A", "B") for k in range(100)}


def test_requests_are_dealt_by_address():
    o = {"symbols": "a,b,c", "start": "2000-01-01", "end": "2012-12-31", "addresses": "2", "overlap": "0"}
    stream = supplier.SupplierStream(o)
    assert stream.initialOffset() == {"until": "1999-12-31"} and stream.latestOffset() == {"until": "2012-12-31"}
    parts = stream.partitions(stream.initialOffset(), stream.latestOffset())
    asked = [r for p in parts for r in p.value]
    assert len(parts) == 2 and sorted(asked) == sorted(supplier.asked_for(o, dt.date(2000, 1, 1), dt.date(2012, 12, 31))) and len(asked) == 9
    assert stream.partitions({"until": "2012-12-31"}, {"until": "2012-12-31"}) == []


def test_an_index_history_is_split_and_an_empty_response_has_no_events(spark):
    from tessaro.sources import layouts

    rows = [("2020-01-02", "1", "2", "0.5", "1.5", "10", "x"), ("bad", "1", "2", "0.5", "1.5", "10", "x"), ("2020-01-03", "1", "--", "0.5", "1.5", "10", "x"), ("2020-01-06", "1", "2", "0.5", "1.5", None, "x")]
    frame = spark.createDataFrame(rows, "date string, open string, high string, low string, close string, volume string, reason_given string")
    good, bad = layouts.index_bars(frame, "sh000300", "2024-01-01")
    assert [tuple(map(str, r)) for r in good.collect()] == [("2020-01-02", "sh000300", "1.0", "2.0", "0.5", "1.5", "10.0", "0.0", "unadjusted", "akshare", "2024-01-01 00:00:00")]
    assert sorted((r.date, r.reason) for r in bad.collect()) == [("2020-01-03", "invalid_number"), ("2020-01-06", "invalid_number"), ("bad", "invalid_trade_date")]
    assert bad.columns == [*frame.columns, "reason"]
    empty = layouts.dividends(spark.range(1).select(), "600000.SH")
    assert empty.count() == 0 and "ex" in empty.columns


def rows_of(endpoint, symbol, start, end):
    return [(symbol, DAY, 1.0), (symbol, dt.date(1990, 1, 1), 2.0)]


def tables_of(endpoint, symbol, start, end):
    import pyarrow as pa

    if symbol == "N7":
        raise supplier.EmptyResponse(symbol)
    return pa.table({"symbol": [symbol] * 3, "trade_date": [DAY, None, dt.date(1990, 1, 1)], "close": [1, 2, 3]})


def test_a_batch_deals_requests_in_lots(spark, monkeypatch):
    """Tasks grow with requests by the hundred, and tables are rows like any other, also in a chain with tuples."""
    names = [f"N{k}" for k in range(450)]
    o = {"symbols": ",".join(names), "start": DAY.isoformat(), "end": (DAY + dt.timedelta(days=9)).isoformat(), "columns": "symbol string, trade_date date, close double"}
    reader = supplier.SupplierReader(o)
    parts = reader.partitions()
    assert [len(p.value) for p in parts] == [100] * 4 + [50] and [r[0] for p in parts for r in p.value] == names
    assert [len(p.value) for p in supplier.SupplierReader(o | {"requests_per_task": "1"}).partitions()] == [1] * 450
    assert "symbols" not in reader.__getstate__()["options"] and "symbols" in reader.options
    schema_of = supplier.SupplierSource(o).schema()
    schema_of = spark.createDataFrame([], schema_of).schema
    asked = [(n, DAY, DAY) for n in ("N6", "N7", "N8")]
    for chain, missing in ((tables_of, ["N7"]), (rows_of, [])):
        monkeypatch.setattr(supplier, "connector_of", lambda options, c=chain: c)
        got = list(supplier.fetched(o, schema_of, asked))
        rows = [r for b in got for r in b.to_pylist()] if chain is tables_of else [dict(zip(schema_of.names, r, strict=True)) for r in got]
        assert rows == [{"symbol": n, "trade_date": DAY, "close": 1.0} for n in ("N6", "N7", "N8") if n not in missing]
    for first, second in ((tables_of, rows_of), (rows_of, tables_of)):  # the first kind of response is that of the task
        monkeypatch.setattr(supplier, "connector_of", lambda options, a=first, b=second: lambda e, s, x, y: (a if s == "N6" else b)(e, s, x, y))
        got = list(supplier.fetched(o, schema_of, [r for r in asked if r[0] != "N7"]))
        assert [tuple(r.values()) for b in got for r in b.to_pylist()] == [("N6", DAY, 1.0), ("N8", DAY, 1.0)] if first is tables_of else got == [("N6", DAY, 1.0), ("N8", DAY, 1.0)]


def test_many_requests_are_longer_tasks_rather_than_more(spark):
    names = [f"N{k}" for k in range(60_000)]
    o = {"symbols": ",".join(names), "start": DAY.isoformat(), "end": (DAY + dt.timedelta(days=9)).isoformat()}
    parts = supplier.SupplierReader(o).partitions()
    assert len(parts) == supplier.MANY_TASKS and [r[0] for p in parts for r in p.value] == names
    assert len(supplier.SupplierReader(o | {"requests_per_task": "100"}).partitions()) == 600


def test_bars_land_by_one_shuffle_where_they_are_asked_for(spark, tmp_path, monkeypatch):
    """A lot's bars are made, sorted and written where its lines came to; an endpoint that isn't asked has nothing to land."""
    from tessaro.plans import market, streams

    sf, at = "/root/testdata/sf0.001", f"file://{tmp_path}"
    b = market.bars(spark, sf, F.expr("left(symbol, length(symbol) - 2)"))
    assert b.columns[0] == "lot" and b._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(b.drop("lot")) == key(market.bars(spark, sf))
    monkeypatch.setattr(streams, "work_folder", lambda spark, what: f"{at}/{what}")
    streams.landing(spark, sf, ("first",))
    assert [p.name for p in (tmp_path / "landing").iterdir()] == ["first"]
    files = [p for p in (tmp_path / "landing/first").glob("names=*/*.parquet")]
    assert len(files) == len({p.parent for p in files}) >= 1


@pytest.mark.parametrize("name", ["supplier_read", "supplier_retry"])
def test_queries_of_one_endpoint_land_that_one(spark, tmp_path, monkeypatch, name):
    from tessaro.plans import all_queries, streams

    monkeypatch.setattr(streams, "work_folder", lambda spark, what: f"file://{tmp_path}/{what}")
    assert all_queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    assert [p.name for p in (tmp_path / "landing").iterdir()] == ["first"]


def test_row_groups_are_read_once_for_neighbouring_requests(spark, tmp_path):
    from tessaro.plans import streams

    df = spark.createDataFrame([(n, DAY, 1.0, 1) for n in ("S112", "S113", "S114")], "symbol string, trade_date date, close double, volume long")
    df.withColumn("names", F.lit("S1xx")).coalesce(1).write.partitionBy("names").parquet(str(tmp_path / "first"))
    before = streams.row_groups.cache_info().misses
    for n in ("S112", "S113", "S113", "S114"):
        rows, _ = streams.landed_first(f"file://{tmp_path}", n, DAY, DAY)
        assert rows.column("symbol").to_pylist() == [n]
    assert streams.row_groups.cache_info().misses == before + 1


def test_landed_names_share_files(spark, tmp_path):
    """A response is the name's own rows, found among the names that share its file."""
    from tessaro.plans import streams

    names = ["S1", "S12", "S13", "S112"]
    df = spark.createDataFrame([(n, DAY + dt.timedelta(days=k), float(k), k) for n in names for k in range(3000)], "symbol string, trade_date date, close double, volume long")
    lots = df.selectExpr("*", "concat(left(symbol, length(symbol) - 2), 'xx') AS names").coalesce(1).sortWithinPartitions("names", "symbol", "trade_date")
    lots.write.option("parquet.block.row.count.limit", 2000).partitionBy("names").parquet(str(tmp_path / "first"))
    assert sorted(p.name for p in (tmp_path / "first").iterdir() if p.is_dir()) == ["names=S1xx", "names=Sxx", "names=xx"]
    for n in names:
        rows, _ = streams.landed_first(f"file://{tmp_path}", n, DAY, DAY)
        assert rows.column("symbol").unique().to_pylist() == [n] and rows.column("volume").to_pylist() == list(range(3000))
    for n in ("S14", "T1", "S99"):
        with pytest.raises(supplier.EmptyResponse):
            streams.landed_first(f"file://{tmp_path}", n, DAY, DAY)


def test_content_hash_is_of_counts_and_whole_sums(spark):
    rows = spark.range(300).select(F.col("id").alias("a"), F.when(F.col("id") % 7 > 0, F.col("id") / 3).alias("b"))
    digests = [r.h for r in rows.select(row_digest(["a", "b"]).alias("h")).collect()]
    plain = lambda xs: hashlib.sha256(json.dumps([str(len(xs)), *(str(sum(int(h[k : k + 15], 16) for h in xs) if xs else None) for k in (0, 15, 30, 45))]).encode()).hexdigest()
    assert catalog.content_hash(rows) == plain(digests)
    assert catalog.content_hash(rows.limit(0)) == plain([])


@pytest.mark.parametrize("name", ["raw_inventory", "content_hash", "version_views", "experiment_identity"])
def test_rows_that_are_read_often_are_made_once(spark, monkeypatch, name):
    from tessaro.plans import all_queries, market

    made, whole = spark.sparkContext.accumulator(0), market.bars

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    def bars(spark, sf_dir):
        rows = whole(spark, sf_dir)
        return rows.mapInArrow(counted, rows.schema)

    monkeypatch.setattr(market, "bars", bars)
    all_queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert made.value == whole(spark, "/root/testdata/sf0.001").count()


def test_a_report_makes_its_curves_once(spark, monkeypatch):
    from tessaro.plans import all_queries, market

    made, whole, sf = spark.sparkContext.accumulator(0), market.equity, "/root/testdata/sf0.001"

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    def equity(spark, sf_dir):
        rows = whole(spark, sf_dir)
        return rows.mapInArrow(counted, rows.schema)

    monkeypatch.setattr(market, "equity", equity)
    all_queries()["experiment_report"](spark, sf).collect()
    assert made.value == whole(spark, sf).count()
    made.add(-made.value)
    curves = spark.createDataFrame([(s, DAY + dt.timedelta(days=7 * k), 1.0 + k) for s in ("a", "b") for k in range(5)], "scenario string, week date, equity double")
    report.experiment("t", spark.createDataFrame([("a", 1)], "scenario string, fold_id int"), curves.mapInArrow(counted, curves.schema))
    assert made.value == 10
