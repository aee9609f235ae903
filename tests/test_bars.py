import json
import random
from collections import defaultdict

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from barlake.dimensions import BAR_UNIVERSE, dimension
from barlake.operators import bars, latest
from barlake.plans import market
from barlake.schemas import BAR
from barlake.session import settings
from barlake.sources import files, tables

DAY = 86_400_000


def bar(symbol="A", date="2024-01-02", open=1.0, high=2.0, low=0.5, close=1.5, volume=10.0,
        vwap=1.2, trade_count=3, timestamp_ms=0):
    return (symbol, date, open, high, low, close, volume, vwap, trade_count, timestamp_ms, 1,
            "polygon", True)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), BAR)


def documents(spark, **by_symbol):
    rows = [(symbol, text if isinstance(text, str) else json.dumps(text))
            for symbol, text in by_symbol.items()]
    return bars.parse_bar_documents(spark.createDataFrame(rows, "symbol STRING, value STRING"))


RESULT = {"t": 1704153599999, "o": 1, "h": 2.5, "l": 0.5, "c": 2, "v": 7.5, "vw": 1.9, "n": 4}


def test_document_bars_take_the_utc_date(spark):
    docs = documents(spark, A={"status": "OK", "results": [RESULT, {**RESULT, "t": 1704153600000}]})
    good, rejected = bars.bars_from_documents(docs, F.lit(9).cast("bigint"))
    rows = sorted(good.collect(), key=lambda row: row.timestamp_ms)
    assert tuple(rows[0]) == ("A", "2024-01-01", 1.0, 2.5, 0.5, 2.0, 7.5, 1.9, 4, 1704153599999, 9,
                              "polygon", True)
    assert rows[1].date == "2024-01-02" and rejected.count() == 0


def test_optional_and_required_bar_fields(spark):
    bare = {k: v for k, v in RESULT.items() if k not in ("vw", "n")}
    broken = {k: v for k, v in RESULT.items() if k not in ("o", "v")}
    docs = documents(spark, A={"results": [bare]}, B={"results": [broken]})
    good, rejected = bars.bars_from_documents(docs)
    assert [(row.symbol, row.vwap, row.trade_count) for row in good.collect()] == [
        ("A", None, None)]
    assert [(row.symbol, row.reason) for row in rejected.collect()] == [("B", "open,volume")]
    with pytest.raises(PySparkException, match="open,volume"):
        bars.bars_from_documents(docs, strict=True)[0].collect()


def test_documents_without_bars_show_up_as_missing(spark):
    docs = documents(spark, A={"results": [RESULT]}, B={"status": "ERROR", "error": "x",
                                                        "results": [RESULT]},
                     C={"status": "OK"}, D={"results": []}, E="{bad", Z={"results": [RESULT]})
    universe = spark.createDataFrame([(s,) for s in "ABCDEF"], "symbol STRING")
    good, _ = bars.bars_from_documents(docs)
    assert sorted(row.symbol for row in bars.missing_symbols(universe, good).collect()) == list(
        "BCDEF")
    assert [row.symbol for row in bars.in_universe(good, universe).collect()] == ["A"]


def test_landing_writes_nulls_and_counts_while_writing(spark, tmp_path):
    bare = {k: v for k, v in RESULT.items() if k != "vw"}
    texts = spark.createDataFrame(
        [("AAPL", json.dumps({"results": [RESULT, bare]})),
         ("XX", json.dumps({"results": [RESULT]}))], "symbol STRING, value STRING")
    universe = dimension(spark, [(symbol,) for symbol in BAR_UNIVERSE], ["symbol"])
    path = str(tmp_path / "bronze")
    for docs in (texts, bars.parse_bar_documents(texts)):
        rows, missing = market.land_bars(docs, universe, path, F.lit(9).cast("bigint"))
    assert rows == 2 and missing.count() == len(BAR_UNIVERSE) - 1
    lines = [json.loads(row.value) for row in spark.read.text(path).collect()]
    assert len(lines) == 2 and all(list(line) == BAR.fieldNames() for line in lines)
    assert sorted(str(line["vwap"]) for line in lines) == ["1.9", "None"]
    assert files.read_bars(spark, path).schema == BAR
    inferred = dict(files.read_bars(spark, path, schema=None).dtypes)
    assert inferred["date"] == "string" and inferred["volume"] == "double"


def test_landed_files_are_small_and_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "LINES_PER_FILE", 300)
    texts = spark.createDataFrame(
        [("A", json.dumps({"results": [{**RESULT, "t": DAY * day, "o": day / 7} for day in range(1000)]}))],
        "symbol STRING, value STRING").coalesce(1)
    path = tmp_path / "bronze"
    rows, missing = market.land_bars(texts, texts, str(path), F.lit(9).cast("bigint"))
    landed = sorted(path.glob("part-*"))
    assert rows == 1000 and missing.count() == 0 and len(landed) == 4
    assert all(name.name.endswith(".json.gz") for name in landed)
    lines = [json.loads(line.value) for line in spark.read.text(str(path)).collect()]
    assert sorted(line["open"] for line in lines) == [day / 7 for day in range(1000)]
    assert files.read_bars(spark, str(path)).agg(F.sum("timestamp_ms")).first()[0] == DAY * 499_500
    assert files.read_bars_checked(spark, str(path))[1].count() == 0
    assert sum(file.stat().st_size for file in landed) < sum(len(json.dumps(line)) for line in lines) / 4


def test_landing_does_not_store_the_documents_for_a_join(spark, tmp_path, monkeypatch):
    texts = spark.createDataFrame(
        [(s, json.dumps({"results": [RESULT] * 2})) for s in ("A", "B", "X", None)], "symbol STRING, value STRING")
    universe = spark.createDataFrame([("A",), ("B",), ("B",), ("C",), (None,)], "symbol STRING")
    joined = {}
    for bound in (5, 4):
        monkeypatch.setattr(bars, "SENT_SYMBOLS", bound)
        with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
            listed = bars.in_counted_universe(texts, universe)
            joined[bound] = listed._jdf.queryExecution().executedPlan().toString()
            rows, missing = market.land_bars(texts, universe, str(tmp_path / f"bronze{bound}"))
            assert sorted(row.symbol for row in listed.collect()) == ["A", "B"]
            assert rows == 4 and {row.symbol for row in missing.collect()} == {"C", None}
    assert "BroadcastHashJoin" in joined[5] and "hashpartitioning" not in joined[5]
    assert "SortMergeJoin" in joined[4]


def test_symbols_are_read_from_the_beginnings_of_lines(spark, tmp_path):
    odd = ["A", 'say "x", "date":1', ',"', '\\', '\\"', 'a,\\"b', "}", "{}", "", " ", "\n", "é\u2028", None]
    rows = frame(spark, *[bar(symbol, open=value) for symbol in odd for value in (1.0, 2.0)])
    files.write_json_lines(rows, str(tmp_path / "bronze"))
    got = files.read_bar_symbols(spark, str(tmp_path / "bronze"))
    assert sorted(map(repr, (row.symbol for row in got.collect()))) == sorted(map(repr, odd))
    # Lines are made distinct before they are parsed, also below a distinct of symbols.
    plan = got.distinct()._jdf.queryExecution().executedPlan().toString()
    assert plan.index("from_json") < plan.index("keys=[begin")


def test_documents_are_read_from_files_by_ticker(spark, tmp_path):
    (tmp_path / "BRK.B.json").write_text(json.dumps({"status": "OK", "results": [RESULT]}, indent=1))
    (tmp_path / "^X Y.json").write_text(json.dumps({"status": "OK"}))
    docs = files.read_bar_documents(spark, str(tmp_path))
    assert sorted(row.symbol for row in docs.collect()) == ["BRK.B", "^X Y"]
    assert [row.symbol for row in bars.bars_from_documents(docs)[0].collect()] == ["BRK.B"]


@pytest.mark.parametrize("volume, kept", [(0.4, 0), (2.5, 2), (3.5, 4), (1.7, 2)])
def test_silver_tests_before_it_casts(spark, volume, kept):
    assert bars.silver_bars(frame(spark, bar(volume=volume))).first().volume == kept


@pytest.mark.parametrize("change", [
    {"high": 0.5, "low": 0.5}, {"low": -3.0}, {"high": -1.0, "low": -2.0}, {"vwap": -1.0},
    {"close": float("nan")}])
def test_silver_keeps(spark, change):
    rows = frame(spark, bar(**change))
    assert bars.silver_bars(rows).count() == 1 and bars.rejected_bars(rows).count() == 0


@pytest.mark.parametrize("change, reason", [
    ({"high": None}, "high_not_below_low"), ({"symbol": None}, "symbol_present"),
    ({"close": 0.0}, "close_positive"), ({"open": 0.0}, "open_positive"),
    ({"volume": 0.0}, "volume_positive"), ({"volume": -1.0}, "volume_positive"),
    ({"high": 0.1}, "high_not_below_low"),
    ({"close": None, "volume": 0.0}, "close_positive,volume_positive")])
def test_silver_drops(spark, change, reason):
    rows = frame(spark, bar(**change))
    assert bars.silver_bars(rows).count() == 0
    assert bars.rejected_bars(rows).first().reason == reason


@pytest.mark.parametrize("change", [{"date": "2024-13-01"}, {"trade_count": 3_000_000_000},
                                    {"volume": 1e19}])
def test_silver_fails_on_values_that_do_not_fit(spark, change):
    with pytest.raises(PySparkException):
        bars.silver_bars(frame(spark, bar(**change))).collect()


def test_silver_schema_and_duplicates(spark):
    silver = bars.silver_bars(frame(spark, bar(), bar()))
    assert silver.count() == 2
    assert silver.dtypes == [
        ("symbol", "string"), ("trade_date", "date"), ("open", "double"), ("high", "double"),
        ("low", "double"), ("close", "double"), ("volume", "bigint"), ("vwap", "double"),
        ("trade_count", "int"), ("source", "string"), ("adjusted", "boolean"),
        ("processed_at", "timestamp")]


def test_refresh_replaces_the_table_and_a_failed_one_leaves_it(spark, tmp_path):
    place = str(tmp_path / "silver")
    market.refresh_silver(frame(spark, bar("A")), "silver_t", place)
    market.refresh_silver(frame(spark, bar("B"), bar("C")), "silver_t", place)
    assert sorted(row.symbol for row in spark.table("silver_t").collect()) == ["B", "C"]
    with pytest.raises(PySparkException):
        market.refresh_silver(frame(spark, bar("D", date="bad")), "silver_t", place)
    assert spark.table("silver_t").count() == 2
    builds = [row.name for row in spark.catalog.listTables() if row.name.startswith("silver_t__")]
    # The build before is left for those who still read it; older ones go once they are old enough.
    assert len(builds) == 2
    assert sorted(path.name for path in (tmp_path / "silver").iterdir()) == sorted(
        name.rpartition("__")[2] for name in builds)
    market.refresh_silver(frame(spark, bar("E")), "silver_managed")
    assert market.symbol_list(spark.table("silver_managed")).first().symbol == "E"


def test_a_reader_of_the_build_before_keeps_its_files(spark, tmp_path):
    place = str(tmp_path / "silver")
    tables.refresh_table(frame(spark, bar("A")).select("symbol"), "kept_t", ["symbol"], place, keep_seconds=0)
    reader = spark.table("kept_t")
    assert reader.inputFiles()
    tables.refresh_table(frame(spark, bar("B")).select("symbol"), "kept_t", ["symbol"], place, keep_seconds=0)
    assert [r.symbol for r in reader.collect()] == ["A"]
    for name in "CD":
        tables.refresh_table(frame(spark, bar(name)).select("symbol"), "kept_t", ["symbol"], place, keep_seconds=0)
    assert [r.symbol for r in spark.table("kept_t").collect()] == ["D"]
    builds = [row.name for row in spark.catalog.listTables() if row.name.startswith("kept_t__")]
    assert len(builds) == 2


def test_lines_that_are_no_json_are_rejected(spark, tmp_path):
    (tmp_path / "bars.json").write_text(
        '{"symbol":"A","open":1.5}\n{"symbol":"B",\n\n  \n[1]\n7\n{"symbol":"C","open":"x"}\n{}\n')
    rows, rejected = files.read_bars_checked(spark, str(tmp_path / "bars.json"))
    assert [(r.symbol, r.open) for r in rows.collect()] == [("A", 1.5), (None, None)]
    assert rows.columns == BAR.names
    assert sorted(r.malformed for r in rejected.collect()) == ['7', '[1]', '{"symbol":"B",', '{"symbol":"C","open":"x"}']
    assert {r.file for r in rejected.collect()} == {"bars.json"}


def test_symbol_filter_reaches_the_scan(spark, tmp_path):
    market.refresh_silver(frame(spark, bar("A"), bar("B")), "silver_p", str(tmp_path / "s"))
    report = market.symbol_bars(spark.table("silver_p"), "a", 5)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(symbol,A)" in plan and "TakeOrderedAndProject" in plan
    assert "ReadSchema: struct<symbol:string>" in market.symbol_list(
        spark.table("silver_p"))._jdf.queryExecution().executedPlan().toString()
    assert [row.trade_date for row in report.collect()] == ["2024-01-02"]


def test_bronze_table_is_created_once_and_appended_to(spark, tmp_path):
    name, place = "lake.ticks", str(tmp_path / "ticks")
    rows = spark.createDataFrame(
        [("A", 1.0, 2.0, 3, 4, 5, "buy", "binance")],
        "symbol STRING, price DOUBLE, quantity DOUBLE, trade_id BIGINT, timestamp_ms BIGINT, "
        "ingested_at_ms BIGINT, side STRING, source STRING").withColumn(
            "day", F.lit("2024-01-02").cast("date"))
    for _ in range(2):
        tables.ensure_table(spark, name, location=place)
        tables.append_rows(rows.select("day", *rows.columns[:-1]), name)
    assert spark.table(name).count() == 2
    plan = spark.table(name).filter("day = '2024-01-03'")._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [isnotnull(day" in plan.toString()


def random_bars(count, seed):
    """Half of all bars on one symbol, most of those on one day, with exact duplicates."""
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        hot = rng.random() < 0.5
        day = 5 if hot and rng.random() < 0.7 else rng.randrange(0, 12)
        value = float(rng.randrange(1, 40))
        rows.append(bar(symbol="HOT" if hot else rng.choice(["A", "B", "C", None]),
                        date=f"1970-01-{day + 1:02d}", open=value, high=value + 1,
                        vwap=rng.choice([None, 1.0]), trade_count=rng.choice([None, 1, 2]),
                        timestamp_ms=day * DAY + rng.randrange(3) * 1000))
    return rows


@pytest.mark.parametrize("cap", [1, 7, 40, 120, 100_000])
def test_capped_history_equals_ranking(spark, cap):
    rows = random_bars(1500, cap)
    by_symbol = defaultdict(list)
    for row in rows:
        if "1970-01-03" <= row[1] <= "1970-01-10":
            by_symbol[row[0]].append(row)
    last = lambda value: (value is None, value or 0)
    key = lambda r: (r[9], r[2], r[3], r[4], r[5], r[6], last(r[7]), last(r[8]))
    expected = sorted(repr(row) for group in by_symbol.values()
                      for row in sorted(group, key=key)[:cap])
    got = bars.capped_history(frame(spark, *rows), "1970-01-03", "1970-01-10", cap)
    assert sorted(repr(tuple(row)) for row in got.collect()) == expected


def test_cap_reached_exactly_at_the_end_of_a_day(spark):
    rows = [bar(timestamp_ms=day * DAY, date=f"1970-01-0{day + 1}") for day in (0, 0, 1, 1, 2)]
    got = bars.capped_history(frame(spark, *rows), "1970-01-01", "1970-01-09", 2).collect()
    assert [row.timestamp_ms for row in got] == [0, 0]


@pytest.mark.parametrize("limit, shares", [(1, 1), (3, 4), (10, 64)])
def test_top_per_key_equals_ranking(spark, limit, shares):
    rng = random.Random(limit)
    rows = [("HOT" if rng.random() < 0.5 else rng.choice("ABC"), rng.random()) for _ in range(800)]
    expected = sorted((key, value, place + 1) for key in {row[0] for row in rows}
                      for place, value in enumerate(
                          sorted((v for k, v in rows if k == key), reverse=True)[:limit]))
    got = latest.top_per_key(spark.createDataFrame(rows, "k STRING, v DOUBLE").repartition(5),
                             ["k"], [F.col("v").desc()], limit, shares)
    assert sorted(tuple(row) for row in got.collect()) == expected


def test_previous_close_follows_every_bar(spark):
    silver = bars.silver_bars(frame(
        spark, bar(date="2024-01-05", close=4.0), bar(date="2024-01-02", close=2.0),
        bar(date="2024-01-05", close=5.0, volume=99.0), bar(date="2024-01-09", close=5.0),
        bar("B", close=7.0)))
    got = latest.previous_close(silver).orderBy("symbol", "trade_date", "close").collect()
    assert [(row.close, row.prev_close, row.change, row.change_pct) for row in got] == [
        (2.0, None, None, None), (4.0, 2.0, 2.0, 100.0), (5.0, 4.0, 1.0, 25.0),
        (5.0, 5.0, 0.0, 0.0), (7.0, None, None, None)]


def test_sample_is_the_same_every_time(spark):
    rows = frame(spark, *random_bars(200, 1))
    assert market.sample_bars(rows).collect() == market.sample_bars(rows.repartition(9)).collect()


def test_copies_of_one_row_are_dealt_to_all_shares(spark):
    rows = spark.createDataFrame([("a", 1)] * 1000, "k STRING, v INT")
    plan = latest.top_per_key(rows, ["k"], [F.col("v")], 10, 8)
    assert plan.count() == 10
    shares = rows.withColumn("s", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(8)))
    assert shares.groupBy("s").count().agg(F.max("count")).first()[0] < 300


def test_append_gathers_a_partition_into_few_files(spark, tmp_path):
    tables.ensure_table(spark, "gathered", "v BIGINT, day STRING", ["day"], str(tmp_path / "g"))
    rows = spark.range(0, 4000, 1, 16).select(
        F.col("id").alias("v"), (F.col("id") % 3).cast("string").alias("day"))
    tables.append_rows(rows, "gathered")
    assert spark.table("gathered").count() == 4000
    files = [len(list(day.glob("*.parquet"))) for day in (tmp_path / "g").glob("day=*")]
    assert len(files) == 3 and max(files) <= 2


def test_capped_history_reaches_from_its_fixed_start_to_today(spark):
    rows = frame(spark, bar("A", date="2023-12-31", timestamp_ms=1703980800000),
                 bar("A", date="2024-01-02", timestamp_ms=1704153600000))
    assert [row.date for row in bars.capped_history(rows).collect()] == ["2024-01-02"]


def test_compaction_replaces_only_the_partitions_it_gets(spark, tmp_path):
    rows = spark.range(0, 3000, 1, 16).select("id", (F.col("id") % 2).cast("string").alias("day"))
    rows.write.partitionBy("day").parquet(str(tmp_path / "stream"))
    stream = spark.read.parquet(str(tmp_path / "stream"))
    for day in ("0", "1", "1"):
        tables.compact_partitions(stream.filter(F.col("day") == day), str(tmp_path / "compact"))
    done = spark.read.parquet(str(tmp_path / "compact"))
    assert done.count() == 3000
    assert len(list((tmp_path / "stream").rglob("*.parquet"))) == 32
    assert len(list((tmp_path / "compact").rglob("*.parquet"))) <= 4
