import json

import pytest

from barlake.operators import boards
from barlake.operators.latest import latest_documents
from barlake.plans import market
from barlake.sources.files import read_documents


def quote(**meta):
    return json.dumps({"chart": {"result": [{"meta": meta}], "error": None}})


def documents(spark, *rows, key="ticker"):
    return spark.createDataFrame(list(rows), f"{key} STRING, seq BIGINT, value STRING")


def one_quote(spark, text):
    row = boards.quote_changes(documents(spark, ("T", 1, text))).first()
    return row.price, row.prev_close, row.change_pct, row.currency, row.error


FAILED = (None, None, None, None, "fetch_failed")


@pytest.mark.parametrize("meta, expected", [
    ({"regularMarketPrice": 1.1, "previousClose": 1, "currency": "EUR"},
     (1.1, 1.0, 10.0, "EUR", None)),
    ({"regularMarketPrice": 1.5}, (1.5, 1.5, 0.0, "USD", None)),
    ({"regularMarketPrice": 0, "previousClose": 2.0}, (2.0, 2.0, 0.0, "USD", None)),
    ({"regularMarketPrice": None, "previousClose": 2.0}, (2.0, 2.0, 0.0, "USD", None)),
    ({"previousClose": 2.0, "currency": None}, (2.0, 2.0, 0.0, None, None)),
    ({"regularMarketPrice": 3.0, "previousClose": 0}, (3.0, 0.0, 0.0, "USD", None)),
    ({"regularMarketPrice": 0, "previousClose": 0}, (0.0, 0.0, 0.0, "USD", None)),
    ({"regularMarketPrice": 1.00005, "previousClose": 0.33335},
     (round(1.00005, 4), round(0.33335, 4), round((1.00005 - 0.33335) / 0.33335 * 100, 4), "USD",
      None)),
    ({"regularMarketPrice": 3.0, "previousClose": None}, FAILED),
    ({"regularMarketPrice": 0}, FAILED),
    ({"regularMarketPrice": "1.5", "previousClose": 1.0}, FAILED),
    ({"regularMarketPrice": 1.5, "previousClose": "1.0"}, FAILED),
    ({}, FAILED),
])
def test_quote_rules(spark, meta, expected):
    assert one_quote(spark, quote(**meta)) == expected


@pytest.mark.parametrize("text", [
    "{bad", "", "null", "[]", '{"chart":{"result":null}}', '{"chart":{"result":[]}}', '{}'])
def test_unreadable_quotes(spark, text):
    assert one_quote(spark, text) == FAILED


@pytest.mark.parametrize("meta, expected", [
    ({"regularMarketPrice": 101.0, "chartPreviousClose": 100.0, "previousClose": 50.0},
     (101.0, 1.0, 1.0, True)),
    ({"regularMarketPrice": 99.0, "chartPreviousClose": 0, "previousClose": 100.0},
     (99.0, -1.0, -1.0, False)),
    ({"regularMarketPrice": 99.0, "chartPreviousClose": None}, (99.0, 0.0, 0.0, True)),
    ({"regularMarketPrice": "99.0", "previousClose": 99.001}, (99.0, -0.0, -0.0, False)),
    ({"regularMarketPrice": 0}, (0.0, 0.0, 0.0, True)),
    ({"regularMarketPrice": 1.005, "previousClose": 1.0}, (round(1.005, 2), round(1.005 - 1.0, 2),
                                                           round((1.005 - 1.0) * 100, 2), True)),
])
def test_index_rules(spark, meta, expected):
    row = boards.index_changes(documents(spark, ("T", 1, quote(**meta)))).first()
    assert (row.val, row.chg, row.pct, row.pos) == expected


def test_indices_without_a_price_are_left_out(spark):
    docs = documents(spark, ("^GSPC", 1, quote(previousClose=1.0)), ("^DJI", 1, "{bad"),
                     ("^RUT", 1, quote(regularMarketPrice=5.0, previousClose=4.0)),
                     ("^VIX", 1, quote(regularMarketPrice=5.0)), ("OTHER", 1, quote()))
    assert [(row.sym, row.chg) for row in market.index_board(docs).collect()] == [
        ("RUSSELL 2K", 1.0), ("VIX", 0.0)]


def test_boards_list_every_key_in_order_and_take_the_newest_document(spark):
    docs = documents(
        spark, ("CL=F", 1, quote(regularMarketPrice=70.0, previousClose=60.0)),
        ("CL=F", 3, quote(regularMarketPrice=66.0, previousClose=60.0)),
        ("CL=F", 2, quote(regularMarketPrice=80.0)), ("GC=F", 1, quote(regularMarketPrice=1.0)),
        ("GC=F", 2, "{bad"), ("UNLISTED", 9, quote(regularMarketPrice=1.0)))
    got = [tuple(row) for row in market.commodity_board(docs.repartition(3)).collect()]
    assert got == [
        ("GOLD", *FAILED), ("OIL", 66.0, 60.0, 10.0, "USD", None), ("SILVER", *FAILED),
        ("NATGAS", *FAILED), ("COPPER", *FAILED), ("WHEAT", *FAILED)]
    assert [row.pair for row in market.forex_board(docs).collect()][:3] == [
        "EURUSD", "GBPUSD", "USDJPY"]


def test_latest_documents_of_listed_keys_only(spark):
    docs = documents(spark, *[(f"K{n % 5}", n, str(n)) for n in range(1000)]).repartition(6)
    got = latest_documents(docs, "ticker", "seq", ["K0", "K3", "K9"]).collect()
    assert sorted(row.value for row in got) == ["995", "998"]


def series(*pairs):
    return json.dumps({"observations": [{"date": d, "value": v} for d, v in pairs]})


def test_macro_pulse(spark):
    docs = documents(
        spark, ("FEDFUNDS", 1, series(("2024-02-01", "5.3"), ("2024-01-01", "5.2"))),
        ("FEDFUNDS", 2, series(("2024-01-15", "9"), ("2024-02-01", "5.33"), ("2024-02-01", "x"))),
        ("UNRATE", 1, series(("2024-01-01", "."))), ("GS10", 1, series()), ("VIXCLS", 1, "{}"),
        ("OTHER", 1, series(("2024-01-01", "1"))), key="series_id")
    got = {row.indicator: (row.label, row.value, row.date)
           for row in market.macro_pulse(docs).collect()}
    assert len(got) == 7
    assert got["fed_rate"] == ("Fed Funds Rate", "5.33", "2024-02-01")
    assert got["unemployment"] == ("Unemployment", ".", "2024-01-01")
    assert got["treasury_10y"] == ("10Y Treasury", None, None)
    assert got["vix"] == ("VIX", None, None) and got["dxy"] == ("USD Index (DXY)", None, None)


def test_newest_observations(spark):
    docs = documents(spark, *[("S", n, series((f"2024-01-{n:02d}", str(n)))) for n in range(1, 31)],
                     ("T", 1, series(("2024-01-01", "t"))), key="series_id")
    got = boards.newest_observations(boards.observations(docs), 3).orderBy("series_id", "place")
    assert [(row.series_id, row.value, row.place) for row in got.collect()] == [
        ("S", "30", 1), ("S", "29", 2), ("S", "28", 3), ("T", "t", 1)]


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "GC=F.json").write_text(json.dumps(
        json.loads(quote(regularMarketPrice=3.0, previousClose=2.0)), indent=2))
    (tmp_path / "^GSPC.json").write_text(quote(regularMarketPrice=9.0))
    docs = read_documents(spark, str(tmp_path), "ticker")
    assert market.commodity_board(docs).first().change_pct == 50.0
    assert market.index_board(docs).first().val == 9.0
