"""The same queries as SQL over the same tables, written from the rules and not from the plans."""

from __future__ import annotations

# Shared views, each the SQL form of one adapter.

TICK = """
tick AS (
  SELECT upper(event_type) AS symbol, value AS price,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS quantity,
         event_id AS trade_id,
         epoch_us(ts) // 1000 - user_id % 8 * 250 AS timestamp_ms,
         epoch_us(ts) // 1000 AS ingested_at_ms,
         CASE WHEN user_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side
  FROM events)
"""

GOOD_TICK = TICK + """,
good AS (SELECT * FROM tick WHERE trade_id % 31 NOT IN (3, 11, 17))
"""

ENVELOPE = """
envelope AS (
  SELECT event_id AS seq,
         '"stream":"' || event_type || '@trade"' AS stream,
         concat_ws(',',
           CASE WHEN event_id % 20 = 1 THEN '"e":"aggTrade"' ELSE '"e":"trade"' END,
           CASE WHEN event_id % 20 <> 3 THEN '"s":"' || upper(event_type) || '"' END,
           CASE WHEN event_id % 20 <> 10 THEN '"t":' || event_id END,
           '"p":"' || CASE WHEN event_id % 20 = 2 THEN 'abc' ELSE value::VARCHAR END || '"',
           CASE WHEN event_id % 20 = 9 THEN '"q":null'
                ELSE '"q":"' || json_extract_string(props, '$.k') || '"' END,
           '"T":' || (epoch_us(ts) // 1000),
           CASE WHEN event_id % 20 = 6 THEN '"m":null'
                WHEN event_id % 20 = 8 THEN '"m":"false"'
                WHEN event_id % 20 = 7 THEN NULL
                WHEN user_id % 2 = 1 THEN '"m":true' ELSE '"m":false' END) AS parts
  FROM events),
message AS (
  SELECT seq,
         CASE WHEN seq % 20 = 4 THEN '{{' || stream || ',"data":{' || parts || '}}'
              WHEN seq % 20 = 5 THEN '{' || stream || '}'
              ELSE '{' || stream || ',"data":{' || parts || '}}' END AS value
  FROM envelope),
payload AS (
  SELECT seq, json_valid(value) AS is_json,
         CASE WHEN json_valid(value) THEN json_extract(value, '$.data') END AS data
  FROM message),
trade AS (
  SELECT seq, is_json,
         json_extract_string(data, '$.e') AS event,
         json_extract_string(data, '$.s') AS symbol,
         TRY_CAST(json_extract_string(data, '$.p') AS DOUBLE) AS price,
         TRY_CAST(json_extract_string(data, '$.q') AS DOUBLE) AS quantity,
         TRY_CAST(json_extract_string(data, '$.t') AS BIGINT) AS trade_id,
         TRY_CAST(json_extract_string(data, '$.T') AS BIGINT) AS timestamp_ms,
         CASE WHEN json_extract(data, '$.m')::VARCHAR = 'false' THEN 'buy' ELSE 'sell' END AS side
  FROM payload),
decoded AS (
  SELECT seq, symbol, price, quantity, trade_id, timestamp_ms, seq + 1000 AS ingested_at_ms, side
  FROM trade
  WHERE event = 'trade' AND symbol IS NOT NULL AND price IS NOT NULL AND quantity IS NOT NULL
    AND trade_id IS NOT NULL AND timestamp_ms IS NOT NULL)
"""

BAR = """
bar AS (
  SELECT CASE WHEN l_linenumber <> 7 THEN 'S' || l_suppkey END AS symbol,
         strftime(l_shipdate, '%Y-%m-%d') AS date,
         l_extendedprice AS open,
         l_extendedprice * (1 + l_tax) AS high,
         l_extendedprice * (1.05::DOUBLE - l_discount) AS low,
         CASE WHEN l_discount >= 0.10::DOUBLE THEN 0.0::DOUBLE
              ELSE l_extendedprice * (1 - l_discount) END AS close,
         l_quantity - 5.5::DOUBLE AS volume,
         CASE WHEN l_linenumber <> 3 THEN (l_extendedprice
              + CASE WHEN l_discount >= 0.10::DOUBLE THEN 0.0::DOUBLE
                     ELSE l_extendedprice * (1 - l_discount) END) / 2 END AS vwap,
         CASE WHEN l_linenumber <> 5 THEN l_partkey END AS trade_count,
         epoch_ms(l_shipdate) AS timestamp_ms,
         'polygon' AS source, true AS adjusted
  FROM lineitem)
"""

SILVER = BAR + """,
silver AS (
  SELECT symbol, date::DATE AS trade_date, open::DOUBLE AS open, high::DOUBLE AS high,
         low::DOUBLE AS low, close::DOUBLE AS close, volume::BIGINT AS volume,
         vwap::DOUBLE AS vwap, trade_count::INTEGER AS trade_count,
         source::VARCHAR AS source, adjusted::BOOLEAN AS adjusted
  FROM bar
  WHERE close > 0 AND volume > 0 AND open > 0 AND high >= low AND symbol IS NOT NULL)
"""

SILVER_ROWS = f"""
WITH {SILVER}
SELECT * REPLACE (trade_date::VARCHAR AS trade_date) FROM silver
"""

DOCUMENT_BAR = """
document_bar AS (
  SELECT 'S' || l_suppkey AS symbol, l_suppkey,
         strftime(l_shipdate, '%Y-%m-%d') AS date,
         l_extendedprice AS open, l_extendedprice * 1.5::DOUBLE AS high,
         l_extendedprice * 0.5::DOUBLE AS low,
         CASE WHEN second THEN l_extendedprice * (1 - l_discount)
              ELSE l_extendedprice * (1 + l_discount) END AS close,
         l_quantity AS volume,
         CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS vwap,
         CASE WHEN l_linenumber <> 5 THEN l_partkey END AS trade_count,
         epoch_ms(l_shipdate) + CASE WHEN second THEN 86399999 ELSE 0 END AS timestamp_ms,
         epoch_ms(l_shipdate) + CASE WHEN second THEN 86399999 ELSE 0 END + 1 AS ingested_at_ms,
         'polygon' AS source, true AS adjusted
  FROM lineitem CROSS JOIN (VALUES (false), (true)) AS half(second)
  WHERE l_linenumber NOT IN (1, 2) AND NOT (second AND l_linenumber = 4))
"""


FIRST_LINE = """
first_line AS (
  SELECT * FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) = 1)
"""


def candle(view: str, seconds: int, clock: str = "ingested_at_ms") -> str:
    """Candles of a tick view as the view `candle`, windows counted from 2026-01-01."""
    return f"""
candle AS (
  SELECT symbol,
         arg_min(price, ({clock}, trade_id)) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, ({clock}, trade_id)) AS close, sum(quantity) AS volume,
         count(*) AS trade_count, bucket + INTERVAL {seconds} SECOND AS timestamp
  FROM (SELECT *, time_bucket(INTERVAL {seconds} SECOND, make_timestamp({clock} * 1000),
                              TIMESTAMP '2026-01-01 00:00:00') AS bucket
        FROM {view})
  GROUP BY symbol, bucket)
"""


def candle_rows(seconds: int, clock: str = "ingested_at_ms") -> str:
    return f"""
WITH {TICK}, {candle('tick', seconds, clock)}
SELECT * REPLACE (timestamp::VARCHAR AS timestamp) FROM candle
"""


ILP = """
SELECT 'ohlcv_1m,symbol=' || symbol || ' open=' || open::VARCHAR || ',high=' || high::VARCHAR
       || ',low=' || low::VARCHAR || ',close=' || close::VARCHAR || ',volume=' || volume::VARCHAR
       || ',trade_count=' || trade_count || 'i ' || epoch_ms(timestamp) * 1000000 AS line
"""

# Candles of a drained stream: windows that end no later than the watermark.
CLOSED = """
WHERE timestamp <= (SELECT make_timestamp(max(ingested_at_ms) * 1000) FROM good)
                   - INTERVAL 10 SECOND
"""

# The listed keys of the boards.
FOREX = """('EURUSD', 'EURUSD=X', 0), ('GBPUSD', 'GBPUSD=X', 1), ('USDJPY', 'JPY=X', 2),
           ('USDCHF', 'CHF=X', 3), ('AUDUSD', 'AUDUSD=X', 4), ('USDCAD', 'CAD=X', 5),
           ('USDCNY', 'CNY=X', 6), ('USDINR', 'INR=X', 7)"""
COMMODITIES = """('GOLD', 'GC=F', 0), ('OIL', 'CL=F', 1), ('SILVER', 'SI=F', 2),
                 ('NATGAS', 'NG=F', 3), ('COPPER', 'HG=F', 4), ('WHEAT', 'ZW=F', 5)"""
INDICES = """('S&P 500', '^GSPC', 0), ('NASDAQ', '^IXIC', 1), ('DOW JONES', '^DJI', 2),
             ('RUSSELL 2K', '^RUT', 3), ('VIX', '^VIX', 4), ('NIKKEI 225', '^N225', 5)"""
SERIES = """('fed_rate', 'FEDFUNDS', 'Fed Funds Rate', 'click'),
            ('treasury_10y', 'GS10', '10Y Treasury', 'view'),
            ('cpi', 'CPIAUCSL', 'CPI Inflation', 'purchase'),
            ('unemployment', 'UNRATE', 'Unemployment', 'signup'),
            ('gdp_growth', 'A191RL1Q225SBEA', 'GDP Growth', 'error'),
            ('vix', 'VIXCLS', 'VIX', NULL), ('dxy', 'DTWEXBGS', 'USD Index (DXY)', NULL)"""


def quotes(listed: str, count: int) -> str:
    """Quote fields per event; a field that is absent or null is null here."""
    return f"""
listed(name, ticker, position) AS (VALUES {listed}),
field AS (
  SELECT ticker, event_id AS seq, event_id % 16 AS kind, event_id % 16 IN (12, 13) AS unreadable,
         CASE WHEN event_id % 16 = 1 THEN 0 WHEN event_id % 16 NOT IN (2, 3) THEN value END AS rmp,
         CASE WHEN event_id % 16 = 4 THEN 0 WHEN event_id % 16 NOT IN (5, 6)
              THEN value + 0.125::DOUBLE END AS pc,
         CASE WHEN event_id % 16 IN (4, 7) THEN 0 WHEN event_id % 16 NOT IN (6, 8, 9)
              THEN value + user_id % 5 - 2.0::DOUBLE END AS chart_pc,
         CASE event_id % 16 WHEN 10 THEN NULL WHEN 11 THEN 'USD' ELSE 'EUR' END AS ccy
  FROM events JOIN listed ON position = user_id % {count - 1}),
raw AS (
  SELECT *, coalesce(nullif(rmp, 0), pc) AS price_raw,
         CASE WHEN kind = 6 THEN coalesce(nullif(rmp, 0), pc) ELSE pc END AS prev_raw
  FROM field),
quote AS (
  SELECT ticker, seq, ok,
         CASE WHEN ok THEN CAST(printf('%.4f', price_raw) AS DOUBLE) END AS price,
         CASE WHEN ok THEN CAST(printf('%.4f', prev_raw) AS DOUBLE) END AS prev_close,
         CASE WHEN ok THEN CASE WHEN prev_raw = 0 THEN 0::DOUBLE ELSE
              CAST(printf('%.4f', (price_raw - prev_raw) / prev_raw * 100) AS DOUBLE)
              END END AS change_pct,
         CASE WHEN ok THEN ccy END AS currency,
         CASE WHEN NOT ok THEN 'fetch_failed' END AS error
  FROM (SELECT *, NOT unreadable AND price_raw IS NOT NULL AND prev_raw IS NOT NULL AS ok
        FROM raw)),
based AS (
  SELECT ticker, seq, rmp AS val, coalesce(nullif(chart_pc, 0), nullif(pc, 0), rmp) AS base
  FROM field WHERE NOT unreadable AND rmp IS NOT NULL),
index_change AS (
  SELECT ticker, seq, CAST(printf('%.2f', val) AS DOUBLE) AS val,
         CAST(printf('%.2f', val - base) AS DOUBLE) AS chg,
         CASE WHEN base = 0 THEN 0::DOUBLE ELSE
              CAST(printf('%.2f', (val - base) / base * 100) AS DOUBLE) END AS pct,
         val - base >= 0 AS pos
  FROM based),
newest AS (SELECT ticker, max(seq) AS seq FROM field GROUP BY ticker)
"""


def quote_board(name: str, listed: str, count: int) -> str:
    return f"""
WITH {quotes(listed, count)}
SELECT name AS {name}, price, prev_close, change_pct, currency,
       CASE WHEN price IS NULL THEN 'fetch_failed' END AS error
FROM listed LEFT JOIN (SELECT q.* FROM quote q JOIN newest n
                       ON q.ticker = n.ticker AND q.seq = n.seq) q
  ON listed.ticker = q.ticker
"""


OBSERVATION = f"""
series(indicator, series_id, label, event_type) AS (VALUES {SERIES}),
observation AS (
  SELECT series_id, event_id AS seq, place,
         strftime(ts::DATE - (1 - place)::INTEGER, '%Y-%m-%d') AS date,
         CASE WHEN place = 0 THEN value::VARCHAR || 'p' ELSE value::VARCHAR END AS value
  FROM events JOIN series USING (event_type) CROSS JOIN (VALUES (0), (1)) AS part(place)
  WHERE event_id % 10 NOT IN (7, 8)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY series_id
                               ORDER BY date DESC, seq DESC, place) AS rank
  FROM observation)
"""

BAR_TIES = """open NULLS LAST, high NULLS LAST, low NULLS LAST, close NULLS LAST,
              volume NULLS LAST, vwap NULLS LAST, trade_count NULLS LAST"""

BRONZE = """
SELECT symbol, price, quantity, trade_id, timestamp_ms, ingested_at_ms, side,
       'binance' AS source, strftime(make_timestamp(ingested_at_ms * 1000), '%Y-%m-%d') AS day
FROM good
"""

TICK_FAULT = """
CASE trade_id % 31 WHEN 3 THEN
  'symbol,price,quantity,trade_id,timestamp_ms,ingested_at_ms,side'
  WHEN 11 THEN 'symbol' ELSE 'price' END
"""

UNIVERSE = """
universe AS (
  SELECT 'S' || s_suppkey AS symbol FROM supplier
  UNION ALL SELECT 'IDLE' || s_suppkey FROM supplier WHERE s_suppkey % 10 = 3)
"""

ORACLES: dict[str, str] = {
    "decode_ticks": f"WITH {ENVELOPE} SELECT * FROM decoded",
    "rejected_envelopes": f"""
WITH {ENVELOPE}
SELECT seq, CASE WHEN NOT is_json THEN 'not_json' ELSE concat_ws(',',
         CASE WHEN symbol IS NULL THEN 'symbol' END, CASE WHEN price IS NULL THEN 'price' END,
         CASE WHEN quantity IS NULL THEN 'quantity' END,
         CASE WHEN trade_id IS NULL THEN 'trade_id' END,
         CASE WHEN timestamp_ms IS NULL THEN 'timestamp_ms' END) END AS reason
FROM trade
WHERE NOT is_json OR (event = 'trade' AND (symbol IS NULL OR price IS NULL OR quantity IS NULL
                                           OR trade_id IS NULL OR timestamp_ms IS NULL))""",
    "subscribed_ticks": f"WITH {ENVELOPE} SELECT * FROM decoded WHERE symbol IN ('CLICK', 'VIEW')",
    "topic_records": f"WITH {TICK} SELECT symbol AS key, * FROM tick",
    "bronze_ticks": f"WITH {GOOD_TICK} {BRONZE}",
    "rejected_ticks": f"""
WITH {TICK} SELECT trade_id AS "offset", {TICK_FAULT} AS reason
FROM tick WHERE trade_id % 31 IN (3, 11, 17)""",
    "bronze_table": f"WITH {GOOD_TICK} {BRONZE}",
    "progress_snapshot": f"""
WITH {TICK}
SELECT count(*) AS ticks, arg_max(symbol, (ingested_at_ms, trade_id)) AS latest_symbol,
       arg_max(price, (ingested_at_ms, trade_id)) AS latest_price FROM tick""",
    "ohlcv_1m": candle_rows(60),
    "ohlcv_1h": candle_rows(3600),
    "ohlcv_1m_event_time": candle_rows(60, "timestamp_ms"),
    "ohlcv_aligned_77s": candle_rows(77),
    "latest_candle": f"""
WITH {TICK}, {candle('tick', 3600)}
SELECT symbol, close AS price, volume, trade_count, open, high, low,
       timestamp::VARCHAR AS timestamp
FROM candle
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1""",
    "candles_for_symbol": f"""
WITH {TICK}, {candle('tick', 3600)}
SELECT * REPLACE (timestamp::VARCHAR AS timestamp) FROM (
  SELECT * FROM candle WHERE symbol = upper('click') ORDER BY timestamp DESC LIMIT 60)""",
    "stored_candles": candle_rows(3600),
    "stored_latest_candle": f"""
WITH {TICK}, {candle('tick', 3600)}
SELECT symbol, close AS price, volume, trade_count, open, high, low,
       timestamp::VARCHAR AS timestamp
FROM candle
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1""",
    "stored_candles_for_symbol": f"""
WITH {TICK}, {candle('tick', 3600)}
SELECT * REPLACE (timestamp::VARCHAR AS timestamp) FROM (
  SELECT * FROM candle WHERE symbol = upper('click') ORDER BY timestamp DESC LIMIT 60)""",
    "ilp_lines": f"WITH {TICK}, {candle('tick', 3600)} {ILP} FROM candle",
    "candle_summaries": f"""
WITH {TICK}, {candle('tick', 3600)}
SELECT symbol, timestamp::VARCHAR AS timestamp,
       printf('%s O=%.2f H=%.2f L=%.2f C=%.2f V=%.4f trades=%d',
              symbol, open, high, low, close, volume, trade_count) AS summary FROM candle""",
    "landed_document_bars": f"""
WITH {FIRST_LINE}, {DOCUMENT_BAR.replace("FROM lineitem", "FROM first_line")}
SELECT * EXCLUDE (l_suppkey) FROM document_bar WHERE l_suppkey % 5 <> 2""",
    "rejected_document_files": f"""
WITH {FIRST_LINE}
SELECT 'S' || l_suppkey AS symbol,
       CASE WHEN l_linenumber = 1 THEN '{{"status":"E' ELSE '{{"status":"O' END AS malformed
FROM first_line WHERE l_suppkey % 5 = 2""",
    "bar_documents": f"WITH {DOCUMENT_BAR} SELECT * EXCLUDE (l_suppkey) FROM document_bar",
    "rejected_document_bars": """
SELECT 'S' || l_suppkey AS symbol, epoch_ms(l_shipdate) + 86399999 AS timestamp_ms,
       'close' AS reason FROM lineitem WHERE l_linenumber = 4""",
    "landed_bars": f"""
WITH {DOCUMENT_BAR}
SELECT * EXCLUDE (l_suppkey) FROM document_bar
WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_nationkey < 10)""",
    "landing_report": f"""
WITH {DOCUMENT_BAR}, {UNIVERSE},
landed AS (SELECT * FROM document_bar WHERE symbol IN (SELECT symbol FROM universe))
SELECT symbol, (SELECT count(*) FROM landed) AS bars_written
FROM universe WHERE symbol NOT IN (SELECT symbol FROM landed)""",
    "silver_bars": SILVER_ROWS,
    "silver_table": SILVER_ROWS,
    "rejected_bars": f"""
WITH {BAR}
SELECT * EXCLUDE (source, adjusted), concat_ws(',',
         CASE WHEN (close > 0) IS NOT TRUE THEN 'close_positive' END,
         CASE WHEN (volume > 0) IS NOT TRUE THEN 'volume_positive' END,
         CASE WHEN (open > 0) IS NOT TRUE THEN 'open_positive' END,
         CASE WHEN (high >= low) IS NOT TRUE THEN 'high_not_below_low' END,
         CASE WHEN symbol IS NULL THEN 'symbol_present' END) AS reason
FROM bar
WHERE (close > 0 AND volume > 0 AND open > 0 AND high >= low AND symbol IS NOT NULL)
      IS NOT TRUE""",
    "bars_for_symbol": f"""
WITH {SILVER}
SELECT symbol, trade_date::VARCHAR AS trade_date, open, high, low, close, volume, vwap,
       trade_count
FROM (SELECT * FROM silver WHERE symbol = upper('s7')
      ORDER BY trade_date DESC, {BAR_TIES} LIMIT 500)""",
    "symbols": f"WITH {SILVER} SELECT DISTINCT symbol FROM silver ORDER BY symbol",
    "universe_bars": f"""
WITH {BAR}
SELECT * FROM bar
WHERE EXISTS (SELECT 1 FROM supplier WHERE symbol = 'S' || s_suppkey AND s_nationkey < 10)""",
    "missing_symbols": f"""
WITH {BAR}, {UNIVERSE}
SELECT symbol FROM universe
WHERE symbol NOT IN (SELECT symbol FROM bar WHERE symbol IS NOT NULL)""",
    "bars_capped": f"""
WITH {BAR}
SELECT *, timestamp_ms + 86400000 AS ingested_at_ms FROM bar
WHERE date BETWEEN '1996-01-01' AND '2001-12-31'
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp_ms, {BAR_TIES}) <= 300""",
    "bars_default_cap": f"""
WITH {BAR}
SELECT *, timestamp_ms + 86400000 AS ingested_at_ms FROM bar
WHERE date >= '1992-01-01'
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp_ms, {BAR_TIES}) <= 50000""",
    "sample_bars": f"""
WITH {BAR}
SELECT *, timestamp_ms + 86400000 AS ingested_at_ms FROM bar
ORDER BY symbol NULLS FIRST, timestamp_ms, {BAR_TIES} LIMIT 3""",
    "prev_close_change": f"""
WITH {SILVER},
lagged AS (
  SELECT symbol, trade_date, close,
         lag(close) OVER (PARTITION BY symbol ORDER BY trade_date, {BAR_TIES}) AS prev_close
  FROM silver)
SELECT symbol, trade_date::VARCHAR AS trade_date, close, prev_close,
       close - prev_close AS change, (close - prev_close) / prev_close * 100 AS change_pct
FROM lagged""",
    "macro_pulse": f"""
WITH {OBSERVATION}
SELECT indicator, label, value, date
FROM series LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r USING (series_id)""",
    "series_history": f"""
WITH {OBSERVATION}
SELECT series_id, date, value, rank::INTEGER AS place FROM ranked WHERE rank <= 5""",
    "index_board": f"""
WITH {quotes(INDICES, 6)}
SELECT name AS sym, val, chg, pct, pos
FROM listed JOIN index_change c ON listed.ticker = c.ticker
JOIN newest n ON c.ticker = n.ticker AND c.seq = n.seq""",
    "forex_board": quote_board("pair", FOREX, 8),
    "commodity_board": quote_board("commodity", COMMODITIES, 6),
    "landed_forex_board": quote_board("pair", FOREX, 8),
    "landed_macro_pulse": f"""
WITH series(indicator, series_id, label, event_type) AS (VALUES {SERIES}),
newest AS (
  SELECT event_type, value::VARCHAR AS value, strftime(ts::DATE, '%Y-%m-%d') AS date, event_id
  FROM events
  QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) = 1)
SELECT indicator, label, CASE WHEN event_id % 10 NOT IN (7, 8) THEN value END AS value,
       CASE WHEN event_id % 10 NOT IN (7, 8) THEN date END AS date
FROM series LEFT JOIN newest USING (event_type)""",
    "quote_changes": f"""
WITH {quotes(FOREX, 8)}
SELECT ticker, seq, price, prev_close, change_pct, currency, error FROM quote""",
    "index_changes": f"""
WITH {quotes(INDICES, 6)} SELECT ticker, seq, val, chg, pct, pos FROM index_change""",
    "stream_bronze": f"WITH {GOOD_TICK} {BRONZE}",
    "stream_rejected": f"""
WITH {TICK} SELECT {TICK_FAULT} AS reason, trade_id AS seq
FROM tick WHERE trade_id % 31 IN (3, 11, 17)""",
    "stream_candles": f"""
WITH {GOOD_TICK}, {candle('good', 60)}
SELECT * REPLACE (timestamp::VARCHAR AS timestamp) FROM candle {CLOSED}""",
    "stream_settled_candles": f"""
WITH {GOOD_TICK}, {candle('good', 3600)} SELECT * REPLACE (timestamp::VARCHAR AS timestamp) FROM candle""",
    "stream_open_candles": f"""
WITH {GOOD_TICK}, {candle('good', 3600)}
SELECT c.* REPLACE (timestamp::VARCHAR AS timestamp) FROM candle c
JOIN (SELECT symbol, max(ingested_at_ms) AS newest FROM good GROUP BY symbol) USING (symbol)
WHERE timestamp + INTERVAL 10 SECOND > make_timestamp(newest * 1000)""",
    "stream_ledger": f"""
WITH {GOOD_TICK}
SELECT (SELECT count(DISTINCT event_id % 7) FROM events) AS batches, 2 AS runs, count(*) AS ticks,
       (SELECT count(*) FROM events) AS input_rows, 0 AS late_rows FROM good""",
    "stream_table": f"WITH {GOOD_TICK} {BRONZE}",
    "stream_ilp_lines": f"WITH {GOOD_TICK}, {candle('good', 3600)} {ILP} FROM candle {CLOSED}",
    "stream_published": f"""
WITH {ENVELOPE}
SELECT symbol AS key, symbol, price, quantity, trade_id, timestamp_ms, side FROM decoded""",
    "stream_totals": f"""
WITH {GOOD_TICK}
SELECT count(*) AS ticks, arg_max(symbol, trade_id) AS latest_symbol,
       arg_max(price, trade_id) AS latest_price FROM good""",
}
