"""SQL fragments of the oracles: the event adapters and rounding."""

from __future__ import annotations

MBO = """mbo AS (
  SELECT epoch_us(ts)*1000 AS event_ts, epoch_us(ts)*1000+1000 AS ingest_ts, event_id+1 AS sequence,
    1+user_id%2 AS instrument_id, CASE WHEN user_id%2=0 THEN 'C1' ELSE 'C2' END AS symbol,
    CASE event_type WHEN 'view' THEN 'A' WHEN 'signup' THEN 'A' WHEN 'click' THEN 'M' WHEN 'error' THEN 'C' WHEN 'purchase' THEN 'T' ELSE 'N' END AS action,
    CASE WHEN sgn<0 THEN 'B' ELSE 'A' END AS side, (80000+sgn*(1+CAST(floor(value) AS BIGINT)%20))*250000000 AS price,
    1+CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT)%9 AS size, user_id AS order_id
  FROM (SELECT *, CASE WHEN (CASE WHEN event_type='purchase' THEN event_id%2 ELSE (user_id//2)%2 END)=0 THEN -1 ELSE 1 END AS sgn FROM events) e)"""

TAPE = """tape AS (
  SELECT epoch_us(l_shipdate)*1000 AS event_ts, l_suppkey%4 AS instrument_id,
    row_number() OVER (PARTITION BY l_suppkey%4 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS sequence,
    'T' AS action, CASE l_returnflag WHEN 'R' THEN 'B' WHEN 'A' THEN 'A' ELSE 'N' END AS side,
    CAST(floor(l_extendedprice/l_quantity+0.5) AS BIGINT)*1000000000 AS price, CAST(l_quantity AS BIGINT) AS size, l_orderkey AS order_id
  FROM lineitem)"""

BIG = "CAST({} AS BIGINT)"


def trades(source: str, interval: int) -> str:
    """trades: a source's trades with volumes by side and their bucket."""
    return f"""trades AS (
  SELECT *, event_ts - event_ts % {interval} AS bucket_start, CASE WHEN side='B' THEN size ELSE 0 END AS bv, CASE WHEN side='A' THEN size ELSE 0 END AS sv
  FROM {source} WHERE action='T')"""


def bars(name: str, interval: int, source: str) -> str:
    """OHLCV bars of a source's trades."""
    return f"""{name} AS (
  SELECT instrument_id, event_ts - event_ts % {interval} AS bucket_start, event_ts - event_ts % {interval} + {interval} AS bucket_end, event_ts - event_ts % {interval} + {interval} AS availability_ts,
    arg_min(price*1e-9::DOUBLE, (event_ts, sequence)) AS o, max(price*1e-9::DOUBLE) AS h, min(price*1e-9::DOUBLE) AS l, arg_max(price*1e-9::DOUBLE, (event_ts, sequence)) AS c,
    CAST(sum(size) AS DOUBLE) AS volume, CAST(sum(CASE WHEN side='B' THEN size ELSE 0 END) AS DOUBLE) AS buy_volume, CAST(sum(CASE WHEN side='A' THEN size ELSE 0 END) AS DOUBLE) AS sell_volume,
    CAST(sum(CASE WHEN side='B' THEN size WHEN side='A' THEN -size ELSE 0 END) AS DOUBLE) AS delta, max(price*1e-9::DOUBLE) - min(price*1e-9::DOUBLE) AS range
  FROM {source} WHERE action='T' GROUP BY ALL)"""


def rounded(query: str, *columns: str, digits: int = 6) -> str:
    """query with its double columns rounded (and no negative zero)."""
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) + 0.0 AS {c}' for c in columns)}) FROM ({query})"
