"""Named queries over the star-schema tables, each beside the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# --- shared SQL: the same views as in sources.tables ---

_SPLIT = """CASE WHEN date BETWEEN {a} AND {b} THEN 'train' WHEN date BETWEEN {c} AND {d} THEN 'valid'
 WHEN date BETWEEN {e} AND {f} THEN 'test' END AS split"""

IMP = (
    "WITH raw_imp AS (SELECT event_id AS row_id, CAST(strftime(ts,'%Y%m%d') AS INTEGER) AS date,"
    " CAST(hour(ts)*100+minute(ts) AS INTEGER) AS hourmin, epoch_us(ts)//1000 AS time_ms,"
    " CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props,'$.k') AS video_id,"
    " CAST(CAST(json_extract_string(props,'$.k') AS INTEGER) % 10 AS VARCHAR) AS author_id,"
    " CAST(event_id % 4 AS VARCHAR) AS tab,"
    " CASE WHEN CAST(json_extract_string(props,'$.k') AS INTEGER) >= 95 THEN 'UNK'"
    " ELSE CAST(CAST(json_extract_string(props,'$.k') AS INTEGER) % 7 AS VARCHAR) END AS tag,"
    " CAST(round(value*1000) AS BIGINT) AS duration_ms,"
    " CAST(event_type IN ('purchase','click') AS INTEGER) AS long_view,"
    " CAST(event_type = 'click' AS INTEGER) AS is_click,"
    " CAST(event_type = 'signup' AS INTEGER) AS is_like,"
    " CAST(event_type = 'view' AS INTEGER) AS is_follow FROM events),"
    " imp AS (SELECT * FROM (SELECT *, "
    + _SPLIT.format(a=20240101, b=20240114, c=20240115, d=20240121, e=20240122, f=20240130)
    + " FROM raw_imp) WHERE split IS NOT NULL), hist AS (SELECT * FROM imp WHERE split='train')"
)

LINES = (
    "WITH raw_line AS (SELECT CAST(strftime(l_shipdate,'%Y%m%d') AS INTEGER) AS date,"
    " l_orderkey AS order_id, l_linenumber AS line_no, CAST(o_custkey AS VARCHAR) AS user_id,"
    " CAST(l_partkey AS VARCHAR) AS video_id, CAST(l_suppkey AS VARCHAR) AS author_id,"
    " o_orderpriority AS tab, CAST(l_quantity*1000 AS BIGINT) AS duration_ms,"
    " CAST(l_returnflag='R' AS INTEGER) AS long_view"
    " FROM lineitem JOIN orders ON l_orderkey=o_orderkey),"
    " lines AS (SELECT * FROM (SELECT *, "
    + _SPLIT.format(a=19950101, b=19991231, c=20000101, d=20001231, e=20010101, f=20011231)
    + " FROM raw_line) WHERE split IS NOT NULL), lhist AS (SELECT * FROM lines WHERE split='train')"
)

OUTCOMES = (
    "WITH outcomes AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq,"
    " 'h_' || json_extract_string(props,'$.k') AS hypothesis_id,"
    " event_type IN ('purchase','click') AS accepted, event_type AS arm,"
    " (CAST(round(value*100) AS BIGINT)-5000)/1000000.0 AS delta,"
    " CAST(round(value*100) AS BIGINT) AS cents FROM events)"
)


def sql_score(salt: int = 7) -> str:
    return (
        f"CAST(((row_id % 1009) * 613 + (duration_ms % 1009) * 271 + {salt * 97}) % 1009"
        " + 120 * is_click AS DOUBLE)/1009.0"
    )


def sql_day(column: str = "date") -> str:
    """Days since 1970-01-01 of an integer date."""
    return f"date_diff('day', DATE '1970-01-01', CAST(strptime(CAST({column} AS VARCHAR),'%Y%m%d') AS DATE))"


def sql_bucket(value: str, edges: str, op: str = "<") -> str:
    """Edges (a list expression) below the value."""
    return f"len(list_filter({edges}, lambda e: e {op} {value}))"
