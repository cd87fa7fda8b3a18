"""Column lists of the published tables. Names, order and types of the formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

TABLES = {
    "daily_bar": "trade_date date, symbol string, open double, high double, low double, close double, volume long, amount double, adjustment string, source string, ingested_at timestamp",
    "adjusted_bar": "trade_date date, symbol string, source string, adjustment string, raw_close double, adjusted_close double, adjustment_factor double, quality_severity string, invalid_reason string, applied_action_ids string",
    "security_master": "symbol string, name string, exchange string, board string, list_date date, delist_date date, list_status string",
    "security_master_coverage": "symbol string, list_date date, delist_date date, list_status string, source string, snapshot_sha256 string, sdk_version string, checked_at timestamp",
    "corporate_action": "symbol string, announcement_date date, record_date date, ex_date date, cash_dividend_per_share double, bonus_share_ratio double, capitalization_ratio double, rights_issue_ratio double, rights_issue_price double, source string, status string",
    "corporate_action_quarantine": "symbol string, announcement_date date, record_date date, ex_date date, cash_dividend_per_share double, bonus_share_ratio double, capitalization_ratio double, rights_issue_ratio double, rights_issue_price double, status string, confirmed_by string, reason string",
    "corporate_action_coverage": "symbol string, window_start date, window_end date, status string, reason string, sources string, snapshot_hashes string, checked_at timestamp",
    "trading_calendar": "calendar_date date, is_trading_day boolean",
    "universe_membership": "universe_id string, symbol string, raw_effective_from date, raw_effective_to date, announcement_date date, status string, reason string, source string, source_url string, snapshot_sha256 string, source_document_sha256 string",
}

# By which columns the rows of a published table are in order, first to last.
ORDERS = {
    "daily_bar": ("symbol", "trade_date"),
    "adjusted_bar": ("trade_date", "symbol"),
    "security_master": ("symbol",),
    "security_master_coverage": ("symbol", "checked_at"),
    "corporate_action": ("symbol", "ex_date"),
    "corporate_action_quarantine": ("symbol", "ex_date", "confirmed_by", "reason"),
    "corporate_action_coverage": ("symbol", "window_start", "window_end"),
    "trading_calendar": ("calendar_date",),
    "universe_membership": ("universe_id", "symbol", "raw_effective_from"),
}


def schema(table: str) -> StructType:
    if table not in TABLES:
        raise ValueError(f"there is no table {table!r}")
    return _parse_datatype_string(TABLES[table])


def conform(rows: DataFrame, table: str) -> DataFrame:
    """Columns in the table's order, cast to its types; other names or another order are refused."""
    want = schema(table)
    if rows.columns != want.names:
        raise ValueError(f"{table} has columns {rows.columns}; wanted {want.names}")
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want])


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row as JSON with its columns in order and its nulls written out."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
