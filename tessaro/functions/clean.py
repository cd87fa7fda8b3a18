"""Cleaning of supplier values as column expressions: codes, boards, dates, numbers, units, corporate-action facts.

A value that doesn't follow its declared form becomes null, never a guess. NaN counts as no value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exchange suffixes and board prefixes of six-digit codes.
EXCHANGES = "SH|SZ|BJ"
BOARDS = {
    "sh_main": ("SH", ("600", "601", "603", "605")),
    "star": ("SH", ("688",)),
    "sz_main": ("SZ", ("000", "001", "002", "003")),
    "chinext": ("SZ", ("300", "301")),
}
# What a lot and a thousand-yuan amount are worth in shares and yuan, by supplier.
UNIT_FACTORS = {"tushare": (100, 1000), "tushare_proxy": (100, 1000), "baostock": (1, 1)}
# Words of plans that a holding-period replay can't book, and the mark of an implemented plan.
UNSUPPORTED_WORDS = ("配股", "换股", "合并", "吸收")
IMPLEMENTED_MARK = "实施"


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank_to_null(value: Column | str) -> Column:
    text = F.trim(_c(value).cast("string"))
    return F.when(text != "", text)


def symbol(value: Column | str) -> Column:
    """``600000.SH`` from ``sh.600000`` or ``600000.sh``; null for anything else."""
    text = F.trim(_c(value).cast("string"))
    suffixed = text.rlike(rf"^(?i)[0-9]{{6}}\.({EXCHANGES})$")
    prefixed = text.rlike(rf"^(?i)({EXCHANGES})\.[0-9]{{6}}$")
    return F.when(suffixed, F.upper(text)).when(prefixed, F.concat(F.substring(text, 4, 6), F.lit("."), F.upper(F.substring(text, 1, 2))))


def bare_symbol(value: Column | str) -> Column:
    """Six digits get the exchange of their first digit; a suffixed code stays; null for anything else."""
    text = F.trim(_c(value).cast("string"))
    digits = text.rlike("^[0-9]{6}$")
    exchange = (
        F.when(text.startswith("6"), "SH")
        .when(text.startswith("0") | text.startswith("3"), "SZ")
        .when(text.startswith("4") | text.startswith("8") | text.startswith("92"), "BJ")
    )
    return F.coalesce(symbol(text), F.when(digits, F.concat(text, F.lit("."), exchange)))


def constituent_symbol(value: Column | str) -> Column:
    """``SZ000001`` as ``000001.SZ``; null for anything else."""
    text = F.upper(F.trim(_c(value).cast("string")))
    return F.when(text.rlike(f"^({EXCHANGES})[0-9]{{6}}$"), F.concat(F.substring(text, 3, 6), F.lit("."), F.substring(text, 1, 2)))


def board(canonical: Column | str) -> Column:
    """The board of a canonical code, null where none is known: an unknown board must block, not default."""
    code = _c(canonical)
    found = F.when(code.rlike(r"^[0-9]{6}\.BJ$"), "bj")
    for name, (exchange, prefixes) in BOARDS.items():
        found = found.when(code.rlike(rf"^({'|'.join(prefixes)})[0-9]{{3}}\.{exchange}$"), name)
    return found


def board_or_other(canonical: Column | str) -> Column:
    """The board for diagnostics: ``other`` for unknown codes, and 302 counts with the growth board."""
    code = _c(canonical)
    return F.coalesce(board(code), F.when(code.rlike(r"^302[0-9]{3}\.SZ$"), "chinext"), F.lit("other"))


def trade_date(value: Column | str) -> Column:
    """A date from YYYYMMDD or a general date text; null where it is none."""
    text = F.trim(_c(value).cast("string"))
    compact = text.rlike("^[0-9]{8}$")
    return F.when(compact, F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")).otherwise(text.try_cast("date"))


def number(value: Column | str) -> Column:
    """A double from a decimal text, thousands commas dropped; null where it is none. NaN is no number."""
    text = F.replace(F.trim(_c(value).cast("string")), F.lit(","), F.lit(""))
    parsed = text.try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def shares(value: Column | str, factor: int = 1) -> Column:
    """Whole shares as a long, scaled exactly in decimal; a fraction of a share is null."""
    text = F.replace(F.trim(_c(value).cast("string")), F.lit(","), F.lit(""))
    scaled = text.try_cast("decimal(28,6)") * factor
    return F.when(scaled == F.floor(scaled), scaled.cast("long"))


def per_share(value: Column | str) -> Column:
    """Amounts are quoted for ten shares."""
    return F.trim(_c(value).cast("string")).try_cast("decimal(18,6)") / 10


def plan_amount(plan: Column | str, mark: str) -> Column:
    """The figure after mark in a plan text such as ``10派2.5元``, decimals included; null where there is none."""
    found = F.regexp_extract(_c(plan), rf"{mark}\s*([0-9]+(?:\.[0-9]+)?)", 1)
    return F.when(found != "", found)


def mentions_unsupported(*texts: Column | str) -> Column:
    return F.coalesce(F.concat_ws(" ", *map(_c, texts)).rlike("|".join(UNSUPPORTED_WORDS)), F.lit(False))


def implemented(progress: Column | str) -> Column:
    return F.coalesce(_c(progress).contains(IMPLEMENTED_MARK), F.lit(False))


def first_reason(*cases: tuple[Column, str]) -> Column:
    """The label of the first case that holds; null if none does."""
    (condition, label), *rest = cases
    found = F.when(condition, label)
    for condition, label in rest:
        found = found.when(condition, label)
    return found


def no_nan(value: Column | str) -> Column:
    """NaN sorts above all numbers in Spark and equals itself; as null it compares like a missing value."""
    x = _c(value)
    return F.when(~F.isnan(x), x)


def in_range(column: str, start: str, end: str) -> Column:
    """Whether a supplier's date text lies in [start, end]: compared as texts of one layout, as suppliers may ignore range parameters."""
    return F.col(column).cast("string").between(start, end)
