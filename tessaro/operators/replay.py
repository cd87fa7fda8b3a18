"""Account replay: orders from target books, executed against daily bars under a cost scenario, with T+1 lots in exact cents.

What doesn't depend on the account is relational and runs for all groups at once: carried closes, price limits, fill prices
and static rejections of every (name, day, side). Only cash and lots are a state machine: one group of rows for each (fold,
scenario), holding the target books and the bars of the names in them, which a book's size bounds whatever the market's size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessaro.functions.money import block_reason, fill_price, price_limits
from tessaro.operators.temporal import effective_join

CENT, ZERO = Decimal("0.01"), Decimal(0)

LEDGER = (
    "{by}, ledger string, seq int, trade_date date, id string, order_id string, side string, symbol string, quantity long, filled_quantity long, "
    "price decimal(18,2), reference_price decimal(18,2), commission decimal(18,2), stamp_tax decimal(18,2), cash decimal(18,2), "
    "market_value decimal(18,2), total_equity decimal(18,2), stale_market_value decimal(18,2), stale_days int, reason string"
)


def executable_bars(bars: DataFrame, rates: DataFrame, rules: DataFrame, open_sessions: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Bars (symbol, trade_date, open, close, quality_severity, board, status, listed_sessions; any further key columns named
    in none of these) with, for each scenario of rates and each side, the fill price or why an order can't trade.

    Precedence: missing open, missing previous close, ERROR, no rule, at the limit. The previous close is the last valid close
    of the name before the day. The limit is checked with the price after slippage. names: symbols that books hold; bars of
    others are left out before they are priced.
    """
    if names is not None:
        bars = bars.join(names.filter("symbol IS NOT NULL").select("symbol").distinct(), "symbol", "left_semi")
    valid = (F.col("close") > 0) & ~F.isnan("close") & ~F.col("quality_severity").eqNullSafe("ERROR")
    w = Window.partitionBy("symbol").orderBy("trade_date")
    b = bars.withColumn("mark", F.when(valid, F.col("close")).cast("decimal(18,6)"))
    b = b.withColumn("pre_close", F.last("mark", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    b = price_limits(b, rules, open_sessions)
    scenarios = rates.select("scenario").distinct()
    b = effective_join(b.crossJoin(F.broadcast(scenarios)), rates, "trade_date", "effective_from", ["scenario"])
    opened = F.when((F.col("open") > 0) & ~F.isnan("open"), F.col("open")).cast("decimal(18,6)")
    b = b.withColumn("reference_price", F.round(opened, 2).cast("decimal(18,2)"))
    for side in ("BUY", "SELL"):
        price = fill_price(F.lit(side), opened, F.col("slippage_rate"))
        b = b.withColumn(f"{side.lower()}_price", price)
        b = b.withColumn(
            f"{side.lower()}_reason",
            F.when(opened.isNull(), "missing_open")
            .when(F.col("pre_close").isNull() | (F.col("pre_close") <= 0), "missing_pre_close")
            .when(F.col("quality_severity").eqNullSafe("ERROR"), "quality_error")
            .otherwise(block_reason(F.lit(side), F.col(f"{side.lower()}_price"))),
        )
    columns = ["scenario", "symbol", "trade_date", "mark", "reference_price", "buy_price", "buy_reason", "sell_price", "sell_reason", "commission_rate", "minimum_commission", "stamp_tax_rate"]
    return b.select(*columns)


@dataclass
class Lot:
    day: object
    quantity: int
    basis: Decimal
    available: object


@dataclass
class Account:
    """Cash and lots of one replay. A lot bought on a day can be sold from the next open day on; without one, never."""

    cash: Decimal
    next_day: dict
    lots: dict[str, list[Lot]] = field(default_factory=lambda: defaultdict(list))
    booked: set[str] = field(default_factory=set)

    def held(self, symbol: str) -> int:
        return sum(x.quantity for x in self.lots.get(symbol, ()))

    def sellable(self, symbol: str, day) -> int:
        return sum(x.quantity for x in self.lots.get(symbol, ()) if x.available is not None and x.available <= day)

    def buy(self, symbol: str, day, quantity: int, cost: Decimal) -> None:
        if cost > self.cash:
            raise ValueError(f"buying {quantity} {symbol} on {day} would overdraw the account")
        self.cash -= cost
        self.lots[symbol].append(Lot(day, quantity, cost, self.next_day.get(day)))

    def sell(self, symbol: str, day, quantity: int, proceeds: Decimal) -> None:
        """First in, first out, among the lots that may be sold; a lot cut short keeps its share of the basis."""
        left, kept = quantity, []
        for lot in self.lots[symbol]:
            take = min(lot.quantity, left) if lot.available is not None and lot.available <= day else 0
            left -= take
            if take < lot.quantity:
                kept.append(Lot(lot.day, lot.quantity - take, lot.basis * (lot.quantity - take) / lot.quantity, lot.available))
        if left:
            raise ValueError(f"{quantity} {symbol} can't be sold on {day}: {left} too many")
        self.lots[symbol] = kept
        self.cash += proceeds

    def distribute(self, symbol: str, ex_date, record_date, cash: Decimal, shares: Decimal) -> tuple[Decimal, int] | None:
        """Cash on the lots of the record date still held, new shares at no cost on the whole holding; once for each event."""
        name = f"{symbol}#{ex_date}"
        if not self.held(symbol) or name in self.booked:
            return None
        entitled = sum(x.quantity for x in self.lots[symbol] if x.day <= record_date)
        paid = (entitled * cash).quantize(CENT, ROUND_HALF_UP)
        added = int((self.held(symbol) * shares).to_integral_value(ROUND_HALF_UP))
        self.cash += paid
        if added:
            self.lots[symbol].append(Lot(ex_date, added, ZERO, self.next_day.get(ex_date)))
        self.booked.add(name)
        return paid, added


def commission(gross: Decimal, rate: Decimal, least: Decimal) -> Decimal:
    return max(gross * rate, least).quantize(CENT, ROUND_HALF_UP)


def affordable(quantity: int, lot: int, price: Decimal, cash: Decimal, rate: Decimal, least: Decimal) -> int:
    """The largest quantity, in steps of a lot down from the order's, whose cost fits the cash.

    Cost rises with the quantity, so the number of lots to leave out is found by bisection.
    """
    fits = lambda q: price * q + commission(price * q, rate, least) <= cash
    if fits(quantity):
        return quantity
    low, high = 0, (quantity - 1) // lot + 1  # leaving out low lots doesn't fit; leaving out high leaves nothing
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(quantity - mid * lot) else (mid, high)
    left = quantity - high * lot
    return left if left > 0 else 0


def plan_quantities(targets: dict[str, int], account: Account, day, lot: int) -> list[tuple[str, str, int]]:
    """Orders that move the holdings to whole-lot targets: sells (of what may be sold) before buys, names in order."""
    sells, buys = [], []
    for s in sorted({*targets, *(k for k, v in account.lots.items() if v)}):
        held, target = account.held(s), targets.get(s, 0)
        if held > target and (q := min(held - target, account.sellable(s, day)) // lot * lot):
            sells.append(("SELL", s, q))
        elif held < target and (q := (target - held) // lot * lot):
            buys.append(("BUY", s, q))
    return [*sells, *buys]


def plan_weights(book: dict[str, tuple], account: Account, day, lot: int, band: Decimal) -> tuple[list[tuple[str, str, int]], list[tuple]]:
    """Orders towards target weights of the equity at signal closes, and the decision on every name.

    book: symbol -> (target weight, signal price, continuing). A continuing name within the band stays.
    """
    equity = account.cash + sum((account.held(s) * book[s][1] for s in account.lots if account.held(s)), ZERO)
    sells, buys, decisions = [], [], []
    for s in sorted({*(k for k, v in book.items() if v[0] > 0), *(k for k in account.lots if account.held(k))}):
        weight, price, continuing = book[s]
        held = account.held(s)
        now = held * price / equity if equity > 0 else ZERO
        target = int(weight * equity / price // lot) * lot
        change = target - held
        if continuing and abs(weight - now) < band or change == 0 and continuing:
            reason = "within_rebalance_band"
        elif change == 0:
            reason = "at_target"
        elif abs(change) < lot:
            reason = "below_one_lot"
        else:
            side = "BUY" if change > 0 else "SELL"
            reason = "rebalance_outside_band" if continuing else "entering_position" if change > 0 else "exiting_position"
            q = change if change > 0 else min(-change, account.sellable(s, day) // lot * lot)
            if q:
                (buys if change > 0 else sells).append((side, s, q))
        decisions.append((s, held, target, now, reason))
    return [*sells, *buys], decisions


def replay(
    targets: DataFrame, bars: DataFrame, actions: DataFrame, calendar: DataFrame, windows: DataFrame, by: list[str], initial_cash: Decimal, lot: int = 100, band: Decimal = Decimal("0.02")
) -> DataFrame:
    """Replay one account for each group; all ledgers as rows told apart by ``ledger``.

    targets: by, trade_date (of execution), symbol, and target_quantity, or target_weight with signal_price and continuing.
    bars: of ``executable_bars``. actions: symbol, ex_date, record_date, cash, bonus, capitalization, rights, status.
    A day of execution without any target has one row of a null symbol: what is held is sold.
    windows: by, first_day, last_day; by must contain scenario. Every open day of a window values the account.
    """
    weights = "target_weight" in targets.columns
    names = targets.filter("symbol IS NOT NULL").select(*by, "symbol").distinct()
    days = windows.join(F.broadcast(calendar), F.col("day").between(F.col("first_day"), F.col("last_day"))).select(*by, F.lit(0).alias("kind"), F.col("day").alias("trade_date"))
    span = windows.select(*by, "first_day", "last_day")
    bar = bars.join(names.join(F.broadcast(span), by), ["scenario", "symbol"]).filter("trade_date BETWEEN first_day AND last_day").select(*by, F.lit(2).alias("kind"), "symbol", *[c for c in bars.columns if c not in (*by, "symbol")])
    act = actions.join(names, "symbol").select(
        *by, F.lit(1).alias("kind"), F.col("ex_date").alias("trade_date"), "symbol", "record_date", F.col("cash").cast("decimal(18,6)").alias("cash_per_share"),
        (F.coalesce("bonus", F.lit(0.0)) + F.coalesce("capitalization", F.lit(0.0))).cast("decimal(18,6)").alias("share_ratio"), F.when((F.col("status") != "implemented") | (F.col("rights") > 0), "unsupported").alias("fault"),
    )
    book = targets.select(*by, F.lit(3).alias("kind"), "trade_date", "symbol", *([F.col("target_weight").cast("decimal(18,12)"), F.col("signal_price").cast("decimal(18,6)"), "continuing"] if weights else ["target_quantity"]))
    events = days.unionByName(bar, True).unionByName(act, True).unionByName(book, True)
    kinds = ", ".join(f"{c} {windows.schema[c].dataType.simpleString()}" for c in by)
    schema = LEDGER.format(by=kinds)
    columns = [x.strip().split()[0] for x in schema.replace("decimal(18,2)", "decimal").split(",")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        key = [group[c].iloc[0] for c in by]
        rows = [(*key, *r) for r in machine(group, initial_cash, lot, band, weights)]
        return pd.DataFrame(rows, columns=columns)

    return events.groupBy(*by).applyInPandas(run, schema)


def machine(group: pd.DataFrame, initial_cash: Decimal, lot: int, band: Decimal, weights: bool) -> Iterator[tuple]:
    days = sorted(group.loc[group.kind == 0, "trade_date"])
    account = Account(initial_cash, dict(zip(days, days[1:])))
    at = {k: defaultdict(list) for k in (1, 2, 3)}
    for k in at:
        for r in group[group.kind == k].sort_values(["trade_date", "symbol"]).itertuples():
            at[k][r.trade_date].append(r)
    marks: dict[str, Decimal] = {}
    stale: dict[str, int] = {}
    seq = {"order": 0, "fill": 0}

    def row(ledger: str, day, **x) -> tuple:
        names = ("id", "order_id", "side", "symbol", "quantity", "filled_quantity", "price", "reference_price", "commission", "stamp_tax", "cash", "market_value", "total_equity", "stale_market_value", "stale_days", "reason")
        seq[ledger] = seq.get(ledger, 0) + 1
        return ledger, seq[ledger], day, *(x.get(n) for n in names)

    for day in days:
        for a in at[1][day]:
            if account.held(a.symbol):
                if a.fault is not None and a.fault == a.fault:
                    raise ValueError(f"{a.symbol} has an event on {day} that a replay can't book while it is held")
                if (got := account.distribute(a.symbol, day, a.record_date, a.cash_per_share, a.share_ratio)) is not None:
                    yield row("action", day, id=f"{a.symbol}#{day}", symbol=a.symbol, quantity=got[1], cash=got[0])
        today = {r.symbol: r for r in at[2][day]}
        orders: list[tuple[str, str, int]] = []
        if at[3][day]:
            if weights:
                book = {r.symbol: (r.target_weight, r.signal_price, bool(r.continuing)) for r in at[3][day] if r.symbol is not None}
                orders, decisions = plan_weights(book, account, day, lot, band)
                for s, held, target, _, why in decisions:
                    yield row("decision", day, symbol=s, quantity=target, filled_quantity=held, reason=why)
            else:
                orders = plan_quantities({r.symbol: int(r.target_quantity) for r in at[3][day] if r.symbol is not None and r.target_quantity == r.target_quantity}, account, day, lot)
        numbered = []
        for side, s, q in orders:
            yield (r := row("order", day, order_id=f"o{seq['order'] + 1:06d}", side=side, symbol=s, quantity=q))
            numbered.append((r[4], side, s, q))
        good = []
        for name, side, s, q in numbered:
            bar = today.get(s)
            why = "suspended_or_unknown" if bar is None else getattr(bar, f"{side.lower()}_reason")
            if why is not None and why == why:
                yield row("rejection", day, order_id=name, side=side, symbol=s, quantity=q, filled_quantity=0, reason=why)
            else:
                good.append((name, side, s, q, bar))
        for name, side, s, q, bar in sorted(good, key=lambda x: x[1] != "SELL"):
            if side == "SELL":
                done, why = (q, None) if account.sellable(s, day) >= q else (0, "insufficient_sellable_quantity")
            else:
                done = affordable(q, lot, bar.buy_price, account.cash, bar.commission_rate, bar.minimum_commission)
                why = None if done == q else "insufficient_cash"
            if done:
                price = bar.sell_price if side == "SELL" else bar.buy_price
                gross = price * done
                fee = commission(gross, bar.commission_rate, bar.minimum_commission)
                tax = (gross * bar.stamp_tax_rate).quantize(CENT, ROUND_HALF_UP) if side == "SELL" else ZERO
                if side == "SELL":
                    account.sell(s, day, done, gross - fee - tax)
                else:
                    account.buy(s, day, done, gross + fee)
                yield row("fill", day, id=f"f{seq['fill'] + 1:06d}", order_id=name, side=side, symbol=s, quantity=done, price=price, reference_price=bar.reference_price, commission=fee, stamp_tax=tax)
            if why:
                yield row("rejection", day, order_id=name, side=side, symbol=s, quantity=q, filled_quantity=done, reason=why)
        valid = {s: r.mark for s, r in today.items() if r.mark is not None and r.mark == r.mark}
        for s in {*marks, *valid}:
            stale[s] = 0 if s in valid else stale.get(s, 0) + 1
        marks |= valid
        worth = carried = ZERO
        oldest = 0
        for s in sorted(account.lots):
            if n := account.held(s):
                if s not in marks:
                    raise ValueError(f"{s} has no close to value it on {day}")
                worth += n * marks[s]
                if stale[s]:
                    carried, oldest = carried + n * marks[s], max(oldest, stale[s])
        cents = lambda x: x.quantize(CENT, ROUND_HALF_UP)
        yield row("equity", day, cash=account.cash, market_value=cents(worth), total_equity=cents(account.cash + worth), stale_market_value=cents(carried), stale_days=oldest)


def readiness_faults(plan: DataFrame, bars: DataFrame, benchmark_days: DataFrame, days: DataFrame) -> DataFrame:
    """What must hold before a replay touches an account: a benchmark close on every day, and a clean bar with a previous
    close for each planned order. plan: trade_date, symbol; bars: symbol, trade_date, open, close, quality_severity."""
    gaps = days.select("trade_date").join(benchmark_days.select("trade_date").distinct(), "trade_date", "left_anti").select("trade_date", F.lit(None).cast("string").alias("symbol"), F.lit("benchmark_gap").alias("fault"))
    w = Window.partitionBy("symbol").orderBy("trade_date")
    b = bars.withColumn("prior", F.lag("close").over(w))
    j = plan.select("trade_date", "symbol").distinct().join(b, ["trade_date", "symbol"], "left")
    fault = F.when(F.col("open").isNull(), "no_bar").when(F.col("quality_severity") == "ERROR", "quality_error").when(F.col("prior").isNull(), "no_prior_close")
    return gaps.unionByName(j.select("trade_date", "symbol", fault.alias("fault")).filter("fault IS NOT NULL"))
