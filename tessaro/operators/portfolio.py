"""Target portfolios: equal weight, capped inverse volatility, risk paths, rebalance band, buffered membership."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaro.operators.factors import rank_desc
from tessaro.operators.lineage import settled

LOT = 100
#: A whole portfolio is split in steps of this weight; written without an exponent, as SQL decimals are.
QUANTUM = Decimal("0.000000000001")


@dataclass(frozen=True)
class BufferPolicy:
    target_count: int = 10
    entry_rank: int = 10
    hold_rank: int = 15
    max_single_weight: Decimal = Decimal("0.15")
    volatility_floor: Decimal = Decimal("0.10")
    gross_exposure: Decimal = Decimal("1")
    rebalance_band: Decimal = Decimal("0.02")


def top_equal_weight(factors: DataFrame, prices: DataFrame, capital: float, n: int = 10, lot: int = LOT) -> DataFrame:
    """The n best names of each date get a slot of capital / n in whole lots at the signal price.

    A slot without a price or below one lot stays cash; it isn't handed to the next name. prices: trade_date, symbol, close.
    """
    top = factors.filter("is_valid").withColumn("rank", rank_desc()).filter(F.col("rank") <= n)
    j = top.join(prices.select("trade_date", "symbol", F.col("close").alias("signal_price")), ["trade_date", "symbol"], "left")
    quantity = (F.floor(F.lit(capital / n) / F.col("signal_price") / lot) * lot).cast("long")
    return j.withColumn("target_quantity", quantity).filter("target_quantity > 0").select("trade_date", "symbol", "rank", "signal_price", F.lit(1.0 / n).alias("target_weight"), "target_quantity")


def target_book(signals: DataFrame, targets: DataFrame) -> DataFrame:
    """execution_date, signal_date, symbol, target_quantity: the book that each signal asks for on its execution day. A signal without
    targets stays, with a null symbol, so that what was held is carried into that day and sold.

    signals: signal_date, execution_date (null: none any more, left out); targets: trade_date (the signal's), symbol, target_quantity.
    """
    t = targets.select(F.col("trade_date").alias("signal_date"), "symbol", F.col("target_quantity").cast("long").alias("target_quantity"))
    return signals.filter("execution_date IS NOT NULL").join(t, "signal_date", "left").select("execution_date", "signal_date", "symbol", "target_quantity")


def possible_names(book: DataFrame, by: list[str] = ()) -> DataFrame:
    """The symbols that may be held at all: what any period aims at, with the first execution day that does."""
    return book.filter("symbol IS NOT NULL").groupBy(*by, "symbol").agg(F.min("execution_date").alias("first_day"), F.count("*").alias("n_periods"))


def moments(column: str, w: Window) -> Column:
    """Count, mean and sum of squared distances from the mean over a window, null without a value; Spark updates them row by row."""
    n = F.count(column).over(w)
    return F.when(n > 0, F.struct(n.cast("double").alias("n"), F.avg(column).over(w).alias("mean"), (F.var_pop(column).over(w) * n).alias("m2")))


def merged(a: Column, b: Column) -> Column:
    """Moments of two sets together; either may be null."""
    n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
    both = F.struct(n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n).alias("m2"))
    return F.when(a.isNotNull() & b.isNotNull(), both).otherwise(F.coalesce(a, b))


def risk_path(bars: DataFrame, calendar: DataFrame, asked: DataFrame, sessions: int = 60, least: int = 40, floor: float = 0.10, tasks: int | None = None) -> DataFrame:
    """Annualised volatility of each (symbol, trade_date) asked over its last open days, or why it can't be trusted.

    bars: symbol, trade_date, close, quality_severity, missing_reason. Each of the window's open days (fewer at the calendar's start)
    must have a bar with a positive close, without ERROR and without a reason for missing, or be a proven suspension with a positive
    carried close, which counts as a return of zero; the first must be a real close. At least ``least`` days need a real close. Counts
    are 0 where a day can't be trusted. tasks: over how many tasks the names are dealt, where the caller knows how many rows there are.

    Open days are cut into blocks of as many days as a window has returns, so that a window is the end of one block and the
    beginning of the next: moments run forwards and backwards within blocks and are merged, so that nothing outside a
    window ever enters its figures. What is asked stands among the bars as three rows: before the window's first day, before its second, and
    after its last; so bars and asked days are brought together by name and sorted twice, and nothing else is joined.
    """
    returns = sessions - 1
    days = F.broadcast(calendar.select(F.col("day").alias("trade_date"), "ord"))
    by_name = lambda rows: rows.repartition(tasks, "symbol") if tasks else rows.repartition("symbol")
    priced = (F.col("close") > 0) & (F.col("close") < float("inf"))
    carry = F.coalesce(priced & (F.col("missing_reason") == "suspended_verified"), F.lit(False))
    real = F.coalesce(priced & F.col("missing_reason").isNull() & ~F.col("quality_severity").eqNullSafe("ERROR"), F.lit(False))
    b = by_name(bars).join(days, "trade_date").select("symbol", "ord", (F.col("ord") * 3 + 1).alias("place"), F.when(real, F.col("close")).alias("close"), carry.alias("carry"))
    first = F.greatest(F.col("ord") - returns, F.lit(1))
    at = lambda part, ord, after: F.struct(F.lit(part).alias("part"), ord.alias("ord"), (ord * 3 + after).alias("place"))
    a = by_name(asked.select("symbol", "trade_date")).distinct().join(days, "trade_date")
    a = a.select("symbol", F.col("ord").alias("asked"), F.explode(F.array(at("before", first, 0), at("second", first + 1, 0), at("last", F.col("ord"), 2))).alias("at")).select("symbol", "asked", "at.*")
    j = b.unionByName(a, allowMissingColumns=True).withColumn("block", F.floor((F.col("ord") - 2) / returns))
    # ordinals order blocks too: naming the block first lets frames over names and over blocks share a sort
    w, block = Window.partitionBy("symbol").orderBy("block", "place"), Window.partitionBy("symbol", "block")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("mark", F.last("close", ignorenulls=True).over(so_far))
    ret = F.when(F.col("close").isNotNull(), F.col("mark") / F.lag("mark").over(w) - 1).when(F.col("carry"), F.lit(0.0))
    j = j.withColumns({"ret": ret, "n_real": F.count("close").over(so_far), "n_carry": F.count_if("carry").over(so_far)})
    j = j.withColumn("ahead", moments("ret", block.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    j = j.filter("asked IS NOT NULL OR ret IS NOT NULL").select("symbol", "block", "place", "asked", "part", "ret", "n_real", "n_carry", F.when(F.col("part") == "last", F.col("ahead")).alias("ahead"))
    j = j.withColumn("behind", moments("ret", block.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0))).filter("asked IS NOT NULL")
    of = lambda part, c, name: F.max(F.when(F.col("part") == part, F.col(c))).alias(name)
    counts = [of(p, c, f"{c}_{p}") for p in ("before", "second", "last") for c in ("n_real", "n_carry", "block")]
    figures = [of(p, f"{c}.{m}", f"{c}_{m}") for p, c in (("second", "behind"), ("last", "ahead")) for m in ("n", "mean", "m2")]
    g = j.groupBy("symbol", "asked").agg(*counts, *figures)
    both = {c: F.when(F.col(f"{c}_n").isNotNull(), F.struct(*[F.col(f"{c}_{m}").alias(m) for m in ("n", "mean", "m2")])) for c in ("behind", "ahead")}
    g = g.withColumns(both).withColumns({f"of_{c}": F.col(f"n_{c}_last") - F.col(f"n_{c}_before") for c in ("real", "carry")})
    path = F.when(F.col("block_second") >= F.col("block_last"), F.col("ahead")).otherwise(merged(F.col("behind"), F.col("ahead")))
    g = g.withColumns({"path": path, "n": F.least("asked", F.lit(sessions)), "starts": F.col("n_real_second") > F.col("n_real_before")})
    g = g.withColumn("vol", F.when(F.col("path.n") > 1, F.sqrt(F.col("path.m2") / (F.col("path.n") - 1)) * F.sqrt(F.lit(252.0))))
    reason = F.when((F.col("of_real") + F.col("of_carry") < F.col("n")) | ~F.col("starts"), "untrusted_missing_observation").when(
        (F.col("of_real") < least) | (F.coalesce("path.n", F.lit(0)) < 2), "insufficient_real_close_observations"
    )
    ok, trusted = reason.isNull(), ~reason.eqNullSafe("untrusted_missing_observation")
    return g.join(days.withColumnRenamed("ord", "asked"), "asked").select(
        "trade_date", "symbol",
        F.when(trusted, F.col("of_real")).otherwise(0).cast("long").alias("real_close_observations"), F.when(trusted, F.col("of_carry")).otherwise(0).cast("long").alias("suspension_carry_days"),
        ok.alias("risk_is_valid"), reason.alias("risk_invalid_reason"),
        F.when(ok, F.col("vol")).alias("raw_annualized_volatility"), F.when(ok, F.greatest(F.col("vol"), F.lit(floor))).alias("applied_annualized_volatility"),
    )


def inverse_volatility(members: DataFrame, by: list[str], cap: float = 0.15, floor: float = 0.10, gross: float = 1.0) -> DataFrame:
    """Weights in proportion to 1 / max(volatility, floor), none above the cap, what no name can take left as cash.

    The water fill has a closed form: with names in descending order of score, name i is capped as long as its share of what
    the names before it left exceeds the cap, and the rest share the remainder. members: by, symbol, volatility. Doubles; the
    exact decimal weights with whole quanta come from ``solve_weights``.
    """
    w = Window.partitionBy(*by)
    order = w.orderBy(F.col("score").desc(), "symbol")
    m = members.withColumn("score", 1 / F.greatest("volatility", F.lit(floor)))
    m = m.withColumn("n", F.count("*").over(w)).withColumn("exposure", F.least(F.lit(gross), F.col("n") * cap)).withColumn("i", F.row_number().over(order))
    # the sum from here on is a running sum from the other end
    m = m.withColumn("suffix", F.sum("score").over(w.orderBy("score", F.desc("symbol")).rowsBetween(Window.unboundedPreceding, 0)))
    m = m.withColumn("capped", (F.col("exposure") - (F.col("i") - 1) * cap) * F.col("score") / F.col("suffix") > cap)
    m = m.withColumn("k", F.sum(F.col("capped").cast("int")).over(w)).withColumn("rest", F.sum(F.when(~F.col("capped"), F.col("score"))).over(w))
    weight = F.when(F.col("capped"), F.lit(cap)).otherwise((F.col("exposure") - F.col("k") * cap) * F.col("score") / F.col("rest"))
    m = m.withColumn("weight", weight)
    return m.select(*by, "symbol", "score", (F.col("exposure") * F.col("score") / F.sum("score").over(w)).alias("raw_weight"), "weight", (F.lit(gross) - F.col("exposure")).alias("cash_weight"))


def solve_weights(volatility: dict[str, Decimal], policy: BufferPolicy) -> tuple[dict[str, Decimal], Decimal]:
    """Exact capped weights in whole quanta and the cash left, which together are the gross exposure.

    Quanta that flooring leaves over go to the names in order of the alphabet, one each, where the cap allows.
    """
    from decimal import ROUND_FLOOR, localcontext

    with localcontext() as c:
        c.prec = 50
        cap, n = policy.max_single_weight, len(volatility)
        score = {s: 1 / max(v, policy.volatility_floor) for s, v in volatility.items()}
        exposure = min(policy.gross_exposure, n * cap)
        left, rest, weight = exposure, sum(score.values()), {}
        queue = sorted(score, key=lambda s: (-score[s], s))
        while queue and left * score[queue[0]] / rest > cap:
            weight[queue[0]] = cap
            left, rest = left - cap, rest - score[queue[0]]
            queue.pop(0)
        weight |= {s: left * score[s] / rest for s in queue}
        whole = {s: (x / QUANTUM).to_integral_value(rounding=ROUND_FLOOR) for s, x in weight.items()}
        limit, over = cap / QUANTUM, int((exposure / QUANTUM).to_integral_value(rounding=ROUND_FLOOR) - sum(whole.values()))
        while over > 0 and (free := [s for s in sorted(whole) if whole[s] + 1 <= limit][:over]):
            for s in free:
                whole[s] += 1
            over -= len(free)
        final = {s: x * QUANTUM for s, x in whole.items()}
        return final, policy.gross_exposure - sum(final.values())


AUDIT = (
    "{by}, signal_date date, symbol string, previous_target_member boolean, raw_rank int, eligible_rank int, member_status string, "
    "member_reason string, target_weight decimal(18,12), cash_weight decimal(18,12)"
)


def buffered_targets(candidates: DataFrame, by: str, policy: BufferPolicy = BufferPolicy()) -> DataFrame:
    """Members carried from date to date within a group (a fold), and reset at its start: audit rows of each date.

    candidates: by, signal_date, symbol, processed_value or null, is_valid, invalid_reason, risk_is_valid,
    risk_invalid_reason, applied_annualized_volatility. Each date keeps members of the date before whose rank among
    risk-valid names is within the hold rank, then fills up from the entry rank. Ranks are windows over all groups at once; only
    the carrying from date to date runs in the group's function, which reads the names that are within the ranks on some date of
    the group; all others can't be members, and get their rows without it.
    """
    valid = candidates.withColumn("raw_rank", F.when(F.col("is_valid"), F.row_number().over(Window.partitionBy(by, "signal_date", "is_valid").orderBy(F.col("processed_value").desc(), "symbol"))))
    ok = F.col("is_valid") & F.coalesce("risk_is_valid", F.lit(False))
    ranked = valid.withColumn("_ok", ok).withColumn("eligible_rank", F.when(F.col("_ok"), F.row_number().over(Window.partitionBy(by, "signal_date", "_ok").orderBy("raw_rank"))))
    kind = candidates.schema[by].dataType.simpleString()
    schema = AUDIT.format(by=f"{by} {kind}")
    names = [x.strip().split()[0] for x in schema.split(", ")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(carried(group.sort_values(["signal_date", "raw_rank", "symbol"]), by, policy)), columns=names)

    columns = [by, "signal_date", "symbol", "is_valid", "invalid_reason", "risk_invalid_reason", "raw_rank", "eligible_rank", "applied_annualized_volatility"]
    ranked = settled(ranked.select(*columns))
    # whoever is a member on some date is within the ranks on some date: only these names can change the books
    near = max(policy.hold_rank, policy.entry_rank)
    ever = ranked.filter(F.col("eligible_rank") <= near).select(by, "symbol").distinct()
    dates = ranked.select(by, "signal_date").distinct().select(by, "signal_date", *[F.lit(None).cast(ranked.schema[c].dataType).alias(c) for c in columns[2:]])
    found = ranked.join(ever, [by, "symbol"], "left_semi").select(*columns).unionByName(dates.select(*columns)).groupBy(by).applyInPandas(run, schema)
    found = settled(found)
    cash = found.filter("symbol IS NULL").select(by, "signal_date", "cash_weight")
    out = ranked.filter("is_valid").join(ever, [by, "symbol"], "left_anti").join(cash, [by, "signal_date"])
    refused = F.col("eligible_rank").isNull()
    rest = out.select(
        by, "signal_date", "symbol", F.lit(False).alias("previous_target_member"), "raw_rank", "eligible_rank", F.when(refused, "risk_invalid").otherwise("not_selected").alias("member_status"),
        F.when(refused, F.coalesce("risk_invalid_reason", F.lit("untrusted_missing_observation"))).otherwise("beyond_entry_rank").alias("member_reason"), F.lit(0).cast("decimal(18,12)").alias("target_weight"), "cash_weight",
    )
    return found.filter("symbol IS NOT NULL").unionByName(rest)


def carried(rows: pd.DataFrame, by: str, policy: BufferPolicy) -> Iterator[tuple]:
    previous: set[str] = set()
    for day, frame in rows.groupby("signal_date", sort=True):
        facts = {r.symbol: r for r in frame.itertuples() if r.symbol is not None}
        eligible = sorted((int(r.eligible_rank), s) for s, r in facts.items() if r.eligible_rank == r.eligible_rank)
        kept = [s for k, s in eligible if s in previous and k <= policy.hold_rank][: policy.target_count]
        new = [s for k, s in eligible if k <= policy.entry_rank and s not in kept][: policy.target_count - len(kept)]
        members = {*kept, *new}
        weights, cash = solve_weights({s: Decimal(str(facts[s].applied_annualized_volatility)) for s in members}, policy) if members else ({}, policy.gross_exposure)
        for s in sorted({s for s, r in facts.items() if r.is_valid} | previous):
            r = facts.get(s)
            rank = lambda x: None if x != x else int(x)
            raw, place = (rank(r.raw_rank), rank(r.eligible_rank)) if r is not None else (None, None)
            if r is None or not r.is_valid:
                status, why = "exited", (r.invalid_reason if r is not None and r.invalid_reason else "left_point_in_time_pool")
            elif place is None:
                status, why = "risk_invalid", r.risk_invalid_reason or "untrusted_missing_observation"
            elif s in members:
                status, why = ("retained", "retained_within_hold_rank") if s in previous else ("entered", "entered_within_entry_rank")
            elif s in previous:
                status, why = "exited", "rank_below_hold_rank" if place > policy.hold_rank else "left_point_in_time_pool"
            else:
                status, why = "not_selected", "beyond_target_count" if place <= policy.entry_rank else "beyond_entry_rank"
            yield getattr(frame, by).iloc[0], day, s, s in previous, raw, place, status, why, weights.get(s, Decimal(0)), cash
        yield getattr(frame, by).iloc[0], day, None, False, None, None, "", "", Decimal(0), cash
        previous = members


def band_decision(lot: int = LOT, band: float = 0.02) -> tuple[Column, Column, Column]:
    """Side, quantity and reason for rows (is_continuing, current_weight, target_weight, current_quantity, target_quantity).

    A continuing position whose weight differs by less than the band stays; exactly the band trades. Differences below one
    lot never order.
    """
    dw = F.abs(F.col("target_weight") - F.col("current_weight"))
    dq = F.col("target_quantity") - F.col("current_quantity")
    c = F.col("is_continuing")
    reason = (
        F.when(c & (dw < band), "within_rebalance_band")
        .when((dq == 0) & c, "within_rebalance_band")
        .when(dq == 0, "at_target")
        .when(F.abs(dq) < lot, "below_one_lot")
        .when(c, "rebalance_outside_band")
        .when(dq > 0, "entering_position")
        .otherwise("exiting_position")
    )
    orders = reason.isin("rebalance_outside_band", "entering_position", "exiting_position")
    return F.when(orders, F.when(dq > 0, "BUY").otherwise("SELL")).otherwise(""), F.when(orders, F.abs(dq)).otherwise(0).cast("long"), reason


def apply_band(rows: DataFrame, lot: int = LOT, band: float = 0.02) -> DataFrame:
    side, quantity, reason = band_decision(lot, band)
    return rows.withColumn("order_side", side).withColumn("order_quantity", quantity).withColumn("reason", reason)
