"""Universe membership: interval facts, point-in-time lookups, cardinality, snapshots, repairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaro.operators.calendars import on_ordinals, ordinals_of
from tessaro.operators.temporal import islands, sessions


def resolve(facts: DataFrame, listing: DataFrame) -> DataFrame:
    """Facts (raw_from, raw_to or open) cut to the listing (symbol, list_date, delist_date): effective ends, why, usable."""
    j = facts.join(listing.select("symbol", "list_date", "delist_date"), "symbol", "left")
    late, early = F.col("list_date") > F.col("raw_from"), F.col("delist_date").isNotNull() & (F.col("raw_to").isNull() | (F.col("delist_date") < F.col("raw_to")))
    labels = F.concat_ws(",", F.when(late, "before_listing"), F.when(early, "after_delisting"))
    out = (
        j.withColumn("effective_from", F.greatest("raw_from", "list_date"))
        .withColumn("effective_to", F.least("raw_to", "delist_date"))
        .withColumn("adjustment", F.when(labels != "", labels))
    )
    return out.withColumn("usable", F.col("effective_to").isNull() | (F.col("effective_from") <= F.col("effective_to"))).drop("list_date", "delist_date")


def delisted_without_end(facts: DataFrame, listing: DataFrame) -> DataFrame:
    """Facts that ended by delisting though no last tradable day is known: an error, as no notice stands in for it."""
    return facts.filter("reason = 'delisting'").join(listing.filter("delist_date IS NOT NULL").select("symbol"), "symbol", "left_anti")


def member_spans(facts: DataFrame, calendar: DataFrame) -> DataFrame:
    """universe_id, symbol, a, b: the open days on which a symbol is a member, as ordinals of the calendar, runs that meet or overlap
    made one. A fact counts inside its interval, and from the day on which it was announced.

    facts: effective_from, effective_to or null, announced, usable. No row is made for a day.
    """
    known = facts.filter("usable").select("universe_id", "symbol", F.greatest("effective_from", "announced").alias("_s"), F.col("effective_to").alias("_e"), F.col("effective_from").alias("_f"), F.col("announced").alias("_k"))
    at = ordinals_of(ordinals_of(known.filter("_f IS NOT NULL AND _k IS NOT NULL"), calendar, "_s", "_a", up=True), calendar, "_e", "_b", up=False)
    last = calendar.agg(F.max("ord")).scalar()
    spans = at.select("universe_id", "symbol", "_a", F.when(F.col("_e").isNull(), last).otherwise(F.col("_b")).alias("_b")).filter("_a <= _b")
    w = Window.partitionBy("universe_id", "symbol").orderBy("_a", "_b")
    reach = F.max("_b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = sessions(spans.withColumn("_reach", reach), ["universe_id", "symbol"], ["_a", "_b"], F.col("_reach").isNull() | (F.col("_a") > F.col("_reach") + 1), "_run")
    return runs.groupBy("universe_id", "symbol", "_run").agg(F.min("_a").alias("a"), F.max("_b").alias("b")).drop("_run")


#: Levels of bins: 2 ** 22 open days are more than any calendar has.
LEVELS = 22


def bins_of_span(a: Column, b: Column) -> Column:
    """The fewest aligned bins (level, number: days number << level and on) that make up the days a to b, two of a level at most."""
    start = F.struct(a.cast("long").alias("a"), (b + 1).cast("long").alias("e"), F.array().cast("array<struct<level:int,number:long>>").alias("bins"))

    def step(s: Column, level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        number = lambda x: F.call_function("shiftright", x, level)
        left = (s["a"] < s["e"]) & (number(s["a"]) % 2 == 1)
        a1 = F.when(left, s["a"] + size).otherwise(s["a"])
        right = (a1 < s["e"]) & (number(s["e"]) % 2 == 1)
        e1 = F.when(right, s["e"] - size).otherwise(s["e"])
        none = F.array().cast("array<struct<level:int,number:long>>")
        one = lambda x: F.array(F.struct(level.alias("level"), number(x).alias("number")))
        return F.struct(a1.alias("a"), e1.alias("e"), F.concat(s["bins"], F.when(left, one(s["a"])).otherwise(none), F.when(right, one(e1)).otherwise(none)).alias("bins"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, step, lambda s: s["bins"])


def members_on(facts: DataFrame, calendar: DataFrame, days: DataFrame) -> DataFrame:
    """(universe_id, symbol, day) for the asked days: inside the interval, and announced by that day.

    Each run of days goes into some bins by powers of two (at most two of each size), and each asked day looks up the bins
    that it lies in by equality: what is shuffled grows with the facts and the answer, not with the length of the facts.
    """
    asked = calendar.join(days.select("day").distinct(), "day").select("day", F.explode(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", F.col("ord"), k).alias("number")))).alias("bin"))
    binned = member_spans(facts, calendar).select("universe_id", "symbol", F.explode(bins_of_span(F.col("a"), F.col("b"))).alias("bin"))
    on = [F.col("f.bin.level") == F.col("d.bin.level"), F.col("f.bin.number") == F.col("d.bin.number")]
    return binned.alias("f").join(asked.alias("d"), on).select("universe_id", "symbol", "day")


def member_history(facts: DataFrame, calendar: DataFrame) -> DataFrame:
    """On how many open days each symbol was a member, and the first and last of them: lengths and ends of runs, no days."""
    g = member_spans(facts, calendar).groupBy("universe_id", "symbol").agg(F.sum(F.col("b") - F.col("a") + 1).alias("n_days"), F.min("a").alias("a"), F.max("b").alias("b"))
    first, last = (calendar.select(F.col("ord").alias(o), F.col("day").alias(n)) for o, n in (("a", "first_day"), ("b", "last_day")))
    return g.join(first, "a").join(last, "b").select("universe_id", "symbol", "n_days", "first_day", "last_day")


def member_counts(facts: DataFrame, calendar: DataFrame) -> DataFrame:
    """universe_id, day, n_members of the open days that have any: running sums of those who join and leave."""
    spans = member_spans(facts, calendar)
    moves = spans.select("universe_id", F.explode(F.array(F.struct(F.col("a").alias("ord"), F.lit(1).alias("step")), F.struct((F.col("b") + 1).alias("ord"), F.lit(-1).alias("step")))).alias("m"))
    steps = moves.groupBy("universe_id", "m.ord").agg(F.sum("m.step").alias("step"))
    w = Window.partitionBy("universe_id").orderBy("ord")
    counted = steps.withColumns({"n_members": F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)), "until": F.lead("ord").over(w)})
    # a row for each day of a universe, which is the answer; few rows before
    daily = counted.filter("n_members > 0").select("universe_id", "n_members", F.explode(F.sequence(F.col("ord"), F.col("until") - 1)).alias("ord"))
    return daily.join(calendar, "ord").select("universe_id", "day", "n_members")


def daily_sizes(facts: DataFrame, calendar: DataFrame, universes: DataFrame, start: str = "raw_from", end: str = "raw_to") -> DataFrame:
    """universe_id, ord, day, actual for each open day from a universe's first start to the calendar's end, days without a member
    included. Counts are running sums of joins and leaves by open day: the facts meet no grid of days.

    universes: universe_id, few rows; facts of other universes are left out. Rows without a start count nowhere.
    """
    dated = facts.filter(F.col(start).isNotNull()).join(universes.select("universe_id"), "universe_id", "left_semi").select("universe_id", F.col(start).alias("_s"), F.col(end).alias("_e"))
    at = ordinals_of(ordinals_of(dated, calendar, "_s", "_a", up=True), calendar, "_e", "_b", up=False)
    moves = at.select("universe_id", F.explode(F.array(F.struct(F.col("_a").alias("ord"), F.lit(1).alias("step")), F.struct((F.col("_b") + 1).alias("ord"), F.lit(-1).alias("step")))).alias("m"))
    # an interval without an open day joins and leaves at once, and one that ended before the first day never counts
    steps = moves.select("universe_id", F.greatest("m.ord", F.lit(1)).alias("ord"), "m.step", F.col("m.ord").isNotNull().alias("known")).filter("known").groupBy("universe_id", "ord").agg(F.sum("step").alias("step"))
    first = at.groupBy("universe_id").agg(F.min("_a").alias("_first"))
    grid = first.withColumn("ord", F.explode(F.sequence("_first", calendar.agg(F.max("ord")).scalar()))).filter(F.col("ord") <= calendar.agg(F.max("ord")).scalar())
    w = Window.partitionBy("universe_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    counted = grid.join(steps, ["universe_id", "ord"], "left").withColumn("actual", F.sum(F.coalesce("step", F.lit(0))).over(w).cast("long"))
    return counted.join(calendar, "ord").select("universe_id", "ord", "day", "actual")


def size_issues(facts: DataFrame, calendar: DataFrame, expected: DataFrame, exceptions: DataFrame | None = None, start: str = "raw_from", end: str = "raw_to") -> DataFrame:
    """Faults of member counts: code, universe_id, expected, actual, n_days, first_day, last_day.

    expected: universe_id, expected. exceptions: universe_id, start, end, size; the earliest that covers a day sets its size, and
    one that begins before the one before it has ended is a UNIVERSE_EXCEPTION_CONFLICT. Open days in a row with the same wrong
    count and size are one UNIVERSE_MEMBER_COUNT_MISMATCH, or with no member UNIVERSE_COVERAGE_GAP, as is a universe without facts.
    """
    sizes = daily_sizes(facts, calendar, expected, start, end).join(expected, "universe_id")
    none = lambda kind: F.lit(None).cast(kind)
    shape = ["code", "universe_id", "expected", "actual", "n_days", "first_day", "last_day"]
    more = []
    if exceptions is not None:
        days = on_ordinals(exceptions.withColumn("_at", F.struct("start", "end", "size")), calendar, "start", "end")
        first = days.groupBy("universe_id", "day").agg(F.min("_at").alias("_at"))
        sizes = sizes.join(first, ["universe_id", "day"], "left").withColumn("expected", F.coalesce("_at.size", "expected"))
        before = F.lag("end").over(Window.partitionBy("universe_id").orderBy("start", "end"))
        clash = exceptions.join(expected, "universe_id", "left_semi").withColumn("_before", before).filter("_before >= start")
        more.append(clash.select(F.lit("UNIVERSE_EXCEPTION_CONFLICT").alias("code"), "universe_id", none("long").alias("expected"), none("long").alias("actual"), none("long").alias("n_days"), F.col("start").alias("first_day"), F.col("_before").alias("last_day")))
    wrong = sizes.withColumn("expected", F.col("expected").cast("long")).filter("actual <> expected")
    by = ["universe_id", "expected", "actual"]
    runs = islands(wrong, by, "ord").groupBy(*by, "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_days"))
    code = F.when(F.col("actual") == 0, "UNIVERSE_COVERAGE_GAP").otherwise("UNIVERSE_MEMBER_COUNT_MISMATCH")
    out = runs.withColumn("code", code).select(*shape)
    absent = expected.join(facts.filter(F.col(start).isNotNull()).select("universe_id").distinct(), "universe_id", "left_anti")
    more.append(absent.select(F.lit("UNIVERSE_COVERAGE_GAP").alias("code"), "universe_id", F.col("expected").cast("long"), none("long").alias("actual"), none("long").alias("n_days"), none("date").alias("first_day"), none("date").alias("last_day")))
    return reduce(DataFrame.unionByName, more, out)


def size_exceptions(records: DataFrame) -> DataFrame:
    """Records of allowed sizes (universe_id, interval_start, interval_end, allowed_size, reason, rules_version, evidence_sha256) with
    content_hash, the SHA-256 of the record as JSON with its names in order and nothing between, and faults, what is wrong with it.

    Reasons and rule versions are plain ASCII; others are a fault, as their JSON isn't one of a kind.
    """
    names = sorted(("universe_id", "interval_start", "interval_end", "allowed_size", "reason", "rules_version", "evidence_sha256"))
    trimmed = lambda c: F.coalesce((F.col(c) != "") & (F.col(c) == F.trim(c)), F.lit(False))
    cases = [
        (~F.coalesce(F.col("universe_id").rlike("^(csi300|csi500|csi1000|sse50|sse180|szse100|custom_[a-z0-9_]+)$"), F.lit(False)), "universe_id"),
        (~F.coalesce(F.col("interval_start") <= F.col("interval_end"), F.lit(False)), "interval"),
        (~F.coalesce(F.col("allowed_size") >= 1, F.lit(False)), "allowed_size"),
        (~trimmed("reason"), "reason"),
        (~trimmed("rules_version"), "rules_version"),
        (~F.coalesce(F.col("evidence_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "evidence_sha256"),
        (F.concat_ws("", "reason", "rules_version").rlike(r"[^\x00-\x7F]"), "not_ascii"),
    ]
    text = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return records.withColumns({"content_hash": F.sha2(text, 256), "faults": F.array_compact(F.array(*[F.when(c, f) for c, f in cases]))})


def exception_conflicts(records: DataFrame) -> DataFrame:
    """Records without a fault that begin before the one before them has ended: universe_id and the hashes of both."""
    w = Window.partitionBy("universe_id").orderBy("interval_start", "interval_end", "content_hash")
    good = size_exceptions(records).filter("size(faults) = 0").withColumns({"first_hash": F.lag("content_hash").over(w), "_end": F.lag("interval_end").over(w)})
    return good.filter("_end >= interval_start").select("universe_id", "first_hash", F.col("content_hash").alias("second_hash"))


def overlaps(facts: DataFrame, start: str = "raw_from", end: str = "raw_to") -> DataFrame:
    """Intervals of a (universe, symbol) that begin before an earlier one has ended; an open one never ends."""
    w = Window.partitionBy("universe_id", "symbol").orderBy(start, F.col(end).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    forever = F.lit("9999-12-31").cast("date")
    reach = F.max(F.coalesce(end, forever)).over(w)
    return facts.withColumn("previous_end", reach).filter(F.col(start) <= F.col("previous_end"))


def from_snapshots(snapshots: DataFrame) -> DataFrame:
    """Periodic constituent lists (universe_id, snapshot, symbol) as intervals.

    A run of consecutive snapshot dates is one interval, ending the day before the next snapshot; open if it reaches the last. A
    symbol's first interval is initial_constituent if it is still open; all others are regular_rebalance.
    """
    dates = snapshots.select("universe_id", "snapshot").distinct()
    w = Window.partitionBy("universe_id").orderBy("snapshot")
    numbered = dates.withColumn("ord", F.row_number().over(w)).withColumn("next_snapshot", F.lead("snapshot").over(w))
    runs = islands(snapshots.distinct().join(numbered, ["universe_id", "snapshot"]), ["universe_id", "symbol"], "ord")
    ends = runs.groupBy("universe_id", "symbol", "island").agg(F.min("snapshot").alias("raw_from"), F.max_by("next_snapshot", "snapshot").alias("_next"))
    first = F.row_number().over(Window.partitionBy("universe_id", "symbol").orderBy("raw_from")) == 1
    reason = F.when(F.col("_next").isNull() & first, "initial_constituent").otherwise("regular_rebalance")
    return ends.select("universe_id", "symbol", "raw_from", F.date_sub("_next", 1).alias("raw_to"), reason.alias("reason"))


def half_open_to_inclusive(history: DataFrame, base: Column) -> DataFrame:
    """opt_in/opt_out (half open) as inclusive intervals; a row without opt_out stays open.

    What is open and began on the base day, when the index was launched, is initial_constituent. A row without opt_in has no
    start, and fails the job when it is met.
    """
    start = F.coalesce(F.col("opt_in"), F.raise_error(F.concat(F.lit("no opt-in date: "), F.coalesce("symbol", F.lit("?")))).cast("date"))
    return history.select(
        "universe_id",
        "symbol",
        start.alias("raw_from"),
        F.date_sub("opt_out", 1).alias("raw_to"),
        F.when(F.col("opt_out").isNull() & (F.col("opt_in") == base), "initial_constituent").otherwise("regular_rebalance").alias("reason"),
    )


def apply_repairs(history: DataFrame, repairs: DataFrame, key: list[str]) -> DataFrame:
    """Apply a repair table (seq, action, key, field, old_value, new_value) in order of seq: set_field and drop_row where the old
    value stands at that point, insert_row (values of the fields as a map in ``row``). A stale old value changes nothing; a
    repair of a symbol that the history doesn't have is an error, raised here. Null and blank values are equal."""
    if unknown := [r.symbol for r in unknown_repairs(history, repairs).select("symbol").distinct().limit(10).collect()]:
        raise ValueError(f"repairs of symbols that the history doesn't have: {', '.join(sorted(unknown))}")
    fields = [c for c in history.columns if c not in key]
    blank = lambda x: F.coalesce(F.trim(x), F.lit(""))
    step = F.struct("seq", "action", "field", blank("old_value").alias("old"), blank("new_value").alias("new"))
    todo = repairs.filter("action <> 'insert_row'").groupBy(*key).agg(F.sort_array(F.collect_list(step)).alias("_todo"))
    state = F.struct(F.lit(False).alias("gone"), *[blank(F.col(c).cast("string")).alias(c) for c in fields])

    def apply(now, repair):
        here = lambda c: ~now["gone"] & (repair["field"] == c) & (now[c] == repair["old"])
        drop = (repair["action"] == "drop_row") & reduce(lambda a, b: a | b, [here(c) for c in fields])
        put = [F.when((repair["action"] == "set_field") & here(c), repair["new"]).otherwise(now[c]).alias(c) for c in fields]
        return F.struct((now["gone"] | drop).alias("gone"), *put)

    done = history.join(todo, key, "left").withColumn("_now", F.when(F.col("_todo").isNotNull(), F.aggregate("_todo", state, apply)))
    value = lambda c: F.when(F.col("_now").isNull(), F.col(c)).otherwise(F.nullif(F.col("_now")[c], F.lit("")).cast(history.schema[c].dataType)).alias(c)
    out = done.filter("_now IS NULL OR NOT _now.gone").select(*[c if c in key else value(c) for c in history.columns])
    added = repairs.filter("action = 'insert_row'").select(*key, *[F.col("row")[c].cast(history.schema[c].dataType).alias(c) for c in fields])
    return out.unionByName(added.select(*history.columns))


def unknown_repairs(history: DataFrame, repairs: DataFrame) -> DataFrame:
    """Repairs of symbols that the history doesn't have: an error."""
    return repairs.filter("action <> 'insert_row'").join(history.select("symbol").distinct(), "symbol", "left_anti")


def trim(facts: DataFrame, keep: DataFrame, universe_id: str) -> DataFrame:
    """Only the kept symbols, under another universe's name."""
    return facts.join(keep.select("symbol").distinct(), "symbol", "left_semi").withColumn("universe_id", F.lit(universe_id))


def universe_changes(members: DataFrame, calendar: DataFrame) -> DataFrame:
    """Runs of open days on which a symbol was a member: joined and left days of each stay."""
    runs = islands(members.join(calendar, "day"), ["universe_id", "symbol"], "ord")
    return runs.groupBy("universe_id", "symbol", "island").agg(F.min("day").alias("joined"), F.max("day").alias("left"), F.count("*").alias("n_days")).drop("island")


def merge_adjacent(facts: DataFrame) -> DataFrame:
    """Intervals of a (universe, symbol) that follow each other without a gap become one; an open end stays open."""
    forever = F.lit("9999-12-31").cast("date")
    f = facts.withColumn("_to", F.coalesce("raw_to", forever))
    w = Window.partitionBy("universe_id", "symbol").orderBy("raw_from", "_to").rowsBetween(Window.unboundedPreceding, -1)
    f = f.withColumn("_reach", F.max("_to").over(w))
    joined = sessions(f, ["universe_id", "symbol"], ["raw_from", "_to"], F.col("_reach").isNull() | (F.col("raw_from") > F.date_add("_reach", 1)), "_run")
    out = joined.groupBy("universe_id", "symbol", "_run").agg(F.min("raw_from").alias("raw_from"), F.max("_to").alias("_to"))
    return out.select("universe_id", "symbol", "raw_from", F.when(F.col("_to") != forever, F.col("_to")).alias("raw_to"))
