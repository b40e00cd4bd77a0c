"""Recordings of any length: samples stay rows, and a recording's order is kept over segments.

samples have key columns, t, tie (orders samples of one time) and value. A recording of more than `rows` samples is cut into
RANGES segments at approximate quantiles of its times, or more so that a segment has about SEGMENT samples whatever the length; a
shorter one is one segment. Tasks order one segment each. What a segment
is to the others is a summary (rows, finite values, last sample), and a running total over summaries gives every segment its
beginning: places, previous samples, crossings and areas then need no task that holds a recording, and no array.

Quantiles are selected, not sorted: a sketch brackets the ranks that are asked for, everything below a bracket is one count,
and only distinct values inside, a few ten-thousandths of a long key, are put in order. A key of few values is an array of them.
Where no recording is long, a sample's place is its place in one ordered window: nothing is cut, sketched or joined.

Places that several aggregates need are written once in the shared folder, so an operator here may run jobs of its own.

Where recordings fit in a task, the array forms (baseline, features, quality, timing) are cheaper and give the same results.

Cases: samples without a time come first; equal (t, tie) are ordered by value. Values that aren't finite count as they do in the
array forms, but an explicit baseline is that of the finite ones. An empty table gives an empty result. A recording whose samples share one time is one segment whatever its length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vapora.functions import arrays as A
from vapora.operators import quality as Q
from vapora.plans import views
from vapora.sources import scratch

#: Samples of a recording that are one segment; segments of a longer one, in COARSE groups that are told first.
ROWS, RANGES, COARSE = 1 << 20, 512, 16
#: Samples of a segment beyond which a longer recording is cut into more segments than asked for.
SEGMENT = 1 << 18
#: Accuracy of the sketch that brackets a rank, and values of a key that are all put in order.
ACCURACY, FEW = 10_000, 10_000


def _sizes(samples: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """Rows of each key (_n), and the most of a key."""
    counts = (samples.groupBy(*keys) if keys else samples).agg(F.count("*").alias("_n"))
    return counts, counts.agg(F.max("_n")).first()[0] or 0


def cut(samples: DataFrame, keys: Sequence[str], rows: int = ROWS, ranges: int = RANGES, sizes: tuple[DataFrame, int] | None = None) -> DataFrame:
    """samples with seg, which grows with t within a recording; dealt by recording and segment."""
    keys = list(keys)
    counts, longest = sizes or _sizes(samples, keys)
    fine = max(1, ranges // COARSE, -(-longest // (SEGMENT * COARSE)) if longest > rows else 1)
    shares = [k / (fine * COARSE) for k in range(1, fine * COARSE)]
    # only long recordings are sketched; where there are none the joins are found empty and go
    beyond = counts.where(F.col("_n") > rows).drop("_n")
    edges = _joined(samples.select(*keys, "t"), beyond, keys).groupBy(*keys).agg(F.percentile_approx("t", shares, 20 * fine * COARSE).alias("_edges"))
    edges = edges.where("_edges IS NOT NULL")
    long = _joined(samples, edges, keys, "left")
    below = lambda some: F.size(F.filter(some, lambda e: e < F.col("t")))
    group = below(F.transform(F.sequence(F.lit(1), F.lit(COARSE - 1)), lambda k: F.get("_edges", k * fine - 1)))
    long = long.withColumn("_group", group)
    seg = F.col("_group") * fine + below(F.slice("_edges", F.col("_group") * fine + 1, F.lit(fine - 1))) if fine > 1 else F.col("_group")
    return long.withColumn("seg", F.when(F.col("_edges").isNull() | F.col("t").isNull(), 0).otherwise(seg)).drop("_edges", "_group").repartition(*keys, "seg")


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys in which nulls are equal."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(named[f"_right_{k}"])
    return left.join(named, on, how).drop(*(f"_right_{k}" for k in keys))


def finite(x: str = "value") -> Column:
    return F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def placed(samples: DataFrame, keys: Sequence[str], rows: int = ROWS, ranges: int = RANGES) -> DataFrame:
    """samples with n, idx (place from 0), finite_idx (finite values before) and the sample before: prev_t, prev_value; NULL for the first."""
    keys = list(keys)
    sizes = _sizes(samples, keys)
    order = [F.col(c).asc_nulls_first() for c in ("t", "tie", "value")]
    if sizes[1] <= rows:
        whole, own = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(*order)
        finite_before = F.coalesce(F.sum(finite().cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        places = {"n": F.count("*").over(whole), "idx": (F.row_number().over(own) - 1).cast("long"), "finite_idx": finite_before.cast("long")}
        return samples.withColumns(places | {f"prev_{c}": F.lag(c).over(own) for c in ("t", "value")})
    parts = cut(samples, keys, rows, ranges, sizes)
    last = F.max(F.struct("t", "tie", "value"))
    sums = parts.groupBy(*keys, "seg").agg(F.count("*").alias("_m"), F.count_if(finite()).alias("_f"), last.alias("_last"))
    by_seg = Window.partitionBy(*keys).orderBy("seg")
    earlier = by_seg.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    sums = sums.select(*keys, "seg", before("_m").alias("_before"), before("_f").alias("_fbefore"), F.lag("_last").over(by_seg).alias("_prev"), F.sum("_m").over(Window.partitionBy(*keys)).alias("n"))
    own = Window.partitionBy(*keys, "seg").orderBy(*order)
    running = own.rowsBetween(Window.unboundedPreceding, -1)
    ordered = parts.withColumns({
        "_pos": F.row_number().over(own) - 1,
        "_fpos": F.coalesce(F.sum(finite().cast("int")).over(running), F.lit(0)),
        "_own": F.lag(F.struct("t", "value")).over(own),
    })
    out = _joined(ordered, sums, [*keys, "seg"])
    previous = F.when(F.col("_pos") == 0, F.struct("_prev.t", "_prev.value")).otherwise(F.col("_own"))
    return out.select(*samples.columns, "n", (F.col("_before") + F.col("_pos")).alias("idx"), (F.col("_fbefore") + F.col("_fpos")).alias("finite_idx"), previous["t"].alias("prev_t"), previous["value"].alias("prev_value"))


def order_statistics(rows: DataFrame, keys: Sequence[str], column: str, ranks: dict[str, str], accuracy: int = ACCURACY, few: int = FEW) -> DataFrame:
    """keys and, by name, the value at each rank from 0 of the column's values; a rank is SQL over m, their count. NULLs don't count.

    Keys of at most `few` values are sorted as arrays, only longer ones are sketched.
    """
    keys = list(keys)
    r = rows.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("_v"))
    counts, longest = _sizes(r, keys)
    if longest <= few:
        return _short_statistics(r, keys, ranks)
    long = counts.where(F.col("_n") > few).select(*keys)
    short = _short_statistics(_joined(r, long, keys, "left_anti"), keys, ranks)
    return short.unionByName(_long_statistics(_joined(r, long, keys), keys, ranks, accuracy))


def _short_statistics(r: DataFrame, keys: list[str], ranks: dict[str, str]) -> DataFrame:
    """order_statistics() of keys whose values fit in an array."""
    # as grouping does, minus zero counts as zero
    value = F.col("_v") + F.lit(0) if r.schema["_v"].dataType.typeName() in ("double", "float") else F.col("_v")
    s = r.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_s")).withColumn("m", F.size("_s").cast("long"))
    found = s.select(*keys, *(F.expr(f"get(_s, cast({sql} AS int))").alias(name) for name, sql in ranks.items()))
    return found.where(F.coalesce(*ranks).isNotNull())


def _long_statistics(r: DataFrame, keys: list[str], ranks: dict[str, str], accuracy: int) -> DataFrame:
    sketch = F.percentile_approx("_v", [k / 1000 for k in range(1001)], accuracy)
    brackets = r.groupBy(*keys).agg(F.count("*").alias("m"), sketch.alias("_q"))
    place = {name: F.expr(f"cast({sql} AS bigint)") for name, sql in ranks.items()}
    step = lambda at, by: F.get("_q", F.least(F.lit(1000), F.greatest(F.lit(0), (F.floor(at * 1000 / F.col("m")) + by).cast("int"))))
    bracket = lambda name: F.struct(
        F.lit(name).alias("name"),
        place[name].alias("rank"),
        step(place[name], -1).alias("lo"),
        step(place[name], 2).alias("hi"),
    )
    brackets = brackets.select(*keys, F.array(*map(bracket, ranks)).alias("_b"))
    told = _joined(r, brackets, keys).select(*keys, "_v", F.explode(F.filter("_b", lambda b: F.col("_v") <= b["hi"])).alias("b"))
    counted = told.groupBy(*keys, "b.name", "b.rank", F.when(F.col("_v") >= F.col("b.lo"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*keys, "name").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    first = counted.withColumn("_first", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    found = first.where("_first <= rank AND rank < _first + _c")
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks))


def medians(rows: DataFrame, keys: Sequence[str], column: str, out: str = "median") -> DataFrame:
    """keys and the mean of the middle values of a column; keys without a value are missing."""
    both = order_statistics(rows, keys, column, {"_below": "(m - 1) div 2", "_above": "m div 2"})
    return both.select(*keys, ((F.col("_below") + F.col("_above")) / 2).alias(out))


def gap_rows(placed_rows: DataFrame) -> DataFrame:
    """Rows with a sample before them, with g, the step in time."""
    return placed_rows.where("idx > 0").withColumn("g", F.col("t") - F.col("prev_t"))


def periods(samples: DataFrame, keys: Sequence[str], rows: int = ROWS, ranges: int = RANGES) -> DataFrame:
    """keys, n, first_t, last_t, non_positive (steps of no time) and median_gap, the median of the positive steps."""
    return _periods(times(samples, keys, rows, ranges), keys)


def times(samples: DataFrame, keys: Sequence[str], rows: int = ROWS, ranges: int = RANGES) -> DataFrame:
    """keys, idx, t and prev_t of samples in their order, written once."""
    return scratch.stored(placed(samples.select(*keys, "t", "tie", "value"), keys, rows, ranges).select(*keys, "idx", "t", "prev_t"), "places")


def _periods(p: DataFrame, keys: Sequence[str]) -> DataFrame:
    g = gap_rows(p)
    whole = p.groupBy(*keys).agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count_if(F.col("t") - F.col("prev_t") <= 0).alias("non_positive"))
    return _joined(whole, medians(g.where("g > 0"), keys, "g", "median_gap"), keys, "left")


def continuity(samples: DataFrame, recordings: DataFrame, key: str = "recording_id", rows: int = ROWS, ranges: int = RANGES, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """quality.continuity() of samples: recordings has the key and the declarations, a row for each recording.

    known has times() and periods() of the samples, if they were needed before.
    """
    p = known[0] if known else times(samples, [key], rows, ranges)
    r = scratch.stored(_joined(known[1] if known else _periods(p, [key]), recordings, [key]), "periods")
    r = r.withColumn("unit_ratio", F.expr("CASE WHEN rate > 0D THEN median_gap / (1000D / rate) END"))
    r = r.withColumn("time_unit_mismatch", F.expr(f"coalesce(unit_ratio < {Q.UNIT_RATIO[0]}D OR unit_ratio > {Q.UNIT_RATIO[1]}D, false)"))
    r = r.withColumn("nominal", F.expr("CASE WHEN rate IS NULL THEN median_gap WHEN rate > 0D THEN 1000D / rate END"))
    near = _joined(gap_rows(p).select(key, "g"), r.select(key, "nominal"), [key])
    regular = near.groupBy(key).agg(F.count_if(F.abs(F.col("g") - F.col("nominal")) <= Q.GAP * F.col("nominal")).alias("regular"))
    r = _joined(r, regular, [key], "left").withColumn("regular", F.coalesce("regular", F.lit(0)))
    value = "CASE WHEN n < 2 THEN 100D WHEN time_unit_mismatch THEN NULL WHEN nominal > 0D THEN 100D * regular / (n - 1) ELSE 50D END"
    reason = "CASE WHEN n < 2 THEN 'ok' WHEN time_unit_mismatch THEN 'time_unit_mismatch' WHEN nominal > 0D AND regular = n - 1 THEN 'ok' ELSE 'irregular_gaps' END"
    return r.withColumns({"continuity": F.expr(value), "continuity_reason": F.expr(reason)}).drop("unit_ratio", "nominal", "regular")


def deskew(samples: DataFrame, keys: Sequence[str], sweep_s: float, period_s: float, rows: int = ROWS, ranges: int = RANGES) -> DataFrame:
    """timing.deskew() of samples (keys, ch_idx among them): keys, idx, value shifted to the common time base, NULL in the tail.

    A value is taken from its own place by a join on places, so the shift may be as long as the recording.
    """
    if period_s <= 0 or sweep_s < 0:
        raise ValueError("the sample period must be positive and the sweep not negative")
    keys = list(keys)
    shift = F.expr(f"cast(greatest(0, least(n - 1, floor(ch_idx * {float(sweep_s)!r}D / {float(period_s)!r}D))) AS bigint)")
    p = placed(samples, keys, rows, ranges).select(*keys, "idx", "value", shift.alias("shift"))
    moved = p.select(*keys, (F.col("idx") - F.col("shift")).alias("idx"), "value").where("idx >= 0")
    return _joined(p.drop("value"), moved, [*keys, "idx"], "left")


def _baseline(placed_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """baseline.r0_view_a() with what crossings need: a row per key. Only the window's values, 30 at most, are gathered."""
    f = finite()
    # 15 % of the finite values, from 5 to 30: a value is in the window if its place allows it whatever n is, so at most 30 are kept
    head = F.collect_list(F.when(f & (F.col("finite_idx") < 30), F.struct("finite_idx", "value")))
    g = placed_rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(f).alias("nf"), head.alias("head"), F.stddev_pop(F.when(f, F.col("value"))).alias("sd"), F.avg(F.when(f & (F.col("value") > 0), F.col("value"))).alias("positive"),
        F.max("value").alias("hi"), F.min("value").alias("lo"), F.max_by("value", "idx").alias("last"), F.min_by("value", "idx").alias("start"),
    )
    g = g.withColumn("k", F.expr(A.window_length("n"))).withColumn("kf", F.expr(A.window_length("nf")))
    g = g.withColumn("m", F.expr(A.median("transform(filter(head, s -> s.finite_idx < kf), s -> s.value)")))
    return g.withColumn("r0", F.expr("CASE WHEN m > 0D THEN m ELSE coalesce(positive, 1D) END")).drop("head", "m", "kf", "positive")


def device_agnostic(samples: DataFrame, keys: Sequence[str], sr: float = 10.0, rows: int = ROWS, ranges: int = RANGES) -> DataFrame:
    """features.device_agnostic() of samples: thresholds from one aggregate, crossings, extreme and area from the next two."""
    keys = list(keys)
    p = scratch.stored(placed(samples, keys, rows, ranges).select(*keys, "idx", "finite_idx", "value"), "places")
    b = _baseline(p, keys)
    b = b.withColumns({"short": F.expr("n < k + 2"), "dead": F.expr("coalesce(nf < 2 OR sd / r0 < 0.001D, true)"), "dir": F.expr("CASE WHEN abs(hi - r0) >= abs(lo - r0) THEN 1 ELSE -1 END")})
    b = b.withColumn("reach", F.expr("abs(CASE WHEN dir > 0 THEN hi ELSE lo END - r0)"))
    b = b.withColumns({f"th{s}": F.expr(f"greatest(lo, least(hi, r0 + 0.{s // 10}D * reach * dir))") for s in (10, 90)})
    beyond = lambda s: F.expr(f"CASE WHEN dir > 0 THEN value >= th{s} ELSE value <= th{s} END")
    back = lambda s: F.expr(f"CASE WHEN dir > 0 THEN value <= th{s} ELSE value >= th{s} END")
    up = _joined(p, b.select(*keys, "r0", "dir", "th10", "th90"), keys)
    first = up.groupBy(*keys).agg(
        F.min(F.when(beyond(10), F.col("idx"))).alias("i10"), F.min(F.when(beyond(90), F.col("idx"))).alias("i90"),
        F.min(F.struct((-F.abs(F.col("value") - F.col("r0"))).alias("less"), "idx"))["idx"].alias("peak"), F.sum(F.abs((F.col("value") - F.col("r0")) / F.col("r0"))).alias("area"),
    )
    b = _joined(b, first, keys)
    # what has come back by 90 % of the reach has come back by 10 % too: both returns are first places behind the peak
    down = _joined(p, b.select(*keys, "dir", "th10", "th90", "peak"), keys).where("idx >= peak")
    b = _joined(b, down.groupBy(*keys).agg(F.min(F.when(back(90), F.col("idx"))).alias("si"), F.min(F.when(back(10), F.col("idx"))).alias("ei")), keys, "left")
    alive = lambda x, dead: f"CASE WHEN short THEN -1D WHEN dead THEN {dead} ELSE {x} END"
    edges = "(abs((start - r0) / r0) + abs((last - r0) / r0)) / 2D"
    return b.select(
        *keys, "n", "r0", "peak", F.expr("short OR dead").alias("is_dead"),
        F.expr(alive("reach / r0", "0D")).alias("relative_amplitude"), F.expr(alive("cast(dir AS double)", "0D")).alias("direction"),
        F.expr(alive(f"CASE WHEN i10 < n - 1 AND i90 < n - 1 THEN abs(i90 - i10) / {sr}D ELSE -1D END", "-1D")).alias("rise_time"),
        F.expr(alive(f"CASE WHEN n - peak > 2 AND si IS NOT NULL AND ei IS NOT NULL THEN (ei - peak) / {sr}D ELSE -1D END", "-1D")).alias("decay_time"),
        F.expr(alive(f"CASE WHEN n < 2 THEN 0D ELSE area - {edges} END / {sr}D", "0D")).alias("auc"), F.expr(alive("(last - r0) / r0", "0D")).alias("endpoint_delta"),
    )


def channel_scores(samples: DataFrame, recordings: DataFrame, rows: int = ROWS, ranges: int = RANGES) -> DataFrame:
    """quality.channel_scores() of samples (recording_id, channel): medians, spans and recoveries by selection instead of sorted arrays."""
    keys = ["recording_id", "channel"]
    p = placed(samples, keys, rows, ranges).select(*keys, "n", "idx", "value")
    p = _joined(p, recordings.select("recording_id", "adc_max", "baseline", "r0_samples"), ["recording_id"])
    p = p.withColumn("k", F.expr(f"CASE WHEN r0_samples > 0 THEN r0_samples ELSE {A.window_length('n')} END"))
    f = finite()
    inside = f & F.expr("coalesce(baseline = 'explicit', false) OR idx < k")
    usable = f & F.expr("adc_max IS NULL OR (value < adc_max AND value > 0D)")
    p = scratch.stored(p.select(*keys, "idx", "value", "adc_max", F.when(inside, F.col("value")).alias("b"), F.when(usable, F.col("value")).alias("u")), "scored")
    g = p.groupBy(*keys).agg(
        F.count("*").alias("n"), F.first("adc_max").alias("adc_max"), F.count("b").alias("nb"), F.count("u").alias("nu"), F.avg(F.when(F.col("b") > 0, F.col("b"))).alias("positive"), F.stddev_pop("b").alias("sb"),
        F.stddev_pop(F.when(f, F.col("value"))).alias("sd"), F.count_if(F.expr("value <= 0D OR coalesce(value >= adc_max, false)")).alias("clipped"), F.max("u").alias("hi"), F.min("u").alias("lo"),
    )
    g = _joined(g, medians(p, keys, "b", "m"), keys, "left")
    g = g.withColumn("r0", F.expr("CASE WHEN nb = 0 THEN NULL WHEN m > 0D THEN m ELSE coalesce(positive, 1D) END"))
    g = g.withColumn("cv", F.expr("sb / r0")).withColumn("dead", F.expr(f"coalesce(sd / r0 < {Q.DEAD_CV}D, false)"))
    cut_at = "cast(greatest(1, floor(0.05D * (m - 1))) AS bigint)"
    spans = order_statistics(p, keys, "u", {"low": f"least(m - 1, {cut_at})", "high": f"greatest(0, m - 1 - {cut_at})"})
    # steps between usable values: their own order, with the clipped ones left out
    usable_rows = p.where("u IS NOT NULL").select(*keys, F.col("idx").cast("double").alias("t"), F.lit(0).alias("tie"), "value")
    steps = scratch.stored(placed(usable_rows, keys, rows, ranges).select(*keys, "n", "idx", "value", "prev_value"), "steps")
    noise = medians(steps.where("idx > 0").withColumn("d", F.abs(F.col("value") - F.col("prev_value"))), keys, "d", "noise")
    ends = steps.where("idx >= n - 15").groupBy(*keys).agg(F.collect_list("value").alias("tail"))
    g = _joined(_joined(_joined(g, spans, keys, "left"), noise, keys, "left"), ends, keys, "left")
    g = g.withColumn("net_span", F.expr(f"CASE WHEN nu < 5 THEN 0D ELSE greatest(0D, high - low - {Q.NOISE_SPAN}D * coalesce(noise, 0D) / 1.4142135623730951D) END"))
    g = g.withColumn("measured", F.expr("coalesce(r0 > 0D, false) AND nu > 0")).withColumn("peak", F.expr("CASE WHEN measured THEN greatest(abs((hi - r0) / r0), abs((lo - r0) / r0)) END"))
    final = A.median("transform(tail, x -> (x - r0) / r0)")
    return g.withColumns({
        "range_score": F.expr(A.clamp(f"net_span / coalesce(adc_max, {Q.ADC_MAX}D) * {1 / Q.SPAN}D")),
        "free_score": F.expr("CASE WHEN n = 0 THEN 100D ELSE 100D * (1D - clipped / n) END"),
        "signal_score": F.expr(f"CASE WHEN NOT measured THEN 0D ELSE 100D * {A.clamp(f'peak / greatest(coalesce(cv, 1D), 1e-6D) / {Q.SNR}D')} END"),
        "recovery_score": F.expr(f"CASE WHEN NOT measured THEN 0D ELSE 100D * (1D - {A.clamp(f'abs({final}) / greatest(peak, 1e-6D)')}) END"),
    }).select(*keys, "n", "r0", "cv", "dead", "net_span", "clipped", "range_score", "free_score", "signal_score", "recovery_score")


def quality(samples: DataFrame, recordings: DataFrame, rows: int = ROWS, ranges: int = RANGES, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """quality.quality() of samples (recording_id, channel, t, tie, value) whose recordings have the declarations, a row each.

    A recording's times are those of all its channels' samples; known is as in continuity().
    """
    return Q.report(channel_scores(samples, recordings, rows, ranges), continuity(samples.drop("channel"), recordings, "recording_id", rows, ranges, known))


#: Segments of the queries, small enough that the tables' recordings have several.
_ROWS, _RANGES = 500, 32


def _longrun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by line number, seven recordings of which the first holds a quarter of the rows."""
    i = views.table(spark, sf_dir, "lineitem")
    return i.select(F.col("l_linenumber").alias("recording_id"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).cast("double").alias("t"), F.struct("l_orderkey", "l_partkey").alias("tie"), F.col("l_extendedprice").alias("value"))


def _q_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.stream_samples(spark, sf_dir).drop("channel")
    out = continuity(s, Q.declare(s.select("recording_id").distinct(), adc_max="200D"), rows=_ROWS, ranges=_RANGES)
    return out.selectExpr("recording_id", f"{A.snap('continuity', 6)} AS continuity", "continuity_reason", "time_unit_mismatch")


def _q_gap_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods(views.stream_samples(spark, sf_dir), ["recording_id", "channel"], _ROWS, _RANGES).selectExpr("recording_id", "channel", "n", f"{A.snap('median_gap', 3)} AS period_ms", "cast(non_positive AS int) AS non_positive")


def _q_deskew(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _longrun(spark, sf_dir).withColumn("ch_idx", F.col("recording_id") % 4)
    out = deskew(s, ["recording_id", "ch_idx"], 0.25, 0.1, _ROWS, _RANGES)
    return out.groupBy("recording_id").agg(F.count("*").alias("n"), F.count("value").alias("n_values"), F.sum(F.col("value") * (F.col("idx") % 10)).alias("s"), F.max(F.when(F.col("value").isNotNull(), F.col("idx"))).alias("last_idx")).selectExpr("recording_id", "n", "n_values", f"{A.snap('s', 1)} AS weighted_sum", "last_idx")


def _q_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth sample of the long recordings with its place and the sample before it."""
    p = placed(_longrun(spark, sf_dir), ["recording_id"], _ROWS, _RANGES).where("idx % 10 = 0")
    return p.selectExpr("recording_id", "n", "idx", "finite_idx", "t", "prev_t", "value", "prev_value")


def _q_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = device_agnostic(_longrun(spark, sf_dir), ["recording_id"], rows=_ROWS, ranges=_RANGES)
    return out.selectExpr("recording_id", "n", "cast(peak AS int) AS peak_idx", "is_dead", "cast(direction AS int) AS direction", *(f"{A.snap(c, 4)} AS {c}" for c in ("r0", "relative_amplitude", "rise_time", "decay_time", "auc", "endpoint_delta")))


def _q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.stream_samples(spark, sf_dir)
    ordered = times(s.drop("channel"), ["recording_id"], _ROWS, _RANGES)
    of = scratch.stored(_periods(ordered, ["recording_id"]), "periods")
    declared = Q.declare(of.select("recording_id", "median_gap"), guess_rate="1000D / median_gap", adc_max="200D", role="'exposure'", baseline="'auto'").drop("median_gap")
    out = quality(s, declared, _ROWS, _RANGES, (ordered, of))
    return out.selectExpr("recording_id", *(f"{A.snap(c, 5)} AS {c}" for c in Q.WEIGHTS), "total", "badge", "n_dead", "array_join(flags, ',') AS flags")


def _q_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = views.table(spark, sf_dir, "lineitem").where("l_extendedprice > 0")
    q = order_statistics(i, ["l_returnflag"], "l_extendedprice", {"low": "cast(floor(0.05D * (m - 1)) AS bigint)", "below": "(m - 1) div 2", "above": "m div 2", "most": "m - 1"}, few=100)
    return q.selectExpr("l_returnflag", "low", f"{A.snap('(below + above) / 2D', 4)} AS median", "most")


QUERIES = {"continuity": _q_continuity, "gap_period": _q_gap_period, "long_deskew": _q_deskew, "long_places": _q_places, "long_crossings": _q_crossings, "long_quality": _q_quality, "selected_medians": _q_medians}

_LONG = "longrun AS (SELECT l_linenumber AS recording_id, epoch_ms(l_shipdate)::DOUBLE AS t, l_extendedprice AS v, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_shipdate, l_orderkey, l_partkey, l_extendedprice) - 1 AS idx, count(*) OVER (PARTITION BY l_linenumber) AS n FROM lineitem)"
_s = A.snap


def _oracle() -> dict[str, str]:
    from vapora.operators.features import _agnostic

    return {
        "continuity": Q.ORACLE_SQL["continuity"],
        "gap_period": Q.ORACLE_SQL["gap_period"],
        "long_quality": Q.ORACLE_SQL["quality_report"],
        "long_places": f"WITH {_LONG}, p AS (SELECT recording_id, n, idx, idx AS finite_idx, t, lag(t) OVER w AS prev_t, v AS value, lag(v) OVER w AS prev_value FROM longrun WINDOW w AS (PARTITION BY recording_id ORDER BY idx)) SELECT * FROM p WHERE idx % 10 = 0",
        "long_deskew": f"WITH {_LONG}, d AS (SELECT recording_id, idx, lead(v, least(n - 1, floor(recording_id % 4 * 0.25::DOUBLE / 0.1::DOUBLE))::INT) OVER (PARTITION BY recording_id ORDER BY idx) AS value FROM longrun) SELECT recording_id, count(*) AS n, count(value) AS n_values, {_s('sum(value * (idx % 10))', 1)} AS weighted_sum, max(idx) FILTER (value IS NOT NULL) AS last_idx FROM d GROUP BY recording_id",
        "long_crossings": f"WITH {_LONG}, {_agnostic('longrun', 'recording_id')} SELECT recording_id, n, peak::INT AS peak_idx, is_dead, direction::INT AS direction, {', '.join(f'{_s(c, 4)} AS {c}' for c in ('r0', 'relative_amplitude', 'rise_time', 'decay_time', 'auc', 'endpoint_delta'))} FROM da",
        "selected_medians": f"WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS r, count(*) OVER (PARTITION BY l_returnflag) AS m FROM lineitem WHERE l_extendedprice > 0) SELECT l_returnflag, max(v) FILTER (r = floor(0.05::DOUBLE * (m - 1))) AS low, {_s('median(v)', 4)} AS median, max(v) AS most FROM r GROUP BY l_returnflag",
    }


ORACLE_SQL = _oracle()
