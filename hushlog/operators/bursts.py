"""Bursts: gap sessions per key, the position of each row in its burst, and the decision.

Rows of one key may be a third of the table, so no task ever orders a whole key.  Time is cut into
moments no longer than the shortest gap, of all or of the key; no burst can end inside a moment.  Per key and moment a
few plain aggregates (built before the shuffle) are all that is needed to find the bursts, and a
row's position is the count before its moment plus its rank inside it.  Moments with very many rows
are cut further, by exact time and by runs of ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushlog.functions import classify
from hushlog.options import Options
from hushlog.schemas import KEY, ORDER

# Moments that one task orders at a time while bursts are found (a minute at the default gaps).
MOMENTS_PER_STRETCH = 600

# Keys are hashed to this many buckets that share a grain: a table of a megabyte.
GRAIN_BUCKETS = 65_536

# What a cell knows about the burst it lies in.
_CARRY = ["burst_no", "life_no", "first_ms", "life_start_ms", "n_before"]


def _span_ms(opts: Options) -> int:
    """Width of a span, which moments of every width divide from its start on."""
    return max(opts.grain_ms, min(opts.idle_ms, max(opts.chunk_ms, opts.coordinates_ms, 2 * opts.general_ms)))


def _span(opts: Options) -> Column:
    # integer arithmetic; pmod keeps times before 1970 in order
    width = F.lit(_span_ms(opts)).cast("long")
    # rows without a time would all meet in one cell and never be told apart
    no_time = F.raise_error(F.lit("a log row has no event_ms, bursts need one"))
    ms = F.coalesce(F.col("event_ms"), no_time.cast("long"))
    return (ms - F.pmod(ms, width)).alias("span")


def _moment(grain: Column) -> Column:
    since = F.col("event_ms") - F.col("span")
    return F.col("event_ms") - F.pmod(since, grain)


def _bucket() -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(GRAIN_BUCKETS)).alias("bucket")


def key_grains(df: DataFrame, opts: Options) -> DataFrame:
    """``(bucket, grain)``: how wide moments may be for the keys of a bucket, their shortest gap.

    At most ``GRAIN_BUCKETS`` rows.  Keys whose records all have long gaps take fewer moments.
    """
    shortest = F.least(F.min("window_ms"), F.lit(opts.idle_ms)).cast("long")
    grain = F.greatest(shortest, F.lit(opts.grain_ms).cast("long"))
    return df.groupBy(_bucket()).agg(grain.alias("grain"))


def _crowded_moments(located: DataFrame, opts: Options) -> DataFrame:
    """``(moment, run_width)`` of moments with more than ``hot_rows`` rows.

    A run of ``seq`` that wide holds about ``block_rows`` rows of one source and millisecond,
    however densely ``seq`` is used.  The first pass reads ``event_ms`` alone; the second is
    skipped at run time when nothing is crowded.
    """
    crowded = (
        located.groupBy("moment")
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") > opts.hot_rows)
        .select("moment")
    )
    spread = (F.max("seq").cast("double") - F.min("seq") + 1) * opts.block_rows
    shares = F.approx_count_distinct("source") * F.approx_count_distinct("event_ms")
    width = F.ceil(spread * shares / F.count(F.lit(1))).cast("long")
    return (
        located.join(_small(crowded, opts), "moment", "left_semi")
        .groupBy("moment")
        .agg(F.greatest(F.lit(opts.block_rows).cast("long"), width).alias("run_width"))
    )


def _small(crowded: DataFrame, opts: Options) -> DataFrame:
    """Broadcast when the bound, rows / hot_rows moments of 16 bytes, is small at any scale."""
    return F.broadcast(crowded) if opts.hot_rows >= 100_000 else crowded


def _located(
    df: DataFrame, opts: Options, grains: DataFrame | None
) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``moment``, and the part of it whose moments may be crowded.

    Moments are as wide as the grain of their key, and of the finest width in spans with more than
    ``hot_rows`` rows: a wider moment holds no more than that.
    """
    finest = F.lit(opts.grain_ms).cast("long")
    spans = df.withColumn("span", _span(opts))
    if grains is None:
        located = spans.withColumn("moment", _moment(finest)).drop("span")
        return located, located
    busy = _small(
        spans.groupBy("span")
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") > opts.hot_rows)
        .select("span", F.lit(True).alias("is_busy")),
        opts,
    )
    grain = F.when(F.col("is_busy"), finest).otherwise(F.coalesce("grain", finest))
    located = (
        spans.join(busy, "span", "left")
        .withColumn("bucket", _bucket())
        .join(F.broadcast(grains), "bucket", "left")
        .withColumn("moment", _moment(grain))
        .drop("span", "is_busy", "bucket", "grain")
    )
    crowded = spans.join(busy, "span", "left_semi").withColumn("moment", _moment(finest))
    return located, crowded


def _with_cell(df: DataFrame, opts: Options, grains: DataFrame | None = None) -> DataFrame:
    """Add ``cell``: the moment, and for crowded moments the exact time, source and run of seq."""
    located, crowded = _located(df, opts, grains)
    width = F.col("run_width")

    def fine(column: Column, name: str) -> Column:
        return F.when(width.isNotNull(), column).alias(name)

    return (
        located.join(_small(_crowded_moments(crowded, opts), opts), "moment", "left")
        .withColumn(
            "cell",
            F.struct(
                F.col("moment"),
                fine(F.col("event_ms"), "ms"),
                fine(F.col("source"), "source"),
                fine(F.col("seq") - F.pmod(F.col("seq"), width), "run"),
            ),
        )
        .drop("moment", "run_width")
    )


def _spot(*place: str) -> Column:
    """Hash of a key and a place in it: leading the key, it decides most comparisons of a sort."""
    return F.xxhash64(*KEY, *place)


def _burst_cells(located: DataFrame, opts: Options) -> DataFrame:
    """One row per key and cell with its place in the key's bursts.

    Three narrow shuffles: cells are aggregated and ordered within stretches of about a minute,
    the first cell of every stretch then collects what lies before it, and hands it on.
    """
    # merged near copies may differ in gap length: a key has that of its first row
    gap_of_first = F.min_by("window_ms", F.struct(*ORDER))
    cells = (
        located.withColumn("spot", _spot("cell"))
        .groupBy("spot", *KEY, "cell")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("event_ms").alias("cell_first_ms"),
            F.max("event_ms").alias("cell_last_ms"),
            gap_of_first.alias("gap_ms"),
        )
    )
    width = F.lit(opts.grain_ms * MOMENTS_PER_STRETCH).cast("long")
    moment = F.col("cell.moment")
    cells = cells.withColumn("stretch", moment - F.pmod(moment, width)).withColumn("spot", _spot("stretch"))

    idle = F.lit(opts.idle_ms)
    first_ms, prev_ms = F.col("cell_first_ms"), F.col("prev_ms")
    pause = first_ms - prev_ms
    new_life = (pause > idle).alias("new_life")
    new_burst = (pause > F.least(idle, F.col("gap_ms"))).alias("new_burst")

    def marked(condition: Column, value: Column) -> Column:
        return F.when(condition, value)

    # 1. inside a stretch
    stretch = Window.partitionBy("spot", *KEY, "stretch")
    ordered = stretch.orderBy("cell")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    inner = (
        cells.select(
            "*",
            F.lag("cell_last_ms").over(ordered).alias("prev_ms"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        )
        .select(
            "*",
            prev_ms.isNull().alias("is_head"),
            F.coalesce(new_life, F.lit(False)).alias("life_break"),
            F.coalesce(new_burst, F.lit(False)).alias("burst_break"),
        )
    )
    breaks = F.col("burst_break").cast("long")
    lives = F.col("life_break").cast("long")
    burst_ms = marked(F.col("burst_break"), first_ms)
    burst_rows = marked(F.col("burst_break"), F.col("rows_before"))
    life_ms = marked(F.col("life_break"), first_ms)
    inner = inner.select(
        "spot",
        *KEY,
        "cell",
        "stretch",
        "rows",
        "cell_first_ms",
        "cell_last_ms",
        "gap_ms",
        "prev_ms",
        "is_head",
        "rows_before",
        F.sum(breaks).over(upto).alias("bursts"),
        F.sum(lives).over(upto).alias("lives"),
        F.max(burst_ms).over(upto).alias("burst_ms"),
        F.max(burst_rows).over(upto).alias("burst_rows"),
        F.max(life_ms).over(upto).alias("life_ms"),
        F.sum("rows").over(stretch).alias("all_rows"),
        F.max("cell_last_ms").over(stretch).alias("all_last_ms"),
        F.sum(breaks).over(stretch).alias("all_bursts"),
        F.sum(lives).over(stretch).alias("all_lives"),
        F.max(burst_ms).over(stretch).alias("all_burst_ms"),
        F.max(burst_rows).over(stretch).alias("all_burst_rows"),
        F.max(life_ms).over(stretch).alias("all_life_ms"),
    )

    # 2. across stretches: only first cells share a lane, other cells stay in their own stretch
    lane = Window.partitionBy("lane_spot", *KEY, "lane").orderBy("cell")
    lane_before = lane.rowsBetween(Window.unboundedPreceding, -1)
    lanes = inner.withColumn("lane", F.when(~F.col("is_head"), F.col("stretch")))
    heads = lanes.withColumn("lane_spot", _spot("lane")).select(
        "*",
        F.lag("all_last_ms").over(lane).alias("stretch_prev_ms"),
        F.coalesce(F.sum("all_rows").over(lane_before), F.lit(0)).alias("base_rows"),
    )
    stretch_pause = first_ms - F.col("stretch_prev_ms")
    first_ever = F.col("stretch_prev_ms").isNull()
    heads = heads.select(
        "*",
        (first_ever | (stretch_pause > idle)).alias("head_life"),
        (first_ever | (stretch_pause > F.least(idle, F.col("gap_ms")))).alias("head_burst"),
    )
    head_burst, head_life = F.col("head_burst"), F.col("head_life")
    base = F.col("base_rows")
    burst_ms_here = marked(head_burst, first_ms)
    burst_rows_here = marked(head_burst, base)
    life_ms_here = marked(head_life, first_ms)
    bursts_here = head_burst.cast("long")
    lives_here = head_life.cast("long")

    def running(total: Column, here: Column) -> Column:
        return F.coalesce(F.sum(total).over(lane_before), F.lit(0)) + here

    def latest(total: Column, here: Column) -> Column:
        return F.coalesce(here, F.max(total).over(lane_before))

    heads = heads.select(
        "*",
        running(bursts_here + F.col("all_bursts"), bursts_here).alias("head_bursts"),
        running(lives_here + F.col("all_lives"), lives_here).alias("head_lives"),
        latest(F.coalesce(F.col("all_burst_ms"), burst_ms_here), burst_ms_here).alias(
            "head_burst_ms"
        ),
        latest(
            F.coalesce(base + F.col("all_burst_rows"), burst_rows_here), burst_rows_here
        ).alias("head_burst_rows"),
        latest(F.coalesce(F.col("all_life_ms"), life_ms_here), life_ms_here).alias(
            "head_life_ms"
        ),
    )

    # 3. back inside the stretch: its first cell hands the totals on
    def handed(name: str) -> Column:
        return F.first(name).over(upto)

    return heads.select(
        *KEY,
        "cell",
        "rows",
        "cell_first_ms",
        "cell_last_ms",
        (handed("head_bursts") + F.col("bursts")).alias("burst_no"),
        (handed("head_lives") + F.col("lives")).alias("life_no"),
        F.coalesce(F.col("burst_ms"), handed("head_burst_ms")).alias("first_ms"),
        F.coalesce(F.col("life_ms"), handed("head_life_ms")).alias("life_start_ms"),
        (
            handed("base_rows")
            + F.col("rows_before")
            - F.coalesce(handed("base_rows") + F.col("burst_rows"), handed("head_burst_rows"))
        ).alias("n_before"),
    )


def burst_table(df: DataFrame, opts: Options = Options()) -> DataFrame:
    """One row per key and burst: start, end, rows and how many of them are suppressed.

    Works on aggregates only; nothing is sorted or ranked at row level.
    """
    cells = _burst_cells(_with_cell(df, opts), opts)
    bursts = cells.groupBy(*KEY, "life_no", "burst_no").agg(
        F.min("cell_first_ms").alias("first_ms"),
        F.max("cell_last_ms").alias("last_ms"),
        F.sum("rows").alias("n_rows"),
    )
    over = F.col("n_rows") - classify.threshold(F.col("level"), opts)
    return bursts.withColumn("suppressed", F.greatest(over, F.lit(0)).cast("long"))


def with_bursts(
    df: DataFrame, opts: Options = Options(), grains: DataFrame | None = None
) -> DataFrame:
    """Add ``life_no, burst_no, n, first_ms, duration_ms`` (and ``life_start_ms``) to keyed rows.

    ``grains`` (see :func:`key_grains`, of the same rows) spares moments; they cost a pass over the
    keys, which pays where the rows are stored.

    ``n`` is the row's position in its burst in ``(event_ms, source, seq)`` order.  The rows are
    shuffled and sorted once; a row holding what came before leads each cell.
    """
    located = _with_cell(df, opts, grains)
    leads = _burst_cells(located, opts).select(*KEY, "cell", *_CARRY, F.lit(0).alias("is_row"))
    mixed = located.withColumn("is_row", F.lit(1)).unionByName(leads, allowMissingColumns=True)
    mixed = mixed.withColumn("spot", _spot("cell"))
    in_cell = Window.partitionBy("spot", *KEY, "cell").orderBy("is_row", *ORDER)
    upto = in_cell.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = {name: F.first(name).over(upto) for name in _CARRY}
    placed = mixed.withColumns(
        {**carried, "n": F.first("n_before").over(upto) + F.row_number().over(in_cell) - 1}
    )
    return (
        placed.filter(F.col("is_row") == 1)
        .withColumn("duration_ms", F.col("event_ms") - F.col("first_ms"))
        .drop("is_row", "n_before", "cell", "spot")
    )


def decide(df: DataFrame, opts: Options = Options()) -> DataFrame:
    """Add ``threshold`` and ``allowed``: the first rows of a burst pass, the rest is suppressed."""
    return df.withColumn("threshold", classify.threshold(F.col("level"), opts)).withColumn(
        "allowed", F.col("n") <= F.col("threshold")
    )
