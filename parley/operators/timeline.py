"""Order-dependent operators over event rows: batches, hysteresis, islands, gaps, decision tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    """Seconds since 1970 as a double; session time zones don't matter for timestamps without one."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def ordered(key: str, order: list[str]):
    return Window.partitionBy(key).orderBy(*order)


def count_batches(rows: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """`batch`: every `size` rows of a key, from 0."""
    return rows.withColumn("batch", F.floor((F.row_number().over(ordered(key, order)) - 1) / size).cast("long"))


def hysteresis(rows: DataFrame, key: str, order: list[str], value: str, threshold: float, length: int) -> DataFrame:
    """`busy`: on when the last `length` values are all above the threshold, off when none is, else as before; off at first."""
    w = ordered(key, order)
    last = w.rowsBetween(1 - length, 0)
    full = F.count(F.lit(1)).over(last) == length
    flip = F.when(full & (F.min(value).over(last) > threshold), True).when(full & (F.max(value).over(last) <= threshold), False)
    held = F.last("_flip", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_flip", flip).withColumn("busy", F.coalesce(held, F.lit(False))).drop("_flip")


def islands(rows: DataFrame, key: str, order: list[str], ts: str, gap: int) -> DataFrame:
    """`island`: rises by one where `gap` seconds or more have passed since the row before."""
    w = ordered(key, order)
    before = F.lag(ts).over(w)
    new = F.when(before.isNull() | (seconds(F.col(ts)) - seconds(before) >= gap), 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def gaps(rows: DataFrame, key: str, order: list[str], ts: str, longest: int) -> DataFrame:
    """How often more than `longest` seconds pass between rows of a key."""
    before = F.lag(ts).over(ordered(key, order))
    return rows.select(key, (seconds(F.col(ts)) - seconds(before)).alias("_gap")).groupBy(key).agg(F.count_if(F.col("_gap") > longest).alias("gaps"))


def hardware_tier(gpu: Column, cores: Column, memory: Column) -> Column:
    """Performance tier by kind of graphics processor, cores and memory."""
    strong, fair = (memory >= 16) & (cores >= 8), (memory >= 12) & (cores >= 6)
    return (
        F.when(gpu.isin("metal", "cuda"), F.when(strong, "ultra").otherwise("high"))
        .when(gpu.isin("vulkan", "opencl"), F.when(fair, "high").otherwise("medium"))
        .otherwise(F.when(strong, "medium").otherwise("low"))
    )


def chunk_ms(tier: Column) -> Column:
    return F.when(tier == "ultra", 25_000).when(tier == "high", 20_000).when(tier == "medium", 15_000).otherwise(10_000).cast("long")


def observations(polls: DataFrame, key: str, order: list[str]) -> DataFrame:
    """What a detector sees at each poll (at, titled, relay, broad): connected, and since when (first_seen).

    While a window is there and no relay connection was seen, any connection counts; after one was
    seen only a relay does. Without a window it starts anew. A connection that the first poll finds
    was there before the detector, which is told by first_seen 0.
    """
    sofar = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = polls.withColumn("island", F.count_if(~F.col("titled")).over(sofar))
    within = Window.partitionBy(key, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("latch", F.bool_or(F.col("relay") & F.col("titled")).over(within))
    rows = rows.withColumn("connected", F.col("titled") & (F.col("relay") | (~F.col("latch") & F.col("broad"))))
    rows = rows.withColumn("run", F.count_if(~F.col("connected")).over(sofar))
    began = F.min(F.when(F.col("connected"), F.col("at"))).over(Window.partitionBy(key, "run"))
    return rows.withColumn("first_seen", F.when(F.col("connected"), F.when(F.col("run") == 0, 0.0).otherwise(began))).drop("island", "latch", "run")


def in_ranges(rows: DataFrame, ranges: DataFrame, family: str, value: str, width: int) -> DataFrame:
    """`rows` with the range (low, high) of their family that holds their value, null if none does.

    Ranges and values meet in cells of `width`, so the join has an equality and needs no broadcast.
    """
    whole = lambda c: F.expr(f"{c} div {width}")
    placed = ranges.withColumn("cell", F.explode(F.sequence(whole("low"), whole("high"))))
    r, p = rows.withColumn("at_cell", whole(value)).alias("r"), placed.alias("p")
    same = (F.col(f"r.{family}") == F.col(f"p.{family}")) & (F.col("r.at_cell") == F.col("p.cell")) & F.col(f"r.{value}").between(F.col("p.low"), F.col("p.high"))
    rest = [F.col(f"p.{c}") for c in ranges.columns if c not in rows.columns]
    return r.join(p, same, "left").select(*(F.col(f"r.{c}") for c in rows.columns), *rest)


def released(chunks: DataFrame, key: str, at: str, kind: str, waits: dict[str, int]) -> DataFrame:
    """`chunks` with the time of the first chunk of their key that comes at least the wait of their kind later.

    Chunks and deadlines of a key go by once from the latest to the earliest, with the last chunk seen in hand.
    """
    wait = F.lit(None).cast("long")
    for name, least in waits.items():
        wait = F.when(F.col(kind) == name, F.lit(least)).otherwise(wait)
    own = [c for c in chunks.columns]
    marks = F.array(F.struct(F.lit(False).alias("due"), F.col(at).alias("t")), F.struct(F.lit(True).alias("due"), (F.col(at) + wait).alias("t")))
    rows = chunks.withColumn("_mark", F.explode(marks)).withColumns({"_due": F.col("_mark.due"), "_t": F.col("_mark.t")})
    falling = Window.partitionBy(key).orderBy(F.col("_t").desc_nulls_last(), "_due").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    poll = F.min(F.when(~F.col("_due"), F.col("_t"))).over(falling)
    return rows.withColumn("_poll", poll).where("_due").select(*own, F.when(F.col("_t").isNotNull(), F.col("_poll")).alias("released"))


def without_repeats(rows: DataFrame, key: str, order: list[str], content: list[str]) -> DataFrame:
    """Rows that differ in `content` from the row before them."""
    mark = F.struct(*content)
    before = F.lag(mark).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("repeated", mark.eqNullSafe(before)).where("NOT repeated").drop("repeated")


def overall_progress(stage: Column, percent: Column, shares: dict[str, tuple[int, int]]) -> Column:
    """Progress within a stage as progress of the whole; `shares` gives each stage's begin and end."""
    out = F.lit(None).cast("long")
    for name, (low, high) in shares.items():
        out = F.when(stage == name, (low + F.floor(F.least(percent, F.lit(100.0)) * ((high - low) / 100))).cast("long")).otherwise(out)
    return out
