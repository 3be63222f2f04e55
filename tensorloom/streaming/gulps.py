"""Gulps of frames, gaps, late packets, sequence changes, look-ups by time.

None of these needs a window over a whole stream: gulps are groups of frames,
a gap is filled from the gulp it is in, and a change of sequence is found by
comparing a row with the one before it in its own block of frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlapping_gulps(rows: DataFrame, frame: str, size: int, stride: int, out: str = "gulp") -> DataFrame:
    """Each row once for each gulp that holds it; gulp ``g`` is frames ``g stride`` to ``g stride + size``."""
    if not 0 < stride <= size:
        raise ValueError("the stride must be from 1 to the gulp's size")
    first = F.greatest(F.lit(0).cast("bigint"), F.expr(f"(`{frame}` - {size} + {stride}) div {stride}"))
    last = F.expr(f"`{frame}` div {stride}")
    return rows.withColumn(out, F.explode(F.sequence(first, last)))


def fill_skipped(rows: DataFrame, frame: str, values: list[str], gulp: int, lanes: list[str]) -> DataFrame:
    """Rows for every frame of each lane between its first and last; skipped ones are zero.

    A lane's frames are made by gulps, so a long gap is spread over tasks.
    """
    ends = rows.groupBy(*lanes).agg(F.min(frame).alias("__lo"), F.max(frame).alias("__hi"))
    gulps = ends.withColumn("__g", F.explode(F.expr(f"sequence(__lo div {gulp}, __hi div {gulp})")))
    all_frames = gulps.withColumn(frame, F.explode(F.expr(f"sequence(greatest(__lo, __g * {gulp}), least(__hi, __g * {gulp} + {gulp - 1}))")))
    out = all_frames.select(*lanes, frame).join(rows, [*lanes, frame], "left")
    return out.select(*lanes, frame, *[F.coalesce(c, F.lit(0)).alias(c) for c in values])


def drop_late(packets: DataFrame, arrival: str, seq: str, lanes: list[str], gulp: int, block: str, tolerance: int = 2) -> tuple[DataFrame, DataFrame]:
    """Packets in time, and the number of late ones by lane.

    A packet is late if, when it arrives, one of ``tolerance`` gulps ahead has
    come before in its ``block`` (a bounded stretch of arrivals, a column).
    """
    w = Window.partitionBy(*lanes, block).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.max(F.expr(f"`{seq}` div {gulp}")).over(w)
    judged = packets.withColumn("__late", F.coalesce(F.expr(f"`{seq}` div {gulp}") + tolerance <= ahead, F.lit(False)))
    late = judged.groupBy(*lanes).agg(F.sum(F.col("__late").cast("bigint")).alias("n_late"), F.sum((~F.col("__late")).cast("bigint")).alias("n_good"))
    return judged.where(~F.col("__late")).drop("__late"), late


def blank_missing(rows: DataFrame, gulp: str, source: str, values: list[str], expected: int) -> DataFrame:
    """Sources of which a gulp lacks more than it has are set to zero there."""
    good = rows.groupBy(gulp, source).agg(F.count("*").alias("__good"))
    out = rows.join(good, [gulp, source])
    bad = expected - F.col("__good") > F.col("__good")
    return out.select(*[F.when(bad, F.lit(0)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])


def sequence_starts(rows: DataFrame, order: str, key: list[str], lanes: list[str], block: int) -> DataFrame:
    """The rows at which a lane's ``key`` differs from the row before.

    ``order`` is a dense integer in each lane.  The row before is met by an
    equi-join with the rows moved by one, so no lane is sorted as a whole.
    """
    before = rows.select(*lanes, (F.col(order) + 1).alias(order), F.struct(*key).alias("__before"))
    joined = rows.join(before, [*lanes, order], "left")
    return joined.where(F.col("__before").isNull() | (F.struct(*key) != F.col("__before"))).drop("__before")


def capture_status(rows: DataFrame, order: str, key: list[str], lanes: list[str], active: str | None = None) -> DataFrame:
    """``STARTED``, ``CHANGED`` or ``CONTINUED`` for each row of a lane.

    With the column ``active`` (whether data came), rows without data are
    ``ENDED`` after one with data and else ``NO_DATA``, and the next row with
    data is ``STARTED`` again.  ``order`` is a dense integer in each lane.
    """
    on = F.col(active) if active else F.lit(True)
    before = rows.select(*lanes, (F.col(order) + 1).alias(order), F.struct(*key).alias("__before"), on.alias("__was"))
    joined = rows.join(before, [*lanes, order], "left")
    was = F.coalesce(F.col("__was"), F.lit(False))
    status = F.when(~on & was, "ENDED").when(~on, "NO_DATA").when(~was, "STARTED").when(F.struct(*key) != F.col("__before"), "CHANGED").otherwise("CONTINUED")
    return joined.withColumn("status", status).drop("__before", "__was")


def sequence_at(requests: DataFrame, sequences: DataFrame, time: str, tag: str, lanes: list[str], which: str = "at", block: float = 4096) -> DataFrame:
    """For each request the sequence with the greatest ``tag`` not after ``time``.

    ``which`` may also be ``earliest`` or ``latest``, of the lane, or ``next``,
    the one with the least ``tag`` after ``time``.  Both sides go into sorted
    stretches of ``block`` units of time, in which a running maximum of (tag,
    sequence) gives the answer; what a stretch begins with comes from one row
    for each stretch before it.  No pairs are made, and no lane is sorted as a
    whole.  ``sequences`` has the lanes, ``tag`` and ``seq``.
    """
    kinds = {c: sequences.schema[c].dataType for c in (tag, "seq")}
    pair = F.struct(F.col(tag).alias("__tag"), F.col("seq").alias("__seq"))
    if which in ("earliest", "latest"):
        ends = sequences.groupBy(*lanes).agg((F.min if which == "earliest" else F.max)(pair).alias("__f"))
        return requests.join(ends, lanes, "left").select(*requests.columns, F.col("__f.__seq").alias("seq"))
    if which not in ("at", "next"):
        raise ValueError(f"unknown sequence {which!r}")
    none = [F.lit(None).cast(kinds[c]).alias(f"__{'tag' if c == tag else 'seq'}") for c in (tag, "seq")]
    a = requests.select(*requests.columns, F.col(time).alias("__t"), F.lit(1).alias("__kind"), *none)
    b = sequences.select(*lanes, F.col(tag).alias("__t"), F.lit(0).alias("__kind"), F.col(tag).alias("__tag"), F.col("seq").alias("__seq"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__b", F.floor(F.col("__t").cast("double") / block))
    own = F.when(F.col("__tag").isNotNull(), F.struct("__tag", "__seq"))
    if which == "at":
        best, order, stretches = F.max, ["__t", "__kind"], [F.asc("__b")]
    else:  # backwards in time, a request before the sequences of its own time
        best, order, stretches = F.min, [F.desc("__t"), F.desc("__kind")], [F.desc("__b")]
    within = Window.partitionBy(*lanes, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*lanes).orderBy(*stretches).rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(*lanes, "__b").agg(best(own).alias("__last")).withColumn("__carry", best("__last").over(before)).drop("__last")
    found = both.withColumn("__f", best(own).over(within)).where("__kind = 1").join(carried, [*lanes, "__b"])
    return found.select(*requests.columns, F.coalesce("__f", "__carry")["__seq"].alias("seq"))
