"""Positions, chunks and prefix scans for ordered per-session data.

A session may hold any share of the table, so nothing here puts a whole session into one task.
Rows carry a dense position (``frame_idx``); ``position div size`` is the chunk, and every window
runs on ``(session, chunk)``:

* windows with a bounded reach get a *halo*: rows close to a chunk border are copied into the
  neighbouring chunk and dropped again afterwards (``halo`` / ``core``);
* unbounded running values are two-level: inside the chunk, then over one summary row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .quantiles import exact_percentiles as by_rank

CHUNK_ROWS = 4096
BUCKET_SECONDS = 600


def time_bucket(ts: str, seconds: int = BUCKET_SECONDS) -> Column:
    """Coarse time slice of a timestamp; finer than a session, ordered like it."""
    since = f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))"
    return F.expr(f"floor({since} / {seconds})")


def dense_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column, name: str
) -> DataFrame:
    """0-based ``row_number`` per key that never sorts a whole key in one task.

    ``bucket`` must be monotone in the first ordering column.  Rows are numbered inside
    ``(keys, bucket)`` and shifted by the number of rows in the earlier buckets of the key.  There may be
    about as many buckets as rows, so the join is by sorting, as the rows already are.
    """
    keys = list(keys)
    cut = df.withColumn("_bucket", bucket)
    local = cut.withColumn(
        "_rn", F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order))
    )
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    shift = (
        cut.groupBy(*keys, "_bucket")
        .agg(F.count("*").alias("_n"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    )
    return (
        local.join(shift.hint("merge"), [*keys, "_bucket"])
        .withColumn(name, (F.col("_rn") - 1 + F.col("_shift")).cast("bigint"))
        .drop("_bucket", "_rn", "_shift")
    )


def halo(
    df: DataFrame, idx: str, before: int, after: int, size: int | None = None
) -> DataFrame:
    """Add ``_chunk``/``_core`` and copy border rows to the chunks whose rows look at them."""
    i = F.col(idx)
    lo = F.floor((i - F.lit(after)) / F.lit(size or CHUNK_ROWS))
    hi = F.floor((i + F.lit(before)) / F.lit(size or CHUNK_ROWS))
    return (
        df.withColumn("_chunk", F.explode(F.sequence(lo, hi)))
        .withColumn("_core", F.col("_chunk") == F.floor(i / F.lit(size or CHUNK_ROWS)))
    )


def core(df: DataFrame) -> DataFrame:
    """Drop the halo copies."""
    return df.where("_core").drop("_core")


def chunked(df: DataFrame, idx: str, size: int | None = None) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(idx) / F.lit(size or CHUNK_ROWS)))


def by_chunk(keys: Sequence[str], idx: str, *extra: str) -> W:
    return W.partitionBy(*keys, "_chunk", *extra).orderBy(idx)


def spread_to_chunks(per_key: DataFrame, last_idx: str, size: int | None = None) -> DataFrame:
    """One row per chunk of the key, so that a per-key value joins on ``(key, _chunk)``.

    The frame side is already partitioned that way by its windows: no exchange, and a hot key
    meets its value in as many tasks as it has chunks.
    """
    top = F.floor(F.col(last_idx) / F.lit(size or CHUNK_ROWS))
    return per_key.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), top))).drop(
        last_idx
    )


def join_per_key(df: DataFrame, per_key: DataFrame, keys: Sequence[str], idx: str, last_idx: str = "_last") -> DataFrame:
    """Rows with their key's value; the join is on (key, chunk), so the rows of a hot key meet it in many tasks.

    ``per_key`` has one row per key with the key's last position in ``last_idx`` (dropped).
    """
    return chunked(df, idx).join(spread_to_chunks(per_key, last_idx), [*keys, "_chunk"]).drop("_chunk")


def last_positions(df: DataFrame, keys: Sequence[str], idx: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(idx).alias("_last"))


def running_last(
    df: DataFrame, keys: Sequence[str], idx: str, values: dict[str, Column], size: int | None = None
) -> DataFrame:
    """``last(value, ignorenulls)`` up to and including each row, for any session length."""
    keys = list(keys)
    w = by_chunk(keys, idx).rowsBetween(W.unboundedPreceding, 0)
    names = list(values)
    cut = chunked(df, idx, size).select("*", *[v.alias(f"_v_{n}") for n, v in values.items()])
    inside = cut.select("*", *[F.last(f"_v_{n}", True).over(w).alias(f"_in_{n}") for n in names])
    past = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        cut.groupBy(*keys, "_chunk")
        .agg(*[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(idx))).alias(f"_t_{n}")
               for n in names])
        .select(*keys, "_chunk", *[F.last(f"_t_{n}", True).over(past).alias(f"_c_{n}") for n in names])
    )
    out = inside.join(carry, [*keys, "_chunk"])
    for n in names:
        out = out.withColumn(n, F.coalesce(f"_in_{n}", f"_c_{n}"))
    return out.drop("_chunk", *[f"{p}{n}" for n in names for p in ("_v_", "_in_", "_c_")])


def running_sum(
    df: DataFrame, keys: Sequence[str], idx: str, values: dict[str, Column], size: int | None = None
) -> DataFrame:
    """Inclusive running sums per key, two-level."""
    keys = list(keys)
    w = by_chunk(keys, idx).rowsBetween(W.unboundedPreceding, 0)
    names = list(values)
    cut = chunked(df, idx, size).select("*", *[v.alias(f"_v_{n}") for n, v in values.items()])
    inside = cut.select("*", *[F.sum(f"_v_{n}").over(w).alias(f"_in_{n}") for n in names])
    past = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        cut.groupBy(*keys, "_chunk")
        .agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
        .select(*keys, "_chunk", *[F.sum(f"_t_{n}").over(past).alias(f"_c_{n}") for n in names])
    )
    out = inside.join(carry, [*keys, "_chunk"])
    for n in names:
        out = out.withColumn(n, F.coalesce(f"_in_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0)))
    return out.drop("_chunk", *[f"{p}{n}" for n in names for p in ("_v_", "_in_", "_c_")])


# A reset of a reflected walk is a step far below anything the walk can climb inside a chunk; over
# chunks it is far below anything that still matters.
_LOCAL_RESET = -(1 << 20)
_CHUNK_RESET = -(1 << 31)


def walk_in_chunk(df: DataFrame, part: Sequence[str], idx: str, step: Column) -> DataFrame:
    """Walk ``c <- max(0, c + step)`` inside each chunk; NULL step resets it to 0.

    ``_s`` is the plain running sum, ``_lo`` the walk started from 0.  Started from a carry ``v``
    the walk is ``greatest(_lo, v + _s)``: such maps are closed under composition, which is what
    lets the chunk totals be combined by windows.
    """
    w = W.partitionBy(*part).orderBy(idx).rowsBetween(W.unboundedPreceding, 0)
    return (
        df.withColumn("_d", F.coalesce(step, F.lit(_LOCAL_RESET)).cast("bigint"))
        .withColumn("_s", F.sum("_d").over(w))
        .withColumn("_lo", F.col("_s") - F.least(F.lit(0), F.min("_s").over(w)))
    )


def walk_first_passage(
    walked: DataFrame, keys: Sequence[str], idx: str, level: int, also: Column | None = None
) -> DataFrame:
    """Per key the first position where the walk reaches ``level`` (or ``also`` holds), else NULL.

    Each chunk is summarised once: its first passage for every possible carry below ``level``,
    its total and its end value.  The carries then follow from windows over the chunk rows.
    """
    keys = list(keys)
    hit = F.col("_lo") >= level
    if also is not None:
        hit = hit | F.coalesce(also, F.lit(False))
    per_carry = [
        F.min(F.when(hit | (F.col("_s") >= level - v), F.col(idx))) for v in range(level)
    ]
    chunks = (
        walked.groupBy(*keys, "_chunk")
        .agg(
            F.array(*per_carry).alias("_hits"),
            F.max_by("_s", idx).alias("_end_s"),
            F.max_by("_lo", idx).alias("_end_lo"),
            F.max(idx).alias("_end"),
        )
        .withColumn(
            "_end_s", F.when(F.col("_end_s") < _LOCAL_RESET // 2, F.lit(_CHUNK_RESET)).otherwise(F.col("_end_s"))
        )
    )
    upto = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, 0)
    prev = W.partitionBy(*keys).orderBy("_chunk")
    return (
        chunks.withColumn("_t", F.sum("_end_s").over(upto))
        .withColumn("_out", F.col("_t") + F.max(F.col("_end_lo") - F.col("_t")).over(upto))
        .withColumn("_carry", F.coalesce(F.lag("_out").over(prev), F.lit(0)))
        .withColumn("_carry", F.least(F.col("_carry"), F.lit(level - 1)).cast("int"))
        .groupBy(*keys)
        .agg(
            F.min(F.element_at("_hits", F.col("_carry") + 1)).alias("first_hit"),
            F.max("_end").alias("_last"),
        )
    )


def running_max_before(
    df: DataFrame, keys: Sequence[str], idx: str, value: Column, name: str, size: int | None = None
) -> DataFrame:
    """Largest value of the earlier rows of the key (NULL on the first), two-level."""
    keys = list(keys)
    w = by_chunk(keys, idx).rowsBetween(W.unboundedPreceding, -1)
    cut = chunked(df, idx, size).withColumn("_v", value)
    past = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        cut.groupBy(*keys, "_chunk")
        .agg(F.max("_v").alias("_t"))
        .select(*keys, "_chunk", F.max("_t").over(past).alias("_c"))
    )
    return (
        cut.withColumn("_in", F.max("_v").over(w))
        .join(carry, [*keys, "_chunk"])
        .withColumn(name, F.greatest("_in", "_c"))
        .drop("_chunk", "_v", "_in", "_c")
    )


def reflected_walk(
    df: DataFrame, keys: Sequence[str], idx: str, step: Column, name: str, size: int | None = None
) -> DataFrame:
    """``c <- max(0, c + step)`` along each key, two-level and exact (steps must not be NULL)."""
    keys = list(keys)
    walked = walk_in_chunk(chunked(df, idx, size), [*keys, "_chunk"], idx, step)
    ends = walked.groupBy(*keys, "_chunk").agg(
        F.max_by("_s", idx).alias("_end_s"), F.max_by("_lo", idx).alias("_end_lo")
    )
    upto = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, 0)
    prev = W.partitionBy(*keys).orderBy("_chunk")
    carry = (
        ends.withColumn("_t", F.sum("_end_s").over(upto))
        .withColumn("_out", F.col("_t") + F.max(F.col("_end_lo") - F.col("_t")).over(upto))
        .select(*keys, "_chunk", F.coalesce(F.lag("_out").over(prev), F.lit(0)).alias("_carry"))
    )
    return (
        walked.join(carry, [*keys, "_chunk"])
        .withColumn(name, F.greatest(F.col("_lo"), F.col("_carry") + F.col("_s")))
        .drop("_chunk", "_d", "_s", "_lo", "_carry")
    )


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float], width: float | None = None) -> DataFrame:
    """Linearly interpolated percentiles by rank (see ``quantiles``); ranges follow the values, ``width`` plays no part."""
    return by_rank(df, keys, value, points)
