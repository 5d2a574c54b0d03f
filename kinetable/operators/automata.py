"""Finite automata over ordered rows, without a scan of a session.

A row turns states into states, so a run of rows is the composition of its maps, and compositions are associative.  Rows are
composed in chunks of ``ROWS``, chunks in groups of as many, and what is left of a session (one map in ``ROWS`` squared rows)
in one go.  Then the states come down again: from the state before a group to those before its chunks and its rows.  All of
it is arrays and higher-order functions; a task holds a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

ROWS = 256


def transition_table(step: Callable[[int, int], int], codes: int, states: int) -> list[list[int]]:
    """For every code of a row the state that follows each state."""
    return [[step(s, c) for s in range(states)] for c in range(codes)]


def _literal(table: list[list[int]]) -> Column:
    return F.array(*[F.array(*[F.lit(x) for x in row]) for row in table])


def _composed(items: Column, states: int, map_of: Callable[[Column], Column]) -> Column:
    identity = F.array(*[F.lit(s) for s in range(states)])
    return F.aggregate(items, identity, lambda acc, item: F.transform(acc, lambda s: F.element_at(map_of(item), s + 1)))


def _followed(items: Column, start: Column, map_of: Callable[[Column], Column]) -> Column:
    """(position, state before, state after) of every item."""
    shape = "array<struct<i:bigint,before:int,after:int>>"
    zero = F.struct(start.cast("int").alias("s"), F.array().cast(shape).alias("out"))

    def step(acc: Column, item: Column) -> Column:
        after = F.element_at(map_of(item), acc["s"] + 1)
        row = F.struct(item["i"].alias("i"), acc["s"].alias("before"), after.alias("after"))
        return F.struct(after.alias("s"), F.concat(acc["out"], F.array(row)).alias("out"))

    return F.aggregate(items, zero, step, lambda acc: acc["out"])


def _states(rows: DataFrame, keys: Sequence[str], states: int, levels: int, map_of: Callable[[Column], Column]) -> DataFrame:
    """(keys, i, before, after) of (keys, i, m); ``map_of`` gives the map of an item (i, m)."""
    item = F.array_sort(F.collect_list(F.struct("i", "m")))
    if not levels:
        lists = rows.groupBy(*keys).agg(item.alias("_items")).withColumn("_start", F.lit(0))
    else:
        above = rows.withColumn("_group", F.floor(F.col("i") / F.lit(ROWS))).groupBy(*keys, "_group").agg(item.alias("_items"))
        maps = above.select(*keys, F.col("_group").alias("i"), _composed(F.col("_items"), states, map_of).alias("m"))
        starts = _states(maps, keys, states, levels - 1, lambda x: x["m"])
        lists = above.join(starts.select(*keys, F.col("i").alias("_group"), F.col("before").alias("_start")), [*keys, "_group"])
    return lists.select(*keys, F.inline(_followed(F.col("_items"), F.col("_start"), map_of)))


def run(rows: DataFrame, keys: Sequence[str], idx: str, code: Column, table: list[list[int]]) -> DataFrame:
    """(keys, idx, state): the state after each row, from state 0 before the first row of a key.

    ``code`` numbers the rows' maps in ``table``.  Positions must not repeat within a key; gaps in them are no rows.
    """
    literal = _literal(table)
    items = rows.select(*keys, F.col(idx).cast("bigint").alias("i"), code.cast("int").alias("m"))
    out = _states(items, list(keys), len(table[0]), 2, lambda x: F.element_at(literal, x["m"] + 1))
    return out.select(*keys, F.col("i").alias(idx), F.col("after").alias("state"))
