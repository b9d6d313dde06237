"""Deletes that cascade, and what blocks them.

References are edges (child row, parent row). Deleting a row takes the rows that
refer to it by a cascading reference along; any other row that refers to it and is not
deleted itself blocks it, and a blocked row blocks the row it would have gone with.
Both are found by rounds of semi-joins over the edges until nothing changes; the
rounds follow the depth of the reference graph, not the number of rows."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .constraints import CASCADES, FOREIGN_KEYS


def edges(tables: dict[str, DataFrame], fks=FOREIGN_KEYS, cascades=CASCADES) -> DataFrame:
    """(child, child_id, fk_column, cascade, parent, parent_id) of every non-null
    reference; each child table is scanned once. ids as text."""
    by_child: dict = {}
    for child, col, parent, _ in fks:
        if child in tables:
            by_child.setdefault(child, []).append(F.struct(
                F.lit(col).alias("fk_column"), F.lit((child, col) in cascades).alias("cascade"), F.lit(parent).alias("parent"),
                F.col(col).cast("string").alias("parent_id")))
    return reduce(DataFrame.unionByName, [
        tables[child].select(F.lit(child).alias("child"), F.col("id").cast("string").alias("child_id"), F.inline(F.array(*refs)))
        for child, refs in by_child.items()]).where(F.col("parent_id").isNotNull())


def _nodes(df: DataFrame, table: str = "table_name", key: str = "id") -> DataFrame:
    return df.select(F.col(table).alias("table_name"), F.col(key).alias("id"))


def closure(requested: DataFrame, refs: DataFrame, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The requested rows and all rows that go with them, (table_name, id) each once."""
    reach = store(requested.distinct())
    new, cascading = reach, refs.where("cascade")
    while True:
        below = cascading.join(new, (F.col("parent") == F.col("table_name")) & (F.col("parent_id") == F.col("id")), "left_semi")
        new = store(_nodes(below, "child", "child_id").distinct().join(reach, ["table_name", "id"], "left_anti"))
        if new.isEmpty():
            return reach
        reach = store(reach.unionByName(new))


def cascade(requested: DataFrame, refs: DataFrame, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(table_name, id, requested, outcome, blocking) of the requested rows and of all
    that would go with them. ``requested``: (table_name, id as text); ``refs``: rows
    of ``edges``; ``store`` writes a frame and reads it back (rounds are cut there).

    ``outcome``: ``deleted``; ``blocked`` (a row that stays refers to it; ``blocking``
    lists the references as table.column); ``spared`` (not requested, and the row it
    would have gone with stays). The largest set of rows is deleted that leaves no
    reference behind; a requested id that no row refers to is deleted."""
    requested = requested.select("table_name", F.col("id").cast("string").alias("id")).where("id is not null")
    reach = closure(requested, refs, store)
    into = store(refs.join(reach, (F.col("parent") == F.col("table_name")) & (F.col("parent_id") == F.col("id")), "left_semi"))
    child = lambda df, nodes, how: df.join(nodes, (F.col("child") == F.col("table_name")) & (F.col("child_id") == F.col("id")), how)
    parent = lambda df, nodes, how: df.join(nodes, (F.col("parent") == F.col("table_name")) & (F.col("parent_id") == F.col("id")), how)
    at = ["table_name", "id"]

    def holding(alive: DataFrame, blocked: DataFrame) -> DataFrame:
        """The references that keep their parent: rows that stay, and rows that would go with it but are blocked."""
        return child(into.where("NOT cascade"), alive, "left_anti").unionByName(child(into.where("cascade"), blocked, "left_semi"))

    alive, blocked = reach, reach.limit(0)
    while True:
        stuck = _nodes(holding(alive, blocked), "parent", "parent_id").distinct()
        held = _nodes(parent(into.where("cascade"), alive, "left_semi"), "child", "child_id")
        spared = alive.join(requested, at, "left_anti").join(held, at, "left_anti")
        left = store(alive.join(stuck.unionByName(spared).distinct(), at, "left_anti"))
        if left.count() == alive.count():
            break
        alive, blocked = left, store(stuck)
    why = (holding(alive, blocked).groupBy(F.col("parent").alias("table_name"), F.col("parent_id").alias("id"))
           .agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(".", "child", "fk_column"))), ",").alias("blocking")))  # one name per reference at most
    out = (reach.join(requested.distinct().withColumn("requested", F.lit(True)), ["table_name", "id"], "left")
           .join(alive.withColumn("_alive", F.lit(True)), ["table_name", "id"], "left").join(why, ["table_name", "id"], "left"))
    return out.select("table_name", "id", F.coalesce("requested", F.lit(False)).alias("requested"),
                      F.when(F.col("_alive"), "deleted").when(F.col("blocking").isNotNull(), "blocked").otherwise("spared").alias("outcome"),
                      F.coalesce("blocking", F.lit("")).alias("blocking"))


def guest_deletes(requested: DataFrame, refs: DataFrame, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Per guest asked to be deleted (column guest_id): blocked, the tables that block
    it, and how many channel identities go with it."""
    asked = requested.select(F.lit("guests").alias("table_name"), F.col("guest_id").cast("string").alias("id")).distinct()
    done = store(cascade(asked, refs, store))
    gone = refs.where("cascade AND child = 'guest_channel_identities'").select(F.col("child_id").alias("id"), F.col("parent_id").alias("guest"))
    with_it = (done.where("table_name = 'guest_channel_identities' AND outcome = 'deleted'").select("id").join(gone, "id")
               .groupBy("guest").agg(F.count(F.lit(1)).alias("n")))
    tables = F.array_join(F.array_distinct(F.transform(F.split("blocking", ","), lambda x: F.substring_index(x, ".", 1))), ",")
    return (done.where("table_name = 'guests'").join(with_it, F.col("id") == F.col("guest"), "left")
            .select(F.col("id").cast("bigint").alias("guest_id"), (F.col("outcome") != "deleted").alias("blocked"), tables.alias("blocking_tables"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("cascaded_identities")))
