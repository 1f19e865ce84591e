"""The visible state of replicated tables: the newest version of each key, without deleted keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeflow.schemas import DELETED, VERSION

KEYS = ("table_name", "id")


def latest_per_key(changes: DataFrame, keys: Sequence[str] = KEYS, version: str = VERSION) -> DataFrame:
    """The newest row of each key, tombstones included.

    Spark limits each key to one row before the shuffle as well, so a key with
    most of the log costs the shuffle one row per task.
    """
    newest = Window.partitionBy(*keys).orderBy(F.col(version).desc())
    return changes.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def without_deleted(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col(DELETED)).drop(DELETED)


def current_state(changes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Current rows from a versioned change log (``_version``, ``_deleted``)."""
    return without_deleted(latest_per_key(changes, keys))


def state_by_anti_join(changes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The same state from separate writes and deletes: a row survives unless its
    key was deleted after it was written.

    Both sides hold one row per key before they meet.
    """
    writes = latest_per_key(changes.where(~F.col(DELETED)), keys).drop(DELETED)
    deletes = (
        changes.where(F.col(DELETED))
        .groupBy(*[F.col(k).alias(f"_d_{k}") for k in keys])
        .agg(F.max(VERSION).alias("_d_version"))
    )
    same_key = [F.col(k) == F.col(f"_d_{k}") for k in keys]
    return writes.join(deletes, [*same_key, F.col(VERSION) < F.col("_d_version")], "left_anti")


def merge_onto(snapshot: DataFrame, changes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Snapshot (one row per key) with a change log applied, tombstones included.

    Both sides hold one row per key before they meet, and each is read and shuffled once.
    """
    columns = snapshot.columns
    old = snapshot.select(*keys, F.struct(*columns).alias("_old"))
    new = latest_per_key(changes, keys).select(*keys, F.struct(*columns).alias("_new"))
    newer = F.col("_old").isNull() | (F.col(f"_new.{VERSION}") > F.col(f"_old.{VERSION}"))
    winner = F.when(newer, F.col("_new")).otherwise(F.col("_old"))
    return old.join(new, list(keys), "full_outer").select(winner.alias("_row")).select("_row.*")


def patch_onto(snapshot: DataFrame, changes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``merge_onto`` for a small change log.

    When Spark finds the newest changes below its broadcast threshold, the snapshot
    is not shuffled: it is read once to replace rows, and its key columns once more
    to find the keys it lacks. Above the threshold the joins shuffle, and
    ``merge_onto`` is the better choice.
    """
    columns = snapshot.columns
    newest = latest_per_key(changes, keys).select(*columns)
    new = newest.select(*keys, F.struct(*columns).alias("_new"))
    newer = F.col(f"_new.{VERSION}") > F.col(VERSION)
    kept = snapshot.join(new, list(keys), "left_outer").select(
        *[F.when(newer, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    )
    present = snapshot.select(*keys).join(newest.select(*keys), list(keys), "left_semi")
    added = newest.join(present, list(keys), "left_anti")
    return kept.unionByName(added)
