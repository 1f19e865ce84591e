"""From change events to one row per changed row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.functions.names import key_column, log_version
from changeflow.schemas import ACTIONS, CORRUPT, DELETED, VERSION


def _well_formed(rows: str = "rows") -> Column:
    """Updates carry (before, after) pairs, so an odd number of images cannot be decoded."""
    return F.col(rows).isNotNull() & ((F.col("action") != "update") | (F.size(rows) % 2 == 0))


def decode_changes(events: DataFrame, keep_before: bool = False) -> DataFrame:
    """One row per changed row, its columns taken from the image.

    ``events`` has ``action`` and ``rows`` (an array of row structs). Inserts and
    deletes give every image; updates give the after-image of each pair. Other
    actions give nothing. ``row_idx`` numbers the images of an event, and
    ``keep_before`` adds the before-image of updates as the struct ``before``.
    """
    known = events.where(F.col("action").isin(*ACTIONS) & _well_formed())
    event_columns = [c for c in events.columns if c != "rows"]
    is_after = (F.col("action") != "update") | (F.col("row_idx") % 2 == 1)
    if not keep_before:
        images = known.select(*event_columns, F.posexplode("rows").alias("row_idx", "image"))
        return images.where(is_after).select(*event_columns, "row_idx", "image.*")
    paired = F.transform(
        "rows",
        lambda row, i: F.struct(
            row.alias("image"),
            F.when((F.col("action") == "update") & (i % 2 == 1), F.get("rows", i - 1)).alias("before"),
        ),
    )
    images = known.select(*event_columns, F.posexplode(paired).alias("row_idx", "pair"))
    return images.where(is_after).select(*event_columns, "row_idx", "pair.before", "pair.image.*")


def malformed_events(events: DataFrame) -> DataFrame:
    """Events of a known action that ``decode_changes`` cannot decode, for the quarantine."""
    return events.where(F.col("action").isin(*ACTIONS) & ~_well_formed())


def parse_images(
    changes: DataFrame,
    image: T.StructType,
    bad_rows: Observation | None = None,
    keep_before: bool = False,
    key: str = "id",
) -> tuple[DataFrame, DataFrame]:
    """Split changes with JSON images into typed rows and rows that do not fit the schema.

    An image fits if it has the columns of the schema, no more and no fewer, by their
    exact names, and its key is not null. A change without ``after`` (a delete) is read from ``before``. ``bad_rows``
    receives the number of rows that do not fit, as ``bad``, once the typed rows are
    written, so the second frame is only needed when there are any. ``keep_before``
    adds the before-image as the struct ``before``.
    """
    schema = T.StructType([*image.fields, T.StructField(CORRUPT, T.StringType())])
    text = F.coalesce("after", "before")
    parsed = changes.withColumn("_image", F.from_json(text, schema, {"mode": "PERMISSIVE"}))
    own_key = key if key in image.names else image.names[0]
    same_columns = F.array_sort(F.json_object_keys(text)) == F.array(*[F.lit(n) for n in sorted(image.names)])
    fits = F.col(f"_image.{CORRUPT}").isNull() & same_columns & F.col(f"_image.{own_key}").isNotNull()
    broken = F.col("_image").isNull() | ~F.coalesce(fits, F.lit(False))
    if bad_rows is not None:
        parsed = parsed.observe(bad_rows, F.count_if(broken).alias("bad"))
    replaced = {"before", "after", "ddl_query", *image.names}
    kept = [c for c in changes.columns if c not in replaced]
    before = [F.from_json("before", image).alias("before")] if keep_before else []
    good = parsed.where(~broken).select(*kept, *before, *[F.col(f"_image.{n}").alias(n) for n in image.names])
    return good, parsed.where(broken).select(*changes.columns)


def versioned(changes: DataFrame, by_position: bool = False) -> DataFrame:
    """Add ``_version`` (place in the log) and ``_deleted``."""
    version = log_version(changes.columns, by_position)
    return changes.withColumns({VERSION: version, DELETED: F.col("action") == "delete"})


def keyed(changes: DataFrame, key: str = "id") -> DataFrame:
    """Add the key as ``key_value``: column ``id``, or the first column of the table."""
    return changes.withColumn("key_value", F.col(key_column(changes, key)))


def key_moves(changes: DataFrame, key: str = "id") -> DataFrame:
    """Deletes of the old key for updates that change the key.

    Needs the before-image as the struct ``before``. By default such updates leave
    the old key behind; adding these rows to the changes removes it.
    """
    key = key if key in changes.schema["before"].dataType.names else changes.schema["before"].dataType.names[0]
    moved = changes.where((F.col("action") == "update") & (F.col(f"before.{key}") != F.col(key)))
    old = {name: F.col(f"before.{name}") for name in changes.schema["before"].dataType.names}
    return moved.withColumns({**old, "action": F.lit("delete")})
