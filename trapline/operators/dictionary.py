"""Dictionary coding of the six text columns.

A dictionary is a table ``(id bigint, value string)``, both unique. The coded
fact table holds ids; decoding joins them back.

Ids are dense and follow the binary order of the values (1, 2, 3, ... for a
new dictionary; ``max(id) + 1 ...`` for values added later). They are assigned
without moving all values to one task: values are range-partitioned and
sorted, the partitioned result is checkpointed to the shared checkpoint
folder (so a lost executor cannot change partition contents between the two
passes), each partition counts its rows, the per-partition start offsets (one
row per partition - a bound fixed by the partition count) are broadcast, and
every row gets ``offset + position in partition``.

Joins against dictionaries are plain equi-joins: Spark's adaptive planner
broadcasts a dictionary only when its measured size is under the broadcast
threshold, and splits skewed join partitions (a user name holding a third of
all rows) when it is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TEXT_COLUMNS
from ..session import checkpoint_root


def _num_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def assign_dense_ids(values: DataFrame, start: int = 0, value_col: str = "value",
                     num_partitions: int | None = None, group_col: str | None = None,
                     starts: dict | None = None) -> DataFrame:
    """Dense ids in binary value order.

    ``values`` holds distinct, non-null values in ``value_col`` (and, with
    ``group_col``, one independent id sequence per group, each starting after
    ``starts[group]``). Returns ``([group,] id, value)``.
    """
    spark = values.sparkSession
    checkpoint_root(spark)
    n = num_partitions or _num_partitions(values)
    gk = [group_col] if group_col else []
    keys = [*gk, "value"]
    ranged = (
        values.select(*gk, F.col(value_col).alias("value"))
        .repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .checkpoint(eager=True)
    )
    pid = F.spark_partition_id()
    # row position inside the partition: low 33 bits of the generated id
    position = F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)
    with_pos = ranged.select(*keys, pid.alias("_pid"), position.alias("_pos"))
    # per (group, partition): row count and first position (rows of a group
    # are contiguous inside a partition because rows are sorted by group)
    counts = with_pos.groupBy(*gk, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    before = Window.partitionBy(*gk).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*gk, "_pid", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    if group_col and starts:
        base = F.coalesce(
            F.element_at(F.create_map(*[x for k, v in starts.items() for x in (F.lit(k), F.lit(int(v)))]),
                         F.col(group_col)),
            F.lit(0),
        )
    else:
        base = F.lit(start)
    # offsets: one row per (group, partition), a size fixed by the plan
    return with_pos.join(F.broadcast(offsets), [*gk, "_pid"]).select(
        *gk,
        (base + F.col("_offset") + F.col("_pos") - F.col("_first") + 1).cast("long").alias("id"),
        "value",
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()


def stacked_values(df: DataFrame, columns) -> DataFrame:
    """Distinct non-null ``(column, value)`` pairs of several columns, in one
    shuffle (partial aggregation drops repeats before it)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]))
    return (
        df.select(pairs.alias("_kv"))
        .select("_kv.column", "_kv.value")
        .where(F.col("value").isNotNull())
        .distinct()
    )


def build_dictionary(df: DataFrame, column: str) -> DataFrame:
    """Dictionary of the distinct non-null values of ``column``."""
    return assign_dense_ids(distinct_values(df, column))


def split_stacked(ids: DataFrame, columns=None) -> dict[str, DataFrame]:
    """The stacked ``(column, id, value)`` form -> ``{column: (id, value)}``."""
    return {c: ids.filter(F.col("column") == F.lit(c)).select("id", "value") for c in columns or TEXT_COLUMNS}


def build_dictionaries(df: DataFrame, columns=None, stacked: bool = False):
    """Dictionaries of several columns from one pass over ``df``: one shuffle,
    one checkpoint. Returns ``{column: (id, value)}``, or the stacked
    ``(column, id, value)`` table when ``stacked``."""
    columns = list(columns or TEXT_COLUMNS)
    ids = assign_dense_ids(stacked_values(df, columns), group_col="column").checkpoint(eager=True)
    return ids if stacked else split_stacked(ids, columns)


def stack_dictionaries(dicts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for c, d in dicts.items():
        part = d.select(F.lit(c).alias("column"), "id", "value")
        out = part if out is None else out.unionByName(part)
    return out


def new_entries(dictionary: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """Dictionary rows for the values of ``df[column]`` the dictionary lacks,
    with ids above its current maximum (insert-or-ignore: known values get
    nothing, so adding the same values twice adds nothing the second time).
    A plain anti-join: which side is broadcast, if any, goes by bytes."""
    new = distinct_values(df, column).join(dictionary.select("value"), "value", "left_anti")
    top = dictionary.agg(F.max("id")).first()[0] or 0
    return assign_dense_ids(new, start=int(top))


def known_entries(stacked_dict: DataFrame, values: DataFrame) -> DataFrame:
    """The entries ``(column, id, value)`` of distinct ``(column, value)`` pairs that a
    stacked dictionary has: one pass over it. However large it is, only ``values``
    need to move if they are the smaller side (the adaptive planner goes by bytes)."""
    return stacked_dict.join(values, ["column", "value"]).select("column", "id", "value")


def extend_dictionary(dictionary: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """The dictionary plus ``new_entries`` for ``df[column]``."""
    fresh = new_entries(dictionary, df, column)
    return dictionary.select("id", "value").unionByName(fresh)


def _tuple_key(columns) -> Column:
    """A digest of a row's values. Senders choose the values, so it is one in which nobody can make two rows meet."""
    told = [F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.col(c)) for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(t, F.lit("-")) for t in told]).cast("binary"), 256))


def _known(column: str, found: Column) -> Column:
    missing = F.raise_error(F.concat(F.lit(f"value missing from dictionary {column}: "), F.coalesce(column, F.lit("NULL"))))
    return F.when(found.isNull(), missing).otherwise(found)


def encode(df: DataFrame, dictionaries: dict[str, DataFrame], columns=None) -> DataFrame:
    """Replace text columns by dictionary ids. A value missing from its
    dictionary, or NULL, fails the job (the coded table allows no NULL id)."""
    out = df
    for c in columns or TEXT_COLUMNS:
        d = dictionaries[c].select(F.col("value").alias(c), F.col("id").alias(f"_{c}_id"))
        out = out.join(d, c, "left")
        out = out.withColumn(c, _known(c, F.col(f"_{c}_id"))).drop(f"_{c}_id")
    return out.select(*df.columns)


def encode_collapsed(df: DataFrame, stacked: DataFrame, columns=None) -> DataFrame:
    """``encode`` for dictionaries that are too large to broadcast; ``stacked`` holds
    them as ``(column, id, value)``, and ``df`` is read twice, so it should be stored.

    ``encode`` shuffles the rows once for each such dictionary. Here they are
    collapsed to their distinct tuples of values, whose values meet all
    dictionaries in one join, and the ids come back by the tuple's digest: the rows
    are shuffled twice at most, whatever the number of columns, and a tuple sent a
    billion times is encoded once."""
    columns = list(columns or TEXT_COLUMNS)
    keyed = df.withColumn("_tuple", _tuple_key(columns))
    tuples = keyed.select("_tuple", *columns).distinct()
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]))
    ids = tuples.select("_tuple", pairs).join(stacked, ["column", "value"])
    coded = ids.groupBy("_tuple").agg(*[F.max(F.when(F.col("column") == F.lit(c), F.col("id"))).alias(f"_{c}_id") for c in columns])
    out = keyed.join(coded, "_tuple", "left")
    return out.select(*[_known(c, F.col(f"_{c}_id")).alias(c) if c in columns else c for c in df.columns])


def decode(fact: DataFrame, dictionaries: dict[str, DataFrame], columns=None) -> DataFrame:
    """Replace id columns by their values (inner joins: a fact row whose id
    is missing from a dictionary drops out). Only ``columns`` are decoded
    (default all six); the joins of unrequested dictionaries are skipped."""
    out = fact
    for c in columns or TEXT_COLUMNS:
        d = dictionaries[c].select(F.col("id").alias(c), F.col("value").alias(f"_{c}_v"))
        out = out.join(d, c, "inner").withColumn(c, F.col(f"_{c}_v")).drop(f"_{c}_v")
    return out.select(*fact.columns)
