"""Problem 4: records that are the same but for case, punctuation, white space or field order.

Method: canonical records are range-partitioned and externally sorted on (full key, id); each sorted partition is then
scanned once for adjacent runs of equal keys. As the id is part of the sort key, a key that holds a third of all rows
spreads over many partitions; only the first run of a partition can have begun earlier, and the true start of those
runs is found from one boundary row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from folioflow.runtime import cut

#: Separates the parts of a canonical key; it is neither letter nor digit, so it cannot occur in a part.
SEPARATOR = "\x1f"


def squeezed(value: Column) -> Column:
    """Letters and digits of ``value``, lower-cased."""
    return F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}]+", ""))


def canonical_key(parts: list[str]) -> Column:
    """Full comparison key of a record, independent of the order of its fields; null if a part is null or blank."""
    whole = F.array_join(F.array_sort(F.array(*(squeezed(F.col(p)) for p in parts))), SEPARATOR)
    blank = F.lit(False)
    for p in parts:
        blank = blank | F.col(p).isNull() | ~F.col(p).rlike(r"[^\s\p{Z}]")
    return F.when(~blank, whole)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, first id, ids) of the adjacent runs, in pieces of at most one batch; ``ids`` is an Arrow array."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ids = batch.column("key"), batch.column("id")
        starts = [0]
        if batch.num_rows > 1:
            changed = pc.not_equal(key.slice(1), key.slice(0, batch.num_rows - 1))
            starts += [i + 1 for i in pc.indices_nonzero(changed).to_pylist()]
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield key[a].as_py(), ids.slice(a, b - a)


def _boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a partition: its first key, and its last run's key and first id."""
    first = last = start = None
    for key, ids in _runs(batches):
        if first is None:
            first = key
        if key != last:
            last, start = key, ids[0].as_py()
    if first is not None:
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "first": [first], "last": [last], "start": [start]}, schema=pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("start", pa.int64())]))


def _starts(rows: list) -> dict[int, int]:
    """partition -> id at which the run really began that its first key continues."""
    begun: dict[int, int] = {}
    key = start = None
    for r in sorted(rows, key=lambda r: r["part"]):
        if r["first"] == key:
            begun[r["part"]] = start
        if r["last"] != key:
            key, start = r["last"], r["start"]
    return begun


def copy_members(df: DataFrame, parts: list[str], id_column: str, partitions: int | None = None) -> DataFrame:
    """(first_id, id) of every record with a usable key, the representative included (there ``first_id`` = ``id``).

    ``first_id`` is the smallest id of the copies. Records with a null or blank part or a null id have no key and are
    left out; other columns of ``df`` are ignored, whatever their names. An empty table gives an empty result.
    """
    records = df.select(canonical_key(parts).alias("key"), F.col(id_column).cast("long").alias("id")).where("key is not null and id is not null")
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(records.repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id"))
    # one row a partition, whatever the table holds
    begun = _starts(ordered.mapInArrow(_boundaries, "part int, first string, last string, start long").collect())

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = begun.get(TaskContext.get().partitionId())
        last = start = None
        for batch in batches:
            firsts: list[pa.Array] = []
            for key, ids in _runs(iter([batch])):
                if last is None and carried is not None:
                    last, start = key, carried
                elif key != last:
                    last, start = key, ids[0].as_py()
                firsts.append(pa.repeat(pa.scalar(start, pa.int64()), len(ids)))
            if firsts:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(firsts), batch.column("id")], names=["first_id", "id"])

    return ordered.mapInArrow(members, "first_id long, id long")


def copies(df: DataFrame, parts: list[str], id_column: str, partitions: int | None = None) -> DataFrame:
    """(first_id, id) of every copy but the representative."""
    return copy_members(df, parts, id_column, partitions).where("id > first_id")


def collapse(df: DataFrame, parts: list[str], id_column: str, partitions: int | None = None) -> DataFrame:
    """One representative a group with its exact number of records: (first_id, copies)."""
    return copy_members(df, parts, id_column, partitions).groupBy("first_id").agg(F.count("*").alias("copies"))
