"""Work on the rows of one document at a time, over Arrow batches of whole partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import dealt, prepare

OUT_ROWS = 5_000


def sound_unions(rows: DataFrame) -> DataFrame:
    """rows, in a session where a union is not taken as partitioned like its inputs."""
    prepare(rows.sparkSession)
    return rows


def by_document(rows: DataFrame, schema: T.StructType, work: Callable[[list[dict]], list[tuple]], key: str = "doc_id", order: str = "node_id") -> DataFrame:
    """work() gets the rows of each document as dicts in order (maps as lists of pairs) and gives output tuples.

    Documents are dealt by key and sorted, so a task holds one document's rows at a time and there is no
    cost per group but for its rows."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            made = pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            out.clear()
            return made

        for piece in batches:
            for row in piece.to_pylist():
                if held and held[0][key] != row[key]:
                    out += work(held)
                    held = []
                    if len(out) >= OUT_ROWS:
                        yield batch()
                held.append(row)
        if held:
            out += work(held)
        if out:
            yield batch()

    return dealt(rows, key).sortWithinPartitions(key, order).mapInArrow(run, schema)


TABLE_ROWS = 50_000


def by_documents(rows: DataFrame, schema: T.StructType, work: Callable[[pa.Table, np.ndarray], pa.Table], key: str = "doc_id") -> DataFrame:
    """work() gets tables of about TABLE_ROWS rows that hold documents whole, and the number of each row's document
    in the table; it gives a table with the columns of the schema.

    Documents are dealt by key and sorted by it, so a task holds one such table, or one larger document, at a time."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            """The documents that are whole; the rest stays."""
            nonlocal held, size
            table = pa.Table.from_batches(held).combine_chunks()
            places = pc.fill_null(pc.dictionary_encode(table.column(key).combine_chunks()).indices, -1).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
            upto = table.num_rows if last else int(begins[-1])
            if upto:
                number = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, table.num_rows)))
                made = work(table.slice(0, upto), number[:upto])
                yield from made.select(arrow.names).cast(arrow).combine_chunks().to_batches(max_chunksize=10_000)
            held = table.slice(upto).to_batches()
            size = table.num_rows - upto

        limit = TABLE_ROWS
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= limit:
                yield from cut(False)
                limit = max(TABLE_ROWS, 2 * size)  # a document that fills the table is not looked at with every batch
        if held:
            yield from cut(True)

    return dealt(rows, key).sortWithinPartitions(key).mapInArrow(run, schema)
