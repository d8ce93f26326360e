"""Occurrences and record counts of every distinct term, with last-seen counters."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.session import spread

PARTIAL = "term string, occurrences long, records long"


def plain_term(value: str | None) -> str | None:
    """``value`` without outer blanks, in lower case and NFC."""
    return None if value is None else unicodedata.normalize("NFC", value.strip().lower())


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Normal form of the terms; equal (term, record) rows of a batch become one."""
    for b in batches:
        t = pa.table({"term": pa.array([plain_term(x) for x in b.column(0).to_pylist()], pa.string()), "record": b.column(1), "n": b.column(2)})
        t = t.group_by(["term", "record"]).aggregate([("n", "sum")])
        yield from pa.table({"term": t["term"], "record": t["record"], "n": t["n_sum"]}).to_batches()


def _changes(column: pa.Array, before: object, first: bool) -> np.ndarray:
    """For each row whether it differs from the row before it; ``before`` precedes the first row."""
    codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    out = np.ones(len(codes), bool)
    out[1:] = codes[1:] != codes[:-1]
    out[0] = first or column[0].as_py() != before
    return out


def _last_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters over rows ordered by (term, record).

    The state is one term with its occurrences, its records and its last record: a row adds a
    record only if its record is not the last one seen. It is carried from batch to batch.
    """
    term, record, occurrences, records, begun = None, None, 0, 0, False
    for b in batches:
        if not b.num_rows:
            continue
        new_term = _changes(b.column(0), term, not begun)
        new_record = (new_term | _changes(b.column(1), record, not begun)) & b.column(1).is_valid().to_numpy(zero_copy_only=False)
        n = b.column(2).fill_null(0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new_term)
        head = starts[0] if len(starts) else b.num_rows
        occurrences += int(n[:head].sum())
        records += int(new_record[:head].sum())
        if len(starts):
            done = [(term, occurrences, records)] if begun else []
            sums = np.add.reduceat(n, starts)
            firsts = np.add.reduceat(new_record.astype(np.int64), starts)
            names = b.column(0).take(pa.array(starts)).to_pylist()
            done += list(zip(names[:-1], sums[:-1].tolist(), firsts[:-1].tolist()))
            term, occurrences, records = names[-1], int(sums[-1]), int(firsts[-1])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["term", "occurrences", "records"])
        begun, record = True, b.column(1)[b.num_rows - 1].as_py()
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([term], pa.string()), pa.array([occurrences], pa.int64()), pa.array([records], pa.int64())], ["term", "occurrences", "records"])


def term_counts(rows: DataFrame, term: str, record: str, weights: list[str] | None = None, salts: int = 16) -> DataFrame:
    """``term, occurrences, records`` of every distinct term of ``rows``.

    Rows equal in all columns count once. A term is the value without outer blanks, in lower
    case and NFC; null terms do not count, an empty one does. Occurrences are the sum of the
    ``weights`` columns (null counts as 0; without weights each row is one occurrence), records
    are the distinct non-null values of ``record``. An empty table gives no rows; columns other
    than those named only matter for the equality of rows and may have any name but ``map`` type
    columns, which have no equality.

    Layout: identical rows meet in a hash aggregate that combines before its shuffle. The rest
    is combined by batch, then hash-partitioned by term and a salt of the record, so that
    neither a frequent term nor a large record makes a large partition, and a record of a term
    still lies in one place. There the rows are sorted by (term, record) and counted by
    last-seen counters; the salted parts of a term are added in the end.
    """
    amount: Column = F.lit(1) if not weights else sum((F.coalesce(F.col(f"`{w}`").cast("long"), F.lit(0)) for w in weights), F.lit(0))
    once = rows.filter(F.col(f"`{term}`").isNotNull()).distinct()
    pairs = once.select(F.col(f"`{term}`").cast("string").alias("term"), F.col(f"`{record}`").cast("string").alias("record"), amount.cast("long").alias("n"))
    pairs = pairs.mapInArrow(_combine, "term string, record string, n long")
    pairs = spread(pairs, F.col("term"), F.pmod(F.xxhash64("record"), F.lit(salts))).sortWithinPartitions("term", "record")
    parts = pairs.mapInArrow(_last_seen, PARTIAL)
    return parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(rows: DataFrame, term: str, record: str, weights: list[str] | None = None, rare_below: int = 5, common_above: float = 0.5) -> DataFrame:
    """``term, occurrences, records, mark`` of every term.

    ``mark`` is ``rare`` for fewer than ``rare_below`` occurrences, else ``common`` for more than
    the share ``common_above`` of all records of the table (rows with a null term included, a
    null record is none), else null. The number of records is one number, counted first.
    """
    total = rows.select(F.countDistinct(f"`{record}`")).first()[0]
    mark = F.when(F.col("occurrences") < rare_below, "rare").when(F.col("records") > F.lit(common_above * total), "common")
    return term_counts(rows, term, record, weights).withColumn("mark", mark)
