"""Exact dedup: a tree-merge of sorted digest runs.

Each partition of the written digest table sorts its digests into a run in which a digest occurs once, with
its best row and the number of its rows. Partitions then exchange runs in binomial rounds: the 2**b partitions
whose numbers differ only in the b bits of the round swap the parts of their digest ranges, so that each ends
with 2**-b of the range, sorts what came (Spark's sort merges the runs) and keeps one entry a digest. After
all bits have had their round, a partition holds the whole corpus's entries for one part of the digest range.
No partition ever holds more than its part, and a digest that a third of all rows share arrives as at most
one entry a partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.llm.common import SPACE, fresh, join_groups, partitions, written

KEY = ["digest", "norm_bytes"]
RUN = "digest binary, norm_bytes bigint, n_chars_neg bigint, doc_id bigint, uid bigint, n bigint"


def digests(docs: DataFrame, uid: str | None = None) -> DataFrame:
    """uid, doc_id, digest (SHA-256 of the normalised text, binary), norm_bytes, n_chars_neg (negative code points).

    A null text counts as empty. uid tells rows with equal or null doc_id apart.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select((F.col(uid) if uid else F.monotonically_increasing_id()).alias("uid"), "doc_id", text.alias("t"), F.regexp_replace(text, SPACE + "+", "").alias("norm"))
    return rows.select(
        "uid",
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.octet_length("norm").cast("bigint").alias("norm_bytes"),
        (-F.char_length("t")).cast("bigint").alias("n_chars_neg"),
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted entries, keep the first of each digest, with the sum of n; a digest may go on over batches."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([pa.RecordBatch.from_arrays(batch.columns, batch.schema.names)])
        if held is not None:
            t = pa.concat_tables([held, t]).combine_chunks()
        d, b = t["digest"], t["norm_bytes"]
        differs = pc.or_(pc.not_equal(d[1:], d[:-1]), pc.not_equal(b[1:], b[:-1])).combine_chunks()
        first = pa.concat_arrays([pa.array([True]), differs])
        starts = pc.indices_nonzero(first)
        total = pc.cumulative_sum(t["n"])
        ends = pa.array([*(starts.to_pylist()[1:]), t.num_rows], pa.int64())
        upto = pc.take(total, pc.subtract(ends, 1)).combine_chunks()
        n = pc.subtract(upto, pa.concat_arrays([pa.array([0], pa.int64()), upto[:-1]]))
        kept = t.take(starts)
        kept = kept.set_column(kept.column_names.index("n"), "n", n)
        held = kept[-1:]
        if kept.num_rows > 1:
            yield from kept[:-1].combine_chunks().to_batches()
    if held is not None:
        yield from held.combine_chunks().to_batches()


def tree_merge(dig: DataFrame, leaves: int | None = None, rounds: int = 2) -> DataFrame:
    """One entry per (digest, norm_bytes): the row to keep (most code points, then smallest doc_id, nulls last, then uid) and n rows.

    ``leaves`` is rounded up to a power of two; its bits are shared out over ``rounds`` rounds.
    """
    bits = max(1, math.ceil(math.log2(max(2, leaves or partitions(dig.sparkSession)))))
    order = [F.col("digest"), F.col("norm_bytes"), F.col("n_chars_neg"), F.asc_nulls_last("doc_id"), F.col("uid")]
    runs = dig.select(*KEY, "n_chars_neg", "doc_id", "uid", F.lit(1).cast("bigint").alias("n"))
    runs = runs.sortWithinPartitions(*order).mapInArrow(_merge, RUN)
    # the digest's leading bits, most significant first, say which partition it ends in
    goal = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint"), 32 - bits)
    done = 0
    for r in range(min(rounds, bits)):
        step = (bits - done) // (min(rounds, bits) - r)
        low = ((1 << step) - 1) << done  # the bits of this round
        # the partition keeps its number but for this round's bits, which the digest sets
        runs = runs.withColumn("node", F.spark_partition_id().bitwiseAND((1 << bits) - 1 & ~low).cast("bigint").bitwiseOR(goal.bitwiseAND(low)).cast("int"))
        runs = runs.repartitionById(1 << bits, F.col("node")).drop("node").sortWithinPartitions(*order).mapInArrow(_merge, RUN)
        done += step
    return runs


def exact_groups(docs: DataFrame, uid: str | None = None) -> DataFrame:
    """Per document (dropped ones too): doc_id, keep_id, group_size, kept, text_sha256; and uid, the row's own number.

    Texts are equal when they are identical after deleting ``[\\x20\\x09-\\x0D]``; null counts as empty, so all empty
    texts are one group. Of a group, the row with most code points stays, then the smallest doc_id (null last), and of
    rows that tie in both (repeated rows) exactly one. An empty table gives no rows. Columns but doc_id and text are
    not looked at, but for ``uid``, which names a column that numbers the rows, if there is one.
    """
    dig = written(digests(docs, uid), "digests")
    n = dig.count()
    groups = written(
        tree_merge(dig).select(*KEY, F.col("doc_id").alias("keep_id"), F.col("uid").alias("keep_uid"), F.col("n").alias("group_size")), "groups"
    )
    rows = join_groups(dig, groups, KEY, "group_size", n)
    return rows.select(
        "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "uid"
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns. Of rows with the same doc_id and text, one stays.

    The documents are written with a row number first, so that both passes see the same numbers.
    """
    (row,) = fresh(docs, "_uid")
    docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    kept = exact_groups(docs, row).filter("kept").select(F.col("uid").alias(row))
    return docs.join(kept, row, "left_semi").drop(row)
