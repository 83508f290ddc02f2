"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.llm.common import WORD, fresh, join_groups, ranked, written

SRC = ["src_null", "src"]
#: Sources up to which their targets are broadcast; beyond that they are joined.
MOST_SENT = 10_000


def shares(sizes: DataFrame, weights: tuple[float, ...], total_share: float, most: float) -> DataFrame:
    """Per source: source_size and target. ``sizes`` has SRC and size.

    Sources by code point, null last, have ``weights`` in turn, and share ``total_share`` of all sizes by weight. A
    target stops at ``most`` times its source's size, and what is over is shared out again until none is above.
    Every round is one sum over the sources, which are never gathered.
    """
    own = sizes.groupBy(*SRC).agg(F.sum("size").alias("source_size"))
    own = ranked(own, [], [F.col("src_null"), F.col("src")], "sources")
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % n + 1).cast("int"))
    own = written(own.select(*SRC, "source_size", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("cap")), "sources")
    row = own.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, level, capped = total_share * (row[0] or 0), None, -1
    if row[1]:
        level = budget / row[1]
        while True:
            over = F.col("cap") < F.lit(level) * F.col("weight")
            gone, left, now = own.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count_if(over)).first()
            if now == capped or not left:
                break
            capped, level = now, max(level, (budget - gone) / left)
    return own.select(*SRC, "source_size", F.least(F.col("cap"), F.lit(level or 0.0) * F.col("weight")).alias("target"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), total_share: float = 1.0, most: int = 3, uid: str | None = None) -> DataFrame:
    """Per document: doc_id, size (its words), source_size, target, copies, taken (copies times size), and uid, the row's number.

    Every document of a source expects target / source_size copies. Documents of a source are put in order of size, the
    copies expected so far are summed (their number times what each expects), one offset in [0, 1), drawn from the source's
    name so that reruns agree, is added, and a document is emitted once for every whole number that the sum passes at it. As
    the order is by size, the words taken differ from the target by about one of the largest documents. No document has
    over ``most`` copies.

    Null and empty texts have size 0, and so have sources that hold only such texts: their target is 0. A null source is a
    source of its own, after all others. Repeated rows and rows with a null doc_id count as rows of their own. An
    empty table gives no rows. Other columns are not looked at; ``uid`` names a column that numbers the rows, if there is one.
    """
    sizes = docs.select(
        (F.col(uid) if uid else F.monotonically_increasing_id()).alias("uid"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").isNull().alias("src_null"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
    )
    sizes = written(sizes, "sizes")  # a range shuffle reads its input twice
    rows = written(ranked(sizes, SRC, [F.col("size"), F.asc_nulls_last("doc_id"), F.col("uid")], "sizes"), "ranks")
    rate = shares(rows, weights, total_share, most)
    own = rows.groupBy(*SRC).count()
    rate = written(rate.join(own, SRC), "rates")
    if rate.limit(MOST_SENT + 1).count() <= MOST_SENT:
        rows = rows.join(F.broadcast(rate), SRC)
    else:
        rows = join_groups(rows, rate, SRC, "count", rows.count())
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(each)).withColumn("part", each - F.floor(each))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit("mix:"), F.col("src_null").cast("string"), F.lit(":"), F.col("src")), 256), 1, 8), 16, 10)
    drawn = drawn.cast("double") / 4294967296.0

    copies = F.col("whole") + F.floor(drawn + F.col("part") * (F.col("rank") + 1)) - F.floor(drawn + F.col("part") * F.col("rank"))
    rows = rows.withColumn("copies", copies)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "uid")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as many times as ``mixed`` says, with all its columns.

    The documents are written with a row number first, so that both passes see the same numbers.
    """
    row, times, copy = fresh(docs, "_uid", "_copies", "_copy")
    docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "mix")
    copies = mixed(docs, uid=row, **how).select(F.col("uid").alias(row), F.col("copies").alias(times)).filter(F.col(times) > 0)
    rows = docs.join(copies, row).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times))))
    return rows.drop(row, times, copy)
