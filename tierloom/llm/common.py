"""What the operators of this subpackage share."""

from __future__ import annotations

import gc

from tierloom.operators.tables import HEAVY, components, done, fresh, join_groups, partitions, ranked, table, written

__all__ = ["HEAVY", "SPACE", "WORD", "components", "done", "fresh", "join_groups", "partitions", "ranked", "release", "table", "written"]


def release(spark) -> None:
    """Let the driver forget shuffles that no frame needs any more, so that their files go while the job goes on."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: The characters of ``[\x20\x09-\x0D]``, as they are written in Java and RE2 patterns.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
