"""Bounds of the Arrow batches that go to Python workers."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Rows and bytes that an Arrow batch of texts holds at most (a longer text is one batch).
TEXT_BATCH_ROWS, TEXT_BATCH_BYTES = 1000, 1 << 24


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Arrow batches that hold whole texts.

    Plans are lazy, so this is a setting of the session that stays; it is lowered,
    never raised.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BATCH_BYTES)):
        given = re.fullmatch(r"(\d+)b?", str(spark.conf.get(key)))
        if given is None or not 0 < int(given[1]) <= most:
            spark.conf.set(key, str(most))
