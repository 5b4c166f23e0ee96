"""Bytes to text in the JVM: which encoding fits first, and the text where Spark itself can decode it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOM = b"\xef\xbb\xbf"
#: Bytes that Python decodes at once; longer content is a piece of its own.
PIECE = 1 << 20


def is_utf8(data: Column) -> Column:
    return F.is_valid_utf8(data.cast("string"))


def utf8_text(data: Column) -> Column:
    """Valid UTF-8 without its mark."""
    return F.when(F.substring(data, 1, 3) == F.lit(BOM), F.substring(data, 4, 2**31 - 1)).otherwise(data).cast("string")


#: States of the automaton of GB 18030: between characters, after the first byte of two or four, after the second and the third of four, wrong.
START, LEAD, SECOND, THIRD, WRONG = range(5)


def is_gb18030(data: Column) -> Column:
    """Whether bytes have the form of GB 18030: one byte to 7F, two, or four with digits second and fourth."""
    pairs = F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))

    def step(state: Column, pair: Column) -> Column:
        digit, lead = pair.between("30", "39"), pair.between("81", "FE")
        trail = pair.between("40", "7E") | pair.between("80", "FE")
        return (
            F.when(state == START, F.when(pair <= "7F", START).when(lead, LEAD).otherwise(WRONG))
            .when(state == LEAD, F.when(digit, SECOND).when(trail, START).otherwise(WRONG))
            .when(state == SECOND, F.when(lead, THIRD).otherwise(WRONG)).when(state == THIRD, F.when(digit, START).otherwise(WRONG)).otherwise(WRONG)
        )

    return F.aggregate(pairs, F.lit(START), step) == START


def kind(data: Column) -> Column:
    """The first of utf-8, gb18030 and other that bytes have the form of (a four-byte form may still have no character)."""
    return F.when(is_utf8(data), "utf-8").when(is_gb18030(data), "gb18030").otherwise("other")


def texts(files: DataFrame) -> DataFrame:
    """``files`` (content and others) with ``text`` by the first encoding that fits, as the text reader decodes.

    UTF-8 never leaves the JVM; only the other rows go to Python, whose codecs have GB 18030.
    """
    from leafpress.sources.readers import decode

    known = files.where(is_utf8(F.col("content")))
    rest = files.where(~is_utf8(F.col("content"))).withColumn("text", F.lit(None).cast("string"))

    def run(batches):
        for b in batches:
            at, lo = b.schema.get_field_index("content"), 0
            sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            while lo < b.num_rows:  # a few rows as Python's bytes and texts at once, whatever the batch holds
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + PIECE, side="right")))
                own = b.slice(lo, hi - lo)
                yield own.set_column(own.num_columns - 1, "text", pa.array([decode(x.as_py()) for x in own.column(at)], pa.string()))
                lo = hi

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return known.withColumn("text", utf8_text(F.col("content"))).unionByName(rest.mapInArrow(run, fields))
