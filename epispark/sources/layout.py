"""A layout of the case table for filters on several columns at once.

Ordered by area alone, a file skips row groups only for the area. Here rows are ordered along a space-filling curve over
area, month and place: the bits of the three are interleaved, so each row group covers a small box of all
three, and a filter on any of them skips most groups. Places have too many values for smallest and largest to tell much, so
they get a Bloom filter as well, in row groups whose dictionary does not hold them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.functions.clean import month_of
from epispark.sources.cases import align, replace_years
from epispark.spec import TB, CaseSpec

#: Bits of area, month and place on the curve.
BITS = 6
#: Bytes of a row group: small enough that a box of the curve is worth skipping.
GROUP_BYTES = 16 << 20
#: Different places in a row group that a Bloom filter is sized for.
PLACES = 20_000


def interleaved(parts: Sequence[Column], bits: int = BITS) -> Column:
    """Position on the curve of non-negative whole numbers, of which the lowest ``bits`` count: bit i of part j becomes bit
    i * n + j. Fits in 63 bits."""
    n = len(parts)
    if n * bits > 63:
        raise ValueError("too many bits for one number")
    out = F.lit(0).cast("long")
    for i in range(bits):
        for j, part in enumerate(parts):
            bit = F.shiftright(part.cast("long"), i).bitwiseAND(F.lit(1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(bit, i * n + j))
    return out


def curve(spec: CaseSpec = TB, bits: int = BITS) -> Column:
    """Area and place by hash, since only equality is asked of them; the month keeps its order."""
    def hashed(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(1 << bits))

    month = F.shiftleft(F.coalesce(month_of(F.col(spec.date)), F.lit(0)), bits - 4)
    return interleaved([hashed(spec.area), month, hashed(spec.place)], bits)


def write_clustered(df: DataFrame, path: str, years: Sequence[int], spec: CaseSpec = TB, group_bytes: int = GROUP_BYTES, places: int = PLACES) -> None:
    """Writes ``years`` in year folders, ranged and ordered along the curve, with Bloom filters on the place.

    Rows are ranged by (year, curve, hash of the row), so a year, an area or a place with a third of all rows is
    several files, and no two files of a year overlap on the curve but at their ends."""
    rows = align(df.where(F.col(spec.year).isin(list(years))), df.schema).withColumn("_curve", curve(spec))
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    ranged = rows.repartitionByRange(F.col(spec.year), F.col("_curve"), spread).sortWithinPartitions(spec.year, "_curve").drop("_curve")
    options = {"parquet.block.size": str(group_bytes), "parquet.bloom.filter.enabled#" + spec.place: "true",
               "parquet.bloom.filter.expected.ndv#" + spec.place: str(places)}
    replace_years(ranged, path, years, column=spec.year, options=options)
