"""Evidence ladders: closed-interval bins with first-match semantics.

A ladder is an ordered list of bins ``[lo, hi]``.  A value falls in the first bin that
contains it (so a shared edge belongs to the lower bin), values above the last edge get the
top label, and everything else (negative, in a gap, null) is ``unknown``.

Bins are built from segment rules (start, stop, width).  A value's bin is computed per segment
as ceil((x - start) / width), then corrected by one exact comparison with the integer edges
on each side (the division alone can land a value just above an edge in the lower bin).  That is
a handful of built-in operations per row instead of an n-branch CASE, so the expression stays
small enough for whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ident, sql_str


def _fmt(v: float) -> str:
    return str(int(v)) if float(v).is_integer() else repr(v)


@dataclass(frozen=True)
class BinSpec:
    column: str
    label_column: str
    bins: tuple[tuple[float, float], ...]
    top_label: str
    unknown_label: str = "unknown"
    segments: tuple[tuple[float, float, float], ...] = ()

    @staticmethod
    def from_segments(column: str, label_column: str, segments, top_label: str) -> "BinSpec":
        """segments: (start, stop, width) -> bins start..stop in steps of width."""
        bins = []
        for start, stop, width in segments:
            if (stop - start) % width:
                raise ValueError("a segment must hold a whole number of bins")
            lo = start
            while lo < stop:
                bins.append((float(lo), float(lo + width)))
                lo += width
        segs = tuple((float(a), float(b), float(w)) for a, b, w in segments)
        return BinSpec(column, label_column, tuple(bins), top_label, segments=segs)

    @property
    def labels(self) -> list[str]:
        """Label per rank: ranks 1..n are the bins, n+1 the top bin, n+2 unknown."""
        return [f"{_fmt(lo)} and {_fmt(hi)}" for lo, hi in self.bins] + [self.top_label, self.unknown_label]

    @property
    def top_rank(self) -> int:
        return len(self.bins) + 1

    @property
    def unknown_rank(self) -> int:
        return len(self.bins) + 2

    def rank(self, x: Column | None = None) -> Column:
        """1-based bin rank of ``x`` (int): first closed bin containing x, else top / unknown."""
        x = F.col(self.column) if x is None else x
        xd = x.cast("double")
        out = F.when(x.isNull(), F.lit(self.unknown_rank)).when(
            x > F.lit(self.bins[-1][1]), F.lit(self.top_rank))
        offset = 0
        for start, stop, width in self.segments:
            m = int(round((stop - start) / width))
            j0 = F.least(F.greatest(F.ceil((xd - F.lit(start)) / F.lit(width)), F.lit(1)), F.lit(m))
            up = xd > F.lit(start) + j0 * F.lit(width)  # above bin j0's upper edge
            down = (j0 > 1) & (xd <= F.lit(start) + (j0 - 1) * F.lit(width))  # on/below its lower edge
            j = j0 + F.when(up, 1).otherwise(0) - F.when(down, 1).otherwise(0)
            # first segment whose upper end reaches x; below its start (a gap) is unknown
            out = out.when(x <= F.lit(stop), F.when(x >= F.lit(start), (j + offset).cast("int"))
                           .otherwise(F.lit(self.unknown_rank)))
            offset += m
        return out.otherwise(F.lit(self.unknown_rank))

    def label_of(self, rank_column: str) -> Column:
        """Label for an int rank column (one constant-array lookup, built as one expression)."""
        labels = ", ".join(sql_str(s) for s in self.labels)
        return F.expr(f"element_at(array({labels}), {ident(rank_column)})")


# ---- fixed values: the three ladders of the analysis ----------------------------------
# distance (metres): 1,000-wide up to 100,000, then 100,000-wide up to 1,000,000
DISTANCE_LADDER = BinSpec.from_segments(
    "distance_to_frequent_location", "distance_break",
    [(0, 100_000, 1_000), (100_000, 1_000_000, 100_000)], "> 1000km")
# value: 10-wide up to 1,000, then 1,000-wide up to 10,000
VALUE_LADDER = BinSpec.from_segments(
    "transaction_value", "value_break",
    [(0, 1_000, 10), (1_000, 10_000, 1_000)], "> 10000")
# device age (days): 1-wide 0..10; 5-wide 11..496; 496..500; 5-wide 501..581
AGE_LADDER = BinSpec.from_segments(
    "device_age_days", "age_break",
    [(0, 10, 1), (11, 496, 5), (496, 500, 4), (501, 581, 5)], "> 581")
