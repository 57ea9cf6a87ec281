"""Bounded samples of labelled rows for training, drawn by a hash so that every run draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTS = 1 << 62  # a label's share of the sample is a whole number of these parts: above 0 for any count


def labelled_sample(rows: DataFrame, label: str, key: Column, per_label: int, in_all: int) -> tuple[DataFrame, dict]:
    """About ``per_label`` rows of each label (fewer if all labels together would exceed ``in_all``), and the labels' counts.

    ``key`` must tell rows apart, as rows with equal keys are drawn together. The expected size is bounded by both parameters
    whatever the input's size. Rows with a null label are left out. The counts are aggregated before the shuffle; only one
    row a label is collected.
    """
    return _drawn(rows, label, key, per_label, in_all, {r[0]: r[1] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()})


def _drawn(rows: DataFrame, label: str, key: Column, per_label: int, in_all: int, counts: dict) -> tuple[DataFrame, dict]:
    if not counts:
        return rows.limit(0), {}
    most = max(1, min(per_label, in_all // len(counts)))
    keep = F.lit(False)
    for value, n in sorted(counts.items()):
        limit = _PARTS if n <= most else _PARTS * most // n
        keep = keep | ((F.col(label) == F.lit(value)) & (F.pmod(F.xxhash64(key, F.lit(17)), F.lit(_PARTS)) < F.lit(limit).cast("long")))
    return rows.where(keep), counts
