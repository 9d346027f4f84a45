"""Timing of frames, and short forms of numbers for their names."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame


def short(n: int) -> str:
    """Three digits at least, in millions (M) or thousands (K), cut down: 1000000 is 001M."""
    for unit, size in (("M", 1_000_000), ("K", 1_000)):
        if n >= size:
            return f"{n // size:03d}{unit}"
    return f"{n:03d}"


def timed(df: DataFrame, times: int = 1) -> list[float]:
    """Seconds of each of some full runs of a frame, without keeping its rows."""
    took = []
    for _ in range(times):
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return took
