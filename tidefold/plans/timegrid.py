"""Time steps: parsing of step lengths, the grid of a run, chunks."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ChunkingError

_DT = re.compile(r"\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*([A-Za-z]+)\s*\Z")


# The spellings of units of time, and their seconds.
SECONDS = {
    **dict.fromkeys(("s", "sec", "second", "seconds"), 1.0), **dict.fromkeys(("min", "minute", "minutes"), 60.0), **dict.fromkeys(("h", "hr", "hour", "hours"), 3600.0),
    **dict.fromkeys(("d", "day", "days"), 86400.0), **dict.fromkeys(("week", "weeks"), 604800.0), **dict.fromkeys(("a", "yr", "year", "years"), 31557600.0),
}


def parse_dt(text: str) -> float:
    """Seconds of a step such as ``1d``, ``0.05d``, ``6h`` or ``30min``."""
    m = _DT.match(text)
    seconds = float(m[1]) * SECONDS[m[2]] if m and m[2] in SECONDS else None
    if seconds is None or seconds < 1e-6:
        raise ValueError(f"not a time step: {text!r}")
    return seconds


def parse_time(text: str | datetime) -> datetime:
    return text if isinstance(text, datetime) else datetime.fromisoformat(text)


@dataclass(frozen=True)
class TimeGrid:
    start: datetime
    end: datetime
    dt_seconds: float
    n_timesteps: int

    @classmethod
    def of(cls, start: str | datetime, end: str | datetime, dt: str) -> TimeGrid:
        """Steps from start up to, without, end; a remainder of more than a second is an error."""
        a, b, step = parse_time(start), parse_time(end), parse_dt(dt)
        length = (b - a).total_seconds()
        n = round(length / step)
        if abs(length - n * step) > 1.0:
            raise ValueError(f"{length:g} s are not evenly divisible by steps of {step:g} s")
        return cls(a, b, step, n)

    def time(self, step: int) -> datetime:
        return self.start + timedelta(seconds=step * self.dt_seconds)

    def coords(self) -> list[datetime]:
        return [self.time(i) for i in range(self.n_timesteps)]

    def frame(self, spark: SparkSession, start: int = 0, end: int | None = None) -> DataFrame:
        """(t_idx, T) of steps start to end."""
        rows = spark.range(start, self.n_timesteps if end is None else end).withColumnRenamed("id", "t_idx")
        return rows.select("t_idx", time_of("t_idx", self.start, self.dt_seconds).alias("T"))


def time_of(column: str, start: datetime, dt_seconds: float):
    """The time at which a step begins."""
    zero = F.lit(int((start - datetime(1970, 1, 1)) / timedelta(microseconds=1)))
    return F.timestamp_micros((zero + F.round(F.col(column) * F.lit(dt_seconds * 1e6))).cast("long"))


def chunk_ranges(n: int, size: int | None) -> list[tuple[int, int]]:
    """Steps cut into ranges of ``size``; all in one if there is none."""
    if size is None:
        return [(0, n)] if n else []
    if size <= 0:
        raise ChunkingError(f"chunk size must be positive, not {size}")
    return [(s, min(s + size, n)) for s in range(0, n, size)]
