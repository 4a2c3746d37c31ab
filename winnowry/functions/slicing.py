"""A table function from one recording's frames to its slices."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the louder of a slice's levels are mixed to: a quarter at 0.9, three quarters as they are.
LEVEL = 0.9 * 0.25 + 0.75


@dataclass(frozen=True)
class SliceLimits:
    """In frames, but for the threshold, which is an amplitude."""

    threshold: float = 10 ** (-35 / 20)
    least: int = 300
    interval: int = 30
    kept: int = 50


def slices_of(frames: list[float | None], limits: SliceLimits) -> Iterator[tuple[int, int, int, float]]:
    """(slice, first, stop, gain): stretches of frames at the threshold or above, joined over silences shorter than ``interval``; those of at least ``least`` frames, with
    up to ``kept`` frames of silence on either side, half a silence between two at most. The gain brings a peak above 1 down to it, then applies the level."""
    loud = [k for k, x in enumerate(frames) if x is not None and abs(x) >= limits.threshold]
    stretches: list[list[int]] = []
    for k in loud:
        if stretches and k - stretches[-1][1] - 1 < limits.interval:
            stretches[-1][1] = k
        else:
            stretches.append([k, k])
    number = 0
    for n, (low, high) in enumerate(stretches):
        if high - low + 1 < limits.least:
            continue
        before = (low - stretches[n - 1][1] - 1) // 2 if n else low
        after = (stretches[n + 1][0] - high - 1) // 2 if n + 1 < len(stretches) else len(frames) - high - 1
        first, stop = low - min(limits.kept, before), high + 1 + min(limits.kept, after)
        peak = max(abs(x) for x in frames[first:stop] if x is not None)
        yield number, first, stop, LEVEL / max(1.0, peak)
        number += 1


@F.udtf(returnType="slice: int, first: int, stop: int, gain: double", useArrow=True)
class Slices:
    """SQL: ``LATERAL slices(frames, threshold, least, interval, kept)``. A recording is a row; null frames are silent, a null recording has no slices."""

    def eval(self, frames, threshold, least, interval, kept):
        if frames is not None:
            yield from slices_of(list(frames), SliceLimits(threshold, least, interval, kept))


def slice_recordings(recordings: DataFrame, frames: str = "frames", limits: SliceLimits | None = None) -> DataFrame:
    """The recordings' columns but their frames, with a row (slice, first, stop, gain) per slice."""
    c = limits or SliceLimits()
    call = Slices(F.col(frames).outer(), F.lit(c.threshold), F.lit(c.least), F.lit(c.interval), F.lit(c.kept))
    return recordings.lateralJoin(call).drop(frames)
