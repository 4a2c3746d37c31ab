"""The table function against its definition, by hand."""
import pytest

from winnowry.functions.slicing import LEVEL, SliceLimits, slice_recordings, slices_of

LIMITS = SliceLimits(threshold=0.5, least=2, interval=2, kept=1)


@pytest.mark.parametrize("frames, want", [
    ([], []), ([0.0, None], []), ([0.9], []), ([0.9, 0.9], [(0, 0, 2, LEVEL)]),
    ([0, 0, 0.6, 0, -0.7, 0, 0, 0.5, 0.5, 0], [(0, 1, 6, LEVEL), (1, 6, 10, LEVEL)]),  # one silent frame doesn't part, two do
    ([0, 2.0, 1, None, None, None, 0.4, 1], [(0, 0, 4, LEVEL / 2)]),  # the last is too short
])
def test_slices(frames, want):
    assert [(n, a, b, pytest.approx(g)) for n, a, b, g in want] == list(slices_of(frames, LIMITS))


def test_table_function(spark):
    rows = [(1, [0.9, 0.9, 0.0, 0.0, 0.0, 0.9, 0.9]), (2, None), (3, []), (4, [0.1] * 9)]
    got = slice_recordings(spark.createDataFrame(rows, "rec long, frames array<double>"), limits=LIMITS)
    assert got.columns == ["rec", "slice", "first", "stop", "gain"]
    assert sorted(tuple(r)[:4] for r in got.collect()) == [(1, 0, 0, 3), (1, 1, 4, 7)]
