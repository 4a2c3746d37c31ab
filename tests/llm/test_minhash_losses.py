"""Near-dedup gives up no more pairs than its docstring states."""
import numpy as np

from winnowry.llm import minhash_dedup as m


def test_pairs_up_to_a_margin_of_14_go_on():
    at, n, seen = int(np.searchsorted(m._GRID, m.SIMILAR / m.OF - 1e-9)), np.array([500.0]), 0
    for equal in range(m.LEAST_EQUAL, m.REGISTERS):
        a = np.full((1, m.REGISTERS), 9, np.uint8)
        b = a.copy()
        b[0, equal:] += np.where(np.arange(m.REGISTERS - equal) % 2, 1, -1).astype(np.int8).view(np.uint8)
        value = m.likelihoods(a, b, n, n)
        margin = value.max() - value[0, at:].max()
        if margin < 13.99:
            assert m.plausible(a, b, n, n)[0].all()
            seen += 10.01 < margin
    assert seen


def test_pairs_of_a_hot_key_meet_without_a_second_band(spark):
    rng = np.random.default_rng(4)
    regs = rng.integers(0, 256, (1400, m.REGISTERS), dtype=np.uint8)
    regs[900] = regs[5]
    bands = spark.createDataFrame([(7, 0, k, k) for k in range(1400)], "key long, band byte, v long, c long")
    detail = spark.createDataFrame([(k, 100, bytearray(r.tobytes())) for k, r in enumerate(regs)], "v long, n long, regs binary")
    assert {tuple(sorted(r)) for r in m.leftover_forest(m.materialise(bands, "bands"), m.materialise(detail, "detail")).collect()} == {(5, 900)}
