"""Sequences of a whole table against the least number that its tokens need."""
import numpy as np
import pyarrow as pa

from winnowry.llm import packing
from winnowry.llm.queries import TOKENIZER


def test_a_table_takes_the_least_number_of_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.best_fit_pack(docs, TOKENIZER).selectExpr("sum(length) AS tokens", "count(DISTINCT sequence_id) AS n").first()
    assert got["n"] <= -(-got["tokens"] // packing.CAPACITY)


def test_tightened_bins_are_whole():
    rng = np.random.default_rng(8)
    for n, top in ((0, 5), (1, 2047), (40, 900), (400, 700), (3000, 2047)):
        lengths = np.sort(rng.integers(1, top + 1, n))[::-1]
        before = packing.sum_of_squares(lengths, 2048)
        where, offset = packing.tighten(lengths, *before, 2048)
        bins = {}
        for s, b, o in zip(lengths.tolist(), where.tolist(), offset.tolist(), strict=True):
            bins.setdefault(b, []).append((o, s))
        assert len(bins) <= (before[0].max() + 1 if n else 0) and sorted(bins) == list(range(len(bins)))
        for b in bins.values():
            end = 0
            for o, s in sorted(b):
                assert o == end
                end += s
            assert end <= 2048


def test_other_vocabularies_are_encoded_whole(tmp_path):
    """A word-level file with a splitter of its own: ids of words wouldn't join to the ids of the text."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"a b": 0, "c": 1, "?": 2}, unk_token="?"))
    t.pre_tokenizer = pre_tokenizers.Split("|", "removed")
    t.save(str(tmp_path / "t.json"))
    texts = ["a b|c", "a b", "c|c", "x"]
    flat, at = packing.Encoder(str(tmp_path / "t.json")).encode(pa.array(texts))
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [t.encode(x).ids for x in texts]
