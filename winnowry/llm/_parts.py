"""Texts as parts between single blanks, so that each distinct part of a block is encoded once."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._blocks import renumbered, runs


class Parts:
    """The parts of a block's texts: ``names`` are distinct, ``part`` numbers them in the texts' order, and a text's are part[at[k]:at[k + 1]]. A part stands between single blanks
    without white space at its ends; a text with other white space around a blank, at its head or tail is one part, and so is one for which ``whole`` says so."""

    def __init__(self, texts: pa.Array, whole: np.ndarray | bool = False):
        texts = pc.fill_null(texts, "")
        listed = pc.split_pattern(texts, " ")
        coded = listed.flatten().dictionary_encode()
        names, part, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), runs(pc.list_value_length(listed).to_numpy(zero_copy_only=False))
        loose = pc.or_(pc.equal(names, ""), pc.not_equal(pc.utf8_trim_whitespace(names), names)).to_numpy(zero_copy_only=False)
        self.whole = (np.diff(np.concatenate(([0], np.cumsum(loose[part])))[at]) > 0) | whole
        used, again = renumbered(part[np.repeat(~self.whole, np.diff(at))], len(names))
        own = np.flatnonzero(self.whole)
        size = np.where(self.whole, 1, np.diff(at))
        self.at = runs(size)
        self.part = np.empty(int(self.at[-1]), np.int64)
        alone = np.repeat(self.whole, size)
        self.part[~alone], self.part[alone] = again, len(used) + np.arange(len(own))
        self.names = pa.concat_arrays([names.take(pa.array(used)), texts.take(pa.array(own))])
        self.n_bytes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
