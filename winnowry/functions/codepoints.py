"""Measures of whole texts in one pass over their code points: numpy over Arrow batches, no pattern that can backtrack."""
from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Characters that a batch holds at most at a time, longer texts apart.
CHUNK = 1 << 20

MEASURES = {
    "length": "int", "plain": "int", "top": "boolean", "loop": "boolean", "run": "boolean", "content": "int", "hangul": "int", "kana": "int", "cjk": "int",
    "latin": "int", "alnum": "int", "digits": "int", "control": "int", "script_ja": "int", "script_zh": "int", "script_en": "int",
}


@cache
def _table(kinds: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The number of each code point's combination of kinds, and for each kind which combinations have it; kinds are patterns of one character."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    flags = np.zeros(0x110000, np.uint32)
    for k, (_, pattern) in enumerate(kinds):
        for found in regex.finditer(f"(?:{pattern})+", every):
            flags[ord(every[found.start()]) : ord(every[found.end() - 1]) + 1] |= np.uint32(1 << k)
    flags[0xD800:0xE000] = 0
    combinations, number = np.unique(flags, return_inverse=True)
    return number.astype(np.uint8), {name: (combinations >> k & 1).astype(bool) for k, (name, _) in enumerate(kinds)}


def _chunks(texts: list[str]):
    low = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield low, k
            low, size = k, 0
        size += len(t)
    if low < len(texts):
        yield low, len(texts)


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and where each begins (n + 1 offsets)."""
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), at


def runs(same: np.ndarray, least: int, at: np.ndarray) -> np.ndarray:
    """Whether each text has ``least`` flags in a row. A text's last flag isn't set."""
    place = np.flatnonzero(same)
    first = place[: max(len(place) - least + 1, 0)]
    out = np.zeros(len(at) - 1, bool)
    out[np.searchsorted(at, first[place[least - 1 :] - first == least - 1], "right") - 1] = True
    return out


def equal_ahead(codes: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """Whether a character equals the one ``step`` further on in the same text."""
    same = np.zeros(len(codes), bool)
    same[: max(len(codes) - step, 0)] = codes[: max(len(codes) - step, 0)] == codes[step:]
    for back in range(1, step + 1):  # the last characters of a text have none ahead in it
        ends = at[1:][np.diff(at) >= back]
        same[ends - back] = False
    return same


def kept(codes: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], total[at]


def collapsed(codes: np.ndarray, at: np.ndarray, least: int = 3) -> np.ndarray:
    """Which characters stay when runs of at least ``least`` equal ones become one."""
    if not len(codes):
        return np.zeros(0, bool)
    first = np.ones(len(codes), bool)
    first[1:] = codes[1:] != codes[:-1]
    first[at[:-1][at[:-1] < len(codes)]] = True
    begins = np.flatnonzero(first)
    size = np.diff(np.append(begins, len(codes)))
    return first | np.repeat(size < least, size)


def majority(codes: np.ndarray, at: np.ndarray, threshold: float) -> np.ndarray:
    """Whether one character makes up more than ``threshold`` (one half at least) of a text: only the one in the middle of the sorted characters can."""
    out = np.zeros(len(at) - 1, bool)
    for k in range(len(out)):
        mine = codes[at[k] : at[k + 1]]
        if len(mine):
            middle = np.partition(mine, len(mine) // 2)[len(mine) // 2]
            out[k] = np.count_nonzero(mine == middle) > threshold * len(mine)
    return out


def measure(texts: list[str], kinds: tuple[tuple[str, str], ...], units: range) -> dict[str, np.ndarray]:
    """The measures of texts, which are stripped first. ``loop``: a unit stands three times in a row; ``run``: five equal characters; ``content``: length
    without punctuation, runs of three as one; kinds: patterns of white space, punctuation and the counted kinds."""
    number, has = _table(kinds)
    codes, at = codes_of([t.strip(WHITE) for t in texts])
    kind = number[codes]
    plain, plain_at = kept(codes, at, ~has["space"][kind])
    bare, bare_at = kept(codes, at, ~has["punctuation"][kind])
    loop = np.zeros(len(texts), bool)
    for unit in units:
        loop |= runs(equal_ahead(plain, plain_at, unit), 2 * unit, plain_at)
    once = np.concatenate([[0], np.cumsum(collapsed(bare, bare_at))])
    out = {"length": np.diff(at), "plain": np.diff(plain_at), "top": majority(plain, plain_at, 0.5), "loop": loop}
    out |= {"run": runs(equal_ahead(codes, at, 1) & (codes != 10), 4, at), "content": np.diff(once[bare_at])}
    counts = np.array([np.bincount(kind[a:b], minlength=len(has["space"])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]).reshape(len(texts), -1)
    return out | {name: counts @ has[name] for name in MEASURES if name not in out}


def measures(text: Column, kinds: dict[str, str], units: range = range(2, 9)) -> Column:
    """struct of ``MEASURES``: counts of characters by kind, and whether a text repeats itself. Null is empty."""
    pairs = tuple(kinds.items())

    @F.pandas_udf("struct<" + ", ".join(f"{k}: {t}" for k, t in MEASURES.items()) + ">")
    def go(texts: pd.Series) -> pd.DataFrame:
        every = texts.fillna("").tolist()
        parts = [pd.DataFrame(measure(every[low:high], pairs, units)) for low, high in _chunks(every)]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({k: [] for k in MEASURES})

    return go(text)


def without(text: Column, pattern: str, collapse: int = 3) -> Column:
    """Without the characters of a class, runs of at least ``collapse`` equal ones as one. Null is empty."""
    pairs = (("gone", pattern),)

    @F.pandas_udf("string")
    def go(texts: pd.Series) -> pd.Series:
        (number, has), out = _table(pairs), []
        every = texts.fillna("").tolist()
        for low, high in _chunks(every):
            codes, at = codes_of(every[low:high])
            bare, bare_at = kept(codes, at, ~has["gone"][number[codes]])
            stay, stay_at = kept(bare, bare_at, collapsed(bare, bare_at, collapse))
            whole = stay.tobytes().decode("utf-32-le", "surrogatepass")
            out += [whole[a:b] for a, b in zip(stay_at[:-1].tolist(), stay_at[1:].tolist(), strict=True)]
        return pd.Series(out, dtype=object)

    return go(text)
