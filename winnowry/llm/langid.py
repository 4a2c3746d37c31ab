"""Language of documents by a linear-chain conditional random field over words.

Each word has a language; its score comes from hashed features (prefixes, suffixes, byte n-grams, and the word itself
if it's in the learned lexicon), and learned transitions tie neighbours together. Forward-backward gives each word's
posterior in code-switched text; a document's language is the one with the largest sum of posteriors.

Fitting uses a bounded sample: of every language that occurs about ``DOCS_PER_LANGUAGE`` documents and ``BYTES_PER_LANGUAGE``
bytes of text (chosen by a hash of id and text, whole texts of at most ``LONGEST_SAMPLE`` characters), from which training
sequences are spliced so that languages switch within a sequence. The model takes 0.5 MB a language. Scoring runs over
whole texts, of any length, in Arrow batches: features are computed once for each distinct word of a block, and
forward-backward is exact, as a scan over runs of 16 words.

Defined results: ``und`` with score 0 where the text is null or has no letter; where nothing could be learned every
text is ``und``; repeated rows give repeated results; extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import LOWER_BYTES, U64, Rolling, blocks, byte_class, mix, spans, text_bytes, words_per_row

DOCS_PER_LANGUAGE = 400
BYTES_PER_LANGUAGE = 1 << 20
LONGEST_SAMPLE = 1 << 16
FEATURE_BITS = 17
RUN = 16
LETTERS = byte_class(list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256)))
ASCII_LETTERS = byte_class(list(range(65, 91)) + list(range(97, 123)))


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (features, labels)
    transitions: np.ndarray  # (labels, labels), logarithms
    lexicon: np.ndarray  # sorted hashes of words


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Rolling hashes of a block; of its words the first occurrences, each word's number among them, and their hashes."""
    rolling = Rolling(data, LOWER_BYTES)
    hashes, first, number = np.unique(rolling(starts, ends), return_index=True, return_inverse=True)
    return rolling, hashes, first, number


def features(rolling: Rolling, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of words, flat, and where each word's begin (n + 1 offsets)."""
    n = len(starts)
    columns = []
    for k in (1, 2, 3, 4):
        columns.append(mix(rolling.raw(starts, np.minimum(starts + k, ends)) + U64(2 * k)))
        columns.append(mix(rolling.raw(np.maximum(ends - k, starts), ends) + U64(2 * k + 1)))
    at = np.searchsorted(lexicon, hashes)
    known = (at < len(lexicon)) & (lexicon[np.minimum(at, max(len(lexicon) - 1, 0))] == hashes) if len(lexicon) else np.zeros(n, bool)
    columns.append(np.where(known, mix(hashes + U64(99)), U64(0)))
    fixed = (np.stack(columns, 1) >> U64(64 - FEATURE_BITS)).astype(np.int64)
    counts, ragged = np.full(n, fixed.shape[1], np.int64), []
    for size in (2, 3):
        many = np.maximum(ends - starts - size + 1, 0)
        owner = np.repeat(np.arange(n), many)
        place = starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        ragged.append((owner, (mix(rolling.raw(place, place + size) + U64(50 + size)) >> U64(64 - FEATURE_BITS)).astype(np.int64)))
        counts += many
    offsets = np.concatenate([[0], np.cumsum(counts)])
    flat, used = np.empty(offsets[-1], np.int64), np.full(n, fixed.shape[1], np.int64)
    flat[(offsets[:-1, None] + np.arange(fixed.shape[1])).ravel()] = fixed.ravel()
    for owner, value in ragged:
        many = np.bincount(owner, minlength=n)
        flat[offsets[owner] + used[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)] = value
        used += many
    return flat, offsets


def emissions(model: Model, rolling: Rolling, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    flat, offsets = features(rolling, starts, ends, hashes, model.lexicon)
    out = np.add.reduceat(model.weights[flat], offsets[:-1], axis=0) if len(starts) else np.zeros((0, len(model.labels)))
    return out / np.sqrt(np.diff(offsets))[:, None]


def posteriors(potentials: np.ndarray, move: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Posterior of every word's label. potentials: exp of the scores, a row per word; at: where each document's words begin.
    Each document is cut into runs; products of the runs' matrices are scanned over the document, then each run is done from its ends."""
    n, size = potentials.shape
    if not n:
        return potentials
    many = np.diff(at)
    runs = -(-many // RUN)
    doc_at = np.concatenate([[0], np.cumsum(runs)])
    owner = np.repeat(np.arange(len(many)), runs)
    inner = np.arange(doc_at[-1]) - doc_at[owner]
    begin = at[owner] + inner * RUN
    length = np.minimum(RUN, at[owner + 1] - begin)
    place = np.minimum(begin[:, None] + np.arange(RUN), n - 1)
    valid = np.arange(RUN) < length[:, None]
    psi = np.where(valid[:, :, None], potentials[place], 1.0)
    head = inner == 0
    kept = valid[:, :, None]
    back = np.ascontiguousarray(move.T)

    # each run's product of matrices, from the word before it to its last word; a first word follows any label alike
    whole = np.where(head[:, None, None], np.ones((size, size)), move) * psi[:, 0, None, :]
    for t in range(1, RUN):
        x = (whole.reshape(-1, size) @ move).reshape(whole.shape)
        x *= psi[:, t, None, :]
        x /= x.sum((1, 2))[:, None, None]
        np.copyto(whole, x, where=kept[:, t, :, None])
    before, after = np.ones((len(owner), size)), np.ones((len(owner), size))
    order = np.argsort(-runs, kind="stable")
    deep = np.searchsorted(-runs[order], -np.arange(1, runs.max() + 1), "right")  # documents with k runs or more
    for k in range(1, len(deep)):
        r = doc_at[order[: deep[k]]] + k
        x = (before[r - 1, :, None] * whole[r - 1]).sum(1)
        before[r] = x / x.sum(1, keepdims=True)
    for k in range(len(deep) - 1, 0, -1):
        r = doc_at[order[: deep[k]]] + k
        x = (whole[r] * after[r, None, :]).sum(2)
        after[r - 1] = x / x.sum(1, keepdims=True)
    out = np.empty_like(psi)
    a = before
    for t in range(RUN):
        x = a @ move
        if t == 0:
            x[head] = 1
        x *= psi[:, t]
        x /= x.sum(1, keepdims=True)
        np.copyto(a, x, where=kept[:, t])
        out[:, t] = a
    b = after
    for t in range(RUN - 1, -1, -1):
        out[:, t] *= b
        x = (psi[:, t] * b) @ back
        x /= x.sum(1, keepdims=True)
        np.copyto(b, x, where=kept[:, t])
    out /= out.sum(2, keepdims=True)
    return out[valid]


def vocabulary(texts: list[str]):
    """Distinct words of a sample by hash; each word's number among them and its document; the lexicon (words of at least 3 documents); the distinct
    words' features, flat, and where each word's begin. Texts are read a block at a time, twice, as features need the lexicon."""
    column, words, docs = pa.array(texts, pa.string()), [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for low, _, data, at in blocks(column):
        starts, ends = spans(data, at, LETTERS)
        words.append(Rolling(data, LOWER_BYTES)(starts, ends))
        docs.append(low + np.repeat(np.arange(len(at) - 1), np.diff(words_per_row(starts, at))))
    of_doc = np.concatenate(docs)
    hashes, first, number = np.unique(np.concatenate(words), return_index=True, return_inverse=True)
    spread = np.unique(number * np.int64(len(texts) + 1) + of_doc) // (len(texts) + 1)
    lexicon = hashes[np.bincount(spread, minlength=len(hashes)) >= 3]
    begin, parts, sizes = 0, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    by_place = np.argsort(first)
    for _, _, data, at in blocks(column):
        starts, ends = spans(data, at, LETTERS)
        mine = by_place[slice(*np.searchsorted(first[by_place], [begin, begin + len(starts)]))]
        if len(mine):
            here = first[mine] - begin
            flat, offsets = features(Rolling(data, LOWER_BYTES), starts[here], ends[here], hashes[mine], lexicon)
            parts.append(flat.astype(np.int32))
            sizes.append(np.diff(offsets))
        begin += len(starts)
    many, flat = np.concatenate(sizes), np.concatenate(parts)
    back = np.empty(len(by_place), np.int64)
    back[by_place] = np.arange(len(by_place))
    at = np.concatenate([[0], np.cumsum(many)])
    kept = many[back]
    offsets = np.concatenate([[0], np.cumsum(kept)])
    return hashes, number, of_doc, lexicon, flat[np.repeat(at[back] - offsets[:-1], kept) + np.arange(len(flat))], offsets


def train(texts: list[str], labels: list[str], rounds: int = 250, batch: int = 64, length: int = 40, rate: float = 0.5, seed: int = 7) -> Model | None:
    """Stochastic gradient ascent on the likelihood of spliced sequences. Words that stand in at least 3 documents make up the lexicon."""
    names = sorted(set(labels))
    if not names:
        return None
    size = len(names)
    hashes, number, of_doc, lexicon, flat, offsets = vocabulary(texts)
    model = Model(names, np.zeros((1 << FEATURE_BITS, size), np.float32), np.zeros((size, size)), lexicon)
    scale = 1 / np.sqrt(np.diff(offsets))
    truth = np.array([names.index(x) for x in labels])[of_doc]
    by_label = [np.flatnonzero(truth == k) for k in range(size)]
    if not len(truth):
        return model
    rng = np.random.default_rng(seed)
    there = [k for k in range(size) if len(by_label[k])]
    for r in range(rounds):
        rows = []
        for _ in range(batch):
            row: list[np.ndarray] = []
            while sum(map(len, row)) < length:
                words = by_label[there[rng.integers(len(there))]]
                k = int(rng.integers(len(words)))
                row.append(words[k : k + int(rng.integers(3, length + 1))])
            rows.append(np.concatenate(row)[:length])
        picked = np.stack(rows)
        y = truth[picked]
        kinds, place = np.unique(number[picked], return_inverse=True)
        place = place.reshape(picked.shape)
        many = np.diff(offsets)[kinds]
        owner = np.repeat(np.arange(len(kinds)), many)
        feats = flat[np.repeat(offsets[kinds], many) + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)]
        score = np.add.reduceat(model.weights[feats], np.cumsum(many) - many, axis=0) * scale[kinds][:, None]
        e = score[place]
        psi = np.exp(e - e.max(2, keepdims=True))
        move = np.exp(model.transitions)
        a = np.empty_like(psi)
        a[:, 0] = psi[:, 0] / psi[:, 0].sum(1, keepdims=True)
        for t in range(1, length):
            x = (a[:, t - 1] @ move) * psi[:, t]
            a[:, t] = x / x.sum(1, keepdims=True)
        b = np.ones((batch, size))
        post, expected = np.empty_like(psi), np.zeros((size, size))
        for t in range(length - 1, -1, -1):
            x = a[:, t] * b
            post[:, t] = x / x.sum(1, keepdims=True)
            if t:
                pair = a[:, t - 1, :, None] * move * (psi[:, t] * b)[:, None, :]
                expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
                b = (psi[:, t] * b) @ move.T
                b /= b.sum(1, keepdims=True)
        step = rate * (1 - r / rounds)
        gap = -post
        gap[np.arange(batch)[:, None], np.arange(length), y] += 1
        by_kind = np.zeros((len(kinds), size))
        np.add.at(by_kind, place.ravel(), gap.reshape(-1, size))
        by_kind *= scale[kinds][:, None] * step
        for k in range(size):
            model.weights[:, k] += np.bincount(feats, by_kind[owner, k], 1 << FEATURE_BITS)
        seen = np.zeros((size, size))
        np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        model.transitions += step * (seen - expected) / batch
    return model


def lettered(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    total = np.concatenate([[0], np.cumsum(ASCII_LETTERS[data])])
    found = np.diff(total[at]) > 0
    for i in np.flatnonzero(~found & (np.diff(at) > 0)):
        found[i] = any(map(str.isalpha, data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace")))
    return found


def classify(model: Model, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the words' posteriors, a row per document."""
    starts, ends = spans(data, at, LETTERS)
    words_at = words_per_row(starts, at)
    out = np.zeros((len(at) - 1, len(model.labels)))
    if len(starts):
        rolling, hashes, first, number = distinct_words(data, starts, ends)
        score = emissions(model, rolling, starts[first], ends[first], hashes)
        psi = np.exp(score - score.max(1, keepdims=True))
        post = posteriors(psi[number], np.exp(model.transitions), words_at)
        full = np.flatnonzero(np.diff(words_at))
        out[full] = np.add.reduceat(post, words_at[full], axis=0)
    return out


PREDICTED = "id long, lang_pred string, score double"


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score (mean posterior of that language over the words)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores = [], []
            for _, _, data, at in blocks(batch.column(1)):
                has = lettered(data, at)
                if model is None:
                    labels += ["und"] * len(has)
                    scores += [0.0] * len(has)
                    continue
                sums = classify(model, data, at)
                best = sums.argmax(1)
                share = sums[np.arange(len(best)), best] / np.maximum(sums.sum(1), 1e-300)
                labels += [model.labels[k] if h else "und" for k, h in zip(best.tolist(), has.tolist(), strict=True)]
                scores += np.where(has, share, 0.0).clip(0, 1).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(go, PREDICTED).withColumnRenamed("id", id_col)


def sample(docs: DataFrame, learn_from, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = DOCS_PER_LANGUAGE) -> pd.DataFrame:
    """A bounded sample of (text, lang): rows for which ``learn_from`` holds, about ``per_language`` of each language and no more than about
    ``BYTES_PER_LANGUAGE`` bytes, chosen by a hash of id and text, so that the same table gives the same sample; repeated rows count once."""
    id_, text, lang = F.col(id_col), F.col(text_col), F.col(lang_col)
    able = docs.where(learn_from & lang.isNotNull() & text.isNotNull() & (F.length(text) <= LONGEST_SAMPLE)).select(id_.alias("id"), text.alias("text"), lang.alias("lang"))
    counts = able.groupBy("lang").agg(F.count(F.lit(1)).alias("k"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    if not counts:
        return pd.DataFrame({"text": [], "lang": []})
    grain = 1 << 30
    least = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, per_language / r["k"], BYTES_PER_LANGUAGE / max(r["bytes"], 1)) * grain))])
    chosen = able.where(F.pmod(F.xxhash64("id", "text", F.lit("language")), F.lit(grain)) < least[F.col("lang")])
    return chosen.dropDuplicates(["id", "text", "lang"]).toPandas().sort_values(["lang", "id", "text"], kind="stable")


def fit(docs: DataFrame, learn_from, **columns) -> Model | None:
    rows = sample(docs, learn_from, **columns)
    return train(rows["text"].tolist(), rows["lang"].tolist()) if len(rows) else None


def keep_known(docs: DataFrame, model: Model | None, least_score: float, text_col: str = "text") -> DataFrame:
    """The documents, all columns, whose language is told with at least this score; ``und`` goes. Without a model only texts with letters are told from others."""
    at = docs.columns.index(text_col)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [np.zeros(0, bool)]
            for _, _, data, of in blocks(batch.column(at)):
                has = lettered(data, of)
                if model is not None:
                    sums = classify(model, data, of)
                    has &= sums.max(1) >= least_score * sums.sum(1)
                keep.append(has)
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(go, docs.schema)
