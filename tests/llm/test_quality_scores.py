"""Scores by folded table lookups against the model as it is defined: mean of vectors, output layer, softmax."""
import numpy as np
import pyarrow as pa

from winnowry.llm import quality as q
from winnowry.llm._arrow import Rolling, blocks, mix, spans


def features_of(text):
    """The features of one text, a character n-gram at a time."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    number = lambda a, b, bits, salt=None: int((mix(Rolling(data).raw(np.array([a]), np.array([b])) + np.uint64(salt)) if salt else Rolling(data)(np.array([a]), np.array([b])))[0] >> np.uint64(64 - bits))
    starts, ends = spans(data, np.array([0, len(data)]), ~q.SPACE)
    words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    out = [number(a, b, q.WORD_BITS) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    out += [q.N_FEATURES - 1 - k for k, back in enumerate(q.AGAIN) for i in range(back, len(words)) if words[i] == words[i - back]]
    at = [len(text[:k].encode()) for k in range(len(text) + 1)]
    for k, size in enumerate(q.GRAMS):
        out += [(1 << q.WORD_BITS) + k * (1 << q.GRAM_BITS) + number(at[i], at[i + size], q.GRAM_BITS, size) for i in range(len(text) - size + 1)]
    return out


def test_folded_scores_equal_the_network():
    texts = ["good words here, good words", "buy buy buy now!!", "naïve café 你好世界 你好", "x", "другой текст", "clean text of some length with words", "spam spam spam spam"]
    model = q.train(texts * 5, [1, 0, 1, 0, 1, 1, 0] * 5, epochs=3)
    asked = [*texts, "", "é", "unseen words, 世", None]
    table, got = model.folded(), []
    for _, _, data, at in blocks(pa.array(asked)):
        got += q.scores(model, table, data, at).tolist()
    for text, score in zip(asked, got, strict=True):
        if not text:
            assert score == model.prior
            continue
        logits = model.output @ model.vectors[features_of(text)].astype(float).mean(0) + model.bias
        chance = np.exp(logits - logits.max())
        assert abs(score - chance[1] / chance.sum()) < 1e-6, text
