"""BPE by distinct words, alignment of tokenizers and fill-in-middle against the libraries and plain loops."""
import collections
import hashlib
import re

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from winnowry.llm import alignment, bpe_words, fill_in_middle
from winnowry.llm._blocks import pack_ints, unpack_ints
from winnowry.llm.queries import PIECE_MODEL, QUERIES, TOKENIZER, WORD_TOKENIZER, table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
TEXTS = [
    None, "", " ", " \n\t \x0b\x0c\r ", "a", "It's They'LL DON'T", "Ünï été Ķ ́x ﬁ ǅ ΟΔΟΣ İ", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "a b　c\xa0d\x85e\x1cf",
    "日本語のテキスト。中文　文字", "🤦🏽‍♂️ 👍 \U0001d518\U0001d51f", "line one\n\nline two\r\nend", "\n", "\n\n", "x\n", "no end", "<P>marked", "a <S> b\nc", "▁ under ▁▁ bar", "two  blanks   three ", "<s></s><unk><0x41>", "\x00\x01 nul",
    "1234567890 3.14", LONG, LONG + " end", "same text here", "same text here", "...!?;,,,--- ((())) 'tis 's 't", "-" * 5000, "naïve café " * 50,
]
CLASHES = ("id", "row", "block", "places", "shard", "words", "ids", "piece", "piece_id", "sizes", "n", "a", "b", "pairs", "place", "links", "best", "units", "h1", "low", "high", "form", "prefix", "middle", "suffix", "output", "decoded", "n_tokens")


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(TEXTS)] + [(5, TEXTS[5], "en", "s", 3), (None, "no id", "en", "s", 3), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).withColumns({c: F.lit(1) for c in CLASHES})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def multiset(rows):
    return collections.Counter(rows)


def test_packed_numbers():
    for x in ([], [0], [255, 1], [256, 0, 65535], [65536, 2**32 - 1, 0]):
        assert unpack_ints(pack_ints(np.asarray(x, np.int64))).tolist() == x


def words_expected(rows):
    lib = Tokenizer.from_file(WORD_TOKENIZER)
    out = []
    for i, t in rows:
        ids = lib.encode(t, add_special_tokens=False).ids
        out.append((i, len(ids), np.asarray(ids, "<u4").tobytes(), lib.decode(ids, skip_special_tokens=False)))
    return multiset(out)


@pytest.mark.parametrize("block_bytes", [1 << 25, 200])
def test_bpe_words(awkward, block_bytes):
    got = bpe_words.encode_and_decode(awkward, WORD_TOKENIZER, block_bytes=block_bytes)
    assert got.columns == ["id", "n_tokens", "ids", "decoded"]
    assert multiset((r["id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in got.collect()) == words_expected(rows_of(awkward))


def test_bpe_words_query(spark):
    want = {(i, n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, n, ids, t in words_expected(rows_of(table(spark, SF, "documents")))}
    assert {tuple(r) for r in QUERIES["op11_bpe_round_trip"](spark, SF).collect()} == want


def test_bpe_words_encodes_each_word_once(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"alpha beta w{k}") for k in range(50)], "id long, text string").repartition(5)
    table = bpe_words.split(docs, 4).where("shard is not null")
    asked = [(r["shard"], w) for r in table.collect() for w in bpe_words.unpack_words(r["words"])]
    assert len(set(asked)) == len({w for _, w in asked}) == 52  # a word is one shard's
    assert sum(w == "alpha" for _, w in asked) <= 5  # asked for once a block, not once an occurrence


def test_bpe_decode(spark, awkward):
    lib = Tokenizer.from_file(WORD_TOKENIZER)
    rows = [(i, lib.encode(t, add_special_tokens=False).ids) for i, t in rows_of(awkward)] + [(77, None), (78, [])]
    got = bpe_words.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), WORD_TOKENIZER)
    assert multiset((r["doc_id"], r["text"]) for r in got.collect()) == multiset((i, lib.decode(ids or [], skip_special_tokens=False)) for i, ids in rows)
    with pytest.raises(Exception, match="no piece has the id"):
        bpe_words.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>"), WORD_TOKENIZER).collect()


def test_bpe_words_refuses_other_splitters():
    with pytest.raises(ValueError, match="encoded apart"):
        bpe_words.Vocabulary(TOKENIZER)


def alignment_expected(rows):
    """Token by token: every pair of spans that overlap."""
    lib = Tokenizer.from_file(TOKENIZER)
    lib.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    byte_of = {v: k for k, v in bytes_to_unicode().items()}
    spans, links, per = {}, collections.Counter(), []
    for i, t in rows:
        a = lib.encode(" " + t, add_special_tokens=False)
        ids_a, ids_b = a.ids, sp.encode(t)
        bytes_a = [bytes(byte_of[c] for c in x) for x in a.tokens]
        bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(k) else p.replace("▁", " ").encode() for k in ids_b for p in [sp.id_to_piece(k)]]
        whole = b" " + t.encode()
        if not t or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            per.append((i, None))
            continue
        pairs, groups, x, y, ga, gb, at_a, at_b = [], [], 0, 0, [], [], 0, 0
        while x < len(ids_a) or y < len(ids_b):
            if at_a <= at_b and x < len(ids_a):
                at_a += len(bytes_a[x])
                ga.append(ids_a[x])
                x += 1
            else:
                at_b += len(bytes_b[y])
                gb.append(ids_b[y])
                y += 1
            if at_a == at_b:
                groups.append((ga, gb))
                ga, gb = [], []
        starts = np.cumsum([0, *map(len, bytes_a)]), np.cumsum([0, *map(len, bytes_b)])
        y = 0
        for k in range(len(ids_a)):
            while starts[1][y + 1] <= starts[0][k]:
                y += 1
            z = y
            while z < len(ids_b) and starts[1][z] < starts[0][k + 1]:
                pairs.append((ids_a[k], ids_b[z]))
                z += 1
        links.update(pairs)
        per.append((i, (len(ids_a), len(ids_b), groups, pairs)))
    top = {}
    for (_, b), n in links.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for i, found in per:
        if found is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        na, nb, groups, pairs = found
        told = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((i, na, nb, len(groups), len(pairs), sum(links[p] == top[p[1]] for p in pairs), sum(links[p] for p in pairs), hashlib.sha256(told.encode()).hexdigest()))
    return multiset(out), links


def bytes_to_unicode():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("block_bytes", [1 << 24, 300])
def test_alignment(awkward, block_bytes):
    got, counts = alignment.align_tokenizers(awkward, TOKENIZER, PIECE_MODEL, block_bytes=block_bytes)
    want, links = alignment_expected(rows_of(awkward))
    assert multiset((r["id"], *(r[c] for c in COLUMNS)) for r in got.collect()) == want
    assert {(r["a"], r["b"]): r["links"] for r in counts.collect()} == dict(links)


def test_alignment_of_parts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 100)
    for v in (alignment.byte_level(TOKENIZER), alignment.pieces(PIECE_MODEL)):
        texts = ["word " * 500, "x" * 900, LONG[:20_000], "a  b\nc d " * 200, "  lead and  trail  " * 40]
        in_parts = v.encode(texts)
        monkeypatch.setattr(alignment, "CHUNK_CHARS", 1 << 30)
        assert [x.tolist() for x in in_parts] == [x.tolist() for x in v.encode(texts)]
        monkeypatch.setattr(alignment, "CHUNK_CHARS", 100)


def test_alignment_query(spark):
    want, _ = alignment_expected(rows_of(table(spark, SF, "documents")))
    got = QUERIES["op12_tokenizer_alignment"](spark, SF).collect()
    assert multiset((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got) == want


GRAMMARS = {"line": r"[^\n]*\n|[^\n]+", "word": r"\s*\S+|\s+", "character": r"(?s).", "paragraph": r"(?s).+?(?:\n\n+|\Z)", "clause": r"(?s)[^.!?;。！？；]*[.!?;。！？；]+|[^.!?;。！？；]+"}


@pytest.mark.parametrize("unit", sorted(GRAMMARS))
def test_units(spark, unit):
    space = re.compile("[ \t\n\x0b\x0c\r]")
    texts = [t for t in TEXTS if t is not None and (unit != "word" or not re.search(r"\s", space.sub("", t))) and len(t) < 10_000] + ["A.B!! c\n\nd\n\n\ne;f", "\n\n\nx"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", fill_in_middle.units(F.col("t"), unit).alias("u")).collect()
    for r in got:
        want = [x for x in re.findall(GRAMMARS[unit], texts[r["k"]]) if x]
        if unit == "word" and len(want) > 1 and not want[-1].strip():
            want = want[:-2] + [want[-2], want[-1]]
        assert "".join(r["u"]) == texts[r["k"]]
        assert r["u"] == want, (unit, texts[r["k"]])


def fim(doc_id, text):
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    u = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(u)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", None, None, text
    a, b, c = "".join(u[:low]), "".join(u[low:high]), "".join(u[high:])
    form = "spm" if h4 % 100 < 50 else "psm"
    return n, form, len(a), len(b), f"<S>{c}<P>{a}<M>{b}" if form == "spm" else f"<P>{a}<S>{c}<M>{b}"


def test_fill_in_middle(awkward):
    done = fill_in_middle.fill_in_middle(awkward).withColumn("back", fill_in_middle.restore(F.col("output"), F.col("form")))
    got = multiset((r["id"], r["n"], r["form"], None if r["prefix"] is None else len(r["prefix"]), None if r["middle"] is None else len(r["middle"]), r["output"], r["back"]) for r in done.collect())
    assert got == multiset((i, *fim(i, t), t) for i, t in rows_of(awkward))


def test_restore_is_exact_near_marks(spark):
    rows = [(k, t) for k, t in enumerate(["<\nS>\n<P", "<S\n<P\n<M\n>", "P>\nM>\n<", "<<\n<<\n"])] * 40
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    done = fill_in_middle.fill_in_middle(docs).select("id", "form", "output", fill_in_middle.restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert {r["form"] for r in done} == {"psm", "spm"}
    assert all(r["back"] == rows[r["id"]][1] for r in done)


def test_fill_in_middle_rate(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'a\nb\nc\n' as text")
    forms = {r["form"]: r["count"] for r in fill_in_middle.fill_in_middle(docs, rate=50, suffix_first=25).groupBy("form").count().collect()}
    assert abs(forms["plain"] - 2000) < 200 and abs(forms["spm"] - 500) < 120


def test_empty_tables(nothing):
    assert bpe_words.encode_and_decode(nothing, WORD_TOKENIZER).count() == 0
    assert alignment.align_tokenizers(nothing, TOKENIZER, PIECE_MODEL)[0].count() == 0
    assert fill_in_middle.fill_in_middle(nothing).count() == 0


def test_fill_in_middle_stays_in_the_jvm(spark):
    plan = QUERIES["op13_fill_in_middle"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Python", "Arrow"))
