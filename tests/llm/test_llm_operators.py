"""Each operator against brute force or SQL on small tables, and its defined results in corner cases."""
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from winnowry.llm import embedding_dedup, exact_dedup, langid, licenses, line_dedup, minhash_dedup, mixing, packing, quality, warc
from winnowry.llm._components import components
from winnowry.llm.queries import TOKENIZER

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
BASE = " ".join(f"tok{k}" for k in range(60))


def docs(spark, *texts, extra=None):
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    out = spark.createDataFrame(rows, DOCS)
    return out.withColumns({c: F.lit(1) for c in extra or ()})


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, copies, near copies, odd white space, and columns whose names clash with inner ones."""
    near = BASE.replace("tok7 ", "other ")
    return docs(spark, None, "", " \n\t ", "a", "a b c d", BASE, BASE, near, BASE.upper(), LONG, LONG + " end", "x　y\r\nz <|endoftext|> q", "one line here of words\none line here of words\n\n", "ü é ñ", "123 456", extra=("id", "key", "set", "n", "line", "row", "words", "digest", "label", "component", "u", "v", "block", "start", "copies", "_id", "_gone", "gone", "_row", "kept", "score", "component_id", "weight", "rest"))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup(spark, awkward, nothing):
    rows = awkward.unionByName(awkward.where("doc_id = 5"))  # a repeated row
    got = exact_dedup.exact_dedup(rows).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in rows.collect()]
    assert len(got) == len(texts)
    for r in got:
        text = dict(texts)[r["doc_id"]]
        same = [i for i, t in texts if t == text]
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == (max(same), len(same), hashlib.sha256(text.encode()).hexdigest())
    assert sum(r["kept"] for r in got) == len({t for _, t in texts})
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_exact_dedup_index_persists(spark, awkward):
    from winnowry.llm._store import scratch_path

    path = scratch_path(spark, "digest_index")
    index = exact_dedup.DigestIndex(spark, path, 4)
    first = index.ingest(awkward.where("doc_id < 7"))
    n = first.where("kept").count()
    again = exact_dedup.DigestIndex(spark, path, 4).ingest(awkward.where("doc_id < 7"))
    assert again.where("kept").count() == 0
    more = index.ingest(awkward.where("doc_id >= 6"))
    assert more.where("doc_id = 6").first()["kept"] is False
    assert index.rows().count() == n + more.where("kept").count()
    plan = awkward.select(exact_dedup.digest(F.col("text")).alias("digest")).join(index.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return set() if not words else {tuple(words)} if len(words) < 5 else {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def clusters(sets, linked):
    label = dict.fromkeys(sets)
    label.update({i: i for i in sets})
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_minhash_dedup(spark, awkward, nothing):
    rng = np.random.default_rng(1)
    variants = []
    for _ in range(40):  # a group of near copies
        words = BASE.split()
        for k in rng.choice(60, rng.integers(0, 5), replace=False):
            words[k] = f"new{rng.integers(1000)}"
        variants.append(" ".join(words))
    rows = awkward.select("doc_id", "text").union(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(variants)], "doc_id long, text string"))
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows.collect()}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    label = clusters(sets, linked)
    for r in minhash_dedup.near_duplicates(rows).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), label[r["doc_id"]], label[r["doc_id"]] == r["doc_id"])
    assert minhash_dedup.near_duplicates(nothing).count() == 0
    kept = minhash_dedup.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns


def test_setsketch_merges_and_estimates():
    rng = np.random.default_rng(2)
    x = np.sort(rng.integers(0, 1 << 63, 900, dtype=np.uint64))
    whole = minhash_dedup.registers(x, np.array([0, 900]))[0]
    parts = minhash_dedup.registers(x, np.array([0, 300, 900]))
    assert (minhash_dedup.merge(parts[0], parts[1]) == whole).all()
    a, b = x[:700], x[200:]
    regs = minhash_dedup.registers(np.concatenate([a, b]), np.array([0, 700, 1400]))
    value = minhash_dedup.likelihoods(regs[:1], regs[1:], np.array([700.0]), np.array([700.0]))
    assert abs(minhash_dedup._GRID[value.argmax()] - 500 / 900) < 0.15


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 99), (7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 99: 99, 100: 99, 101: 99}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_line_dedup(spark, awkward, nothing):
    rng = np.random.default_rng(3)
    vocabulary = [f"v{k}" for k in range(60)]
    texts = ["\n".join(" ".join(rng.choice(vocabulary, rng.integers(1, 25))) for _ in range(6)) for _ in range(25)]
    for k in range(10):  # near copies of lines
        words = texts[k].split("\n")[0].split(" ")
        texts.append(" ".join([*words[:-1], "changed"]) + "\nshort")
    rows = awkward.select("doc_id", "text").union(spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    classes = {}
    for i, t in sorted((r["doc_id"], r["text"] or "") for r in rows.collect()):
        for k, line in enumerate(t.split("\n")):
            words = frozenset(WORD.findall(line.translate(LOWER)))
            if len(words) >= line_dedup.MIN_WORDS:
                classes.setdefault(words, []).append((i, k))
    near = lambda a, b: line_dedup.OF * len(a & b) >= line_dedup.SIMILAR * len(a | b)
    linked = {a: [b for b in classes if a != b and near(a, b)] for a in classes}
    want = {at: (min(places), len(linked[c]), at != min(places) or any(min(classes[b]) < min(places) for b in linked[c])) for c, places in classes.items() for at in places}
    got = {(r["doc_id"], r["line"]): ((r["class_id"], r["class_line"]), r["n_links"], r["removed"]) for r in line_dedup.duplicate_lines(rows).collect()}
    for at, told in got.items():
        assert told == want.get(at, ((None, None), 0, False))
    assert line_dedup.duplicate_lines(nothing).count() == 0
    cleaned = line_dedup.drop_lines(awkward)
    assert cleaned.columns == awkward.columns and cleaned.count() == awkward.count()
    assert cleaned.where("doc_id = 12").first()["text"] == "one line here of words\n\n"
    assert cleaned.where("doc_id = 0").first()["text"] is None


def test_posteriors_equal_brute_force():
    rng = np.random.default_rng(4)
    at = np.array([0, 5, 5, 6, 25])
    e, t = rng.normal(size=(25, 2)), rng.normal(size=(2, 2))
    got = langid.posteriors(np.exp(e), np.exp(t), at)
    for low, high in ((0, 5), (5, 6)):
        want = np.zeros((high - low, 2))
        for y in itertools.product(range(2), repeat=high - low):
            w = np.exp(sum(e[low + k, y[k]] for k in range(high - low)) + sum(t[a, b] for a, b in itertools.pairwise(y)))
            for k, v in enumerate(y):
                want[k, v] += w
        assert np.allclose(got[low:high], want / want.sum(1, keepdims=True))


def test_language_id(spark, awkward, nothing):
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(source, F.crc32(F.col("doc_id").cast("string")) % 4 != 2, per_language=60)
    told = langid.predict(source, model).join(source.select("doc_id", "lang"), "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    assert told.where("lang = lang_pred").count() >= 0.97 * told.count()
    got = {r["doc_id"]: r for r in langid.predict(awkward, model).collect()}
    assert [got[k]["lang_pred"] for k in (0, 1, 2, 14)] == ["und"] * 4 and got[0]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.predict(nothing, model).count() == 0
    assert langid.fit(nothing, F.lit(True)) is None and langid.predict(awkward, None).where("lang_pred <> 'und'").count() == 0
    kept = langid.keep_known(awkward, model, 0.4)
    assert kept.columns == awkward.columns and kept.where("doc_id in (0, 1, 2, 14)").count() == 0


def test_quality_classifier(spark, awkward, nothing):
    source, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3
    model = quality.fit(source, labels, held != 1)
    told = quality.score_documents(source, model).join(labels, "doc_id").where(held == 1)
    assert told.where((F.col("score") >= 0.5).cast("int") == F.col("quality")).count() >= 0.9 * told.count()
    got = [r["score"] for r in quality.score_documents(awkward, model).collect()]
    assert len(got) == awkward.count() and all(0 <= x <= 1 for x in got)
    assert quality.fit(nothing, labels.limit(0), F.lit(True)) is None
    assert {r["score"] for r in quality.score_documents(awkward, None).collect()} == {0.5}
    assert quality.score_documents(nothing, model).count() == 0


def test_embedding_dedup(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    x[200:260] = x[:60] + rng.normal(size=(60, 16)) * 0.15
    x[260:280] = x[0]
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [1.0, 2.0]), (1005, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(9))
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicate_vectors(table).collect()}
    u = np.array([r[1] for r in rows[:300]], np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    true = u @ u.T >= 0.9
    np.fill_diagonal(true, False)
    found = sum(got[k]["n_links"] for k in range(300))
    assert found <= true.sum() and found >= 0.9 * true.sum()
    assert all(got[k]["n_links"] <= true[k].sum() for k in range(300))
    assert all((got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True) for k in range(1000, 1006))
    assert got[270]["component_id"] == 0 and not got[270]["kept"]
    assert embedding_dedup.near_duplicate_vectors(table.limit(0)).count() == 0


def test_license_scan(spark, awkward, nothing):
    mit = licenses.TEMPLATES["text-mit"]
    text = re.sub(r"<<var[^>]*>>", "2020 A B", re.sub(r"<<(begin|end)Optional>>", "", mit))
    texts = [text, text.replace("merge", "marge"), "The MIT License and the mit LICENSE.", "Licensed under CC BY-NC 4.0.", "mit-license", None, "", LONG + " apache license"]
    got = [tuple(r)[1:8] for r in licenses.license_scan(docs(spark, *texts)).orderBy("doc_id").collect()]
    assert got[0][5] == "text-mit" and got[0][6] == 1.0
    assert got[1][5] == ""
    assert got[2] == (7, 2, 1, 5, "mit", "mit", 0.5)
    assert got[3][4:6] == ("cc-by", "cc-by,notice-cc-by")
    assert got[4][1] == 1 and got[5] == (0, 0, None, None, "", "", 0.0) == got[6]
    assert got[7][:4] == (30_002, 1, 30_000, 30_000)
    assert licenses.license_scan(awkward).count() == awkward.count() and licenses.license_scan(nothing).count() == 0


def test_template_automata_equal_regular_expressions():
    rng = np.random.default_rng(6)
    template = 'a <<beginOptional>>b <<beginOptional>>c<<endOptional>> d<<endOptional>> <<var;tokens="0-2">> e<<beginOptional>> a<<endOptional>> b'
    automaton, pattern = licenses.compile_template("t", template), re.compile("(?:^| )" + licenses.template_regex(template))
    for _ in range(3000):
        words = [bytes([97 + c]) for c in rng.integers(0, 5, rng.integers(0, 10))]
        assert bool(licenses.find_all(words, [automaton])) == bool(pattern.search("".join(w.decode() + " " for w in words)))


def test_packing(spark, awkward, nothing):
    from tokenizers import Tokenizer

    rows = awkward.unionByName(awkward.where("doc_id in (3, 9)"))
    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = packing.best_fit_pack(rows, TOKENIZER).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for row in awkward.collect():
        ids = np.array([*tokenizer.encode(row["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[row["doc_id"]]})
        assert [p[0] for p in pieces] == list(range(len(pieces))) and sum(p[2] for p in pieces) == len(ids)
        assert all(p[2] == packing.CAPACITY for p in pieces[1:])
        for _, start, length, crc in pieces:
            assert crc == zlib.crc32(ids[start : start + length].tobytes())
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(sequences) <= -(-sum(r["length"] for r in got) // packing.CAPACITY) + 2
    assert packing.best_fit_pack(nothing, TOKENIZER).count() == 0


def test_sum_of_squares_places_where_the_sum_is_least():
    rng = np.random.default_rng(7)
    sizes, capacity = rng.integers(1, 12, 60), 12
    where, _ = packing.sum_of_squares(sizes, capacity)
    gaps: dict[int, int] = {}
    for s, b in zip(sizes.tolist(), where.tolist(), strict=True):
        def after(k):
            trial = {**gaps, k: gaps.get(k, capacity) - s}
            counts = np.bincount([g for g in trial.values() if 0 < g], minlength=capacity)
            return int((counts**2).sum())

        options = {k: after(k) for k, g in gaps.items() if g >= s} or {len(gaps): after(len(gaps))}  # a new one only where none has room
        assert options[b] == min(options.values())
        gaps[b] = gaps.get(b, capacity) - s


def test_parts_join_to_the_ids_of_the_text(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "ENCODE_ROWS", 7)
    texts = [BASE, BASE.upper(), "naïve café\nline two", "", " lead", "trail ", "a  b", "x <|endoftext|> y<|endoftext|>", "it's ' s 'll we'll", "a\u3000 b", "a \u2003b", "tab\tbed a\t b", "日本 語", "1 234 5,6 %", "a\n b", None]
    monkeypatch.setattr(packing, "CACHE_PARTS", 30)
    enc = packing.Encoder(TOKENIZER)
    enc.encode(pa.array(["tok3 tok7 line two", "it's"]))
    flat, at = enc.encode(pa.array(texts))
    whole = Tokenizer.from_file(TOKENIZER)
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_warc(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", "<p>" + "x" * k + "é</p>") for k in range(700)] + [(700, None, None)], "page_id long, url string, html string").withColumns({"file": F.lit(1), "digest": F.lit("d")})
    other = pages.where("page_id not in (10, 600)").withColumn("html", F.when(F.col("page_id") == 200, F.translate("html", "x", "y")).otherwise(F.col("html")))
    got = {r["page_id"]: r for r in warc.fixity(pages, other).collect()}
    assert got[10]["status"] == "missing" and got[200]["status"] == "corrupt" and got[9]["status"] == "ok" and got[11]["status"] == "moved"
    assert got[599]["status"] == "ok" and got[601]["status"] == "moved"
    assert {r["status"] for r in warc.fixity(pages, pages).collect()} == {"ok"}
    assert {r["status"] for r in warc.fixity(pages.limit(0), pages).collect()} == {"extra"}
    assert {r["status"] for r in warc.fixity(pages, pages.limit(0)).collect()} == {"missing"}
    assert warc.fixity(pages.limit(0), pages.limit(0)).count() == 0
    twice = warc.fixity(pages.unionByName(pages.where("page_id = 5")), pages).where("page_id = 5").first()
    assert twice["n_records"] == 2 and twice["status"] == "corrupt"
    text = pages.where("page_id < 3").select(warc.record_text(F.col("url"), F.col("html"))).collect()
    raw = "".join(r[0] for r in text).encode()
    assert [(u, b.decode()) for _, _, u, b in warc.parse(raw)] == [(f"http://h/{k}", "<p>" + "x" * k + "é</p>") for k in range(3)]


def test_mixing(spark, awkward, nothing):
    rows = spark.createDataFrame([(k, "w " * (k % 7 + 1), "big" if k < 900 else f"s{k % 4}", 0) for k in range(1000)], "doc_id long, text string, source string, n_chars long")
    got = mixing.plan(rows).collect()
    shares = {}
    for r in got:
        shares.setdefault(r["source"], [0, r["weight"]])[0] += r["n_tokens"]
    total = sum(t for t, _ in shares.values())
    weights = {s: w for s, (_, w) in shares.items()}
    assert abs(sum(weights.values()) - 1) < 1e-9
    assert all(w * total / shares[s][0] <= mixing.MAX_REPEATS + 1e-6 for s, w in weights.items())
    read = {s: sum(r["copies"] * r["n_tokens"] for r in got if r["source"] == s) for s in shares}
    assert all(weights[s] * total - 7 <= read[s] <= weights[s] * total + 1e-3 for s in shares)
    assert mixing.plan(nothing).count() == 0
    mixed = mixing.realise(awkward)
    assert mixed.columns == awkward.columns
    assert mixed.where("doc_id in (0, 1, 2)").count() == 3  # no tokens: kept once


def test_arrow_helpers():
    from winnowry.llm._arrow import LOWER_BYTES, SPACE, Rolling, blocks, spans, text_bytes

    texts = ["Ab c", None, "", "ab  C", "x" * 50]
    data, at = text_bytes(pa.array(texts, pa.string()).slice(0, 4))
    starts, ends = spans(data, at, ~SPACE)
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [b"Ab", b"c", b"ab", b"C"]
    h = Rolling(data, LOWER_BYTES)(starts, ends)
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
    assert sum(high - low for low, high, _, _ in blocks(pa.array(texts), 10)) == 5


def test_null_ids(spark):
    rows = spark.createDataFrame([(None, BASE), (None, BASE), (1, BASE), (None, None), (2, "x y z a b c\nx y z a b c")], "doc_id long, text string").withColumns({"source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")})
    assert exact_dedup.exact_dedup(rows).where("kept").count() == 3
    near = minhash_dedup.near_duplicates(rows).collect()
    assert len(near) == 5 and {r["component_id"] for r in near} == {1, 2, None}
    lines = line_dedup.duplicate_lines(rows)
    assert lines.count() == 6 and lines.where("removed").count() == 2
    assert packing.best_fit_pack(rows, TOKENIZER).count() == 5
    assert licenses.license_scan(rows).count() == mixing.plan(rows).count() == quality.score_documents(rows, None).count() == langid.predict(rows, None).count() == 5
    assert langid.fit(rows, F.lit(True)) is None
    vectors = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in embedding_dedup.near_duplicate_vectors(vectors).collect())
    assert got == [(0, 0, 0), (0, 0, 1), (1, 0, 1), (2, 0, 2)]
