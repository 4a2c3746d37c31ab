"""Examples for many queries: against a plain loop, and without shuffling pairs of queries and lines."""
import hashlib
import random

from pyspark.sql import functions as F

from winnowry.operators.retrieval import pick_examples

ITEM = "ordinal long, text string, lang string, scenes array<string>, era_tag string"
KANA = "のをか"


def kana(text):
    return any(c in KANA for c in text)


def expected(queries, official, fan, pool, seed):
    out = set()
    for name, text, scenes in queries:
        best = {}
        for part, rows in enumerate((official, fan, pool)):
            for ordinal, line, lang, own, era in rows:
                share, none = bool(set(own or ()) & set(scenes)), not scenes
                if kana(line) and not kana(text):
                    continue
                if part < 2:
                    if not (none or share):
                        continue
                    at = (0, f"{part}{ordinal:012d}")
                else:
                    if (era == "late" and "告别" not in scenes) or not (lang == "zh" or (lang == "ja" and kana(text))):
                        continue
                    at = (1 + (lang == "ja"), f"{part}{ordinal:012d}") if share else (3 + (lang == "ja"), hashlib.md5(f"{seed}|{name}|{line}".encode()).hexdigest())
                best[line] = min(best.get(line, at), at)
        sure = sum(at[0] < 3 for at in best.values())
        ranked = sorted((at, line) for line, at in best.items() if at[0] < 3 or sure < 3)
        out |= {(name, line, k + 1) for k, (_, line) in enumerate(ranked[:5])}
    return out


def test_tiers_and_filling(spark):
    rng = random.Random(7)
    queries = [(k, *rng.choice([("你好", ["问候"]), ("你好の", ["问候"]), ("再见", ["告别"]), ("谢谢の", ["感谢"]), ("震惊", ["惊讶"])])) for k in range(40)] + [(40, "zzz", []), (41, "の", [])]
    line = lambda k, name, scenes: (k, f"{name}{rng.randrange(400)}{rng.choice(['', '', 'の'])}", rng.choice(["zh", "zh", "ja", "en", None]), rng.choice(scenes), rng.choice(["late", "peak", None]))
    official = [line(k, "o", [["问候"], ["别的"], None]) for k in range(4)]
    fan = [line(k, "f", [["告别"], []]) for k in range(3)]
    pool = [line(k, "p", [["惊讶"], ["别的"], [], None] if k < 4 else [["别的"], [], None]) for k in range(900)]
    for rows in (pool, pool[:9], []):
        tables = [spark.createDataFrame(x, ITEM) for x in (official, fan, rows)]
        got = pick_examples(spark.createDataFrame([q[:2] for q in queries], "query_id long, text string"), *tables, 3)
        assert {tuple(r) for r in got.collect()} == expected(queries, official, fan, rows, 3)


def shuffled(spark):
    """Rows that the session's stages have written to shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_pairs_are_not_shuffled(spark):
    line = lambda name: spark.range(500).select(F.col("id").alias("ordinal"), F.concat(F.lit(name), "id").alias("text"), F.lit("zh").alias("lang"), F.array(F.lit("问候")).alias("scenes"), F.lit(None).cast("string").alias("era_tag"))
    queries = spark.range(300).select(F.col("id").alias("query_id"), F.expr("CASE id % 3 WHEN 0 THEN 'zzz' WHEN 1 THEN '你好' ELSE '震惊' END").alias("text"))
    before = shuffled(spark)
    assert pick_examples(queries, line("a"), line("b"), line("c"), 3).count() == 1500
    assert shuffled(spark) - before < 100_000  # 300 queries meet 1500 lines
