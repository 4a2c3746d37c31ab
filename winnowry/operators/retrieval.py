"""Lexical retrieval for prompts: facts and examples by substrings, composed into messages."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnowry.functions.similarity import nfkc_key
from winnowry.functions.text import has_kana, strip
from winnowry.operators.selection import seeded
from winnowry.operators.substrings import substring_pairs
from winnowry.operators.windows import top_per_key
from winnowry.sources.scratch import written

MAX_FACTS, MAX_EXAMPLES = 4, 5
#: Queries with fewer examples of their scenes are filled up. Parts into which the texts to choose from are dealt.
LEAST_EXAMPLES, SLOTS = 3, 64
#: A table of facts, examples or scenes is joined to queries by broadcast only up to this many bytes (as JSON); beyond, Spark picks the way.
MAX_BROADCAST_BYTES = 16 << 20
# The keywords of the scenes.
SCENES = {
    "问候": ("你好", "早安", "晚安", "早上好", "晚上好", "欢迎", "在吗", "辛苦了", "こんにちは", "おはよう"),
    "感谢": ("谢谢", "感谢", "阿里嘎多", "多谢", "ありがとう"),
    "自嘲": ("菜", "笨", "不行", "没办法", "输了", "坑", "笨蛋"),
    "游戏": ("游戏", "lol", "apex", "宝可梦", "赛马娘", "雀魂", "打一把", "开黑", "段位", "ゲーム"),
    "食物": ("吃", "好吃", "麦当劳", "蜜雪", "冰淇淋", "甜", "肉", "饭", "野菜", "食べ"),
    "唱歌": ("歌", "唱", "live", "演唱会", "歌う"),
    "情绪": ("开心", "难过", "害怕", "生气", "累", "心情", "嬉しい", "悲しい"),
    "惊讶": ("什么", "真的吗", "不会吧", "震惊", "えっ"),
    "屑": ("屑", "坏", "欺负", "恶作剧"),
    "告别": ("再见", "拜拜", "毕业", "想她", "回来", "さようなら", "バイバイ"),
    "夸赞": ("可爱", "厉害", "好听", "棒", "喜欢", "すごい", "かわいい"),
    "被说小": ("小", "矮", "萝莉", "ちっちゃい"),
    "被开盒": ("开盒", "线下", "地址", "黑粉"),
}
SENSITIVE = "sensitive"


def small(rows: DataFrame) -> DataFrame:
    """Marked for broadcast if it's measured small."""
    size = rows.agg(F.sum(F.octet_length(F.to_json(F.struct(*rows.columns))))).first()[0]
    return F.broadcast(rows) if (size or 0) <= MAX_BROADCAST_BYTES else rows


def fact_hits(queries: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, fact_id, hits): how many of a fact's phrases hold the query or stand in it, both in normal form. facts: id, cat, q, fact, ordinal."""
    said = queries.select(F.col("query_id").alias("key"), nfkc_key(F.col("text")).alias("text"))
    phrases = facts.select(F.col("id").alias("fact_id"), "cat", "fact", "ordinal", F.explode("q").alias("p")).withColumn("p", nfkc_key(F.col("p"))).where("p <> ''")
    met = substring_pairs(said, phrases).withColumnRenamed("key", "query_id").join(phrases, "p")
    return met.groupBy("query_id", "fact_id", "cat", "fact", "ordinal").agg(F.count(F.lit(1)).alias("hits"))


def retrieve_facts(queries: DataFrame, facts: DataFrame, most: int = MAX_FACTS) -> DataFrame:
    """(query_id, sensitive, fact_id, fact, rank): the facts with the most hits; a hit of the sensitive kind leaves only its mark."""
    hits = fact_hits(queries, facts)
    marked = hits.join(hits.groupBy("query_id").agg(F.bool_or(F.col("cat") == SENSITIVE).alias("sensitive")), "query_id")
    top = top_per_key(marked.where(~F.col("sensitive")), ["query_id"], most, F.desc("hits"), F.asc("ordinal"))
    guard = marked.where("sensitive").select("query_id").distinct()
    return top.select("query_id", "sensitive", "fact_id", "fact", "hits").unionByName(guard.select("query_id", F.lit(True).alias("sensitive"), F.lit(None).cast("string").alias("fact_id"), F.lit(None).cast("string").alias("fact"), F.lit(None).cast("long").alias("hits")))


def matched_scenes(text: Column, scenes: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Scenes of which a keyword stands in the text. The keywords are lower case and without width variants."""
    said = nfkc_key(text)
    found = [F.when(said.rlike("|".join(r"\Q" + w + r"\E" for w in words)), F.lit(scene)) for scene, words in (scenes or SCENES).items()]
    return F.array_compact(F.array(*found))


def era_allowed(era: Column, scenes: Column) -> Column:
    """Late material only for farewells; without a tag it's allowed."""
    return ~F.coalesce(era == "late", F.lit(False)) | F.array_contains(scenes, "告别")


def pick_examples(queries: DataFrame, official: DataFrame, fan: DataFrame, pool: DataFrame | None, seed: int | str, most: int = MAX_EXAMPLES) -> DataFrame:
    """(query_id, text, rank): up to ``most`` different texts per query, by tiers: official and fan lines of a matched scene (all of
    them if no scene matched), transcripts of a matched scene, and where fewer than three were found other transcripts in seeded order. Texts with kana only for queries with kana.

    Which lines the first two tiers give follows from the scenes and the kana of a query alone, so lines meet the few different kinds of queries. Only queries left with fewer
    than three meet the transcripts, twice: of the digests in each of ``SLOTS`` parts or more of the texts the smallest tell a bound for the ones wanted, then what keeps
    within it is ranked. Neither pass keeps or shuffles the pairs."""
    asked = queries.select("query_id", F.col("text").alias("said")).withColumns({"scenes_asked": matched_scenes(F.col("said")), "kana": has_kana(F.col("said"))})
    asked = asked.withColumn("kind", F.to_json(F.struct("scenes_asked", "kana"))).drop("said")
    part = lambda rows, k: rows.select(F.lit(k).alias("part"), "ordinal", strip(F.col("text")).alias("text"), "lang", "scenes", "era_tag").where("text <> ''").withColumn("in_kana", has_kana(F.col("text")))
    readable = ~F.col("in_kana") | F.col("kana")
    told = era_allowed(F.col("era_tag"), F.col("scenes_asked")) & ((F.col("lang") == "zh") | ((F.col("lang") == "ja") & F.col("kana")))
    script = F.when(F.col("lang") == "ja", 1).otherwise(0)
    items = part(official, 0).unionByName(part(fan, 1))
    if pool is not None:
        pool = part(pool, 2)
        items = items.unionByName(pool)
    none, share, curated = F.size("scenes_asked") == 0, F.arrays_overlap("scenes", "scenes_asked"), F.col("part") < 2
    kinds = asked.select("kind", "scenes_asked", "kana").distinct()
    met = items.join(small(kinds), readable & ((curated & (none | share)) | (~curated & ~none & share & told)))
    met = met.select("kind", "text", F.struct(F.when(curated, 0).otherwise(1 + script).alias("tier"), F.format_string("%d%012d", "part", "ordinal").alias("place")).alias("at"))
    near = written(top_per_key(met.groupBy("kind", "text").agg(F.min("at").alias("at")), ["kind"], most, F.asc("at"), F.asc("text")), "near")
    first = asked.select("query_id", "kind").join(small(near), "kind").groupBy("query_id", "text").agg(F.min("at").alias("at"))
    if pool is not None:
        sure = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("sure"))
        few = written(asked.join(sure, "query_id", "left").where(F.coalesce("sure", F.lit(0)) < LEAST_EXAMPLES).select("query_id", "scenes_asked", "kana"), "few")
        first = first.unionByName(_filled(few, pool.select("text", "lang", "era_tag", "in_kana").distinct(), first, readable & told, script, seed, most))
    return top_per_key(first, ["query_id"], most, F.asc("at"), F.asc("text"), name="rank").select("query_id", "text", "rank")


def _filled(few: DataFrame, pool: DataFrame, sure: DataFrame, fits: Column, script: Column, seed: int | str, most: int) -> DataFrame:
    """(query_id, text, at): for each query of ``few`` the first texts of the pool by script and digest, ``most`` of those that ``sure`` hasn't, or somewhat more."""
    place = seeded(seed, "query_id", "text")
    rank = F.conv(F.substring(place, 1, 15), 16, 10).cast("long") + F.shiftleft(script.cast("long"), 60)  # in the order of script and digest but for ties
    slot = F.pmod(F.xxhash64("text"), F.lit(max(SLOTS, 8 * most)))
    least = pool.join(small(few), fits).groupBy("query_id", slot.alias("slot")).agg(F.min(rank).alias("rank"))
    # a slot's smallest is a text of its own, and fewer than LEAST_EXAMPLES of them are among the sure ones
    bound = least.groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("rank")), F.lit(most + LEAST_EXAMPLES - 2)).alias("bound"))
    close = pool.join(small(few.join(bound, "query_id")), fits & (F.col("bound").isNull() | (rank <= F.col("bound"))))
    close = close.groupBy("query_id", "text").agg(F.min(F.struct((3 + script).alias("tier"), place.alias("place"))).alias("at"))
    return close.join(sure.select("query_id", "text"), ["query_id", "text"], "left_anti")


def reference_clip(styles: DataFrame, clips: DataFrame, default: str) -> DataFrame:
    """styles (style) with the clip of the style, else the default style's clip."""
    from winnowry.functions.speech import normalize_style

    own = clips.select(*[F.col(c).alias(f"own_{c}") for c in clips.columns])
    other = clips.where(F.col("style") == default).limit(1).select(*[F.col(c).alias(f"default_{c}") for c in clips.columns])
    rows = styles.withColumn("_k", normalize_style(F.col("style"))).join(own, F.col("_k") == F.col("own_style"), "left").join(F.broadcast(other), F.lit(True), "left")
    return rows.select("style", *[F.coalesce(f"own_{c}", f"default_{c}").alias(f"clip_{c}") for c in clips.columns if c != "style"])


def compose_context(queries: DataFrame, facts: DataFrame, examples: DataFrame, avoid_hint: str) -> DataFrame:
    """(query_id, messages): system messages of facts and examples; a sensitive hit leaves only the hint to avoid the topic."""
    told = facts.groupBy("query_id").agg(F.bool_or("sensitive").alias("sensitive"), F.sort_array(F.collect_list(F.struct((-F.col("hits")).alias("h"), "fact_id", "fact"))).alias("f"))
    shown = examples.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("e"))
    rows = queries.select("query_id").join(told, "query_id", "left").join(shown, "query_id", "left")
    message = lambda body: F.struct(F.lit("system").alias("role"), body.alias("content"))
    lines = lambda name, xs: F.concat(F.lit(f"<{name}>\n"), F.array_join(F.transform(xs, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit(f"\n</{name}>"))
    plain = F.array_compact(F.array(F.when(F.size("f") > 0, message(lines("facts", F.col("f.fact")))), F.when(F.size("e") > 0, message(lines("examples", F.col("e.text"))))))
    return rows.select("query_id", F.when(F.coalesce("sensitive", F.lit(False)), F.array(message(F.lit(avoid_hint)))).otherwise(plain).alias("messages"))
