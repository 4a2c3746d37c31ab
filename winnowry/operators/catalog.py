"""From a catalog of recordings to a collection plan: exclusion, tiers, risks, dates, dedupe, priority."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from winnowry.functions.dates import plan_date, record_date
from winnowry.operators.windows import best_stream_per_date, in_order, longest_per_id

# Ids and keywords that the plan's rules name.
EXCLUDED = ("BV1Hh9XBnEPF", "BV18ro9BVEQJ", "BV1ReodBdEM1", "BV1e6oZB8EeD", "BV1yGzyB8EVn")
UPLOADERS = {"xun隐者不遇": 5, "小电视录播姬": 5, "主播代录mklubo": 5, "HatsuneMiku9358": 4, "大前神": 3, "朝乃芳Channel": 3, "SilverCreeper": 3}
CHAT = ("学中文", "中文学习", "中文", "杂谈", "聊天", "白菜来啦", "白菜来了", "今天怎么样", "做饭", "料理", "菜鸟直播", "后日谈")
WATCH = ("一起看", "一起看看", "看看", "白菜看", "视频鉴赏", "看最美的夜")
HINTS = ("中文", "学中文", "杂谈", "白菜来啦", "今天怎么样")
CHAT_WANTED = ("白菜来啦", "白菜来了", "今天怎么样", "杂谈", "聊天", "谢谢", "粉丝", "做饭", "料理", "学中文", "中文学习", "中文", "回顾", "后日谈", "菜鸟直播")
CHAT_UNWANTED = (
    "歌回", "唱歌", "演唱会", "音乐会", "一起看", "一起看看", "看看", "白菜看", "视频鉴赏", "看最美的夜", "看三国", "看动画", "看jojo", "bml",
    "联动", "repo", "连麦", "玩破防", "只狼", "我的世界", "逃离鸭科夫", "盛世天下", "小游戏", "麻将", "pvz", "切片", "剪辑",
)
TIER_BASE = {"B": 300.0, "A": 200.0, "C": 100.0}
MIN_DURATION = {"B": 600, "A": 30, "C": 1800}


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a literal word stands in the text."""
    return text.rlike("|".join(r"\Q" + w + r"\E" for w in words))


def is_hard_excluded(source_id: Column, title: Column) -> Column:
    title = F.coalesce(title, F.lit(""))
    concert = title.contains("3D演唱会") | (title.contains("演唱会") & ~title.contains("看"))
    return source_id.isin(*EXCLUDED) | concert | (title.contains("歌回") & contains_any(title, ("全程", "整场", "全收录")))


def classify_tier(title: Column) -> Column:
    title = F.coalesce(title, F.lit(""))
    clip = contains_any(title, ("切片", "经典老番")) | (title.contains("剪辑") & ~title.contains("歌回"))
    chat = contains_any(title, CHAT) & ~contains_any(title, WATCH) & ~contains_any(title, ("歌回", "演唱会"))
    return F.when(clip, "A").when(chat, "B").otherwise("C")


def lang_hint(title: Column) -> Column:
    return F.when(contains_any(F.coalesce(title, F.lit("")), HINTS), "zh_bias").otherwise("mixed")


def risks(title: Column) -> Column:
    title = F.coalesce(title, F.lit(""))
    return F.array_compact(F.array(F.when(contains_any(title, WATCH), "watch"), F.when(contains_any(title, ("歌", "唱")) & ~title.contains("歌回"), "bgm")))


def is_chat_candidate(title: Column) -> Column:
    plain = F.replace(F.lower(title), F.lit(" "), F.lit(""))
    return ~contains_any(plain, CHAT_UNWANTED) & contains_any(plain, CHAT_WANTED)


def _by_tier(values: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for tier, value in values.items():
        out = F.when(F.col("tier") == tier, F.lit(value)).otherwise(out)
    return out


def uploader_priority() -> Column:
    out = F.lit(0)
    for name, value in UPLOADERS.items():
        out = F.when(F.col("author") == name, value).otherwise(out)
    return out


def priority_score() -> Column:
    part = lambda c, most: F.least(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(float(most))) / float(most)
    return _by_tier(TIER_BASE, 100.0) + F.when(F.col("lang_hint") == "zh_bias", 10.0).otherwise(0.0) - F.when(F.array_contains("risk", "watch"), 20.0).otherwise(0.0) + part("play", 1_000_000) + part("duration", 20_000)


def build_plan(catalog: DataFrame, min_duration: dict[str, int] | None = None) -> DataFrame:
    """Plan rows from catalog rows: the longest record of each clip, the best stream of each date, by priority."""
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    rows = catalog.where((F.coalesce("source_id", F.lit("")) != "") & ~is_hard_excluded(F.col("source_id"), F.col("title")))
    rows = rows.withColumns({
        "title": F.coalesce("title", F.lit("")), "author": F.coalesce("author", F.lit("")), "duration": zero("duration"), "pubdate": zero("pubdate"), "play": zero("play"),
        "tier": classify_tier(F.col("title")), "lang_hint": lang_hint(F.col("title")), "risk": risks(F.col("title")), "stream_date": plan_date(F.coalesce("title", F.lit(""))),
    })
    rows = rows.where(F.col("duration") >= _by_tier({k: float(v) for k, v in (MIN_DURATION if min_duration is None else min_duration).items()}, 0.0))
    clips = longest_per_id(rows.where("tier = 'A'"))
    streams = best_stream_per_date(rows.where("tier <> 'A'"), uploader_priority())
    planned = clips.unionByName(streams).withColumn("status", F.lit("planned"))
    return planned.withColumn("priority_score", priority_score()).select("source_id", "title", "author", "duration", "pubdate", "play", "tier", "lang_hint", "risk", "stream_date", "status", "priority_score")


def in_priority_order(plan: DataFrame) -> DataFrame:
    """The plan with ``place``: by priority, then id, date and tier. Places are given range by range."""
    placed = in_order(plan, F.desc("priority_score"), F.asc("source_id"), F.coalesce("stream_date", F.lit("")).asc(), F.asc("tier"))
    return placed.withColumnRenamed("_place", "place")


def to_download(plan: DataFrame, known: DataFrame, tiers: tuple[str, ...] = ("A", "B", "C"), max_hours: float | None = None) -> DataFrame:
    """Planned or failed rows of the tiers without known ids; with a budget the head by priority, whose first row always stays."""
    rows = plan.where(F.col("status").isin("planned", "failed") & F.col("tier").isin(*tiers)).join(known.select("source_id").distinct(), "source_id", "left_anti")
    if max_hours is None:
        return rows
    hours = F.col("duration") / 3600
    placed = in_order(rows, F.desc("priority_score"), F.asc("source_id"), amount=hours)
    return placed.where((F.col("_place") == 1) | (F.col("_before") + hours <= max_hours)).drop("_place", "_before")


def in_date_range(records: DataFrame, first: str, last: str) -> DataFrame:
    """Records whose title's date, else upload date, is in the range; those without a date go."""
    return records.withColumn("date", record_date(F.col("title"), F.col("pubdate"))).where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def one_per_date(records: DataFrame) -> DataFrame:
    """Of the records of a date the preferred uploader's, the longest, the first."""
    order = Window.partitionBy("date").orderBy(uploader_priority().desc(), F.desc("duration"), F.asc("ordinal"))
    return records.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
