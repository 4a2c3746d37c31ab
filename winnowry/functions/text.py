"""Text-quality functions: Column in, Column out, all built-in expressions.

Patterns begin with (?s) where a dot must take line ends. White space is Unicode's, as (?U)\\s.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnowry.config import TextLimits
from winnowry.functions import codepoints

# Character classes that results depend on.
SPACE = r"(?U)\s"
PUNCTUATION = "[\t\n\r\f\x0b 　-〿＀-￯\\-_/\\\\|~～〜ー…·•.,!?;:\"'“”‘’、。！？【】（）()\\[\\]{}<>《》「」『』]+"
KANA = "぀-ヿ"
CJK = "一-鿿"
SCRIPT = {"ja": f"[{KANA}{CJK}ー～…、。！？]", "zh": f"[{CJK}，。！？、…；：]", "en": "[A-Za-z0-9'\\-]"}
LANGUAGES = {"ja": ("jp", "jpn", "japanese"), "zh": ("cn", "zho", "chinese", "zh-cn", "zh-tw"), "en": ("eng", "english")}


#: What is counted in one pass over a text, each a class of one character.
KINDS = {
    "space": "[" + codepoints.WHITE + "]", "punctuation": PUNCTUATION[:-1], "hangul": r"[\uac00-\ud7af]", "kana": f"[{KANA}]", "cjk": f"[{CJK}]", "latin": "[A-Za-z]",
    "alnum": r"[\p{L}\p{N}]", "digits": r"\p{Nd}", "control": r"(?![\n\t])\p{C}", "script_ja": SCRIPT["ja"], "script_zh": SCRIPT["zh"], "script_en": SCRIPT["en"],
}


def measures(text: Column) -> Column:
    """Counts of characters by kind and repetitions of the stripped text, as a struct (see ``codepoints.MEASURES``)."""
    return codepoints.measures(text, KINDS)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def no_space(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))


def normalize_lang(lang: Column) -> Column:
    """Codes and names of a language to its two letters; others in lower case."""
    value = F.lower(strip(F.coalesce(lang, F.lit(""))))
    out = value
    for code, names in LANGUAGES.items():
        out = F.when(value.isin(*names), code).otherwise(out)
    return out


def content_chars(text: Column) -> Column:
    """Without punctuation and white space; runs of 3 or more equal characters become one."""
    return codepoints.without(text, PUNCTUATION[:-1])


def text_key(text: Column) -> Column:
    return F.lower(content_chars(text))


def _share(text: Column, pattern: str) -> Column:
    n = F.length(no_space(text))
    return F.when(n == 0, F.lit(0.0)).otherwise(count_of(text, pattern) / n)


def script_ratio(text: Column, lang: Column) -> Column:
    """Share of the non-space characters that belong to the language's script; 0 for other languages."""
    code = normalize_lang(lang)
    out = F.lit(0.0)
    for name, pattern in SCRIPT.items():
        out = F.when(code == name, _share(text, pattern)).otherwise(out)
    return out


def is_char_repetitive(text: Column, threshold: float = 0.5) -> Column:
    """Whether one character makes up more than ``threshold`` of the non-space characters.
    From one half up only one character can: sorted, it's the one in the middle, so one count decides."""
    if threshold < 0.5:
        raise ValueError("threshold must be at least 0.5")
    plain = no_space(text)
    n = F.length(plain)
    chars = F.sort_array(F.split(plain, ""))
    middle = F.get(chars, F.floor(F.size(chars) / 2).cast("int"))
    same = n - F.length(F.replace(plain, middle, F.lit("")))
    return F.when(n == 0, F.lit(False)).otherwise(same / n > threshold)


def has_kana(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"[{KANA}]")


def reasons(*gates: tuple[Column, str | Column]) -> Column:
    """Names of all gates whose condition holds, in order; a null condition doesn't hold."""
    return F.filter(F.array(*[F.when(condition, name if isinstance(name, Column) else F.lit(name)) for condition, name in gates]), lambda x: x.isNotNull())


def first_reason(*gates: tuple[Column, str | Column]) -> Column:
    """Name of the first gate whose condition holds; null if none does."""
    return F.coalesce(*[F.when(condition, name if isinstance(name, Column) else F.lit(name)) for condition, name in gates])


def quality_reasons(text: Column, lang: Column, limits: TextLimits | None = None) -> Column:
    """All reasons against a transcript, in fixed order; empty means keep."""
    return measured_reasons(measures(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("/"))), lang, limits)


def measured_share(m: Column, name: str) -> Column:
    """A kind's share of the characters that aren't white space."""
    return F.when(m["plain"] > 0, m[name] / m["plain"]).otherwise(0.0)


def measured_script_ratio(m: Column, lang: Column) -> Column:
    """As ``script_ratio``, from measures; lang is a two-letter code."""
    out = F.lit(0.0)
    for name in SCRIPT:
        out = F.when(lang == name, measured_share(m, f"script_{name}")).otherwise(out)
    return out


def measured_reasons(m: Column, lang: Column, limits: TextLimits | None = None) -> Column:
    """``quality_reasons`` from the text's measures ("|" read as "/")."""
    limits = limits or TextLimits()
    code = normalize_lang(lang)
    native, latin = measured_script_ratio(m, code), measured_share(m, "latin")
    chinese_or_japanese = code.isin("ja", "zh")
    return reasons(
        (m["length"] < 2, "short_text"),
        (~code.isin("ja", "zh", "en"), "unsupported_lang"),
        ((code == "en") & F.lit(not limits.allow_en), "en_disabled"),
        (m["hangul"] > 0, "hangul"),
        (m["top"], "repetitive_char"),
        (m["loop"], "phrase_loop"),
        (m["run"], "char_run"),
        (m["content"] < max(2, limits.min_content_chars), "nonlexical"),
        (chinese_or_japanese & (native < limits.min_script_ratio), "script_mismatch"),
        ((code == "ja") & (m["kana"] + m["cjk"] == 0), "ja_without_jp_script"),
        ((code == "zh") & (m["cjk"] == 0), "zh_without_cjk"),
        (chinese_or_japanese & (latin > limits.max_latin_ratio) & ((native < 0.70) | (latin > 0.60)), "latin_heavy"),
        ((m["alnum"] > 0) & (m["digits"] / F.greatest(m["alnum"], F.lit(1)) > 0.80), "digit_heavy"),
        (m["control"] > 0, "control_chars"),
    )


def compact_text(text: Column, punctuation: str = r"(?U)[\s，。！？、；：…,.!?;:·~～\-_/\\|@#$%^&*+=<>()（）「」『』【】\[\]{}\"'“”‘’]+") -> Column:
    """Without white space and the punctuation set that agreement is measured without (other sets by parameter)."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), punctuation, "")


#: Punctuation sets of the cross-check and of the third-pass adjudication (fixed values).
CROSSCHECK_PUNCTUATION = r"(?U)[\s，。！？、；：…,.!?;:·~～\-]+"
ADJUDICATION_PUNCTUATION = r"(?U)[\s，。！？、；：…,.!?;:·~～\-_/\\|\"'“”‘’()（）]+"

#: Traditional characters and their simplified forms; a table may be passed instead (fixed values).
TRADITIONAL = "們個這來說時會對學國過還後裡麼樣點開關問間聽見現實"
SIMPLIFIED = "们个这来说时会对学国过还后里么样点开关问间听见现实"


def to_simplified(text: Column, traditional: str = TRADITIONAL, simplified: str = SIMPLIFIED) -> Column:
    """Character by character. The fixed table holds the commonest characters only; pass the strings of a whole one (see ``character_map``)."""
    return F.translate(text, traditional, simplified)


def character_map(table: DataFrame, most: int = 65_536) -> tuple[str, str]:
    """The two strings of a conversion table (traditional, simplified), single characters each, for ``to_simplified``."""
    rows = table.select("traditional", "simplified").distinct().orderBy("traditional").limit(most + 1).collect()
    if len(rows) > most or any(len(x) != 1 for r in rows for x in r) or len({r[0] for r in rows}) < len(rows):
        raise ValueError("a conversion table has one character for each of its characters")
    return "".join(r[0] for r in rows), "".join(r[1] for r in rows)


def joined_parts(parts: Column, lang: Column) -> Column:
    """A transcript of its segments' texts: stripped, blank ones left out, joined without a space in Chinese and Japanese."""
    said = F.filter(F.transform(parts, lambda p: strip(F.coalesce(p, F.lit("")))), lambda p: p != "")
    return F.when(lang.isin("zh", "ja"), F.array_join(said, "")).otherwise(F.array_join(said, " "))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def strip_engine_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|[^|]*\|>", "")


def safe_title(text: Column) -> Column:
    return F.regexp_replace(text, r'[\\/:*?"<>|]', "_")


def era_tag(name: Column) -> Column:
    """peak for 2020-2023, late from 2024, by the first year from 2019 to 2026 in a name."""
    years = F.transform(F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"(20[0-2][0-9])"), 1), lambda y: y.cast("int"))
    year = F.get(F.filter(years, lambda y: y.between(2019, 2026)), F.lit(0))
    return F.when(year.between(2020, 2023), "peak").when(year >= 2024, "late").otherwise("unknown")


def in_length_range(text: Column, low: int = 4, high: int = 40) -> Column:
    return F.length(content_chars(text)).between(low, high)


def has_end_punctuation(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))).rlike(r"[。！？…!?.;；]$")


def is_truncated(text: Column, min_chars: Column | int) -> Column:
    return (F.length(strip(F.coalesce(text, F.lit("")))) < min_chars) & ~has_end_punctuation(text)


def language_tag(lang: Column) -> Column:
    return F.when(lang == "ja", "JP").when(lang == "zh", "ZH").when(lang == "en", "EN")


def resolve_text_language(text: Column, configured: str = "auto") -> Column:
    """ja, zh or en where only that script occurs, else auto."""
    if configured != "auto":
        return F.lit(configured)
    kana, cjk, latin = has_kana(text), F.coalesce(text, F.lit("")).rlike("[㐀-䶿一-鿿]"), F.coalesce(text, F.lit("")).rlike("[A-Za-z]")
    return F.when(kana & ~latin, "ja").when(cjk & ~kana & ~latin, "zh").when(latin & ~kana & ~cjk, "en").otherwise("auto")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def source_id(path: Column) -> Column:
    """The video id at the head of a file name; '' if there is none."""
    return F.regexp_extract(basename(path), r"^(BV[0-9A-Za-z]+)", 1)


def normalize_source_id(value: Column) -> Column:
    """An id with its prefix in the usual case; raises an error for anything else."""
    trimmed = strip(value)
    fixed = F.when(F.upper(F.substring(trimmed, 1, 2)) == "BV", F.concat(F.lit("BV"), F.substring(trimmed, 3, 1000))).otherwise(F.concat(F.lit("BV"), trimmed))
    return F.when(fixed.rlike("^BV[0-9A-Za-z]{10}$"), fixed).otherwise(F.raise_error(F.concat(F.lit("not a video id: "), value)).cast("string"))


def source_stem(path: Column) -> Column:
    """What stands before the vocals marker of a file name; null if the marker is missing."""
    name = basename(path)
    return F.when(name.contains("_(Vocals)"), F.substring_index(name, "_(Vocals)", 1))


def slice_offsets(path: Column, rate: int = 32000) -> Column:
    """struct(start, end) in seconds from a name that ends in __{start}_{end}.wav, in samples."""
    at = lambda k: F.expr("null") if k is None else F.regexp_extract(basename(path), r"__(\d{10})_(\d{10})\.wav$", k)
    return F.struct((F.try_to_number(F.nullif(at(1), F.lit("")), F.lit("9999999999")).cast("double") / rate).alias("start"), (F.try_to_number(F.nullif(at(2), F.lit("")), F.lit("9999999999")).cast("double") / rate).alias("end"))


def resolved_text(final_text: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(strip(final_text), F.lit("")), text)
