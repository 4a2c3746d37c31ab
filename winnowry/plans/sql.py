"""Pieces of the oracles' SQL."""
from __future__ import annotations

from winnowry.functions.text import CJK, KANA

WS = r"[\s\x0b\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
PUNCT = r"""[\t\n\r\f\x0b \x{3000}-\x{303f}\x{ff00}-\x{ffef}\-_/\\|~～〜ー…·•.,!?;:"''“”‘’、。！？【】（）()\[\]{}<>《》「」『』]+"""


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{WS}+|{WS}+$', '', 'g')"


def count_of(x: str, pattern: str) -> str:
    return f"(length({x}) - length(regexp_replace({x}, '{pattern}', '', 'g')))"


def script_ratio(x: str, lang: str) -> str:
    """x without white space."""
    share = lambda p: f"{count_of(x, p)}::DOUBLE / length({x})"
    return f"""CASE WHEN length({x}) = 0 THEN 0 WHEN {lang} = 'ja' THEN {share(f"[{KANA}{CJK}ー～…、。！？]")} WHEN {lang} = 'zh' THEN {share(f"[{CJK}，。！？、…；：]")}
        WHEN {lang} = 'en' THEN {share("[A-Za-z0-9''-]")} ELSE 0 END"""


def nonlexical(x: str) -> str:
    return f"(length({x}) < 2 OR (length({x}) >= 3 AND {x} = repeat(left({x}, 1), length({x}))))"


def quality(rows: str, allow_en: bool = True) -> str:
    """CTEs ending in ``quality`` (k, reasons); rows: a query of (k, text, lang) with lang already normal."""
    sizes = " OR ".join(f"coalesce(max(r) FILTER (WHERE s = {s}), 0) >= {2 * s}" for s in range(2, 9))
    eq = " UNION ALL ".join(f"SELECT k, {s} AS s, i, lead(c, {s}) OVER (PARTITION BY k ORDER BY i) IS NOT DISTINCT FROM c AS e FROM chars" for s in range(2, 9))
    return rf"""q_in AS ({rows}),
q_raw AS (SELECT k, lang, {strip("replace(text, '|', '/')")} AS raw FROM q_in),
q_plain AS (SELECT k, lang, raw, regexp_replace(raw, '{WS}', '', 'g') AS ns, regexp_replace(raw, '{PUNCT}', '', 'g') AS p FROM q_raw),
chars AS (SELECT k, unnest(string_split(ns, '')) AS c, generate_subscripts(string_split(ns, ''), 1) AS i FROM q_plain WHERE ns <> ''),
eqs AS ({eq}),
islands AS (SELECT k, s, count(*) AS r FROM (SELECT k, s, e, i - row_number() OVER (PARTITION BY k, s, e ORDER BY i) AS g FROM eqs) WHERE e GROUP BY k, s, g),
loops AS (SELECT k, {sizes} AS loop FROM islands GROUP BY k),
raws AS (SELECT k, unnest(string_split(raw, '')) AS c, generate_subscripts(string_split(raw, ''), 1) AS i FROM q_raw WHERE raw <> ''),
runs AS (SELECT k, max(n) >= 5 AS run FROM (SELECT k, count(*) AS n FROM (SELECT k, c, i - row_number() OVER (PARTITION BY k, c ORDER BY i) AS g FROM raws WHERE c <> chr(10)) GROUP BY k, c, g) GROUP BY k),
tops AS (SELECT k, max(n)::DOUBLE / sum(n) > 0.5 AS top FROM (SELECT k, c, count(*) AS n FROM chars GROUP BY k, c) GROUP BY k),
q_num AS (SELECT q.*, coalesce(loop, false) AS loop, coalesce(run, false) AS run, coalesce(top, false) AS top, {script_ratio("ns", "lang")} AS sr,
    CASE WHEN length(ns) = 0 THEN 0 ELSE {count_of("ns", "[A-Za-z]")}::DOUBLE / length(ns) END AS lr, {count_of("raw", r"[\p{L}\p{N}]")} AS an, {count_of("raw", r"\p{Nd}")} AS dg
    FROM q_plain q LEFT JOIN loops USING (k) LEFT JOIN runs USING (k) LEFT JOIN tops USING (k)),
quality AS (SELECT k, list_filter([
    CASE WHEN length(raw) < 2 THEN 'short_text' END, CASE WHEN lang NOT IN ('ja', 'zh', 'en') THEN 'unsupported_lang' END, CASE WHEN lang = 'en' AND {str(not allow_en).lower()} THEN 'en_disabled' END,
    CASE WHEN regexp_matches(raw, '[\x{{AC00}}-\x{{D7AF}}]') THEN 'hangul' END, CASE WHEN top THEN 'repetitive_char' END, CASE WHEN loop THEN 'phrase_loop' END, CASE WHEN run THEN 'char_run' END,
    CASE WHEN {nonlexical("p")} THEN 'nonlexical' END, CASE WHEN lang IN ('ja', 'zh') AND sr < 0.5 THEN 'script_mismatch' END,
    CASE WHEN lang = 'ja' AND NOT regexp_matches(raw, '[{KANA}{CJK}]') THEN 'ja_without_jp_script' END, CASE WHEN lang = 'zh' AND NOT regexp_matches(raw, '[{CJK}]') THEN 'zh_without_cjk' END,
    CASE WHEN lang IN ('ja', 'zh') AND lr > 0.45 AND (sr < 0.70 OR lr > 0.60) THEN 'latin_heavy' END, CASE WHEN an > 0 AND dg::DOUBLE / an > 0.80 THEN 'digit_heavy' END,
    CASE WHEN regexp_matches(translate(raw, chr(10) || chr(9), ''), '\p{{C}}') THEN 'control_chars' END], lambda x: x IS NOT NULL) AS reasons FROM q_num)"""
