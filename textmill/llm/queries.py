"""Queries pN_... of the training-data problems and their DuckDB statements."""

from __future__ import annotations

import importlib
import unicodedata

#: module -> names of its queries
_MODULES = {
    "truncation": ("p1_found", "p1_source_report"),
    "group_split": ("p2_found", "p2_splits", "p2_shares", "p2_classes"),
    "pair_defects": ("p3_found", "p3_pair_coverage"),
    "pii": ("p4_found", "p4_redacted"),
    "language": ("p5_found", "p5_segments"),
    "format_dedup": ("p6_found", "p6_collapsed"),
    "overlap": ("p7_found", "p7_report", "p7_record_overlap", "p7_classes"),
    "packing": ("p8_packed", "p8_fill"),
    "mixing": ("p9_drawn", "p9_shares"),
    "lookalikes": ("p10_found", "p10_normalized", "p10_classes"),
}


def _lazy(module: str, name: str):
    def run(spark, sf_dir):
        return getattr(importlib.import_module(f"{__package__}.{module}"), name)(spark, sf_dir)

    run.__name__ = name
    return run


def queries() -> dict:
    return {name: _lazy(module, name) for module, names in _MODULES.items() for name in names}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _narrow(value: str) -> str:
    """Full-width signs as ASCII, by code points made in SQL."""
    signs = lambda shift: f"(SELECT string_agg(chr((i + {shift})::INT), '' ORDER BY i) FROM range(33, 127) t(i))"
    return f"translate({value}, {signs(65248)}, {signs(0)})"


#: The statement of p2 is written apart from the operator: of what stands behind the last slash the
#: letters and digits are kept, and of these the last ten.
_SPELLINGS = rf"""
WITH v AS (SELECT DISTINCT product_id AS value FROM raw_records WHERE product_id IS NOT NULL),
     w AS (SELECT value, list_last(string_split(regexp_replace(upper(trim({_narrow("value")}, E' \t\n\r' || chr(160) || chr(12288))), '[.]0+$', ''), '/')) AS tail FROM v),
     x AS (SELECT value, regexp_replace(tail, '[^0-9A-Z]', '', 'g') AS bare, tail FROM w),
     k AS (SELECT value, CASE WHEN length(bare) > 10 THEN right(bare, 10) WHEN regexp_full_match(bare, '[0-9]{{4,9}}') THEN right('000000' || bare, 10) ELSE bare END AS code FROM x
           WHERE NOT regexp_matches(tail, '[\p{{Cyrillic}}\p{{Greek}}\p{{Han}}]'))
SELECT a.value AS product_id_a, b.value AS product_id_b FROM k a JOIN k b ON a.code = b.code AND a.value < b.value WHERE length(a.code) = 10
"""

#: Names of labelled fields, as the statement of p6 looks for them.
_LABELS = "pros cons comment liked disliked verdict плюсы минусы итог достоинства недостатки комментарий".split()
_HAN_LABELS = ("优点", "缺点", "总结", "不满意", "满意", "备注")


def _groups() -> str:
    """``id, k``: the text without what p6 ignores; labelled fields are cut out one by one and put in order, which the operator does without."""
    words, han = "|".join(_LABELS), "|".join(_HAN_LABELS)
    flat = f"lower(upper({_narrow("replace(replace(replace(original_text, chr(92) || 'n', ' '), chr(92) || 'r', ' '), chr(92) || 't', ' ')")}))"
    return rf"""
WITH r AS (SELECT DISTINCT id, original_text FROM raw_records WHERE id IS NOT NULL),
     f AS (SELECT id, ' ' || regexp_replace({flat}, '[^\p{{L}}\p{{N}}\p{{M}}]+', '  ', 'g') || ' ' AS t FROM r),
     m AS (SELECT id, regexp_replace(t, ' ({words}) ', chr(1) || '\1' || chr(2), 'g') AS t FROM f),
     p AS (SELECT id, regexp_replace(replace(t, ' ', ''), '({han})', chr(1) || '\1' || chr(2), 'g') AS t FROM m),
     g AS (SELECT id, CASE WHEN starts_with(t, chr(1)) THEN array_to_string(list_sort(list_filter(string_split(t, chr(1)), lambda x: x <> '')), chr(1))
                           ELSE nullif(replace(replace(t, chr(1), ''), chr(2), ''), '') END AS k FROM p)
"""


#: Letters of other alphabets and the Latin letter each looks like.
_LOOKS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y",
    "ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï", "ɑ": "a", "ɡ": "g",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c",
    "⺁": "厂", "⺄": "乙", "⺈": "刀", "⺌": "小", "⺍": "小", "⺮": "竹", "⺼": "肉", "⻁": "虎", "⻄": "西", "⻅": "见", "⻆": "角", "⻉": "贝", "⻋": "车", "⻌": "辶", "⻓": "长", "⻔": "门", "⻘": "青", "⻙": "韦",
    "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻩": "黄", "⻬": "齐", "⻮": "齿", "⻰": "龙", "⻳": "龟",
    "‐": "-", "‑": "-", "⁃": "-", "﹣": "-", "−": "-", "ʼ": "’", "‚": ",", "․": ".", "∶": ":", "…": "...",
}


def _looks() -> str:
    """Pairs of documents that look alike, sign by sign: each sign of the composed text is looked up in a table and the text is put together again."""
    table = dict(_LOOKS)
    for code in [*range(0x2E80, 0x2FE0), *range(0xF900, 0xFB07), *range(0xFF01, 0xFFEF)]:
        flat = unicodedata.normalize("NFKC", chr(code))
        if flat != chr(code):
            table.setdefault(chr(code), "".join(_LOOKS.get(c, c) for c in flat))
    for code in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 9):
        table[chr(code)] = " "
    gone = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF, *range(1, 9), *range(0x0E, 0x20), 0x7F]
    values = ", ".join(f"({ord(c)}, {_quote(x)})" for c, x in table.items()) + ", " + ", ".join(f"({c}, '')" for c in gone)
    return rf"""
WITH looks(code, seen) AS (VALUES {values}),
     d AS (SELECT DISTINCT doc_id AS id, text AS raw FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
     c AS (SELECT id, raw, unnest(regexp_extract_all(t, '(?s).')) AS sign, unnest(range(length(t))) AS place FROM (SELECT id, raw, nfc_normalize(replace(replace(raw, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS t FROM d)),
     s AS (SELECT id, raw, nfc_normalize(string_agg(coalesce(seen, sign), '' ORDER BY place)) AS look FROM c LEFT JOIN looks ON code = unicode(sign) GROUP BY id, raw),
     l AS (SELECT id, raw, coalesce(look, '') AS look FROM d LEFT JOIN s USING (id, raw))
SELECT a.id AS doc_id_a, b.id AS doc_id_b FROM l a JOIN l b ON a.look = b.look AND a.id < b.id AND a.raw <> b.raw
"""


def _forms() -> str:
    """The consistent form of each document: words of the look that hold a Cyrillic letter are spelt in Cyrillic, and so are words of shared letters only in texts that are mostly Cyrillic."""
    latin: dict[str, str] = {}
    for sign, seen in _LOOKS.items():
        if "Ѐ" <= sign <= "ԯ":
            latin.setdefault(seen, sign)
    shared, own = "".join(latin), "".join(latin.values())
    word = r"'[\p{L}\p{M}]+|[^\p{L}\p{M}]+'"
    return (
        _looks()[: _looks().rindex("SELECT a.id")].rstrip()
        + rf""",
     w AS (SELECT id, look, raw, unnest(regexp_extract_all(look, {word})) AS word, unnest(range(len(regexp_extract_all(look, {word})))) AS place FROM l),
     k AS (SELECT *, regexp_matches(word, '\p{{Cyrillic}}') AS cyrillic, regexp_full_match(word, '[{shared}]+') AS both_ways FROM w),
     t AS (SELECT id, raw, count(*) FILTER (cyrillic) > count(*) FILTER (regexp_matches(word, '\p{{Latin}}') AND NOT cyrillic AND NOT both_ways) AS mostly FROM k GROUP BY id, raw),
     f AS (SELECT id, raw, string_agg(CASE WHEN cyrillic OR (mostly AND both_ways) THEN translate(word, '{shared}', '{own}') ELSE word END, '' ORDER BY place) AS form FROM k JOIN t USING (id, raw) GROUP BY id, raw)
SELECT DISTINCT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(form, '') END AS text, text IS DISTINCT FROM CASE WHEN text IS NOT NULL THEN coalesce(form, '') END AS changed
FROM documents LEFT JOIN f ON f.id = doc_id AND f.raw = text"""
    )


def oracle_sql() -> dict[str, str]:
    return {
        "p10_normalized": _forms(),
        "p2_found": _SPELLINGS,
        "p2_classes": _SPELLINGS[: _SPELLINGS.rindex("SELECT a.value")] + "SELECT value AS product_id, min(value) OVER (PARTITION BY code) AS class_id, count(*) OVER (PARTITION BY code) AS spellings FROM k WHERE length(code) = 10",
        "p6_found": _groups() + "SELECT first_id, id FROM (SELECT id, min(id) OVER (PARTITION BY k) AS first_id FROM g WHERE k IS NOT NULL) WHERE id <> first_id",
        "p6_collapsed": _groups() + "SELECT min(id) AS id, count(*) AS copies FROM g GROUP BY CASE WHEN k IS NULL THEN id END, k",
        "p10_found": _looks(),
        "p10_classes": _looks()[: _looks().rindex("SELECT a.id")] + "SELECT DISTINCT id AS doc_id, class_id, spellings, documents FROM l JOIN (SELECT look, min(id) AS class_id, count(DISTINCT raw) AS spellings, count(DISTINCT id) AS documents FROM l GROUP BY look) USING (look)",
    }
