"""Script shares and transliteration."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Code point ranges of each script's letters.
RANGES = {
    "latin": r"[A-Za-z\x{00C0}-\x{024F}]",
    "greek": r"[\x{0370}-\x{03FF}]",
    "cyrillic": r"[\x{0400}-\x{04FF}]",
    "hebrew": r"[\x{0590}-\x{05FF}]",
    "arabic": r"[\x{0600}-\x{06FF}]",
    "devanagari": r"[\x{0900}-\x{097F}]",
    "hangul": r"[\x{AC00}-\x{D7AF}]",
    "kana": r"[\x{3040}-\x{30FF}]",
    "han": r"[\x{4E00}-\x{9FFF}]",
}
#: Greek letters in Latin ones; digraphs are read first.
GREEK_PAIRS = {"ου": "ou", "αυ": "av", "ευ": "ev", "μπ": "b", "ντ": "nt", "γγ": "ng", "γχ": "nch"}
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a v g d e z i th i k l m n x o p r s s t y f ch ps o".split()))
#: Cyrillic letters in Latin ones.
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e yo zh z i y k l m n o p r s t u f kh ts ch sh shch  y  e yu ya".split(" ")))


def count_of(c: Column, script: str) -> Column:
    return F.regexp_count(c, F.lit(RANGES[script]))


def shares(c: Column) -> Column:
    """Map of script to its letters, of scripts that occur."""
    pairs = F.array(*(F.struct(F.lit(s).alias("k"), count_of(c, s).alias("v")) for s in RANGES))
    return F.map_from_entries(F.filter(pairs, lambda x: x["v"] > 0))


def primary(c: Column) -> Column:
    """Script of the first letter that any range holds."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    at = F.regexp_substr(c, F.lit("|".join(RANGES.values())))
    for s, r in RANGES.items():
        out = out.when(at.rlike(r), s)
    return out


def _greek(x: str) -> str:
    x = "".join(c for c in unicodedata.normalize("NFD", x.lower()) if unicodedata.category(c) != "Mn")
    for k, v in GREEK_PAIRS.items():
        x = x.replace(k, v)
    return "".join(GREEK.get(c, c) for c in x)


@F.pandas_udf(StringType())
def latin_of_greek(s: pd.Series) -> pd.Series:
    return s.map(_greek, na_action="ignore")


@F.pandas_udf(StringType())
def latin_of_cyrillic(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "".join(CYRILLIC.get(c, c) for c in x.lower()), na_action="ignore")


@F.pandas_udf(StringType())
def latin_of_hangul(s: pd.Series) -> pd.Series:
    """Syllables by their parts, revised romanisation without sound changes."""
    lead = "g kk n d tt r m b pp s ss  j jj ch k t p h".split(" ")
    vowel = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
    tail = " g kk gs n nj nh d r lg lm lb ls lt lp lh m b bs s ss ng j ch k t p h".split(" ")

    def one(c: str) -> str:
        n = ord(c) - 0xAC00
        return lead[n // 588] + vowel[n % 588 // 28] + tail[n % 28] if 0 <= n < 11172 else c

    return s.map(lambda x: "".join(map(one, x)), na_action="ignore")


#: Letters of the Ethiopic syllabary in the order of its block, eight syllables each; empty where
#: the block has other signs.
ETHIOPIC = "h l h m s r s sh q q q  b v t ch h n ny ' k k kh  w ' z zh y d d j g gg  t ch p ts ts f p".split(" ")
ETHIOPIC_VOWELS = ["e", "u", "i", "a", "ie", "", "o", "wa"]


def latin_of_ethiopic(c: Column) -> Column:
    """Syllables by their place in the block: the letter by eights, the vowel within; other
    characters stay."""
    letters = F.array(*map(F.lit, ETHIOPIC))
    vowels = F.array(*map(F.lit, ETHIOPIC_VOWELS))

    def one(ch: Column) -> Column:
        at = F.ascii(ch) - 0x1200
        inside = (at >= 0) & (at < 8 * len(ETHIOPIC))
        return F.when(inside, F.concat(F.get(letters, F.floor(at / 8).cast("int")), F.get(vowels, (at % 8).cast("int")))).otherwise(ch)

    return F.array_join(F.transform(F.split(c, ""), one), "")


#: Common characters of names and how they are read, from general knowledge.
HAN = {
    "zh": dict(zip("王李张刘陈杨黄赵吴周徐孙马朱胡林郭何高罗明华伟强文武", "Wang Li Zhang Liu Chen Yang Huang Zhao Wu Zhou Xu Sun Ma Zhu Hu Lin Guo He Gao Luo Ming Hua Wei Qiang Wen Wu".split())),
    "ja": dict(zip("佐鈴高田中渡伊山本村木小藤井", "Sa Suzu Taka Ta Naka Wata I Yama Moto Mura Ki Ko Fuji I".split())),
    "ko": dict(zip("김이박최정강조윤장임민준서연", "Kim Lee Park Choi Jung Kang Cho Yoon Jang Lim Min Jun Seo Yeon".split())),
}


def romanised(c: Column, script: str) -> Column:
    """Known characters read one by one, joined by spaces; others stay."""
    m = F.create_map(*(F.lit(x) for kv in HAN[script].items() for x in kv))
    return F.trim(F.array_join(F.transform(F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(m, ch), ch)), " "))


def back_converted(c: Column, script: str) -> Column:
    """The first character that is read so, for each word; others stay."""
    back: dict[str, str] = {}
    for ch, x in HAN[script].items():
        back.setdefault(x, ch)
    m = F.create_map(*(F.lit(x) for kv in back.items() for x in kv))
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.coalesce(F.try_element_at(m, w), w)), "")


def second_share(c: Column) -> Column:
    """Share of the second most frequent script among the letters; a name is mixed from a tenth
    on."""
    counts = F.array_sort(F.map_values(shares(c)))
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    return F.round(F.coalesce(F.try_element_at(counts, F.lit(-2)), F.lit(0)) / F.greatest(total, F.lit(1)), 6)
