"""Scalar functions over personal names, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Surname particles moved behind the given name in look-up keys.
PARTICLES = ("von", "van", "de", "der", "den", "di", "da", "del", "della", "la", "le", "du", "dos", "das", "el", "al", "bin", "ibn", "zu")
#: Ligatures and letters folded to plain ones.
FOLDS = {"æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "Oe", "ß": "ss", "ẞ": "SS", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ"}
#: The folds of a region's own cleaning, which write one in capitals and know one more.
REGIONAL_FOLDS = {**FOLDS, "Œ": "OE", "ﬅ": "st"}
#: Quotes, dashes and spaces that are written plainly.
PLAIN = {"'": "‘’‚", '"': "“”„", "-": "–—‐‑", " ": "\u00a0\u2002\u2003\u2009\u202f\u3000"}
#: Control, zero-width and direction characters that names must not hold.
INVISIBLE = "".join(map(chr, [*range(0x00, 0x10), 0x1F, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2066, 0x206A), 0xFEFF]))
#: Title suffixes of a generation.
GENERATIONS = r"(?i)(^|[\s,])(jr|sr|ii|iii|iv|v)\.?$"


def normalized(form: str):
    """Arrow function for a Unicode normal form; Spark has none built in."""

    @F.pandas_udf(StringType())
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")

    return apply


@F.pandas_udf(StringType())
def strip_marks(s: pd.Series) -> pd.Series:
    """NFD without combining marks (category Mn), recomposed; letters like ł and ø stay."""
    return s.map(lambda x: unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn")), na_action="ignore")


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(str.casefold, na_action="ignore")


def strip_invisible(c: Column) -> Column:
    return F.translate(c, INVISIBLE, "")


def fold_letters(c: Column) -> Column:
    for k, v in FOLDS.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def clean(c: Column) -> Column:
    """Invisible characters out, then NFC, NFKD, folds, NFC."""
    return normalized("NFC")(fold_letters(normalized("NFKD")(normalized("NFC")(strip_invisible(c)))))


def fold_exceptions(c: Column) -> Column:
    """Ligatures spelled out; quotes, dashes and spaces in their plain forms."""
    out = F.translate(c, "".join(PLAIN.values()), "".join(k * len(v) for k, v in PLAIN.items()))
    for k, v in REGIONAL_FOLDS.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


@F.pandas_udf(StringType())
def latinise(s: pd.Series) -> pd.Series:
    """NFKD without combining characters."""
    return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)), na_action="ignore")


def variants(c: Column) -> Column:
    """The text and one variant for each ligature it holds, distinct, in order."""
    each = [F.when(F.contains(c, F.lit(k)), F.replace(c, F.lit(k), F.lit(v))) for k, v in FOLDS.items()]
    return F.array_distinct(F.array_compact(F.array(c, *each)))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\n\x0B\f\r]+", " "))


def family(latin: Column) -> Column:
    return F.split_part(latin, F.lit(", "), F.lit(1))


def given(latin: Column) -> Column:
    """What follows the first comma and space; empty without them."""
    at = F.instr(latin, ", ")
    return F.when(at > 0, latin.substr(at + 2, F.length(latin))).otherwise("")


def canonical_person(c: Column) -> Column:
    """"First Last" to "Last, First"; names with a comma or one word stay."""
    parts = F.split(F.trim(c), " ")
    turned = F.concat(F.element_at(parts, -1), F.lit(", "), F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " "))
    return F.when(F.contains(c, F.lit(",")) | (F.size(parts) < 2), F.trim(c)).otherwise(turned)


def name_key(c: Column) -> Column:
    """Bracketed parts out, marks stripped, lower case, single spaces, "last, first"."""
    plain = F.lower(strip_marks(F.regexp_replace(c, r"\([^)]*\)", "")))
    return canonical_person(squeeze(plain))


def fold_particles(key: Column) -> Column:
    """Leading particles of the surname move behind the given name; applying it twice changes
    nothing."""
    lead = F.regexp_extract(family(key), "^((?:(?:" + "|".join(PARTICLES) + ") )+)", 1)
    rest = F.substr(family(key), F.length(lead) + 1)
    return F.when((F.length(lead) > 0) & (F.length(rest) > 0), F.trim(F.concat(rest, F.lit(", "), F.trim(F.concat(given(key), F.lit(" "), F.trim(lead)))))).otherwise(key)


def short_key(key: Column) -> Column:
    first = F.split_part(given(key), F.lit(" "), F.lit(1))
    return F.when(F.length(first) > 0, F.concat(family(key), F.lit(", "), first)).otherwise(family(key))


def given_tokens(c: Column) -> Column:
    """Distinct words of more than one character of a given name."""
    return F.array_distinct(F.filter(F.split(c, r"[ \-]+"), lambda x: F.length(x) > 1))


def short_form_tags(latin: Column) -> Column:
    initials = latin.rlike(r"^([A-Z]\.[ ]?)+([A-Z]\.?)?$") | given(latin).rlike(r"^([A-Z]\.[ \-]?)+$")
    return F.array_compact(
        F.array(
            F.when(initials, F.lit("initials_only")),
            F.when(latin.rlike(GENERATIONS), F.lit("generational_suffix")),
            F.when(latin.rlike(r"(^|[ ,])[A-Z]\."), F.lit("has_abbreviations")),
        )
    )


def shape(c: Column) -> Column:
    """Length, words, special characters, digits and capitals of a name."""
    return F.struct(
        F.length(c).alias("length"),
        F.size(F.filter(F.split(c, r"[ ]+"), lambda x: F.length(x) > 0)).alias("words"),
        F.regexp_count(c, F.lit(r"[^A-Za-z0-9 ]")).alias("specials"),
        F.regexp_count(c, F.lit("[0-9]")).alias("digits"),
        F.regexp_count(c, F.lit("[A-Z]")).alias("capitals"),
    )
