"""Cleaning, variants, checks and order keys by region. A region is a row of REGIONS: its script,
its cleaning rules, its variant rules and how its order key reads a name. Rules are column
expressions, so a batch of any mix of regions is one projection."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import family, given, squeeze

Rule = Callable[[Column], Column]


def _sub(pattern: str, to: str) -> Rule:
    return lambda c: F.regexp_replace(c, pattern, to)


#: Rules that clean a name.
CLEAN: dict[str, Rule] = {
    "middle_initial": _sub(r"^([^,]+, [^ ]+) [A-Z]\.$", "$1"),
    "iberian_honorific": _sub(r"^(Don|Doña|Dr\.|Prof\.|D\.) ", ""),
    "german_particle": _sub(r"^(von der|von dem|von|zu|vom|zum) ", ""),
    "slavic_patronymic": _sub(r" [^ ,]+(ovich|evich|ovna|evna|ich)$", ""),
    "arabic_prefix": _sub(r"^(Ibn|Abu|Um|Umm) ", ""),
    "sharp_s": _sub("ẞ", "SS"),
    "azerbaijani_schwa": _sub("[əƏ]", "a"),
    "baltic_titles": _sub(r"(?i)(^|[ ,]+)(prof|dr|habil|doc|mgr|ing)\.(?=[ ,]|$)", ""),
    "tight_marks": lambda c: squeeze(F.regexp_replace(F.regexp_replace(c, r"\s*,\s*", ", "), r"\s*-\s*", "-")),
    "devanagari_dot": _sub("[.]$", ""),
}
#: Rules that give a variant of a name; null where they do not apply.
VARIANT: dict[str, Rule] = {
    "iberian_first_surname": lambda c: F.when(family(c).rlike(r"^[^ ]+ [^ ]+$"), F.concat(F.split_part(family(c), F.lit(" "), F.lit(1)), F.lit(", "), given(c))),
    "arabic_article": lambda c: F.when(c.rlike("^[Aa]l-"), F.regexp_replace(c, "^[Aa]l-", "")),
    "sun_letter": lambda c: F.when(c.rlike("^Al-([TDRSZLN])"), F.regexp_replace(F.regexp_replace(c, "^Al-([TDRSZLN])", "A$1-$1"), "^A([TDRSZLN])", "A$1")),
    "ibn_patronymic": lambda c: F.when(c.rlike(r" (bin|ibn|bint|binti|binte) "), F.regexp_replace(c, r" (bin|ibn|bint|binti|binte) .*$", "")),
    "turkish_plain_i": lambda c: F.when(c.rlike("[ıİ]"), F.translate(c, "ıİ", "iI")),
    "ezafe": lambda c: F.when(c.rlike("-[ei] "), F.regexp_replace(c, "-[ei] ", " ")),
    "hungarian_order": lambda c: F.when(F.contains(c, F.lit(", ")), F.concat(family(c), F.lit(" "), given(c))),
    "japanese_order": lambda c: F.when(F.contains(c, F.lit(", ")), F.concat(F.upper(family(c)), F.lit(" "), given(c))),
    "korean_hyphen": lambda c: F.when(given(c).rlike("^[A-Z][a-z]+-[a-z]+$"), F.regexp_replace(c, "-", " ")),
    "greek_hatzi": lambda c: F.when(c.rlike("^(Chatzi|Hatzi)"), F.when(c.startswith("Chatzi"), F.regexp_replace(c, "^Chatzi", "Hatzi")).otherwise(F.regexp_replace(c, "^Hatzi", "Chatzi"))),
    "turkic_oglu": lambda c: F.when(c.rlike("(oğlu|oglu)"), F.regexp_replace(c, "oğlu", "oglu")),
    "zadeh": lambda c: F.when(c.rlike("[ -]?zadeh"), F.regexp_replace(c, "[ -]?zadeh", "zade")),
    "macron": lambda c: F.when(c.rlike("[āēīōūĀĒĪŌŪ]"), F.translate(c, "āēīōūĀĒĪŌŪ", "aeiouAEIOU")),
    "vietnamese_plain": lambda c: F.when(c.rlike("[đĐ]"), F.translate(c, "đĐ", "dD")),
    "maternal_middle": lambda c: F.when(given(c).rlike(r"^[^ ]+ [A-Z]\.$"), F.regexp_replace(c, r" [A-Z]\.$", "")),
    "ascii": lambda c: F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, MARKED, BARE)),
    "armenian_ending": lambda c: F.when(family(c).rlike("[yi]an$"), F.concat(F.regexp_replace(family(c), "[yi]an$", ""), F.when(family(c).endswith("yan"), "ian").otherwise("yan"), F.substr(c, F.length(family(c)) + 1))),
    "order_swap": lambda c: F.when(c.rlike(r"^[^ ,]+ [^ ,]+$"), F.concat(F.split_part(c, F.lit(" "), F.lit(2)), F.lit(", "), F.split_part(c, F.lit(" "), F.lit(1)))),
    "georgian_stem": lambda c: F.when(family(c).rlike("(shvili|dze)$"), F.regexp_replace(family(c), "(shvili|dze)$", "")),
    "nordic_particle": lambda c: F.when(c.rlike("^(af|av|von|de la) "), F.regexp_replace(c, "^(af|av|von|de la) ", "")),
    "kazakh_latin": lambda c: F.when(c.rlike("[қғұүәі]"), F.translate(c, "қғұүәі", "qğūüäı")),
}
#: Letters with marks of the northern languages, and without.
MARKED, BARE = "ąčęėįšųūžāēģīķļņōŗõäöüåøéáíóúýÅÄÖØÕÜĄČĘĖĮŠŲŪŽĀĒĢĪĶĻŅ", "aceeisuuzaegiklnoroaouaoeaiouyAAOOOUACEEISUUZAEGIKLN"
#: Kind of a name by its form.
KIND = (("patronymic", r"(son|sson|dóttir|dottir|sen|shvili|dze|[yi]an)(,|$)"), ("mononym", r"^[^ ,]+$"), ("dual", r"^[^ ,]+ [^ ,]+, "))


def sort_plain(c: Column) -> Column:
    return F.lower(squeeze(c))


def sort_particle(c: Column) -> Column:
    """Particles do not sort, but a French d' does."""
    return F.lower(squeeze(F.regexp_replace(c, r"^(von|van|de|der|den|di|da|du|la|le) ", "")))


def sort_article(c: Column) -> Column:
    return F.lower(squeeze(F.regexp_replace(c, "^[Aa]l-", "")))


def sort_given_first(c: Column) -> Column:
    return F.lower(squeeze(F.concat(given(c), F.lit(" "), family(c))))


def sort_shouted(c: Column) -> Column:
    """Family and given name in capitals, signs left out."""
    return F.upper(squeeze(F.regexp_replace(F.concat(family(c), F.lit(" "), given(c)), r"[^\p{L}\p{N}_\s]", "")))


def sort_family(c: Column) -> Column:
    """The family name (the last word where no comma tells) without common marks."""
    own = F.when(F.contains(c, F.lit(", ")), family(c)).otherwise(F.element_at(F.split(c, " "), -1))
    return F.translate(F.lower(own), MARKED, BARE)


def sort_nordic(c: Column) -> Column:
    """Patronymics by the given name, others by the surname without its particle; capitals."""
    main = F.regexp_replace(family(c), "^(af|av|von|de la) ", "")
    key = F.when(family(c).rlike("(son|dóttir|dottir)$"), F.concat(given(c), F.lit(" "), family(c))).otherwise(F.concat(main, F.lit(", "), given(c)))
    return F.upper(squeeze(F.translate(key, MARKED, BARE)))


def sort_as_is(c: Column) -> Column:
    return c


def sort_upper(c: Column) -> Column:
    return F.upper(c)


def sort_quarantine(c: Column) -> Column:
    return F.concat(F.lit("QUARANTINE_"), c)


#: Characters that a name may have, where a region sets a bound.
MOST_CHARS = {"C6": 150, "E1": 150, "H1": 150, "R0": 150, "Z0": 100}
LATIN, ANY = r"^[\p{IsLatin}\p{M}\s,.'’\-0-9]+$", r"^\P{C}+$"
#: Region: script of its Latin column, cleaning rules, variant rules, order key.
REGIONS: dict[str, tuple[str, tuple[str, ...], tuple[str, ...], Rule]] = {
    "A1": (LATIN, ("middle_initial",), (), sort_plain),
    "A2": (LATIN, ("german_particle", "iberian_honorific", "sharp_s"), ("iberian_first_surname",), sort_particle),
    "A3": (LATIN, ("tight_marks",), ("ascii", "nordic_particle"), sort_nordic),
    "A4": (LATIN, (), ("macron",), sort_plain),
    "A5": (LATIN, ("middle_initial",), ("iberian_first_surname",), sort_plain),
    "B1": (ANY, ("slavic_patronymic",), (), sort_plain),
    "B2": (LATIN, (), ("hungarian_order",), sort_plain),
    "B3": (ANY, (), ("greek_hatzi",), sort_plain),
    "C1": (ANY, (), ("turkish_plain_i", "turkic_oglu", "kazakh_latin"), sort_plain),
    "C2": (ANY, (), ("ezafe", "zadeh"), sort_plain),
    "C3": (ANY, ("arabic_prefix",), ("arabic_article", "sun_letter", "ibn_patronymic"), sort_article),
    "C4": (ANY, ("arabic_prefix",), ("arabic_article", "ibn_patronymic"), sort_article),
    "C5": (ANY, ("arabic_prefix",), ("arabic_article",), sort_article),
    "C6": (ANY, (), (), sort_as_is),
    "C7": (ANY, (), ("armenian_ending", "order_swap"), sort_family),
    "C8": (ANY, (), ("georgian_stem", "order_swap"), sort_family),
    "C9": (LATIN, ("baltic_titles", "tight_marks"), ("ascii",), sort_family),
    "C9-ALT": (LATIN, ("azerbaijani_schwa",), ("turkic_oglu",), sort_plain),
    "D1": (ANY, ("devanagari_dot",), (), sort_shouted),
    "D2": (ANY, (), (), sort_given_first),
    "D3": (ANY, ("devanagari_dot",), (), sort_shouted),
    "D4": (ANY, ("arabic_prefix",), ("ibn_patronymic",), sort_article),
    "D5": (ANY, (), (), sort_shouted),
    "E1": (ANY, (), ("order_swap",), sort_shouted),
    "E2": (ANY, (), ("order_swap",), sort_shouted),
    "E3": (ANY, (), ("japanese_order",), sort_plain),
    "E4": (ANY, (), ("korean_hyphen",), sort_plain),
    "E5": (ANY, (), ("vietnamese_plain",), sort_plain),
    "E6": (ANY, (), (), sort_given_first),
    "E7": (LATIN, (), ("ibn_patronymic", "maternal_middle"), sort_plain),
    "F1": (LATIN, (), (), sort_particle),
    "F2": (LATIN, ("middle_initial",), (), sort_plain),
    "F3": (ANY, (), (), sort_given_first),
    "F4": (LATIN, ("iberian_honorific",), ("iberian_first_surname",), sort_particle),
    "G1": (LATIN, ("iberian_honorific",), ("iberian_first_surname",), sort_particle),
    "H1": (ANY, (), (), sort_as_is),
    "R0": (LATIN, (), (), sort_upper),
    "Z0": (ANY, (), (), sort_quarantine),
}


def process(df: DataFrame, region: str = "region", name: str = "name") -> DataFrame:
    """df with cleaned, variants, order_key, valid and kind by each row's region; unknown
    regions are treated as R0."""
    known = F.when(F.col(region).isin(*REGIONS), F.col(region)).otherwise("R0")
    d = df.withColumn("_region", known).withColumn("cleaned", squeeze(F.col(name)))

    def dispatch(of: Callable[[str], Column], default: Column) -> Column:
        out = None
        for r in REGIONS:
            c = of(r)
            if c is not None:
                cond = F.col("_region") == r
                out = F.when(cond, c) if out is None else out.when(cond, c)
        return out.otherwise(default)

    clean = dispatch(lambda r: reduce(lambda c, k: CLEAN[k](c), REGIONS[r][1], F.col("cleaned")) if REGIONS[r][1] else None, F.col("cleaned"))
    d = d.withColumn("cleaned", clean)
    none = F.array().cast("array<string>")
    variants = dispatch(lambda r: F.array_distinct(F.array_compact(F.array(*(VARIANT[k](F.col("cleaned")) for k in REGIONS[r][2])))) if REGIONS[r][2] else None, none)
    key = dispatch(lambda r: REGIONS[r][3](F.col("cleaned")) if REGIONS[r][3] is not sort_plain else None, sort_plain(F.col("cleaned")))
    short = F.length("cleaned") <= F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in MOST_CHARS.items() for x in kv)), F.col("_region")), F.lit(1 << 30))
    valid = dispatch(lambda r: F.col("cleaned").rlike(REGIONS[r][0]) if REGIONS[r][0] != ANY else None, F.col("cleaned").rlike(ANY)) & short
    kind = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, p in KIND:
        kind = kind.when(F.col("cleaned").rlike(p), k)
    return d.withColumn("variants", variants).withColumn("order_key", key).withColumn("valid", valid).withColumn("kind", kind.otherwise("plain")).drop("_region")
