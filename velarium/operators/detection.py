"""Region of a person from country, sub-national code, era, script and name, as expressions over
one row: the small tables are literal maps, so a batch of any size is detected without a
shuffle. Callers may pass larger tables of the same shape."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import names

#: Territories of each region (ISO 3166).
TERRITORIES = {
    "A1": "US GB CA AU NZ IE AG AI BB BM BS DM GD JM KN LC MS TC TT VC VG VI GU AS MP UM FK",
    "A2": "FR DE IT ES PT NL BE CH AT LU LI SM MC GI AD MT VA HU",
    "A3": "DK NO SE FI IS FO AX EE LV",
    "A4": "FJ PG SB VU WS TO KI TV NR CK NU PF NC",
    "A5": "CW SX BQ MQ GF GP RE YT PM",
    "B1": "RU UA BY",
    "B2": "BG RS ME HR SI BA MK PL CZ SK RO AL XK",
    "B3": "GR CY",
    "C1": "TR AZ UZ TM KG KZ",
    "C2": "IR AF TJ",
    "C3": "IQ JO LB SY PS EG SD",
    "C4": "SA KW AE QA OM BH YE",
    "C5": "MA DZ TN LY EH MR",
    "C6": "IL",
    "C7": "AM",
    "C8": "GE",
    "C9": "LT",
    "D1": "IN NP BT",
    "D3": "BD",
    "D4": "PK",
    "D5": "LK",
    "E1": "CN",
    "E2": "TW HK MO",
    "E3": "JP",
    "E4": "KR KP",
    "E5": "VN",
    "E6": "TH KH LA",
    "E7": "ID MY SG BN PH TL",
    "F1": "BJ BF CM CF CG CI DJ GA GN ML NE SN TG TD KM SC MG BI",
    "F2": "GH NG KE UG TZ ZW ZM MW GM LR SL BW LS NA RW SZ MU SS",
    "F3": "ET ER",
    "F4": "AO MZ CV GW ST",
    "G1": "AR BO BR CL CO CR CU DO EC GT GY HN HT MX NI PA PE PY SV SR UY VE PR",
}
#: Sub-national and community codes.
OVERLAYS = {"CH-FR": "A2", "RU-NC": "C9", "AZ-IR": "C9", "IN-HN": "D1", "IN-SOUTH": "D2", "IN-WB": "D3", "LK-TA": "D2", "LK-SI": "D5", "TR-TRP": "D3", "AS-ASM": "D3"}
#: Years of birth in which a country's names are another region's.
ERAS = {"TH": (("-2015", "E6"), ("2016-", "A1"))}
#: Groups of regions that a weaker hint can still tell.
GROUPS = {
    "ANGLO_SPHERE": ["A1"], "GERMANIC_WESTERN": ["A2"], "NORDIC_BALTIC": ["A3"], "OCEANIA_PACIFIC": ["A4"], "CARIBBEAN_FRENCH": ["A5"], "SLAVIC_EAST": ["B1"], "SLAVIC_CENTRAL": ["B2"], "HELLENIC": ["B3"],
    "TURKIC": ["C1"], "BALTIC": ["C9"], "PERSIAN": ["C2"], "ARABIC": ["C3", "C4", "C5"], "HEBREW": ["C6"], "ARMENIAN": ["C7"], "GEORGIAN": ["C8"], "SOUTH_ASIAN": ["D1", "D2", "D3", "D4", "D5"],
    "SINOPHONE": ["E1", "E2"], "JAPANESE": ["E3"], "KOREAN": ["E4"], "VIETNAMESE": ["E5"], "SEA": ["E6", "E7"], "SSA": ["F1", "F2", "F3", "F4"], "LATIN": ["G1"],
}
GROUP_OF = {r: g for g, rs in GROUPS.items() for r in rs}
#: Common surnames by region, from general knowledge.
SURNAMES = {
    "A1": "smith johnson brown taylor wilson davies evans thomas walker wright campbell stewart murphy",
    "A2": "müller schmidt schneider fischer weber dubois lefebvre moreau rossi ferrari bianchi jansen",
    "A3": "andersson johansson nilsson hansen olsen korhonen virtanen tamm berzins",
    "B1": "ivanov petrov smirnov kuznetsov volkov shevchenko kovalenko popov",
    "B2": "kowalski novak horvat jovanovic popescu dimitrov wozniak svoboda",
    "B3": "papadopoulos georgiou nikolaidis ioannou vlachos",
    "C1": "yilmaz kaya demir aliyev nazarbayev karimov",
    "C2": "hosseini mohammadi rezaei ahmadi karimi rahmonov",
    "C3": "haddad khoury mansour hariri nasser",
    "C4": "alghamdi alqahtani alotaibi alsabah almaktoum",
    "C5": "benali bouazza ziani belkacem trabelsi",
    "C6": "cohen levy mizrahi peretz friedman",
    "C7": "petrosyan sargsyan hakobyan grigoryan",
    "C8": "beridze kapanadze gelashvili lomidze",
    "C9": "kazlauskas petrauskas jankauskas",
    "D1": "sharma gupta singh kumar verma mishra",
    "D2": "iyer reddy nair pillai subramanian rao",
    "D3": "banerjee chatterjee mukherjee rahman bose",
    "D4": "khan malik qureshi chaudhry",
    "D5": "perera fernando silva jayawardena wickramasinghe",
    "E1": "wang zhang chen liu yang zhao huang zhou xu sun",
    "E2": "chan wong cheung leung lau tsai hsu",
    "E3": "sato suzuki takahashi tanaka watanabe ito yamamoto",
    "E4": "kim lee park choi jung kang yoon",
    "E5": "nguyen tran pham hoang vu dang",
    "E6": "somchai srisai chaiyaporn sok",
    "E7": "santoso wijaya reyes cruz bautista",
    "F1": "diallo traore ouedraogo ndiaye",
    "F2": "okafor mensah mwangi dlamini adeyemi",
    "F3": "tesfaye bekele haile",
    "F4": "mondlane guebuza",
    "G1": "garcia rodriguez martinez hernandez lopez gonzalez ramirez",
}
#: Given names that speak for a region, from general knowledge.
GIVEN = {
    "A1": "robert michael david jennifer william james richard", "A2": "hans pierre giovanni marie luigi", "A3": "lars sven ingrid", "B1": "ivan sergei olga dmitri", "B2": "piotr jan katarzyna", "B3": "nikolaos dimitrios",
    "C1": "mehmet ayse mustafa", "C2": "reza mohsen", "C3": "omar fatima ahmed", "C6": "moshe yael", "D1": "rajesh priya", "D2": "srinivasan lakshmi", "E1": "wei xiaoming", "E3": "hiroshi yuki kenji", "E4": "minjun jisoo",
    "E5": "thi van", "F2": "kwame chinua", "G1": "carlos jose maria",
}
#: Surname endings that speak for a region by themselves, and those for a group only.
SIGNATURE_ENDINGS = {
    "A2": "mann stein", "A3": "sson sen dottir", "B1": "ov ova ev eva enko evich ovich", "B2": "escu eanu ovic evic", "B3": "opoulos poulos akis ides idis iadis", "C1": "maz mez oglu",
    "C2": "zadeh pour nejad nezhad", "C7": "yan", "C8": "shvili dze adze",
}
LEAF_ENDINGS = {"B2": "owski ewski inski anski wicz", "B1": "evsky ovsky insky", "C9": "auskas aitis evicius ičius"}
GROUP_ENDINGS = {"SLAVIC_CENTRAL": "ski", "SLAVIC_EAST": "sky", "HELLENIC": "ou is"}
#: Weights of the evidence.
W_SURNAME, W_GIVEN, W_ENDING, W_LEAF, W_GROUP, W_HYPHEN = 5.0, 2.0, 2.5, 1.0, 1.2, 2.5
#: Surnames that a region shares by migration count less there.
SHARED = {("A2", "singh"): 0.5, ("A1", "singh"): 0.4, ("A1", "garcia"): 0.6, ("A1", "rodriguez"): 0.6, ("A1", "martinez"): 0.6, ("A1", "lopez"): 0.6, ("A1", "hernandez"): 0.6}
LEAST_SCORE, LEAST_MARGIN = 2.0, 0.5
NOWHERE = "R0"


def listed(table: dict[str, str]) -> dict[str, list[str]]:
    """word -> regions, of a table region -> words."""
    out: dict[str, list[str]] = {}
    for region, words in table.items():
        for w in words.split():
            out.setdefault(w, []).append(region)
    return out


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _map(pairs: dict[str, str]) -> Column:
    """A literal map, parsed at once and folded."""
    return F.expr("map(" + ", ".join(_quoted(x) for kv in pairs.items() for x in kv) + ")")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def territory(country: Column, table: dict[str, str] = TERRITORIES) -> Column:
    return F.coalesce(F.try_element_at(_map({c: r[0] for c, r in listed(table).items()}), F.upper(country)), F.lit(NOWHERE))


def overlay(code: Column, table: dict[str, str] = OVERLAYS) -> Column:
    return F.try_element_at(_map(table), F.upper(F.trim(code)))


def interval(text: str) -> tuple[int | None, int | None]:
    """"..2015", "-2015", "2016-", "1980..2000" or one year, both ends included; null: open."""
    text = text.strip().replace("..", "-")
    if "-" not in text:
        return (int(text), int(text)) if text.isdigit() else (1, 0)  # nothing fits
    low, _, high = text.partition("-")
    return (int(low) if low else None, int(high) if high else None)


def era(country: Column, birth: Column, rules: dict = ERAS) -> Column:
    """The region of the first rule of the country whose years hold the birth year."""
    tests = []
    for c, each in rules.items():
        for text, region in each:
            low, high = interval(text)
            inside = [birth >= low] * (low is not None) + [birth <= high] * (high is not None)
            tests.append(F.when(reduce(lambda a, b: a & b, inside, F.upper(country) == c) & birth.isNotNull(), F.lit(region)))
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def answer(region: Column, confidence: Column, method: str) -> Column:
    """(region, confidence, method), null without a region."""
    return F.when(region.isNotNull(), F.struct(region.alias("region"), confidence.cast("double").alias("confidence"), F.lit(method).alias("method")))


NOTHING = "named_struct('region', 'R0', 'confidence', 0.1D, 'method', 'none')"


def geography(country: Column, code: Column, birth: Column) -> Column:
    """(region, confidence, method): by overlay code, else era, else territory, else nowhere."""
    t = F.nullif(territory(country), F.lit(NOWHERE))
    steps = [(overlay(code), 0.88, "overlay"), (era(country, birth), 0.9, "era"), (t, 0.85, "territory")]

    def step(region: Column, confidence: float, method: str) -> Column:
        return let(region, lambda r: answer(r, F.lit(confidence), method))

    return F.coalesce(*(step(*x) for x in steps), F.expr(NOTHING))


# ---------------------------------------------------------------- names
def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\-']+"), lambda w: w != "")


def surname_words(latin: Column) -> Column:
    """Before the comma where there is one, else the first and the last word."""
    w = words(latin)
    ends = F.array_distinct(F.array_compact(F.array(F.try_element_at(w, F.lit(1)), F.try_element_at(w, F.lit(-1)))))
    return F.when(F.contains(latin, F.lit(",")), words(names.family(latin))).otherwise(ends)


def given_words(latin: Column) -> Column:
    w = words(latin)
    rest = F.when(F.contains(latin, F.lit(",")), words(names.given(latin))).otherwise(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))))
    return F.flatten(F.transform(rest, lambda x: F.when(F.contains(x, F.lit("-")), F.concat(F.array(x), F.split(x, "-"))).otherwise(F.array(x))))


_HITS = "array<struct<region:string,weight:double>>"


def _hit(region: str, weight: float) -> Column:
    return F.struct(F.lit(region).alias("region"), F.lit(float(weight)).alias("weight"))


def _hits_map(table: dict[str, list[tuple[str, float]]]) -> str:
    """Literal map of a word to its regions and weights, as text."""
    def one(region: str, weight: float) -> str:
        return f"named_struct('region', {_quoted(region)}, 'weight', {float(weight)}D)"

    values = [f"{_quoted(w)}, array({', '.join(one(*h) for h in hits)})" for w, hits in table.items()]
    return f"map({', '.join(values)})"


def _looked_up(tokens: Column, table: dict[str, list[tuple[str, float]]]) -> Column:
    m = F.expr(_hits_map(table))
    return F.flatten(F.transform(F.array_distinct(tokens), lambda t: F.coalesce(F.try_element_at(m, t), F.array().cast(_HITS))))


def endings() -> list[tuple[str, list[tuple[str, float]]]]:
    """(ending, its regions and weights), longest first."""
    out: dict[str, list[tuple[str, float]]] = {}
    for e, rs in listed(SIGNATURE_ENDINGS).items():
        out.setdefault(e, []).extend((r, W_ENDING) for r in rs)
    for e, rs in listed(LEAF_ENDINGS).items():
        for r in rs:
            out.setdefault(e, []).extend((x, W_GROUP + (W_LEAF if x == r else 0.0)) for x in GROUPS[GROUP_OF[r]])
    for e, gs in listed(GROUP_ENDINGS).items():
        out.setdefault(e, []).extend((r, W_GROUP) for g in gs for r in GROUPS[g])
    return sorted(out.items(), key=lambda kv: (-len(kv[0]), kv[0]))


def evidence(latin: Column) -> Column:
    """Array of (region, weight) that the words of a name speak for. A given name counts the less
    the more regions share it; of endings, a surname word's longest counts."""
    ends = F.expr(_hits_map(dict(endings())))
    longest = max(len(e) for e, _ in endings())

    def by_end(w: Column) -> Column:
        sizes = F.filter(F.sequence(F.lit(longest), F.lit(1), F.lit(-1)), lambda n: n + 1 < F.length(w))
        found = F.filter(F.transform(sizes, lambda n: F.try_element_at(ends, F.right(w, n))), lambda h: h.isNotNull())
        return F.coalesce(F.try_element_at(found, F.lit(1)), F.array().cast(_HITS))

    def of(s: Column, g: Column) -> Column:
        by_surname = _looked_up(s, {w: [(r, W_SURNAME * SHARED.get((r, w), 1.0)) for r in rs] for w, rs in listed(SURNAMES).items()})
        by_given = _looked_up(g, {w: [(r, W_GIVEN / len(rs)) for r in rs] for w, rs in listed(GIVEN).items() if len(rs) < 4})
        by_ending = F.flatten(F.transform(F.array_distinct(s), by_end))
        hyphen = F.when(F.exists(g, lambda x: x.rlike(r"^\p{L}+-\p{L}+$")), F.array(_hit("E4", W_HYPHEN))).otherwise(F.array().cast(_HITS))
        return F.concat(by_surname, by_given, by_ending, hyphen)

    return let(surname_words(latin), lambda s: let(given_words(latin), lambda g: of(s, g)))


def ranked(hits: Column) -> Column:
    """Regions by the sum of their weights, highest first, ties by code: array of (score, region)."""

    def summed(h: Column, r: Column) -> Column:
        total = F.aggregate(F.filter(h, lambda x: x["region"] == r), F.lit(0.0), lambda a, x: a + x["weight"])
        return F.struct((-F.round(total, 3)).alias("less"), r.alias("region"))

    def order(h: Column) -> Column:
        regions = F.array_distinct(F.transform(h, lambda x: x["region"]))
        return F.transform(F.array_sort(F.transform(regions, lambda r: summed(h, r))), lambda x: F.struct((-x["less"]).alias("score"), x["region"].alias("region")))

    return let(hits, order)


def scored(latin: Column) -> Column:
    """(region, score, margin): the best region, null if the score or its lead is too small."""

    def judge(r: Column) -> Column:
        best, next_ = F.try_element_at(r, F.lit(1)), F.try_element_at(r, F.lit(2))
        margin = F.round(best["score"] - F.coalesce(next_["score"], F.lit(0.0)), 3)
        return F.struct(F.when((best["score"] >= LEAST_SCORE) & (margin >= LEAST_MARGIN), best["region"]).alias("region"), best["score"].alias("score"), margin.alias("margin"))

    return let(ranked(evidence(latin)), judge)


def known_surname(latin: Column) -> Column:
    """The one region that lists the surname; null if none or several do."""
    own = {w: rs[0] for w, rs in listed(SURNAMES).items() if len(rs) == 1 and not any(k[1] == w for k in SHARED)}
    return F.try_element_at(_map(own), F.array_join(words(names.family(latin)), " "))


def hybrid(latin: Column) -> Column:
    """E1 or E4 for a surname of theirs beside a Western given name."""
    table = _map({w: r for r in ("E1", "E4") for w in SURNAMES[r].split()})
    found = F.filter(F.transform(surname_words(latin), lambda w: F.try_element_at(table, w)), lambda r: r.isNotNull())
    return F.when(F.arrays_overlap(given_words(latin), F.array(*map(F.lit, GIVEN["A1"].split()))), F.try_element_at(found, F.lit(1)))


def western_given(latin: Column) -> Column:
    return F.arrays_overlap(given_words(latin), F.array(*map(F.lit, f"{GIVEN['A1']} {GIVEN['A2']}".split())))


def name_origin(latin: Column, native: Column, fast: bool = False) -> Column:
    """(region, confidence, method): Hangul, one region's surname, a hybrid name, the scorer, else
    nowhere. fast: the surname and the hybrid only."""
    hangul = F.when(F.concat_ws(" ", latin, native).rlike("[\\uAC00-\\uD7AF\\u1100-\\u11FF]"), F.lit("E4"))
    steps = [let(known_surname(latin), lambda r: answer(r, F.lit(0.95), "surname")), let(hybrid(latin), lambda r: answer(r, F.lit(0.95), "hybrid"))]
    if not fast:
        steps.insert(0, let(hangul, lambda r: answer(r, F.lit(0.95), "script")))
        steps.append(let(scored(latin), lambda s: answer(s["region"], F.round(F.least(F.lit(0.9), 0.6 + 0.04 * s["score"]), 6), "scorer")))
    return F.coalesce(*steps, F.expr(NOTHING))


def merged(geo: Column, name: Column) -> Column:
    """One answer of (region, confidence, method) by geography and by name: geography first; with
    whether they disagree, and how far the answer holds: leaf, group, single or none."""
    g = _map(GROUP_OF)

    def one(geo: Column, name: Column) -> Column:
        by_geo, by_name = geo["region"] != NOWHERE, name["region"] != NOWHERE
        same = F.try_element_at(g, geo["region"]) == F.try_element_at(g, name["region"])
        region = F.when(by_geo, geo["region"]).otherwise(name["region"])
        held = F.when(~by_geo & ~by_name, "none").when(~by_geo | ~by_name, "single").when(geo["region"] == name["region"], "leaf").when(same, "group").otherwise("disputed")
        return F.struct(
            region.alias("region"), F.when(by_geo, geo["confidence"]).otherwise(name["confidence"]).alias("confidence"), F.when(by_geo, geo["method"]).otherwise(name["method"]).alias("method"),
            (by_geo & by_name & (geo["region"] != name["region"])).alias("conflict"), F.try_element_at(g, region).alias("grp"), held.alias("resolution"),
        )

    return let(geo, lambda a: let(name, lambda b: one(a, b)))


def fallback(candidates: Column, rules: Column, prior: Column) -> Column:
    """(region, strategy) for an answer that a model withheld: the rules' region if it is among the
    candidates, else the rules', else the graph's, else nowhere."""

    def say(region: Column, how: str) -> Column:
        return F.struct(region.alias("region"), F.lit(how).alias("strategy"))

    def choose(r: Column) -> Column:
        spoken = r.isNotNull() & (r != NOWHERE)
        return F.when(spoken & F.array_contains(candidates, r), say(r, "agreement")).when(spoken, say(r, "rules")).when(prior.isNotNull(), say(prior, "graph")).otherwise(say(F.lit(NOWHERE), "none"))

    return let(rules, choose)


def tempered(probabilities: Column, temperature: float, least: float) -> Column:
    """(best, p): an array of (region, p) sharpened or softened and scaled to one; best is null
    below `least`."""
    hot = F.transform(probabilities, lambda x: F.struct(F.pow(x["p"], 1.0 / temperature).alias("p"), x["region"].alias("region")))
    total = F.aggregate(hot, F.lit(0.0), lambda a, x: a + x["p"])
    top = F.array_max(hot)
    p = F.round(top["p"] / total, 6)
    return F.struct(F.when(p >= least, top["region"]).alias("best"), p.alias("p"))


def by_affiliation(institution_country: Column, countries: Column) -> Column:
    """(region, confidence): by the institution's country, else by the first country that is known."""
    first = F.try_element_at(F.filter(F.transform(countries, lambda c: territory(c)), lambda r: r != NOWHERE), F.lit(1))
    own = territory(F.coalesce(institution_country, F.lit("")))
    return F.when(own != NOWHERE, F.struct(own.alias("region"), F.lit(0.85).alias("confidence"))).when(first.isNotNull(), F.struct(first.alias("region"), F.lit(0.8).alias("confidence")))


def nudged(region: Column, confidence: Column, doi: Column, affiliation: Column) -> Column:
    """A little more confidence for a publisher prefix in A1 or A2 and for a university; 0.95 at
    most."""
    more = F.when(region.isin("A1", "A2") & F.startswith(doi, F.lit("10.1007/")), 0.02).otherwise(0.0) + F.when(F.lower(affiliation).rlike("universit|institut"), 0.02).otherwise(0.0)
    return F.round(F.least(F.lit(0.95), confidence + F.coalesce(more, F.lit(0.0))), 6)


def signals(field: Column, table: list[tuple[str, str, str, float]]) -> Column:
    """(region, confidence) of the best region by signals (region, kind, value, weight) on a lower
    case text; kinds: prefix, suffix, token, contains, regex. Null without any."""
    t = F.lower(field)
    tests = {
        "prefix": lambda v: t.startswith(v), "suffix": lambda v: t.endswith(v), "token": lambda v: F.contains(F.concat(F.lit(" "), t, F.lit(" ")), F.lit(f" {v} ")),
        "contains": lambda v: F.contains(t, F.lit(v)), "regex": lambda v: t.rlike(v),
    }
    hits = F.array_compact(F.array(*(F.when(tests[k](v), _hit(r, w)) for r, k, v, w in table)))
    best = F.try_element_at(ranked(hits), F.lit(1))
    return let(best, lambda b: F.when(b.isNotNull(), F.struct(b["region"].alias("region"), F.round(F.least(F.lit(0.98), 0.5 + b["score"] / 10), 6).alias("confidence"))))


def features(latin: Column) -> Column:
    """Length, words, share of vowels, last three and first two letters of a name."""
    t = F.lower(latin)
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    vowels = F.round(F.coalesce(F.regexp_count(t, F.lit("[aeiouy]")) / F.nullif(letters, F.lit(0)), F.lit(0.0)), 6)
    return F.struct(F.length(t).alias("length"), F.size(words(latin)).alias("words"), vowels.alias("vowels"), F.right(t, F.lit(3)).alias("last"), F.substr(t, F.lit(1), F.lit(2)).alias("first"))


#: Words that mark a romanisation, in the order in which they are tried.
ROMANISED = (
    ("fa-hist", r"(^|[ -])(ibn|khwarizmi|tusi|biruni)([ ,-]|$)"),
    ("zh", r"(^|[ -])(zh\p{L}+|x(iao|u|ie|in)\p{L}*|qi\p{L}*)([ ,-]|$)"),
    ("ja", r"(shi|tsu|moto|yama|kawa|saki)([ ,-]|$)"),
    ("ko", r"(^|[ -])(kim|park|choi|jung|yoon)([ ,-]|$)"),
    ("fa", r"(zadeh|pour|nejad|nia)([ ,-]|$)"),
    ("ar", r"(^|[ -])(al|el|abd|abu|bin)([ -]|$)"),
)


def romanisation(latin: Column) -> Column:
    return F.coalesce(*(F.when(F.lower(latin).rlike(p), F.lit(n)) for n, p in ROMANISED))


#: Particles that are not part of a surname when it is looked up.
SURNAME_PARTICLES = "von van de der den di da del della la le du dos das el al bin ibn zu"


def bare_surname(latin: Column) -> Column:
    """The surname without particles, lower case; the whole of it if nothing else is left."""
    w = words(names.family(latin))
    rest = F.filter(w, lambda x: ~x.isin(SURNAME_PARTICLES.split()))
    return F.array_join(F.when(F.size(rest) > 0, rest).otherwise(w), " ")


def calibrated(p: Column, knots: list[tuple[float, float]]) -> Column:
    """Value of the first knot (threshold, value) that p does not exceed, else the last one's."""
    if not knots:
        return p
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    return F.coalesce(*(F.when(q <= t, F.lit(float(v))) for t, v in sorted(knots)), F.lit(float(max(knots)[1])))


#: Scripts that one region's names are written in, in the order in which they are tried.
SCRIPT_REGIONS = (
    ("E4", "[\\uAC00-\\uD7AF\\u1100-\\u11FF]"), ("E3", "[\\u3040-\\u30FF]"), ("E1", "[\\u4E00-\\u9FFF]"), ("B1", "[\\u0400-\\u04FF]"), ("B3", "[\\u0370-\\u03FF]"), ("C6", "[\\u0590-\\u05FF]"),
    ("C3", "[\\u0600-\\u06FF]"), ("C7", "[\\u0530-\\u058F]"), ("C8", "[\\u10A0-\\u10FF]"), ("D1", "[\\u0900-\\u097F]"), ("D3", "[\\u0980-\\u09FF]"), ("D5", "[\\u0D80-\\u0DFF]"), ("E6", "[\\u0E00-\\u0E7F]"), ("F3", "[\\u1200-\\u137F]"),
)


def by_script(c: Column) -> Column:
    """The region whose script a name holds; nowhere for Latin and others."""
    return F.coalesce(*(F.when(c.rlike(p), F.lit(r)) for r, p in SCRIPT_REGIONS), F.lit(NOWHERE))
