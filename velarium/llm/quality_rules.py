"""Quality rules by distribution divergence, in DataFrame expressions only.

A document is held against the reference of its language by the Jensen-Shannon distance (base
2, 0 to 1) of two histograms: character classes over code points, and common function words
over words (all other words share one bin). The references are the summed histograms of all
documents that bear the same `lang` (null is a language of its own), so they cover the whole
corpus and are one small row per language. A distance counts only from a minimum number of
words on: short texts scatter.

Fixed base counts stand beside it: words, their code points, symbols, repeated lines, and words
in three-word windows that occur twice or more.

Null and empty texts have no words and fail the base rule. Repeated rows are judged alike. An
empty table gives no rows. `quality_filter` carries each row as one struct, so other columns pass
through whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WORD, table, written

#: Character classes, taken in this order.
CLASSES = {
    "lower": "[a-z]+",
    "white": r"[\x20\x09-\x0D]+",
    "upper": "[A-Z]+",
    "digit": "[0-9]+",
    "symbol": r"[#*$%&|<>]+",
    "shout": "[!?]+",
    "stop": r"[.,;:'\"()\-]+",
    "letter": r"\p{L}+",
}
#: Frequent function words of the languages at hand.
COMMON = (
    "the of and to in that is for "
    "der die und das den von ist nicht "
    "le la les et des un que est "
    "el los las en por con una para"
).split()
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Greatest distances of a kept document, each from so many words on.
CHAR_LIMITS = ((50, 0.32),)
WORD_LIMITS = ((200, 0.19), (100, 0.25))
#: Languages up to which the references are sent to every executor (each some 2 KB).
MAX_BROADCAST_LANGUAGES = 2000

LONG = "bigint"


def repeat_words(words: str) -> Column:
    """Words in three-word windows that occur twice or more, the first included. Windows are
    compared by a 64-bit hash inside one text."""
    return F.expr(f"""
      CASE WHEN size({words}) < 4 THEN 0L ELSE
        transform(array(transform(sequence(1, size({words}) - 2), i -> xxhash64(get({words}, i - 1), get({words}, i), get({words}, i + 1)))), h ->
          CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
            transform(array(sort_array(transform(h, (x, i) -> struct(x AS x, i AS i)))), s ->
              cast(size(array_distinct(flatten(transform(
                filter(s, (e, j) -> get(s, j - 1).x <=> e.x OR get(s, j + 1).x <=> e.x),
                e -> array(e.i, e.i + 1, e.i + 2))))) AS bigint))[0]
          END)[0]
      END""")


def _measured(docs: DataFrame, text_col: str, lang_col: str, base: bool) -> DataFrame:
    """Adds a struct `_q` of lang, histograms and, if asked for, the base counts. Each step's
    columns are used more than once below, so the optimizer keeps the steps apart."""
    d = docs.withColumn("_q_t", F.coalesce(F.col(text_col), F.lit("")))
    d = d.withColumn("_q_w", F.regexp_extract_all("_q_t", F.lit(WORD), F.lit(0)))
    left = "_q_t"
    for i, (name, pattern) in enumerate(CLASSES.items()):
        d = d.withColumn(f"_q_{i}", F.regexp_replace(left, pattern, ""))
        left = f"_q_{i}"
    steps = ["_q_t", *(f"_q_{i}" for i in range(len(CLASSES)))]
    chars = [F.struct(F.lit(f"c:{name}").alias("bin"), (F.length(a) - F.length(b)).cast(LONG).alias("n")) for name, a, b in zip(CLASSES, steps, steps[1:])]
    chars.append(F.struct(F.lit("c:other").alias("bin"), F.length(steps[-1]).cast(LONG).alias("n")))
    most = max(map(len, COMMON))
    listed = ", ".join(f"'{w}'" for w in COMMON)
    d = d.withColumn("_q_c", F.expr(f"sort_array(filter(_q_w, w -> octet_length(w) <= {most} AND array_contains(array({listed}), lower(w))))"))
    d = d.withColumn("_q_c", F.expr("transform(_q_c, w -> lower(w))")).withColumn("_q_c", F.sort_array("_q_c"))
    common = F.expr("""concat(
        transform(array(array_distinct(_q_c)), d -> transform(d, (w, i) -> struct(concat('w:', w) AS bin,
          cast(if(i + 1 < size(d), array_position(_q_c, get(d, i + 1)) - 1, size(_q_c)) - array_position(_q_c, w) + 1 AS bigint) AS n)))[0],
        array(struct('w:' AS bin, cast(size(_q_w) - size(_q_c) AS bigint) AS n)))""")
    fields = [
        F.col(lang_col).cast("string").alias("lang"),
        F.array(*chars).alias("chars"),
        common.alias("common"),
        F.size("_q_w").cast(LONG).alias("n_words"),
        F.length("_q_t").cast(LONG).alias("n_chars"),
    ]
    if base:
        symbols = reduce(lambda a, b: a + b, (F.octet_length("_q_t") - F.octet_length(F.replace("_q_t", F.lit(c), F.lit(""))) for c in SYMBOLS))
        d = d.withColumn("_q_l", F.expr(r"filter(split(_q_t, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
        fields += [
            F.length(F.array_join("_q_w", "")).cast(LONG).alias("word_chars"),
            symbols.cast(LONG).alias("n_symbols"),
            (F.size("_q_l") - F.size(F.array_distinct("_q_l"))).cast(LONG).alias("n_dup_lines"),
            repeat_words("_q_w").alias("n_repeat_words"),
        ]
    return d.withColumn("_q", F.struct(*fields))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, shares: map of bin to its share of the language's characters or words), from all
    documents. Written once: it is read twice and its size is checked before use."""
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None)
    m = _measured(docs.select(F.col(text_col).alias("_text"), lang.alias("_lang")), "_text", "_lang", base=False)
    bins = m.select(F.col("_q.lang").alias("lang"), F.inline(F.concat("_q.chars", "_q.common"))).groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    by = bins.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("n"))
    share = F.expr("""transform(array(struct(
        aggregate(map_entries(n), 0L, (a, e) -> a + if(startswith(e.key, 'c:'), e.value, 0L)) AS c,
        aggregate(map_entries(n), 0L, (a, e) -> a + if(startswith(e.key, 'w:'), e.value, 0L)) AS w)),
        s -> transform_values(n, (k, v) -> if(startswith(k, 'c:'), try_divide(v, s.c), try_divide(v, s.w))))[0]""")
    return written(by.select(F.col("lang").alias("_q_lang"), share.alias("_q_ref")))


def _distance(counts: str, total: str, prefix: str) -> Column:
    """Jensen-Shannon distance of a document's counts from its reference; 0 without counts."""
    return F.expr(f"""
      if({total} = 0, 0.0D, sqrt(greatest(0.0D, aggregate(
        transform(filter(map_entries(_q_ref), e -> startswith(e.key, '{prefix}')), e -> struct(
          coalesce(element_at(map_from_entries({counts}), e.key), 0L) / {total} AS p, coalesce(e.value, 0.0D) AS q)),
        0.0D, (a, x) -> a
          + if(x.p > 0, 0.5D * x.p * log2(2 * x.p / (x.p + x.q)), 0.0D)
          + if(x.q > 0, 0.5D * x.q * log2(2 * x.q / (x.p + x.q)), 0.0D)))))""")


def judged(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", char_limits=CHAR_LIMITS, word_limits=WORD_LIMITS) -> DataFrame:
    """(_row: the document as a struct, _verdict: base counts, distances, base_failed, kept). The
    texts stay in place; only the references move."""
    refs = references(docs, text_col, lang_col)
    if refs.count() <= MAX_BROADCAST_LANGUAGES:
        refs = F.broadcast(refs)
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None)
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"), lang.alias("_lang"))
    j = _measured(rows, "_text", "_lang", base=True).select("_row", "_q").join(refs, F.col("_q.lang").eqNullSafe(F.col("_q_lang")), "left")
    j = j.withColumn("_q_cd", F.round(_distance("_q.chars", "_q.n_chars", "c:"), 6)).withColumn("_q_wd", F.round(_distance("_q.common", "_q.n_words", "w:"), 6))
    j = j.withColumn("_q_b", F.expr(f"_q.n_words < {MIN_WORDS} OR 100 * _q.n_repeat_words > {MAX_REPEAT_PERCENT} * _q.n_words"))
    limits = [("_q_cd", *x) for x in char_limits] + [("_q_wd", *x) for x in word_limits]
    far = F.expr(" OR ".join(f"(_q.n_words >= {n} AND {d} > {most}D)" for d, n, most in limits) or "false")
    verdict = F.struct(
        *(F.col(f"_q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        F.col("_q_b").alias("base_failed"),
        (~F.col("_q_b") & ~far).alias("kept"),
        F.col("_q_cd").alias("char_distance"),
        F.col("_q_wd").alias("word_distance"),
    )
    return j.select("_row", verdict.alias("_verdict"))


def quality_filter(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with their columns. The verdict is exploded rather
    than filtered on: a filter would move below the steps and compute them several times over."""
    kept = F.explode(F.expr("filter(array(_verdict), v -> v.kept)")).alias("_kept")
    return judged(docs, **options).select("_row", kept).select("_row.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("_row.doc_id", "_verdict.*")
