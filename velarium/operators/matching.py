"""Look-ups, fuzzy matches and merges. Candidates always come from an equi-join on blocking keys;
the caller chooses keys fine enough that a block's pairs stay few."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product
from math import prod
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..functions import similarity as S
from ..session import checkpoints


def blocked_pairs(df: DataFrame, key: str, block: list, columns: list[str]) -> DataFrame:
    """Pairs with a smaller left key that share the block; columns get _a and _b."""
    b = [F.expr(x) if isinstance(x, str) else x for x in block]
    base = df.select(key, *columns, *(x.alias(f"_b{i}") for i, x in enumerate(b)))
    blocks = [f"_b{i}" for i in range(len(b))]
    left = base.select(*(F.col(c).alias(f"{c}_a") for c in (key, *columns)), *blocks)
    right = base.select(*(F.col(c).alias(f"{c}_b") for c in (key, *columns)), *blocks)
    return left.join(right, blocks).where(F.col(f"{key}_a") < F.col(f"{key}_b")).drop(*blocks)


#: Members of a kind in one row of scored_pairs, members in a tile, and pairs worth a task.
CHUNK, TILE, TASK_PAIRS = 256, 2048, 4_000_000
#: Distinct values of a part, and rows of its table of scores, up to which scored_pairs goes by parts.
PART_VALUES, PART_SCORES = 256, 4096


def _cells(rows: DataFrame, key: str, block: list[str], columns: list[str], lists: list[str], chunk: int, tile: int) -> DataFrame:
    """Pairs of kinds (rows alike in block and columns) that share a block, in both directions:
    columns and, for each of key and lists, the members' values in one order, with _a and _b. A
    kind's members stand in chunks, a block's chunks in tiles; a task gets pairs of tiles, so neither
    a large kind nor a large block is one task's. The number of tasks follows that of the pairs.
    Chunks are written to the checkpoint folder, as both sides read them."""
    checkpoints(rows.sparkSession)
    rows = rows.withColumn("_kind", F.xxhash64(*block, *columns))  # deals only; equal hashes stay apart below
    many = rows.groupBy("_kind").agg(F.count("*").alias("_n")).where(F.col("_n") > chunk)
    part = F.when(F.col("_n").isNull(), 0).otherwise(F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / chunk)))
    chunks = rows.join(many, "_kind", "left").withColumn("_part", part).groupBy(*block, *columns, "_kind", "_part").agg(F.collect_list(F.struct(key, *lists)).alias("_m"))
    chunks = chunks.select("*", *(F.col(f"_m.{c}").alias(f"_all_{c}") for c in (key, *lists))).drop("_m")
    chunks = chunks.withColumn("_lo", F.array_min(f"_all_{key}")).withColumn("_hi", F.array_max(f"_all_{key}")).checkpoint()
    sizes = chunks.groupBy(*block).agg(F.sum(F.size(f"_all_{key}")).alias("_n"))
    pairs = sizes.agg(F.sum(F.col("_n").cast("double") * F.col("_n"))).first()[0] or 0.0
    tasks = int(min(max(1, pairs // 2 // TASK_PAIRS), 100_000))
    tiled = chunks.join(sizes, block).withColumn("_tiles", F.ceil(F.col("_n") / tile).cast("int"))
    tiled = tiled.withColumn("_tile", F.pmod(F.xxhash64("_kind", "_part"), F.col("_tiles")).cast("int"))
    others, kept = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)), (*columns, *(f"_all_{c}" for c in (key, *lists)), "_lo", "_hi")
    cell = [*(f"_b{i}" for i in range(len(block))), "_i", "_j"]

    def side(x: str, own: str, other: str) -> DataFrame:
        d = tiled.select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(block)), F.col("_tile").alias(own), others.alias(other), *(F.col(c).alias(f"{c}_{x}") for c in kept))
        return d.repartition(tasks, *cell)

    return side("a", "_i", "_j").join(side("b", "_j", "_i"), cell).where("_lo_a < _hi_b")


def _part_table(rows: DataFrame, columns: list[str], outcome: Column):
    """(values with _id, their number, outcomes by pairs of ids, row by row, as numbers, and for each
    number its outcome and a pair of values), or None where the values are many."""
    spark, values = rows.sparkSession, rows.select(*columns).distinct()
    got = values.limit(PART_VALUES + 1).collect()
    if len(got) > PART_VALUES:
        return None
    ids = spark.createDataFrame([(*r, i) for i, r in enumerate(got)], T.StructType([*values.schema, T.StructField("_id", T.IntegerType())])).coalesce(1)
    a, b = (ids.select(*(F.col(c).alias(f"{c}_{x}") for c in ids.columns)) for x in "ab")
    numbers, examples, flat = {}, [], [0] * len(got) ** 2
    for i, j, v in a.crossJoin(F.broadcast(b)).select("_id_a", "_id_b", outcome).collect():
        if v not in numbers:
            numbers[v] = len(numbers)
            examples.append((v, (*got[i], *got[j])))
        flat[i * len(got) + j] = numbers[v]
    return ids, len(got), flat, examples


def _scored_by_parts(rows: DataFrame, key: str, block: list[str], score: Callable[[DataFrame], DataFrame], parts: list[tuple[list[str], Column]], chunk: int, tile: int) -> DataFrame | None:
    """scored_pairs where every part but the first has few values, else None. Kinds are of the first
    part only; the others' outcomes stand in tables over pairs of values, and `score` sees one pair
    for each combination of outcomes."""
    spark, (wide, wide_outcome), a, b = rows.sparkSession, parts[0], f"{key}_a", f"{key}_b"
    tables = []
    for columns, outcome in parts[1:]:
        if (found := _part_table(rows, columns, outcome)) is None:
            return None
        tables.append(found)
    for n, ((columns, _), (ids, *_)) in enumerate(zip(parts[1:], tables)):
        ids = ids.select(*(F.col(c).alias(f"_v{i}") for i, c in enumerate(columns)), F.col("_id").alias(f"_id{n}"))
        rows = rows.join(F.broadcast(ids), reduce(and_, (F.col(c).eqNullSafe(F.col(f"_v{i}")) for i, c in enumerate(columns)))).drop(*(f"_v{i}" for i in range(len(columns))))
    lists = [f"_id{n}" for n in range(len(tables))]
    cells = _cells(rows.select(key, *block, *wide, *lists), key, block, wide, lists, chunk, tile).withColumn("_o", wide_outcome)
    if found := _part_table(rows, wide, wide_outcome):
        wides = found[3]
    else:
        example = F.first(F.struct(*(f"{c}_{x}" for x in "ab" for c in wide))).alias("e")
        wides = [(r["_o"], tuple(r["e"])) for r in cells.groupBy("_o").agg(example).limit(PART_SCORES + 1).collect()]
    sizes = [len(wides), *(len(t[3]) for t in tables)]
    if not wides:
        return rows.select(F.col(key).alias(a), F.col(key).alias(b), F.lit(0.0).alias("score")).limit(0)
    if prod(sizes) > PART_SCORES:
        return None
    combined = [(n, *(v for _, values in es for v in values)) for n, es in enumerate(product(wides, *(t[3] for t in tables)))]
    kinds = {f.name: f.dataType for f in cells.schema} | {f"{f.name}_{x}": f.dataType for t in tables for f in t[0].schema for x in "ab"}
    names = [f"{c}_{x}" for columns, _ in parts for x in "ab" for c in columns]
    of = dict(score(spark.createDataFrame(combined, T.StructType([T.StructField("_n", T.IntegerType()), *(T.StructField(c, kinds[c]) for c in names)]))).select("_n", "score").collect())
    step = [prod(sizes[n + 1 :]) for n in range(len(sizes))]
    flat = [[v * s for v in t[2]] for t, s in zip(tables, step[1:])]
    one = spark.createDataFrame([(*flat, [of[n] for n in range(len(combined))])], ", ".join([*(f"_t{n} array<int>" for n in range(len(flat))), "_s array<double>"]))
    base = F.coalesce(*(F.when(F.col("_o").eqNullSafe(F.lit(o)), n * step[0]) for n, (o, _) in enumerate(wides)))
    both = cells.withColumn("_base", base).crossJoin(F.broadcast(one))
    right = [f"_all_{c}_b" for c in (key, *lists)]
    left = both.select("_base", *one.columns, *right, *(f"_all_{c}_a" for c in lists), F.posexplode(f"_all_{key}_a").alias("_p", a))
    left = left.select(a, "_base", *one.columns, *right, *((F.get(f"_all_{c}_a", F.col("_p")) * t[1]).alias(f"_r{n}") for n, (c, t) in enumerate(zip(lists, tables))))
    spread = left.select(*left.columns, F.posexplode(f"_all_{key}_b").alias("_q", b)).where(F.col(a) < F.col(b))
    at = sum((F.get(f"_t{n}", F.col(f"_r{n}") + F.get(f"_all_{c}_b", F.col("_q"))) for n, c in enumerate(lists)), F.col("_base"))
    return spread.select(a, b, F.get("_s", at).alias("score"))


def scored_pairs(df: DataFrame, key: str, block: list[str], columns: list[str], score: Callable[[DataFrame], DataFrame], chunk: int = CHUNK, tile: int = TILE, parts: list[tuple[list[str], Column]] | None = None) -> DataFrame:
    """(key_a, key_b, score): the pairs of blocked_pairs, scored by what `score` adds to its columns.
    Rows that agree in block and columns are of one kind: kinds are paired and scored, and only then
    spread to their members. `parts` splits the columns by what the score takes from each: columns,
    and an expression of their _a and _b that decides it (the first a number). Where the parts after
    the first have few values, rows alike in the first are enough for a kind."""
    rows = df.select(key, *block, *columns).where(" AND ".join(f"`{c}` IS NOT NULL" for c in (key, *block)))
    if parts and (found := _scored_by_parts(rows, key, block, score, parts, chunk, tile)) is not None:
        return found
    a, b = f"{key}_a", f"{key}_b"
    scored = score(_cells(rows, key, block, columns, [], chunk, tile)).select(f"_all_{key}_a", f"_all_{key}_b", "score")
    return scored.select(F.explode(f"_all_{key}_a").alias(a), f"_all_{key}_b", "score").select(a, F.explode(f"_all_{key}_b").alias(b), "score").where(F.col(a) < F.col(b))


def fill_only(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Left join that copies fields only where the left one is null or empty."""
    r = right.select(key, *(F.col(f).alias(f"_r_{f}") for f in fields))
    j = left.join(r, key, "left")
    out = []
    for c in left.columns:
        empty = F.col(c).isNull() | (F.col(c).cast("string") == "")
        out.append(F.when(empty, F.col(f"_r_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c))
    return j.select(*out)


def token_set_match(queries: DataFrame, known: DataFrame) -> DataFrame:
    """(query, gid): same surname and one given-name set within the other, if only one fits.
    Both sides hold key, surname and tokens; known also gid."""
    j = queries.select(F.col("key").alias("query"), "surname", F.col("tokens").alias("qt")).join(known.select("gid", "surname", F.col("tokens").alias("kt")), "surname")
    fit = j.where((F.size(F.array_except("qt", "kt")) == 0) | (F.size(F.array_except("kt", "qt")) == 0))
    return fit.groupBy("query").agg(F.count_distinct("gid").alias("n"), F.min("gid").alias("gid")).where("n = 1").select("query", "gid")


def cascade(queries: DataFrame, levels: list[tuple[str, str, DataFrame]], key: str = "query") -> DataFrame:
    """(key, gid, level): each query's answer at its first level that has exactly one. A level is
    (name, query column, table of (k, gid))."""
    found = None
    for n, (name, column, known) in enumerate(levels):
        one = known.groupBy("k").agg(F.count_distinct("gid").alias("_n"), F.min("gid").alias("gid")).where("_n = 1")
        hit = queries.join(one, F.col(column) == F.col("k")).select(key, "gid", F.lit(name).alias("level"), F.lit(n).alias("_rank"))
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy(key).agg(F.min_by(F.struct("gid", "level"), "_rank").alias("m"))
    return queries.select(key).join(best, key, "left").select(key, "m.gid", "m.level")


def grams(c: Column) -> Column:
    """Bigrams of a text, each with its number among its equals, so that repeats count."""
    n = F.length(c) - 1
    plain = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(c, i, F.lit(2)))).otherwise(F.array(c))
    return F.transform(plain, lambda g, i: F.concat(g, F.size(F.filter(F.slice(plain, F.lit(1), i + 1), lambda x: x == g)).cast("string")))


def close_names(left: DataFrame, right: DataFrame, ratio: float) -> DataFrame:
    """(l, r): all pairs of distinct texts of left.l and right.r whose sequence ratio may reach
    `ratio`, and a few others. Texts of n and m letters with that ratio differ in (1 - ratio)(n + m)
    insertions and deletions at most, and each costs two bigrams, so a text of n letters shares
    (4 ratio - 3) n - 1 of its bigrams with any partner: one of the others and the rarest is enough
    to list. Rarity is counted over the right side."""
    keep = 4 * ratio - 3

    def listed(df: DataFrame, c: str) -> DataFrame:
        n = F.length(c)
        must = F.greatest(F.lit(1), F.ceil(keep * n - 1))
        g = df.select(c, F.explode(grams(F.col(c))).alias("g")).join(rare, "g", "left")
        by = g.groupBy(c).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g"))).alias("gs"))  # a text's own bigrams
        return by.select(c, F.explode(F.slice("gs", F.lit(1), F.greatest(F.lit(1), F.size("gs") - must + 1).cast("int"))).alias("x")).select(c, "x.g")

    rare = right.select(F.explode(grams(F.col("r"))).alias("g")).groupBy("g").agg(F.count("*").alias("df"))
    return listed(left, "l").join(listed(right, "r"), "g").select("l", "r").distinct()


def nearest(left: DataFrame, right: DataFrame, name: str, year: str, least: float = 0.85, key: str = "ord") -> DataFrame:
    """(key, found, score) for each left row: the right row of the same name in any case, if its
    year agrees or the left one has none (score 1, smallest key); else the one with the highest
    sequence ratio times 1, 0.9 or 0.6 for years equal, at most two apart, or farther (1 if either
    is null), if that reaches `least`; ties go to the smaller key. Equal names and years are
    compared once."""
    plain = F.lower(names.squeeze(names.latinise(F.col(name))))
    q = left.select(F.col(key).alias("key"), F.lower(name).alias("low"), plain.alias("l"), F.col(year).alias("y"))
    k = right.groupBy(F.lower(name).alias("k_low"), plain.alias("r"), F.col(year).alias("k_y")).agg(F.min(key).alias("id"))
    d = q.select("low", "l", "y").distinct()
    exact = d.join(k, (F.col("low") == F.col("k_low")) & (F.col("y").isNull() | (F.col("y") == F.col("k_y")))).groupBy("low", "l", "y").agg(F.min("id").alias("exact"))
    rest = d.join(exact.select(F.col("low").alias("_a"), F.col("y").alias("_y")), (F.col("low") == F.col("_a")) & F.col("y").eqNullSafe(F.col("_y")), "left_anti")
    pairs = close_names(rest.select("l").distinct(), k.select("r").distinct(), least)
    pairs = pairs.withColumn("ratio", S.sequence_ratio(F.col("r"), F.col("l"))).where(F.col("ratio") >= least)
    gap = F.abs(F.col("y") - F.col("k_y"))
    factor = F.when(gap.isNull() | (gap == 0), 1.0).when(gap <= 2, 0.9).otherwise(0.6)
    scored = rest.join(pairs, "l").join(k, "r").withColumn("score", F.col("ratio") * factor).where(F.col("score") >= least)
    fuzzy = scored.groupBy("low", "l", "y").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("m"))
    found = exact.select("low", "l", "y", F.col("exact").alias("found"), F.lit(1.0).alias("score")).unionByName(fuzzy.select("low", "l", "y", F.col("m.id").alias("found"), F.round("m.score", 9).alias("score")))
    f = found.select(F.col("low").alias("_a"), F.col("l").alias("_l"), F.col("y").alias("_y"), "found", "score")
    return q.join(f, (F.col("low") == F.col("_a")) & (F.col("l") == F.col("_l")) & F.col("y").eqNullSafe(F.col("_y"))).select(F.col("key").alias(key), "found", "score")


def similar(df: DataFrame, name: str, least: float = 0.7, top: int = 10) -> DataFrame:
    """(name, other, score, rank): of each distinct name the most similar others by the mixed
    score, in both directions. Candidates share a bigram; of names without one, the sequence part
    is near zero and the score cannot reach 0.7."""
    d = df.select(F.col(name).alias("name")).distinct()
    g = d.select("name", F.explode(F.array_distinct(F.transform(grams(F.lower("name")), lambda x: F.substr(x, F.lit(1), F.lit(2))))).alias("g"))
    half = g.alias("a").join(g.alias("b"), "g").where("a.name < b.name").select(F.col("a.name").alias("x"), F.col("b.name").alias("y")).distinct()
    s = half.withColumn("score", F.round(S.composite(F.col("x"), F.col("y")), 9)).where(F.col("score") >= least)
    both = s.select(F.col("x").alias("name"), F.col("y").alias("other"), "score").unionAll(s.select("y", "x", "score"))
    w = Window.partitionBy("name").orderBy(F.desc("score"), "other")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def duplicate_parts() -> list[tuple[list[str], Column]]:
    """What duplicate_score takes from its columns, for scored_pairs."""
    same = F.lower("name_a") == F.lower("name_b")
    close = S.char_overlap(F.lower("name_a"), F.lower("name_b")) > 0.8
    gap = F.abs(F.col("birth_a") - F.col("birth_b"))
    return [
        (["name"], F.when(same, 0.4).when(close, 0.3).otherwise(0.0)),
        (["birth"], F.when(gap == 0, 0.2).when(gap <= 2, 0.1).otherwise(0.0)),
        (["country", "keys"], F.struct((0.3 * S.jaccard(F.col("keys_a"), F.col("keys_b"))).alias("keys"), F.when(F.col("country_a") == F.col("country_b"), 0.1).otherwise(0.0).alias("country"))),
    ]


def duplicate_score(pairs: DataFrame) -> DataFrame:
    """Pairs with name_a, name_b, birth_a, birth_b, keys_a, keys_b (arrays), country_a,
    country_b: weights for equal or close names, years, shared keys and country."""
    (_, name), (_, birth), (_, rest) = duplicate_parts()
    return pairs.withColumn("score", F.round(name + birth + rest["keys"] + rest["country"], 6))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge per student and advisor key: sources united, the highest confidence wins, a
    small bonus for each further source, at most 0.99."""
    g = edges.groupBy("student", "advisor").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.max("confidence").alias("top"))
    n = F.size("sources")
    return g.select("student", "advisor", "sources", F.round(F.least(F.lit(0.99), F.col("top") + F.least(F.lit(0.06), 0.02 * (n - 1))), 6).alias("confidence"), (n > 1).alias("verified"))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
