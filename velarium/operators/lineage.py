"""Advisor graphs: cleaning, lineage, cycles, components and centrality. Paths are a
recursive query; walks iterate over frames of distinct pairs written to the checkpoint folder."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoints

#: Nodes outside trees up to which betweenness starts from each; beyond, from PIVOTS of them.
EXACT_NODES, PIVOTS = 10_000, 256


def clean_edges(edges: DataFrame) -> DataFrame:
    """Edges without self loops, without either direction of mutual pairs, each once."""
    e = edges.where("student <> advisor").distinct()
    back = e.select(F.col("student").alias("b"), F.col("advisor").alias("a"))
    return e.join(back, (F.col("student") == F.col("a")) & (F.col("advisor") == F.col("b")), "left_anti")


def walks(edges: DataFrame, up: bool, depth: int, root: int | None = None) -> DataFrame:
    """(root, node, depth): all nodes within `depth` steps of each root, or of one, at their least
    depth."""
    start = edges.select(F.col("student" if up else "advisor").alias("node")).distinct()
    return frontier(edges, start if root is None else start.where(F.col("node") == root), up, depth)


def paths(edges: DataFrame, root: int, up: bool, depth: int) -> DataFrame:
    """(path, length): every path of at most `depth` steps from one node, in which no node repeats,
    as an array. One recursive query; their number can grow with the power of the depth."""
    a, b = ("student", "advisor") if up else ("advisor", "student")
    edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct().createOrReplaceTempView("_path_edges")
    return edges.sparkSession.sql(f"""
      WITH RECURSIVE w(node, length, path) MAX RECURSION LEVEL {depth + 2} AS (
        SELECT b, 1, array(a, b) FROM _path_edges WHERE a = {int(root)} AND a <> b
        UNION ALL
        SELECT e.b, w.length + 1, concat(w.path, array(e.b)) FROM w JOIN _path_edges e ON w.node = e.a
        WHERE w.length < {depth} AND NOT array_contains(w.path, e.b))
      SELECT path, length FROM w""")


def frontier(edges: DataFrame, roots: DataFrame, up: bool, depth: int) -> DataFrame:
    """The same from given roots only, by joins of the frontier with the edges; for wide graphs.
    Each step's new pairs are checkpointed, so the plan stays short."""
    checkpoints(edges.sparkSession)
    a, b = ("student", "advisor") if up else ("advisor", "student")
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).checkpoint()
    seen = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"))
    last = seen
    for d in range(1, depth + 1):
        new = last.join(e, F.col("node") == F.col("a")).select("root", F.col("b").alias("node")).distinct()
        last = new.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(d)).checkpoint()
        if last.isEmpty():
            break
        seen = seen.unionByName(last)  # steps already written
    return seen.where("depth > 0")


def cycle_pairs(edges: DataFrame, most: int) -> DataFrame:
    """(node, length): nodes on a cycle of at most `most` steps, with the shortest length. Distinct
    pairs by steps, as in `frontier`: a recursive query stops at a million rows. A root that came
    back goes no farther, and a pair that was seen is on no shorter way."""
    checkpoints(edges.sparkSession)
    e = edges.select(F.col("student").alias("a"), F.col("advisor").alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct().checkpoint()
    last = e.select(F.col("a").alias("root"), F.col("b").alias("node"), F.lit(1).alias("depth"))
    back, seen = last.where("root = node"), last
    for d in range(2, most + 1):
        done = back.select(F.col("root").alias("done"))
        on = last.join(done, F.col("root") == F.col("done"), "left_anti").join(e, F.col("node") == F.col("a")).select("root", F.col("b").alias("node")).distinct()
        last = on.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(d)).checkpoint()
        if last.isEmpty():
            break
        seen, back = seen.unionByName(last), back.unionByName(last.where("root = node"))  # steps already written
    return back.select(F.col("root").alias("node"), F.col("depth").alias("length"))


def peel(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """Edges left after nodes without outgoing ones are taken away again and again: empty exactly
    if the graph has no cycle."""
    checkpoints(edges.sparkSession)
    e = edges.select("student", "advisor").distinct().checkpoint()
    for _ in range(rounds):
        out = e.select(F.col("student").alias("s")).distinct()
        rest = e.join(out, F.col("advisor") == F.col("s"), "left_semi").checkpoint()
        if rest.count() == e.count():
            return rest
        e = rest
    raise RuntimeError("peeling did not settle")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in, ratio): ratio is the degree over the number of nodes."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("student").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("advisor").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    g = ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    n = g.agg(F.count("*").alias("n"))
    return g.join(F.broadcast(n)).select("node", "n_out", "n_in", F.round((F.col("n_out") + F.col("n_in")) / F.col("n"), 9).alias("ratio"))


def components(edges: DataFrame, a: str, b: str, rounds: int = 100) -> DataFrame:
    """(node, component): least node reachable. Labels take the least of their neighbours' and
    then of their label's label, so long paths halve each round."""
    checkpoints(edges.sparkSession)
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionAll(edges.select(F.col(b), F.col(a))).distinct().checkpoint()
    label = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("l")).checkpoint()
    for _ in range(rounds):
        near = both.join(label.withColumnRenamed("x", "n"), F.col("y") == F.col("n")).groupBy("x").agg(F.min("l").alias("m"))
        new = label.join(near, "x").select("x", F.least("l", "m").alias("l"))
        jump = new.select(F.col("x").alias("k"), F.col("l").alias("ll"))
        new = new.join(jump, F.col("l") == F.col("k"), "left").select("x", F.least("l", F.coalesce("ll", "l")).alias("l")).checkpoint()
        if new.join(label.withColumnRenamed("l", "old"), "x").where("l <> old").isEmpty():
            return new.select(F.col("x").alias("node"), F.col("l").alias("component"))
        label = new
    raise RuntimeError("components did not settle")


def fold_leaves(edges: DataFrame, rounds: int = 64) -> tuple[DataFrame, list[DataFrame]]:
    """(rest, folded): nodes with one neighbour are folded into it, again and again. Rows are (node,
    deg, other, m, sq): neighbours left, their ids by exclusive or (of a leaf: its neighbour), nodes
    folded into it with itself, and the sum of squares of its folded branches. folded has one frame
    for each round; of a forest the rest is one node a tree. A long path leaves some for later."""
    checkpoints(edges.sparkSession)
    both = edges.select(F.col("student").alias("node"), F.col("advisor").alias("o")).unionAll(edges.select("advisor", "student")).where("node <> o").distinct()
    one = F.lit(1).cast("bigint")
    rest = both.groupBy("node").agg(F.count("*").alias("deg"), F.bit_xor("o").alias("other")).withColumns({"m": one, "sq": one - 1}).checkpoint()
    folded = []
    for _ in range(rounds):
        got = rest.where("deg = 1").groupBy(F.col("other").alias("to")).agg(F.count("*").alias("k"), F.bit_xor("node").alias("x"), F.sum("m").alias("dm"), F.sum(F.col("m") * F.col("m")).alias("ds"))
        # a leaf that got something is one of two joined to each other only: the smaller stays
        stays = (F.col("deg") != 1) | (F.col("k").isNotNull() & (F.col("node") < F.col("other")))
        new = rest.join(got, F.col("node") == F.col("to"), "left").withColumn("stays", stays).checkpoint()
        gone = new.where("NOT stays").select(*rest.columns)
        if gone.isEmpty():
            break
        folded.append(gone)
        more = {"deg": F.col("deg") - F.coalesce("k", one - 1), "other": F.col("other").bitwiseXOR(F.coalesce("x", one - 1)), "m": F.col("m") + F.coalesce("dm", one - 1), "sq": F.col("sq") + F.coalesce("ds", one - 1)}
        rest = new.where("stays").withColumns(more).select(*rest.columns)
    return rest.checkpoint(), folded


def betweenness(edges: DataFrame, most_edges: int = 5_000_000, exact_nodes: int | None = EXACT_NODES) -> DataFrame:
    """(node, score, exact): shortest-path betweenness, undirected. Trees are folded first and
    counted exactly by the sizes of their branches, as frames. What is left, the core, is walked
    from every node up to exact_nodes of them (None: always), else scaled from PIVOTS chosen by
    hash; `exact` says which. Starts are dealt over tasks; the core's edges go to each, so their
    number is checked."""
    rest, folded = fold_leaves(edges)
    core = rest.where("deg > 0")
    known, part, exact = rest.where("deg = 0").select("node", "m", "sq", F.col("m").alias("n")), None, True
    if not core.isEmpty():
        at = [core.select(F.col("node").alias(c)) for c in ("student", "advisor")]
        e = edges.select(F.least("student", "advisor").alias("student"), F.greatest("student", "advisor").alias("advisor")).where("student <> advisor").distinct().join(at[0], "student", "left_semi").join(at[1], "advisor", "left_semi").checkpoint()
        of = components(e, "student", "advisor").join(core, "node")
        whole = of.groupBy("component").agg(F.sum("m").alias("n"))
        known = known.unionByName(of.join(whole, "component").select("node", "m", "sq", "n").checkpoint())
        part, exact = _walked(e, core.select("node", "m"), most_edges, exact_nodes)
    m, n, sq = F.col("m"), F.col("n"), F.col("sq")
    score = ((m - 1) * (m - 1) - sq) / 2 + (m - 1) * (n - m)
    known = known.select("node", "n", score.alias("score"))
    for gone in reversed(folded):  # a folded node's other side is all but its own
        up = known.select(F.col("node").alias("up"), "n")
        known = known.unionByName(gone.join(up, F.col("other") == F.col("up")).select("node", "n", score.alias("score")).checkpoint())
    if part is not None:
        known = known.join(part, "node", "left").withColumn("score", F.col("score") + F.coalesce("part", F.lit(0.0)))
    return known.select("node", F.round(F.col("score").cast("double"), 6).alias("score")).withColumn("exact", F.lit(exact))


def _walked(e: DataFrame, masses: DataFrame, most_edges: int, exact_nodes: int | None) -> tuple[DataFrame, bool]:
    """(node, part) by walks from the nodes of `masses` (node, m), each of which counts m times as an
    end of paths, and whether from all."""
    spark = e.sparkSession
    if e.count() > most_edges:
        raise ValueError("too many edges to send to every task")
    table, mass = e.toPandas(), masses.toPandas()
    sent = spark.sparkContext.broadcast((table["student"].to_numpy(), table["advisor"].to_numpy(), mass["node"].to_numpy(), mass["m"].to_numpy()))
    n = len(mass)
    exact = exact_nodes is None or n <= exact_nodes
    pivots = masses.select("node") if exact else masses.select("node").orderBy(F.xxhash64("node"), "node").limit(PIVOTS)
    scale = 1.0 if exact else n / min(n, PIVOTS)

    def work(batches):
        students, advisors, *weights = (v.tolist() for v in sent.value)
        near: dict[int, list[int]] = {}
        for x, y in zip(students, advisors):
            near.setdefault(x, []).append(y)
            near.setdefault(y, []).append(x)
        m = dict(zip(*weights))
        total: dict[int, float] = {}
        for b in batches:
            for s in b["node"].tolist():
                dist, paths, before, order = {s: 0}, {s: 1.0}, {s: []}, [s]
                for v in order:
                    for w in near[v]:
                        if w not in dist:
                            dist[w], paths[w], before[w] = dist[v] + 1, 0.0, []
                            order.append(w)
                        if dist[w] == dist[v] + 1:
                            paths[w] += paths[v]
                            before[w].append(v)
                share = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in before[w]:
                        share[v] += paths[v] / paths[w] * (m[w] + share[w])
                    if w != s:
                        total[w] = total.get(w, 0.0) + m[s] * share[w]
        yield pd.DataFrame({"node": list(total), "part": list(total.values())})

    parts = pivots.repartition("node").mapInPandas(work, "node bigint, part double")
    return parts.groupBy("node").agg((F.sum("part") * scale / 2).alias("part")), exact


def integrity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rule, violations): self loops, mutual pairs, repeated edges, advisors without a node."""
    e = edges.select("student", "advisor")
    d = e.distinct()
    back = d.select(F.col("student").alias("b"), F.col("advisor").alias("a"))
    return (
        e.agg(F.count_if(F.col("student") == F.col("advisor")).alias("n")).select(F.lit("self_loop").alias("rule"), "n")
        .unionAll(d.where("student < advisor").join(back, (F.col("student") == F.col("a")) & (F.col("advisor") == F.col("b")), "left_semi").agg(F.count("*")).select(F.lit("mutual"), "count(1)"))
        .unionAll(e.groupBy("student", "advisor").agg((F.count("*") - 1).alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0)).alias("n")).select(F.lit("repeated"), "n"))
        .unionAll(d.select("advisor").distinct().join(nodes.select(F.col("node")), F.col("advisor") == F.col("node"), "left_anti").agg(F.count("*")).select(F.lit("dangling"), "count(1)"))
        .withColumnRenamed("n", "violations")
    )


def gini(df: DataFrame, value: str) -> DataFrame:
    """Equal values are counted first, so the ordered pass sees one row for each distinct value."""
    g = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum(F.col("v") * F.col("n")).over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = g.select("v", "n", (F.col("n") * before + F.col("v") * F.col("n") * (F.col("n") + 1) / 2).alias("c"))
    return r.agg(F.round((F.sum("n") + 1 - 2 * F.sum("c") / F.sum(F.col("v") * F.col("n"))) / F.sum("n"), 9).alias("gini"))


def resolve(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(student, target, found): each advisor reference by id, else by name in lower case, else a
    shadow node of its name. edges: student, ref; nodes: gid, name."""
    by_id = nodes.select(F.col("gid").alias("_i")).distinct()
    by_name = nodes.groupBy(F.lower("name").alias("_n")).agg(F.min("gid").alias("_g"))
    j = edges.join(by_id, F.col("ref") == F.col("_i"), "left").join(by_name, F.lower("ref") == F.col("_n"), "left")
    found = F.when(F.col("_i").isNotNull(), "id").when(F.col("_g").isNotNull(), "name").otherwise("shadow")
    return j.select("student", F.coalesce("_i", "_g", F.concat(F.lit("SHADOW::"), "ref")).alias("target"), found.alias("found"))


def coherence(degree: DataFrame) -> DataFrame:
    """Mean of positive scores and how many are high (over .8) and medium (over .5)."""
    s = F.col("score")
    return degree.agg(F.round(F.avg(F.when(s > 0, s)), 9).alias("mean"), F.count_if(s > 0.8).alias("high"), F.count_if((s > 0.5) & (s <= 0.8)).alias("medium"), F.count_if(s <= 0.5).alias("low"))
