"""The training-data operators against brute force, and on odd inputs."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from velarium.llm import _common, cover_tree, lm_scoring, mixing, packing, quality_model, quality_rules, queries, simhash, suffix_dedup, token_counts, toxicity

SF = "/root/testdata/sf0.001"
needs = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in parent}


# ------------------------------------------------------------------ shared helpers
def test_words_match_the_pattern():
    texts = ["  a bb\tccc\n", None, "", "é ü\x0bx", "one"]
    w = _common.Words(pa.array(texts))
    got = [x.decode() for x in w.array().to_pylist()]
    assert got == [m for t in texts for m in WORD.findall(t or "")]
    assert np.diff(w.bounds).tolist() == [len(WORD.findall(t or "")) for t in texts]
    sliced = pa.array(["skip", *texts]).slice(1)
    assert len(_common.Words(sliced)) == len(w)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(5, None)]
    got = dict(rows(_common.components(spark.createDataFrame(pairs, "a int, b int"))))
    want = groups({n for p in pairs for n in p if n is not None}, [p for p in pairs if None not in p])
    assert got == {n: c for n, c in want.items() if any(n in p and p[0] != p[1] and None not in p for p in pairs)}


# ------------------------------------------------------------------ 1 embeddings
@pytest.mark.parametrize("block", [40, 8192])
def test_near_vectors_equal_brute_force(spark, block):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 16))
    x = np.concatenate([centers[rng.integers(0, 12, 150)] + 0.25 * rng.normal(size=(150, 16)), rng.normal(size=(40, 16))]).astype(np.float32)
    x[7], x[8] = x[3], 2 * x[3]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [float("inf")] + [1.0] * 15), (504, [None] + [1.0] * 15), (505, [1.0, 0.0]), (506, [])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    comp = groups(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(near))])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cover_tree.near_vectors(df, block=block).collect()}
    assert got == {**{i: (int(near[i].sum()) - 1, comp[i], comp[i] == i) for i in range(len(x))}, **{i: (0, i, True) for i in range(500, 507)}}


def test_near_vectors_of_nothing(spark):
    assert cover_tree.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    nulls = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    assert rows(cover_tree.near_vectors(nulls).select("n_links", "component_id")) == [(2, 3)] * 3


def test_vectors_go_to_few_blocks(spark):
    """Clusters far apart: each vector is sent about once, however many blocks there are."""
    rng = np.random.default_rng(5)
    centers = np.eye(32)[:16]
    x = np.repeat(centers, 100, axis=0) + 0.01 * rng.normal(size=(1600, 32))
    df = spark.createDataFrame([(i, v.tolist(), "k", 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, uid string, v int")
    got = cover_tree.near_vectors(df, block=100)
    assert {(r["n_links"], r["component_id"]) for r in got.collect()} == {(99, 100 * i) for i in range(16)}


# ------------------------------------------------------------------ 2, 5 classifiers
def corpus(spark, bad, n=600):
    rng = random.Random(4)
    out = []
    for i in range(n):
        w = ["".join(rng.choice(["an", "the", "or", "ing", "st", "on", "re"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 60))]
        y = i % 3 == 0
        out.append((i, bad(rng, w) if y else " ".join(w), int(y)))
    return spark.createDataFrame(out, "id bigint, text string, y int")


def test_toxicity_finds_gapped_insults(spark):
    insults = ["idiot", "moron", "scum", "clown"]

    def bad(rng, w):
        w[rng.randrange(len(w))] = rng.choice(insults)
        return " ".join(w)

    model = toxicity.fit(corpus(spark, bad))
    texts = ["the onan an idiot restan", "the onan an i.d.i.o.t restan", "the an i d i o t restan", "the onan an idxiot restan", "the onan an or restan", "", None]
    p = model.score(pa.array(texts))
    assert (p[:4] > 0.3).all()
    assert (p[4:] < 0.3).all()
    assert ((p >= 0) & (p <= 1)).all()


def test_toxicity_learns_sentences_of_several_words(spark):
    """No word of the insult is bad alone: clean texts hold each of them, in different sentences."""
    parts = ["garbage", "person", "nobody"]

    def sentence(rng, some):
        w = [rng.choice(["the", "on", "restan", "oring", "stanre", "anon"]) for _ in range(6)]
        for x in some:
            w.insert(rng.randrange(len(w)), x)
        return " ".join(w) + "."

    rng = random.Random(8)
    rows = []
    for i in range(700):
        y = i % 3 == 0
        texts = [sentence(rng, parts if y and k == 2 else [rng.choice(parts)] if rng.random() < 0.5 else []) for k in range(5)]
        rows.append((i, " ".join(texts), int(y)))
    df = spark.createDataFrame(rows, "id bigint, text string, y int")
    model = toxicity.fit(df.where("id < 500"))
    held = rows[500:]
    p = model.score(pa.array([r[1] for r in held]))
    pos, neg = p[[bool(r[2]) for r in held]], p[[not r[2] for r in held]]
    assert np.mean(pos[:, None] > neg[None, :]) > 0.9


def test_sentences_end_with_their_sign_or_text():
    texts = pa.array(["a b. c", None, "", "d! e", "f"])
    w = toxicity.Words(texts, lower=True)
    assert toxicity.sentences_of(w, texts).tolist() == [0, 0, 1, 2, 3, 4]


def test_samples_are_bounded_by_bytes(spark):
    from velarium.llm._labels import labelled_sample

    docs = spark.createDataFrame([(i, "x" * (10 if i % 2 else 1000)) for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    whole = labelled_sample(docs, labels, "toxic", F.lit(False))
    assert whole.count() == 40
    some = labelled_sample(docs, labels, "toxic", F.lit(False), most_bytes=5000)
    assert 0 < some.agg(F.sum(F.length("text"))).first()[0] <= 5000
    assert labelled_sample(docs.limit(0), labels, "toxic", F.lit(False)).count() == 0


def test_quality_separates_junk(spark):
    def bad(rng, w):
        return rng.choice([lambda: " ".join(x + "%%%" for x in w), lambda: " ".join(x.upper() + "!!" for x in w), lambda: " ".join([w[0]] * len(w))])()

    sample = corpus(spark, bad).withColumn("y", 1 - F.col("y"))
    model = quality_model.fit(sample.where("id < 450"))
    held = sample.where("id >= 450").collect()
    p = model.score(pa.array([r["text"] for r in held]))
    assert np.mean((p >= 0.5) == np.array([r["y"] == 1 for r in held])) > 0.95
    assert len(model.score(pa.array([None, "", "x" * 100_000]))) == 3


def test_one_label_only(spark):
    one = spark.createDataFrame([(1, "a b c", 1), (2, "d e", 1)], "id bigint, text string, y int")
    for m in (toxicity, quality_model):
        for sample in (one, one.limit(0)):
            p = m.fit(sample).score(pa.array(["a b", None]))
            assert ((p >= 0) & (p <= 1)).all()


@pytest.mark.parametrize("module", [toxicity, quality_model])
def test_classifiers_on_odd_rows(spark, odd, none, module):
    sample = corpus(spark, lambda rng, w: " ".join(x.upper() + "!!" for x in w))
    model = module.fit(sample)
    score = toxicity.toxicity_scores if module is toxicity else quality_model.quality_scores
    got = score(odd, model).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got) == sorted((r["doc_id"] is None, r["doc_id"]) for r in odd.select("doc_id").collect())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 2}) == 1  # repeated rows score alike
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4)}) == 1  # null is empty
    assert score(none, model).count() == 0


def test_quality_of_many_shapes_needs_little_memory():
    import tracemalloc

    rng = random.Random(31)
    texts = pa.array([" ".join("".join(rng.choice("aA0.,!|%") for _ in range(rng.randint(4, 12))) for _ in range(12)) for _ in range(10_000)])
    index = quality_model.index_vectors()
    units = quality_model.Units(texts)
    assert len(units.kinds) > 20_000
    tracemalloc.start()
    got = quality_model.pooled(units, index, index, index)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 30
    one = quality_model.pooled(quality_model.Units(texts.slice(77, 1)), index, index, index)
    assert got[77] == pytest.approx(one[0], abs=1e-5)


# ------------------------------------------------------------------ 3 simhash
def fingerprint(text):
    w = WORD.findall(lower(text))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_fingerprints(odd):
    got = simhash.fingerprints(odd).collect()
    want = Counter(np.uint64(fingerprint(r["text"])).view(np.int64).item() for r in odd.select("text").collect())
    assert Counter(r["fp"] for r in got) == want


@pytest.mark.parametrize("bucket", [1, 3, 64])
def test_near_pairs_connect_exactly(spark, bucket):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(15)]
    fps = set(base)
    for b in base:
        for _ in range(12):
            fps.add(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2]
    want = {n: c for n, c in groups(signed, links).items() if any(n in p for p in links)}
    got = dict(rows(_common.components(simhash.near_pairs(spark.createDataFrame([(f,) for f in signed], "fp bigint"), bucket))))
    assert got == want


@pytest.mark.parametrize("bucket", [2, 64])
def test_stage_links_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(16)
    texts, line = [], [f"common{i}" for i in range(12)]
    for _ in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 40, 120]))] + line
        for _ in range(8):
            w = list(words)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    far = [p for p in links if bin(fingerprint(texts[p[0]]) ^ fingerprint(texts[p[1]])).count("1") > 2]
    assert far  # links that two bits of 64 miss
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert dict(rows(simhash.similar_documents(docs))) == groups(range(len(texts)), links)


def test_stage_turns_leave_settled_lists(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 2)
    written, sizes = simhash.written, []

    def counted(df):
        out = written(df)
        if out.columns == ["token", "node", "size", "pos", "c"]:
            sizes.append((out.count(), out.groupBy("token").agg(F.count_distinct("c").alias("n")).where("n = 1").count()))
        return out

    monkeypatch.setattr(simhash, "written", counted)
    rng = random.Random(17)
    texts = []
    for _ in range(10):
        words = [f"w{rng.randrange(3000)}" for _ in range(160)]
        for _ in range(10):
            w = list(words)
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += [" ".join(f"common{j}" for j in range(12)) + f" a{i} b{i}" for i in range(8)]  # share a list and stay apart
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = dict(rows(simhash.similar_documents(docs)))
    assert got == {i: i - i % 10 if i < 100 else i for i in range(108)}
    assert len(sizes) > 1 and any(n for _, n in sizes)  # several turns, and lists that are settled
    assert sizes[-1][0] < sizes[0][0] and not sizes[-1][1]


def test_simhash_on_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {r["component_id"] for r in got if r["doc_id"] == 2} == {1}
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 4, 5)} == {3}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert 2 not in [r["doc_id"] for r in kept.collect()]
    assert simhash.near_duplicates(none).count() == 0


# ------------------------------------------------------------------ 4 token counts
def test_token_counts_equal_longest_match(odd, none, tmp_path):
    path = token_counts.default_vocabulary()
    vocabulary = set(token_counts.vocabulary(path)) | {bytes([i]) for i in range(256)}

    def greedy(word):
        w, n, i = b" " + word.encode(), 0, 0
        while i < len(w):
            j = next(j for j in range(len(w), i, -1) if w[i:j] in vocabulary)
            i, n = j, n + 1
        return n

    got = sorted(r["n_tokens"] for r in token_counts.count_tokens(odd.where("doc_id IS NULL OR doc_id <> 6"), path).collect())
    assert got == sorted(sum(map(greedy, WORD.findall(r["text"] or ""))) for r in odd.where("doc_id IS NULL OR doc_id <> 6").collect())
    assert token_counts.count_tokens(none, path).count() == 0


def test_automaton_with_nested_tokens():
    tokens = [b" a", b" abc", b"abcd", b"bc", b"cde", b"ab"]
    auto = token_counts.Automaton(tokens)
    vocabulary = set(tokens) | {bytes([i]) for i in range(256)}
    rng = random.Random(8)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    data, offsets = _common.bytes_of(pa.array(words))
    want = []
    for w in words:
        b, n = b" " + w.encode(), 0
        while b:
            k = next(k for k in range(len(b), 0, -1) if b[:k] in vocabulary)
            b, n = b[k:], n + 1
        want.append(n)
    assert auto.lengths(data, offsets).tolist() == want


# ------------------------------------------------------------------ 6 quality rules
def test_quality_base_counts(odd, none):
    got = quality_rules.judged(odd).select("_row.doc_id", "_row.text", "_verdict.*").collect()
    assert len(got) == odd.count()
    for r in got:
        x = r["text"] or ""
        w = WORD.findall(x)
        seen = Counter(zip(w, w[1:], w[2:]))
        cover = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [t for t in x.split("\n") if WORD.search(t)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), len(lines) - len(set(lines)), len(cover))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
    assert quality_rules.quality_filter(odd).columns == odd.columns
    assert quality_rules.quality_filter(none).count() == 0


def test_quality_rules_reject_symbols_and_keep_prose(spark):
    rng = random.Random(9)
    words = "the and of to in that is for with this from stone river house green walk light over under".split()
    prose = [(i, " ".join(rng.choice(words) + ("." if j % 9 == 8 else "") for j in range(300)), "en") for i in range(60)]
    junk = [(100, " ".join(w + "%%%" for w in prose[0][1].split()), "en"), (101, prose[1][1].upper().replace(" ", "!! "), "en")]
    kept = {r["doc_id"] for r in quality_rules.quality_filter(spark.createDataFrame(prose + junk, "doc_id bigint, text string, lang string")).collect()}
    assert kept == set(range(60))


# ------------------------------------------------------------------ 7 mixing
@pytest.mark.parametrize("seed", range(3))
def test_sainte_lague_equals_highest_quotients(spark, seed):
    rng = random.Random(seed)
    c = [rng.choice([0, 1, 5, rng.random() * 100, rng.randint(1, 1000)]) for _ in range(50)]
    n = rng.choice([7, 60, 555])
    got = {r["k"]: r["seats"] for r in mixing.sainte_lague(spark.createDataFrame([(i, float(x)) for i, x in enumerate(c)], "k int, c double"), ["k"], "c", n).collect()}
    best = sorted((-x / (2 * k + 1), i) for i, x in enumerate(c) if x for k in range(n))[:n]
    assert got == {i: sum(j == i for _, j in best) for i in range(len(c))}


def test_mix_targets_and_limits(spark):
    rng = random.Random(11)
    data = [(i, " ".join(["w"] * rng.randint(0, 200)), rng.choice(["a", "b", "c", "d", None])) for i in range(400)]
    m = mixing.mix(spark.createDataFrame(data, "doc_id bigint, text string, source string"), shard_words=2000, block=16)
    got = m.collect()
    size = Counter()
    for _, t, s in data:
        size[s] += len(t.split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, rest = {}, dict(weight), 1.5 * sum(size.values())
    while True:
        level = rest / sum(free.values())
        over = [s for s in free if level * free[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            rest -= target[s]
            del free[s]
    target |= {s: level * w for s, w in free.items()}
    taken = Counter()
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in order:
        assert taken[s] == pytest.approx(target[s], rel=0.02)
    again = mixing.mix(spark.createDataFrame(data, "doc_id bigint, text string, source string").repartition(7), shard_words=2000, block=16)
    assert rows(m) == rows(again)


def test_mix_on_odd_rows(odd, none):
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0
    assert mixing.mixed(none).count() == 0


def test_mixed_tells_rows_apart(spark):
    """Equal in id and text, different in source: both stay what they are, and reruns agree."""
    text = " ".join(["w"] * 300)
    data = [(1, text, "a", "en"), (1, text, "b", "de"), (2, text, "a", "en"), (2, text, "a", "en"), (None, text, "a", "en"), (3, None, "a", "en")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string, lang string").withColumn("extra", F.create_map(F.lit("k"), F.col("lang")))
    got = rows(mixing.mixed(df).drop("extra"))
    assert {r for r in got} <= {r for r in data}
    assert {(1, text, "a", "en"), (1, text, "b", "de")} <= {r for r in got}
    assert got == rows(mixing.mixed(df.repartition(5)).drop("extra"))


# ------------------------------------------------------------------ 8 language model
def tree_scores(train, texts, depth=lm_scoring.DEPTH):
    """Log10 probabilities by the definition, one dictionary entry for each node."""
    count, below = Counter(), {}

    def decisions(text):
        data = bytes([lm_scoring.PAD] * depth) + lower(text).encode() + bytes([lm_scoring.END])
        for i in range(depth, len(data)):
            node = 1
            for k in range(8):
                bit = data[i] >> (7 - k) & 1
                yield data[i - depth : i][::-1], node, bit
                node = 2 * node + bit

    for text in train:
        for context, node, bit in decisions(text):
            for d in range(depth + 1):
                count[context[:d], node, bit] += 1
                if d < depth:
                    below.setdefault((context[:d], node), set()).add(context[: d + 1])

    def own(c, node):
        a, b = count[c, node, 0], count[c, node, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    weighted = {}

    def log_weighted(c, node):
        if (c, node) not in weighted:
            x = own(c, node)
            if len(c) < depth:
                y = sum(log_weighted(k, node) for k in below.get((c, node), ()))
                x = max(x, y) + math.log1p(math.exp(-abs(x - y))) + math.log(0.5)
            weighted[c, node] = x
        return weighted[c, node]

    out = []
    for text in texts:
        total = 0.0
        for context, node, bit in decisions(text):
            mixed, left, one = 0.0, 1.0, 0.5
            for d in range(depth + 1):
                c = context[:d]
                n = count[c, node, 0] + count[c, node, 1]
                if not n:
                    break
                estimate = (count[c, node, 1] + 0.5) / (n + 1)
                one = mixed + left * estimate
                if d < depth:
                    w = math.exp(own(c, node) + math.log(0.5) - log_weighted(c, node))
                    mixed, left = mixed + left * w * estimate, left * (1 - w)
            total += math.log10(one if bit else 1 - one)
        out.append(total)
    return out


def lm_texts():
    rng = random.Random(3)
    words = "the cat sat on mat and a dog ran éà".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))), i % 4 == 1) for i in range(60)]
    return [*rows, (60, None, False), (61, "", True), (62, "ZZZ top", True)]


@pytest.mark.parametrize("block", [700, 8 << 20])
def test_scores_equal_the_definition(spark, block):
    docs = lm_texts()
    df = spark.createDataFrame(docs, "doc_id bigint, text string, h boolean").repartition(3)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.scored(df, "h", block_bytes=block).collect()}
    want = tree_scores([t for _, t, h in docs if not h], [t for _, t, _ in docs])
    assert got == {i: pytest.approx(w, rel=1e-4) for (i, _, _), w in zip(docs, want)}


def test_parts_of_a_group_give_the_same(spark, monkeypatch):
    """One group, and subtrees one by one."""
    docs = lm_texts()
    df = spark.createDataFrame(docs, "doc_id bigint, text string, h boolean")
    want = {r["doc_id"]: r["score"] for r in lm_scoring.scored(df, "h").collect()}
    whole = lm_scoring._subtrees
    monkeypatch.setattr(lm_scoring, "MAX_GROUPS", 1)
    monkeypatch.setattr(lm_scoring, "_subtrees", lambda k, n: whole(k, n, 1))
    got = {r["doc_id"]: r["score"] for r in lm_scoring.scored(df, "h").collect()}
    assert got == {i: pytest.approx(x, rel=1e-4) for i, x in want.items()}


def test_scores_of_other_texts(spark):
    corpus = spark.createDataFrame([(i, "the cat sat on the mat. " * 5, 1) for i in range(20)], "doc_id bigint, text string, n int")
    docs = spark.createDataFrame([(1, "the cat sat on the mat. "), (None, "xq zvk wjp qqz xxv kkj. "), (3, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in lm_scoring.lm_scores(docs, corpus).collect()}
    assert got[1]["score"] > got[None]["score"] + 20
    assert got[3]["n_bytes"] == 1
    assert got[1]["bits_per_byte"] == pytest.approx(-got[1]["score"] / math.log10(2) / 25)


def test_kt_of_large_counts():
    a, b = np.array([0, 5, 20_000, 3_000_000]), np.array([0, 1, 7, 40_000])
    want = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.lgamma(x + y + 1) - math.log(math.pi) for x, y in zip(a.tolist(), b.tolist())]
    assert lm_scoring.log_kt(a, b) == pytest.approx(want, rel=1e-9)


def check_base(docs, got, held):
    counts = Counter()
    tokens = {r["doc_id"]: [*WORD.findall(lower(r["text"])), "\n"] for r in docs}
    for i, w in tokens.items():
        if not held(i):
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    for r in got:
        w = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] < 0


@needs
def test_lm_base_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    check_base(docs, queries.QUERIES["op8_lm_scoring"](spark, SF).collect(), lambda i: zlib.crc32(str(i).encode()) % 7 == 2)


def test_lm_on_odd_rows(odd, none):
    docs = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).withColumn("h", F.col("doc_id") == 9)
    check_base(docs.collect(), lm_scoring.scored(docs, "h").collect(), lambda i: i == 9)
    assert lm_scoring.scored(odd.withColumn("h", F.lit(True)), "h").count() == odd.count()
    assert lm_scoring.scored(none.withColumn("h", F.lit(False)), "h").count() == 0


# ------------------------------------------------------------------ 9 passages
def passages(docs):
    """{id: (n_bytes, n_removed, n_spans, sha256)} by definition; ids distinct."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda r: (r[0] is None, r[0])):
        b = (text or "").encode()
        own = [b[k : k + 50] for k in range(len(b) - 49)]
        gone = [False] * len(b)
        for k, w in enumerate(own):
            if w in seen:
                gone[k : k + 50] = [True] * 50
        seen.update(own)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("hot", "groups"), [(1, 1024), (4096, 1024), (4096, 2)])
def test_passages_equal_definition(spark, hot, groups):
    """With hot minimizers, with many groups, and with few groups of several parts."""
    rng = random.Random(12)
    shared = ["".join(rng.choice("abcd é") for _ in range(rng.randint(40, 300))) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = ["".join(rng.choice("abcd é") for _ in range(rng.randint(0, 120)))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 20)
            parts += [s[a : len(s) - rng.randint(0, 20)], rng.choice(["", "x", "yz" * 60])]
        docs.append((i, "".join(parts)))
    docs += [(60, docs[3][1]), (61, None), (62, ""), (63, "ab" * 400), (64, "ab" * 300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    out, name = suffix_dedup.judged(df, block_bytes=3000, bucket_bytes=2000, part_bytes=1000, hot=hot, max_groups=groups)
    got = {r["doc_id"]: tuple(r[name])[:4] for r in out.collect()}
    assert got == passages(docs)


@pytest.mark.parametrize("shard", [20, 60, 10_000])
def test_merged_transforms(shard):
    rng = random.Random(shard)
    segments = list(dict.fromkeys(bytes(rng.choice(b"ab") for _ in range(rng.randint(12, 18))) for _ in range(60)))
    least = np.array([rng.randrange(30) for _ in segments])
    s, o = suffix_dedup.repeated_windows(segments, least, length=12, shard_bytes=shard)
    smallest = {}
    for k, x in enumerate(segments):
        for i in range(len(x) - 11):
            smallest[x[i : i + 12]] = min(smallest.get(x[i : i + 12], 99), least[k])
    want = {(k, i) for k, x in enumerate(segments) for i in range(len(x) - 11) if smallest[x[i : i + 12]] < least[k]}
    assert set(zip(s.tolist(), o.tolist())) == want


def test_passages_on_odd_rows(odd, none):
    out = suffix_dedup.remove_passages(odd)
    assert out.columns == odd.columns
    assert out.count() == odd.count()
    assert suffix_dedup.remove_passages(none).count() == 0
    assert [r["text"] for r in out.where("doc_id = 2").collect()] == ["", ""]


# ------------------------------------------------------------------ 10 packing
def test_pieces_round_trip(odd, none):
    from tokenizers import Tokenizer

    args = packing.public_byte_bpe()
    slow = Tokenizer.from_file(args["tokenizer_path"])
    docs = odd.dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = packing.pack_documents(docs, window=4, **args).collect()
    filled, covered = Counter(), Counter()
    spans = {}
    for r in got:
        ids = [*slow.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert r["doc_tokens"] == len(ids)
        part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(part.tobytes())
        covered[r["doc_id"]] += r["length"]
        filled[r["sequence_id"]] += r["length"]
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert covered == Counter({i: len(slow.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()})
    assert max(filled.values()) <= 1024
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
    assert packing.pack_documents(none, **args).count() == 0


@needs
def test_small_partitions_are_packed_together(spark):
    """The sequences are as full from many small partitions as from one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")

    def fill(df):
        total, sequences = df.selectExpr("sum(length)", "count(distinct sequence_id)").first()
        return total / 1024 / sequences

    args = packing.public_byte_bpe()
    many = fill(packing.pack_documents(docs.repartition(40), **args))
    assert fill(packing.pack_documents(docs, **args)) > 0.95
    assert many > 0.95


def test_dot_product_is_the_heuristic():
    """Against a plain loop that fills one bin after another."""
    rng = np.random.default_rng(17)
    sizes = np.stack([rng.integers(1, 60, 80), np.ones(80, int), rng.integers(0, 40, 80)], axis=1)
    cap = np.array([100, 4, 70])
    demand = sizes.sum(axis=0) / cap / len(sizes)
    left, want, b = list(range(80)), {}, 0
    while left:
        room = np.ones(3)
        while True:
            fits = [i for i in left if (sizes[i] / cap <= room + 1e-12).all()]
            if not fits:
                break
            best = max(fits, key=lambda i: (round(float((sizes[i] / cap * demand) @ room), 12), *(-x for x in sizes[i]), -i))
            want[best] = b
            room = room - sizes[best] / cap
            left.remove(best)
        b += 1
    where, _ = packing.dot_product_pack(sizes, cap)
    used = lambda w: sorted(tuple(sorted(map(tuple, sizes[[i for i in range(80) if w[i] == k]].tolist()))) for k in set(w))
    assert used([want[i] for i in range(80)]) == used(where.tolist())


def test_dot_product_keeps_all_limits():
    rng = np.random.default_rng(13)
    tokens = rng.integers(1, 800, 500)
    sizes = np.stack([tokens, np.ones(500, int), rng.integers(0, tokens + 1)], axis=1)
    where, place = packing.dot_product_pack(sizes, np.array([1024, 4, 600]) if sizes[:, 2].max() <= 600 else np.array([1024, 4, 800]))
    limit = [1024, 4, 600 if sizes[:, 2].max() <= 600 else 800]
    for b in np.unique(where):
        assert (sizes[where == b].sum(axis=0) <= limit).all()
        assert sorted(place[where == b]) == list(range((where == b).sum()))


def test_examples_over_a_limit_stand_apart(spark):
    df = spark.createDataFrame([(1, 10, 5), (2, 5000, 5), (3, None, None), (None, 7, 7)], "id bigint, tokens bigint, loss_tokens bigint")
    got = {r["id"]: r["sequence_id"] for r in packing.pack_examples(df.coalesce(1)).collect()}
    assert got[2] is None
    assert got[1] == got[3] == got[None] == 0


def test_fast_ids_equal_the_file():
    args = packing.public_byte_bpe()
    tok = packing.TextTokenizer(*args.values())
    rng = random.Random(14)
    alphabet = "abc XYZ 019 .,;'!\n\t\r\x0b  éüßñ\xa0\x85don'tI'll"
    for _ in range(300):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert tok.ids(t) == tok.slow.encode(t, add_special_tokens=False).ids


# ------------------------------------------------------------------ pipeline
@needs
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = _common.written(stage(spark, docs, SF))
        assert docs.columns == columns, name
        now = {r["doc_id"] for r in docs.collect()}
        assert now <= ids, name
        ids = now
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_on_odd_rows(spark, odd, none, tmp_path):
    import corpus_pipeline

    for df in (odd, none):
        docs = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = _common.written(stage(spark, docs, str(tmp_path)))
            assert docs.columns == df.columns, name
        last = _common.written(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)))
        assert (last.count() > 0) == (docs.count() > 0)


@needs
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_equivalents(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    r = c.execute(queries.ORACLES[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.select(*columns)) == sorted(r.fetchall(), key=repr)
