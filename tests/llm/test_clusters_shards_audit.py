"""Centroid clustering, sharding and the divergence audit against plain versions, with their defined cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandloom.llm import clustering, divergence, queries, sharding
from strandloom.llm.common import table

SF = "/root/testdata/sf0.001"
CLASH = ", cluster string, distance string, weight string, part string, place string, shard string, slot string, term string, g string, v string, node string, `key` string"


# ---------------------------------------------------------------- 11 centroid clustering


def clusters_by_hand(rows, k, rounds, scale, width):
    """(id, cluster, distance) of the usable rows and the last centroids, in Python's integers."""
    kept = [(i, [int(np.floor(scale * x)) if abs(scale * x) < 2**53 else int(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        own = defaultdict(list)
        for (_, v), (_, n) in zip(kept, assign()):
            own[n].append(v)
        cents = [[sum(col) // len(own[n]) for col in zip(*own[n])] if n in own else c for n, c in enumerate(cents)]
    return [(i, n, d) for (i, _), (d, n) in zip(kept, assign())], cents


def check_clusters(got, want, cents):
    top = 2**63 - 1
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == Counter((i, n, min(d, top)) for i, n, d in want)
    inertia = Counter()
    for _, n, d in want:
        inertia[n] += min(d, top)
    for r in got:
        assert r.cluster_inertia == min(inertia[r.cluster], top) and r.inertia == min(sum(inertia.values()), top)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cents[r.cluster])).encode()).hexdigest()


@pytest.mark.parametrize(("seed", "spread"), [(1, 0.02), (2, 3.0), (3, 1e-9)])
def test_clusters_equal_brute_force(spark, seed, spread):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        v = [round(rng.choice([-1, 0, 2]) + rng.gauss(0, spread), 2) for _ in range(4)]
        rows.append((i, v))
        if i % 9 == 0:
            rows.append((i, v if i % 2 else [x + 1 for x in v]))  # repeated rows, and ids with two vectors
    rows += [(None, [1.0, 2.0, 3.0, 4.0]), (900, None), (901, [1.0, None, 0.0, 0.0]), (902, [float("nan")] * 4), (903, [float("inf")] * 4), (904, [1.0] * 3), (905, [])]
    df = spark.createDataFrame([(*r, *"x" * 12) for r in rows], "vec_id long, embedding array<double>" + CLASH).repartition(5)
    got = clustering.cluster_vectors(df, k=12, rounds=4, scale=256, width=4).collect()
    check_clusters(got, *clusters_by_hand(rows, 12, 4, 256, 4))


def test_clusters_of_huge_components_and_of_few_rows(spark):
    rows = [(i, [1e30 * (i % 3), -3.4e38 if i % 5 == 0 else 2.0**40 + i, 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    check_clusters(clustering.cluster_vectors(df, k=5, rounds=3, scale=256, width=3).collect(), *clusters_by_hand(rows, 5, 3, 256, 3))
    few = clustering.cluster_vectors(df.limit(2), k=5, rounds=2, scale=256, width=3)
    assert few.count() == 2 and few.select("cluster").distinct().count() == 2
    assert clustering.cluster_vectors(df.limit(0), k=5, rounds=2, scale=256, width=3).count() == 0


def test_annulus_keeps_ties_and_leaves_out_the_rest():
    ring = [[3, 4], [5, 0], [0, 5], [-5, 0], [50, 0], [0, 100]]
    search = clustering.Annulus(ring)
    number, distance = search.nearest(np.array([[0.0, 0.0], [60.0, 0.0], [0.0, 99.0]]))
    assert number.tolist() == [0, 4, 5] and distance == [25, 100, 1]  # four at the same distance: the smallest number
    v = np.array([[0.0, 100.0]])
    low, high = search._candidates(v, np.array([100.0]))
    assert high[0] - low[0] == 1  # the annulus of a vector on its centroid holds that alone


# ---------------------------------------------------------------- 12 sharding


def check_shards(rows, got, n, tolerance):
    size = [len((t or "").encode()) + 16 for _, t in rows]
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, s, zlib.crc32((t or "").encode())) for (i, t), s in zip(rows, size))
    slots = defaultdict(list)
    total = Counter()
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < n and r.grown_shard is None
        slots[r.shard].append(r.slot)
        total[r.shard] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(total.values()) - min(total[s] for s in range(n)) <= tolerance
    return total


def shard_rows(rows):
    return [(i, t, rng, src, *"x" * 12) for i, t, rng, src in rows]


DOCS = "doc_id long, text string, lang string, source string" + CLASH


def test_shards_are_even_whatever_is_hot(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        text = "the one text of all" if i % 3 == 0 else f"found {i // 500} times" if i % 100 == 1 else None if i % 50 == 1 else "x" * rng.randrange(0, 400)
        rows.append((i % 2900, text, rng.choice(["en", "en", "en", None, ""]), "hot" if i % 2 else f"s{i % 7}"))
    df = spark.createDataFrame(shard_rows(rows), DOCS).repartition(6)
    got = sharding.shard_documents(df, shards=7)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = got.collect()
    check_shards([r[:2] for r in rows], got, 7, 1500)
    # copies of a light text share a shard; the hot one is spread
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    assert len(where[zlib.crc32(b"the one text of all")]) == 7
    assert all(len(where[zlib.crc32(f"found {i} times".encode())]) == 1 for i in range(6))


def tree_by_hand(units, dims, first, shards, out):
    """Plain k-d tree over (keys by dimension, weight) with the operator's keys: cut where the weight is nearest to its goal."""
    if shards == 1:
        out.update({u[0]: first for u in units})
        return
    wide = max(range(dims), key=lambda d: ((max(u[1][d] for u in units) >> 32) - (min(u[1][d] for u in units) >> 32), -d))
    units = sorted(units, key=lambda u: u[1][wide])
    goal = sum(u[2] for u in units) * (shards // 2) / shards
    upto, best = 0, (goal, 0)
    for n, u in enumerate(units, 1):
        upto += u[2]
        best = min(best, (abs(upto - goal), n))
    n = best[1]
    tree_by_hand(units[:n], dims, first, shards // 2, out)
    tree_by_hand(units[n:], dims, first + shards // 2, shards - shards // 2, out)


def test_tree_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sharding, "EXACT", 10**9)  # narrow down to one key
    monkeypatch.setattr(sharding, "BINS", 64)
    docs = table(spark, SF, "documents")
    slim = sharding._slim(docs, False)
    none = spark.createDataFrame([], "h1 long, h2 long, pieces long")
    keyed = sharding._keys(sharding._units(slim, none)[1]).cache()
    units = [((r.h1, r.h2), tuple(r[f"k_{d}"] for d in sharding.DIMENSIONS), r.weight) for r in keyed.collect()]
    want = {}
    tree_by_hand(units, len(sharding.DIMENSIONS), 0, 13, want)
    tree = sharding.build_tree(keyed, 13)
    got = keyed.mapInArrow(lambda it: sharding._shard_of(it, tree), "h1 long, h2 long, piece long, shard int").collect()
    assert {(r.h1, r.h2): r.shard for r in got} == want and len(set(want.values())) == 13


def test_shards_of_few_rows_and_with_whole_rows(spark):
    rows = [(1, "a", "en", "s"), (1, "a", "en", "s"), (None, None, None, None), (2, "b" * 100_000, "de", "t")]
    df = spark.createDataFrame(shard_rows(rows), DOCS)
    got = sharding.shard_documents(df, shards=40, carry=True)
    assert Counter((r["row"]["text"], r["row"]["term"]) for r in got.collect()) == Counter((t, "x") for _, t, *_ in rows)
    check_shards([r[:2] for r in rows], got.collect(), 40, 10**6)
    assert sharding.shard_documents(df.limit(0), shards=40).count() == 0
    one = sharding.shard_documents(df, shards=1).collect()
    assert {r.shard for r in one} == {0}


# ---------------------------------------------------------------- 13 source divergence audit


def audit_by_hand(rows, min_docs, top):
    """All rows of the audit from (text, lang, source), in plain Python."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", src or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(fold)))) for t, lang, src in rows]
    out = set()
    share = lambda c, n, v: 1 + 10**9 * (c + 2) // (n + 2 * v)
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in d[2])
        kept = [t for t in df if df[t] >= min_docs]
        v, groups = len(kept), defaultdict(Counter)
        for _, src, c in own:
            groups[src].update({t: c[t] for t in c if df[t] >= min_docs})
        both = sum(groups.values(), Counter())
        p = {s: {t: share(c[t], sum(c.values()), v) for t in kept} for s, c in groups.items()}
        q = {t: share(both[t], sum(both.values()), v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", o, -x, r) for r, (x, _, o) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", t, -x, r) for r, (x, _, t) in enumerate(sorted(terms)[:top], 1)}
    return out


@pytest.mark.parametrize(("light", "blocks"), [(0, 64), (3, 4), (100, 64)])
def test_audit_equals_brute_force(spark, monkeypatch, light, blocks):
    """All terms heavy, all light, and both, with several blocks of groups and several tiles."""
    monkeypatch.setattr(divergence, "BLOCK_GROUPS", blocks)
    monkeypatch.setattr(divergence, "TILE_TERMS", 5)
    rng = random.Random(7)
    words = ["alpha", "Beta", "GAMMA", "déjà", "Été", "日本", "e9f", "x_y", "gß"] + [f"w{chr(97 + i)}q" for i in range(20)]
    rows = [(None, None, None), ("", "en", "s0"), ("12 34", "en", "silent"), ("alone here", "xx", "one")]
    for i in range(400):
        src = f"s{min(rng.randrange(14), rng.randrange(14))}"
        some = rng.sample(words, 8) if src > "s4" else words[:6] + rng.sample(words, 3)
        rows.append((" ".join(rng.choices(some, k=rng.randrange(0, 12))), rng.choice(["en", "en", "de", None]), src if i % 30 else None))
    rows += [("rare " * 300 + "alpha", "en", "s1")] * 12
    df = spark.createDataFrame([(i % 50, *r, *"x" * 12) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string" + CLASH).repartition(4)
    got = divergence.audit(df, min_docs=10, light=light, terms=10).collect()
    got_set = {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got}
    assert len(got_set) == len(got) and got_set == audit_by_hand(rows, 10, 10)


def test_audit_of_nothing_and_of_long_shares(spark):
    none = table(spark, SF, "documents").limit(0)
    assert divergence.audit(none).count() == 0
    rng = random.Random(8)
    cases = [(rng.randrange(2 * 10**15), 2 * 10**15 + rng.randrange(10**15)) for _ in range(50)] + [(0, 0), (0, 2), (5 * 10**15 - 2, 5 * 10**15)]
    df = spark.createDataFrame(cases, "c long, d long")
    from pyspark.sql import functions as F

    got = [r.p for r in df.select(divergence.share(F.col("c"), F.col("d")).alias("p")).collect()]
    assert got == [1 + (10**9 * (c + 2) // d if d else 0) for c, d in cases]


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_sharding", "op13_source_divergence"])
def test_queries_are_registered(name):
    assert name in queries.QUERIES and (name in queries.SQL) == (name != "op12_sharding")
