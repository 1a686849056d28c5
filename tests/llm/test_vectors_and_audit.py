"""Top-k search, filter audit and clustering against brute force, and on awkward rows."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunledger.llm import clustering, filter_audit, top_k

NAN, INF = float("nan"), float("inf")


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# -- vectors -------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, shard string, place string, vector string, query_row string, score string, distance string, cluster string, inertia string"


def random_vectors(n, seed, width=64, kinds=7, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(kinds, width))
    return [[float(np.float32(v)) for v in centres[i % kinds] + spread * rng.normal(size=width)] for i in range(n)]


@pytest.fixture(scope="module")
def vectors(spark):
    """Nulls, NaN, infinities, other lengths, one vector that a third of all rows share, repeated rows, null ids, large components."""
    found = list(enumerate(random_vectors(400, 1)))
    hot = random_vectors(1, 2)[0]
    found += [(1000 + i, hot) for i in range(230)] + [(700, hot), (700, hot), (None, hot), (None, found[3][1]), (5, found[5][1]), (5, found[6][1])]
    odd = found[0][1]
    found += [(2000, None), (2100, []), (2200, [None] + odd[1:]), (2300, [NAN] + odd[1:]), (2400, [INF] + odd[1:]), (2500, odd[:30]), (2600, odd + [1.0, 2.0]), (2700, [-INF]), (2800, [0.0] * 64), (2900, [-0.0] * 64)]
    return spark.createDataFrame([(i, v, 0, *"zzzzzzzz") for i, v in found], VECTORS).repartition(5).cache()


def whole(row, scale):
    v = row["embedding"]
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(scale * x) for x in v]


def brute_top_k(source, k=10, asks=lambda i: i is not None and i % 100 == 0):
    known = [(r["vec_id"], v) for r in source if (v := whole(r, 1024)) is not None]
    out = []
    for q, x in known:
        if asks(q):
            scores = sorted((-sum(a * b for a, b in zip(x, y)), i is None, i or 0) for i, y in known if i != q)
            out += [(q, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(scores[:k])]
    return Counter(out)


def found_top_k(df, **options):
    return Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(top_k.top_k(df, F.col("vec_id") % 100 == 0, **options)))


def test_top_k(vectors):
    want = brute_top_k(rows(vectors))
    assert found_top_k(vectors) == want
    assert found_top_k(vectors, shard=40) == want  # many shards: limits are shared between them
    assert found_top_k(vectors, k=3) == brute_top_k(rows(vectors), 3)


def test_top_k_of_few_rows(spark, vectors):
    assert found_top_k(vectors.limit(0)) == Counter()
    alone = spark.createDataFrame([(100, [1.0, 2.0]), (None, [3.0]), (7, [-1.0, 0.5])], "vec_id long, embedding array<double>")
    assert found_top_k(alone) == Counter({(100, 1, None, 3 * 1024 * 1024): 1, (100, 2, 7, 0): 1})
    assert found_top_k(spark.createDataFrame([(100, [1.0])], "vec_id long, embedding array<double>")) == Counter()


def test_top_k_of_large_components(spark):
    """Beyond what float64 holds exactly."""
    rng = random.Random(3)
    found = [(i, [float(rng.randint(-(2**40), 2**40)), 2.0**30 + rng.randint(0, 3)]) for i in range(60)]
    df = spark.createDataFrame([(i * 20, v) for i, v in found], "vec_id long, embedding array<double>")
    want = Counter({(q, n, i, max(min(s, 2**63 - 1), -(2**63))): c for (q, n, i, s), c in brute_top_k(rows(df)).items()})
    got = found_top_k(df)
    assert sum(got.values()) == sum(want.values())
    assert Counter((q, n, s) for q, n, _, s in got) == Counter((q, n, s) for q, n, _, s in want)
    small = spark.createDataFrame([(i * 20, [x / 2**20 for x in v]) for i, v in found], "vec_id long, embedding array<double>")
    assert found_top_k(small) == brute_top_k(rows(small))


def test_repeated_rows_stay_few(spark):
    """A row that is repeated thousands of times doesn't fill a shard."""
    df = spark.createDataFrame([(i % 2 * 100, [1.0 + i % 2]) for i in range(6000)], "vec_id long, embedding array<double>").repartition(3)
    got = found_top_k(df, k=4)
    assert set(got) == {(0, n, 100, 2 * 1024 * 1024) for n in range(1, 5)} | {(100, n, 0, 2 * 1024 * 1024) for n in range(1, 5)}
    assert set(got.values()) == {3000}
    kept = sum(len(b) for b in top_k._few_copies(4)(iter(df.select("vec_id", F.col("embedding").alias("vector"), F.xxhash64("vec_id", "embedding").alias("place")).toArrow().to_batches())))
    assert kept < 100


def test_ball_tree_leaves_out(spark):
    """On clustered vectors most leaves are never scanned, and the result is that of a plain search."""
    x = np.floor(1024 * np.array(random_vectors(6000, 4, kinds=60, width=24, spread=0.1))).astype(np.int64)
    tree = top_k.BallTree(x, np.arange(len(x)), np.zeros(len(x), bool), 10)
    scanned, scan = [], tree._scan
    tree._scan = lambda queries, r, *more: scanned.append(len(r)) or scan(queries, r, *more)
    row, ids, _, scores = tree.search(x[:50], np.arange(50), np.full(50, -np.inf), 10)
    assert sum(scanned) < 0.5 * 50 * tree.leaf.sum()
    for q in range(50):
        plain = sorted((-int(x[q] @ y), i) for i, y in enumerate(x) if i != q)[:10]
        assert [(-int(s), int(i)) for s, i in zip(scores[row == q], ids[row == q])] == plain


# -- clustering ----------------------------------------------------------------------------------


def brute_clusters(source, k=16, rounds=3):
    known = [(r["vec_id"], [math.floor(64 * x) for x in r["embedding"]]) for r in source if r["embedding"] is not None and len(r["embedding"]) == 64 and whole(r, 64) is not None]
    raw = {tuple(math.floor(64 * x) for x in r["embedding"]): r["embedding"] for r in source if r["embedding"] is not None and len(r["embedding"]) == 64 and whole(r, 64) is not None}
    digest = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, _, v in sorted((digest(i), raw[tuple(v)], v) for i, v in known)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in known]

    for _ in range(rounds):
        groups = defaultdict(list)
        for (_, v), (_, n) in zip(known, assign()):
            groups[n].append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if groups[n] else c for n, c in enumerate(centroids)]
    found = assign()
    each = Counter()
    for d, n in found:
        each[n] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, n, d, each[n], sum(each.values()), sha[n]) for (i, _), (d, n) in zip(known, found))


def found_clusters(df, **options):
    return Counter(tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in rows(clustering.cluster(df, **options)))


def test_clustering(vectors):
    assert found_clusters(vectors) == brute_clusters(rows(vectors))


def test_clusters_of_few_rows(spark, vectors):
    assert found_clusters(vectors.limit(0)) == Counter()
    assert clustering.cluster(vectors.limit(0)).columns == clustering.cluster(vectors).columns
    few = vectors.filter("vec_id in (1, 2, 2800, 2900)")  # the last two are equal once rounded
    assert found_clusters(few) == brute_clusters(rows(few))


def test_clusters_of_large_components(spark):
    """Sums of squares beyond int64 on the way: exact, and null where a long can't hold the result."""
    base = random_vectors(40, 5)
    df = spark.createDataFrame([(i, [x * 2.0**14 for x in v]) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    assert found_clusters(df, k=4) == brute_clusters(rows(df), 4)
    beyond = spark.createDataFrame([(i, [x * 2.0**40 for x in v]) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    got, want = found_clusters(beyond, k=4), brute_clusters(rows(beyond), 4)
    assert Counter((r[0], r[1], r[5]) for r in got) == Counter((r[0], r[1], r[5]) for r in want)
    assert all(r[4] is None for r in got)


def test_transform_and_pruning():
    x = np.random.default_rng(6).integers(-500, 500, (300, 64))
    t = clustering.transform(x)
    assert ((t**2).sum(axis=1) == 64 * (x**2).sum(axis=1)).all()
    assert (t[:, 0] == x.sum(axis=1)).all()  # the coarsest coefficient is the sum
    smooth = np.cumsum(x, axis=1)  # most of the energy is coarse
    number, distance, work = clustering.nearest(smooth, smooth[:16])
    plain = ((smooth[:, None, :] - smooth[None, :16]) ** 2).sum(axis=2)
    assert (number == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()
    assert work < 0.5 * 300 * 16 * 64
    number, distance, _ = clustering.nearest(x[:5], np.repeat(x[:1], 16, axis=0))
    assert (number == 0).all()  # ties go to the smaller number


# -- filter audit --------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, block string, shared string, suspect string, part string, mask string, n string, good string, toxic string"


@pytest.fixture(scope="module")
def audited(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    texts = [(i, " ".join(word() for _ in range(rng.choice([3, 150, 199, 200, 260])))) for i in range(150)]
    long = " ".join(word() for _ in range(40_000))
    texts += [(1000, None), (1001, ""), (1002, ""), (1003, long), (1004, long), (1005, "A" * 3 + "b" * 97), (1006, "A" * 4 + "b" * 96), (1007, "É" * 50), (1008, "a b c\td\ne" * 60), (1009, "50% of $1"), (1010, "x|y"), (1011, "\U0001f600 " * 210)]
    texts += [(i, texts[i % 7][1]) for i in range(2000, 2090)] + [(3, texts[3][1]), (3, texts[4][1]), (None, texts[0][1]), (None, None), (None, "alone"), (-5, texts[2][1])]
    out = [(i, t, rng.choice(["en", "de", None, ""]), *"zzzzzzzz") for i, t in texts]
    return spark.createDataFrame(out, DOCS).repartition(4).cache(), spark.createDataFrame([(i % 300 if i % 11 else None, i % 3 % 2, i % 5 % 2, "z") for i in range(500)] + [(2003, None, None, "z"), (2004, 1, None, "z")], "doc_id long, quality int, toxic int, mask string")


def brute_audit(docs, labels):
    good, toxic = ({r["doc_id"] for r in labels if r[c] == 1 and r["doc_id"] is not None} for c in ("quality", "toxic"))
    texts = defaultdict(list)
    for r in docs:
        if r["doc_id"] is not None:
            texts[r["text"] or ""].append(r["doc_id"])
    found = []
    for r in docs:
        t, i = r["text"] or "", r["doc_id"]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and any(x < i for x in texts[t])}
        found.append((r["lang"] or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in found}:
        own, removed = [f for f in found if f[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            for step, letter in enumerate(order):
                before = set(order[:step])
                gone = [f for f in own if letter in f[1] and not f[1] & before]
                removed[letter] += len(gone)
                out[part, "".join(order), step + 1] = [sum(not f[1] & (before | {letter}) for f in own), len(gone), sum(letter in f[1] and bool(f[1] & before) for f in own), sum(f[1] == {letter} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed[order[step - 1]])
    return out


def found_audit(*tables, **options):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in rows(filter_audit.audit(*tables, **options))}


def test_filter_audit(audited):
    want = brute_audit(*map(rows, audited))
    assert found_audit(*audited) == want
    assert found_audit(*audited, most=0) == want  # the sketch is joined, not broadcast


def test_filter_audit_of_nothing(audited):
    docs, labels = audited
    assert found_audit(docs.limit(0), labels) == {}
    assert found_audit(docs, labels.limit(0)) == brute_audit(rows(docs), [])


def test_sketch_clears_no_copy(audited):
    """Every text that occurs twice is a suspect, whatever the number of blocks; with enough counters few others are."""
    texts = audited[0].select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for blocks, most in ((1, filter_audit.BROADCAST), (7, filter_audit.BROADCAST), (7, 0)):
        told = rows(filter_audit.with_suspicion(texts, filter_audit.merged_sketch(texts, blocks), blocks, most))
        assert len(told) == texts.count()
        times = Counter(r["text"] for r in told)
        assert all(r["suspect"] for r in told if times[r["text"]] > 1)
        assert sum(r["suspect"] for r in told if times[r["text"]] == 1) <= 3
