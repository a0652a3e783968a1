"""The estimates against the exact minimum covariance determinant, small groups, long texts."""

import itertools
import math
import random

import numpy as np

from scribewash.llm import quality_rules as q

from test_operators import brute_counts, documents, prose

D = len(q.DIMS)


def exact_mcd(x):
    """Of all subsets of three quarters of the rows, the centre and scatter with the least determinant."""
    h = math.ceil(q.KEEP_SHARE * len(x))
    best = None
    for some in itertools.combinations(range(len(x)), h):
        s = np.cov(x[list(some)].T, bias=True) * q.KEEP_SHARE / q.chi2_cdf(q.chi2_quantile(q.KEEP_SHARE, D), D + 2) + q._floor()
        logdet = np.linalg.slogdet(s)[1]
        if best is None or logdet < best[0]:
            best = logdet, set(some)
    return best


def test_estimates_against_the_exact_mcd(spark):
    """14 rows, two or three of them far off: the exact subset leaves these out, and so does the estimate."""
    rng = np.random.default_rng(5)
    groups, rows = {}, []
    for g in range(12):
        x = np.round((rng.normal(size=(14, D)) * np.array(q.FLOOR) * 1.5 + 3) * q.QUANTUM)
        far = set(rng.choice(14, 2 + g % 2, replace=False).tolist())
        for i in far:
            x[i] += rng.choice([-1, 1], D) * 15 * np.array(q.FLOOR) * q.QUANTUM
        groups[f"g{g}"] = x, far
        rows += [(f"g{g}", *map(float, r)) for r in x]
    df = spark.createDataFrame(rows, "gkey string, " + ", ".join(f"v{i} double" for i in range(D)))
    near = 0
    for r in q.mcd(df, 12).collect():
        x, far = groups[r.gkey]
        least, subset = exact_mcd(x)
        assert subset.isdisjoint(far)
        diff = x - np.array(r.center)
        d2 = np.einsum("ij,jk,ik->i", diff, np.array(r.precision).reshape(D, D), diff)
        cut = q.chi2_quantile(1 - q.TAIL, D)
        assert {i for i in range(14) if d2[i] > cut} == far
        near += abs(np.linalg.slogdet(np.array(r.scatter).reshape(D, D))[1] - least) < 0.15 * D
    assert near >= 10


def test_every_group_has_its_own_estimate(spark):
    """Two sources of one language, one all in short words: each is judged by its own, few rows by the parent's."""
    rng = random.Random(4)
    plain = [(i, prose(rng, 150 + rng.randrange(100), 4000), "a") for i in range(200)]
    shouts = [(1000 + i, prose(rng, 150 + rng.randrange(100), 4000).upper(), "b") for i in range(400)]
    lone = [(5000, prose(rng, 200, 4000).upper(), "c"), (5001, prose(rng, 200, 4000), "c")]
    rows = [(i, t, "en", s) for i, t, s in plain + shouts + lone]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in q.quality_rules(docs).collect()}
    assert sum(kept[i] for i, _, _ in plain) >= 195 and sum(kept[i] for i, _, _ in shouts) >= 395
    own = q.quality_rules(docs.where("source <> 'b'"))
    kept = {r.doc_id: r.kept for r in own.collect()}
    assert kept[5001] and not kept[5000]


def test_without_groups(spark):
    docs = spark.createDataFrame([(i, "some text " * 40) for i in range(5)], "doc_id long, text string")
    assert q.quality_rules(docs, groups=()).count() == 5


def test_long_texts_part_by_part(monkeypatch):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["a b c", "a  b", "", " ", "x # | y", "é ÜX", prose(rng, 9)]) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    texts += ["a" * 300, "\n" * 50, " x\n x", "a b\n" * 30, "a b\na b"]
    whole = [q.text_counts(t.encode()) for t in texts]
    monkeypatch.setattr(q, "PART_BYTES", 20)
    assert [q.text_counts(t.encode()) for t in texts] == whole
    assert [c[:5] for c in whole] == [brute_counts(t) for t in texts]


def test_clashing_columns(spark):
    docs = documents(spark, [(1, "word " * 60)]).selectExpr("*", "'x' AS gkey", "'y' AS g0", "1 AS n_words", "2 AS distance", "3 AS center")
    assert [r.n_words for r in q.quality_rules(docs).collect()] == [60]
