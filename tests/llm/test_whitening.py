"""Whitening against a plain version in whole numbers and fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=4):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} by fractions and a dense eigh."""
    usable = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fitted = sorted({tuple(x) for _, x in usable})
    n, dim = len(fitted), len(fitted[0])
    mean = [Fraction(sum(x[d] for x in fitted), n) for d in range(dim)]
    centred = [[x[d] - mean[d] for d in range(dim)] for x in fitted]
    cov = np.array([[float(sum(c[i] * c[j] for c in centred) / n) for j in range(dim)] for i in range(dim)])
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1], w[:, ::-1]
    out = []
    for i, x in usable:
        y = np.array([float(x[d] - mean[d]) for d in range(dim)])
        deviation = sum((n * x[d] - sum(f[d] for f in fitted)) ** 2 for d in range(dim))
        out += [(i, c + 1, n, deviation, y @ w[:, c] / math.sqrt(e[c]), e[c] / np.trace(cov)) for c in range(min(k, dim)) if e[c] > 1e-13 * e[0]]
    return out


def compare(got, want):
    """Equal up to each component's sign, which is the same for all rows."""
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(abs(r[4]), 6))
    got, want = sorted((tuple(r)[:6] for r in got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for component in {r[1] for r in want}:
        a, b = ([r[4] for r in rows if r[1] == component] for rows in (got, want))
        sign = max(zip(map(abs, b), (x * y for x, y in zip(a, b))))[1]
        assert a == pytest.approx([math.copysign(1, sign) * x for x in b], rel=1e-8, abs=1e-9)
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9)


def test_against_fractions(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 5)) @ np.diag([3, 2, 1, 0.5, 0.1]) + 1
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base.astype(np.float32))]
    rows += [(100, rows[0][1]), (100, rows[0][1]), (None, rows[1][1]), (7, None), (8, []), (9, [1.0, None, 1.0, 1.0, 1.0]), (10, [math.nan] * 5), (11, [math.inf, 0.0, 0.0, 0.0, 0.0]), (120, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, SCHEMA)
    got = whitening.whiten(vectors).collect()
    compare(got, plain([r for r in rows if r[0] != 120]))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whole_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = queries.op12_polarised_whitening(spark, sf)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    got = got.collect()
    usable = [r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    assert len(got) == 4 * len(usable)
    x = np.array([[math.floor(256 * float(c)) for c in v] for _, v in usable])
    fitted = np.unique(x, axis=0)
    e = np.linalg.eigvalsh(np.cov(fitted.T.astype(float), bias=True))[::-1]
    assert {round(r.explained, 12) for r in got} == {round(v, 12) for v in e[:4] / e.sum()}
    y = len(fitted) * x - fitted.sum(0)
    assert {(r.vec_id, r.deviation) for r in got} == {(i, int(d)) for (i, _), d in zip(usable, (y * y).sum(1))}
    assert all(r.identity_error < 1e-4 for r in got)


def test_few_wide_and_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(none).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).count() == 0  # no variance
    line = [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0])]
    assert {r.component for r in whitening.whiten(spark.createDataFrame(line, SCHEMA)).collect()} == {1}
    one = whitening.whiten(spark.createDataFrame([(1, [0.0]), (2, [1.0])], SCHEMA)).collect()
    assert sorted((r.vec_id, r.component, r.deviation, abs(r.whitened), r.explained) for r in one) == [(1, 1, 65536, 1.0, 1.0), (2, 1, 65536, 1.0, 1.0)]


def test_large_values_stay_exact(spark):
    rows = [(i, [float((i * 7919) % 31) * 2.0**30, float(i % 5), -float(i) * 2.0**28]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = plain(rows)
    fits = lambda d: d if d < 1 << 63 else None
    assert {(r.vec_id, r.deviation) for r in got} == {(w[0], fits(w[3])) for w in want}
    assert sorted(r.explained for r in got) == pytest.approx(sorted(w[5] for w in want), rel=1e-6)


def test_clashing_columns_and_long_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(30, 300)))]
    vectors = spark.createDataFrame(rows, "`a.b` long, `__v` array<double>").withColumns({c: F.lit("x") for c in ("x", "n", "w", "at", "whitened", "vec_id", "embedding")})
    got = whitening.whiten(vectors, vec_id="a.b", embedding="__v").collect()
    assert len(got) == 120 and got[0].identity_error < 1e-6
