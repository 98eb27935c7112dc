"""The interpolating surface of the smoother, against a plain computation on single rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from thermoband.operators import smooth

SPAN = 0.3


def plain_vertices(rows, span=SPAN):
    """Vertices of the cells of sorted single values, by the recursion itself."""
    x = sorted(rows)
    n = len(x)
    most = max(int(np.floor(n * (span * smooth.CELL))), 1)
    margin = smooth.MARGIN * max(x[-1] - x[0], 1e-3 * max(abs(x[0]), abs(x[-1])) + 1e-30)
    found = {x[0] - margin, x[-1] + margin}

    def cut(first, last, lo, hi):
        if last - first + 1 <= most:
            return
        middle = (first + last) // 2
        at, offset = middle, 0
        while first <= middle + offset < last:
            if x[middle + offset - 1] != x[middle + offset]:  # places count from 1
                at = middle + offset
                break
            offset = -offset if offset > 0 else -offset + 1
        t = (x[at - 1] + x[at]) / 2
        if t not in (lo, hi):
            found.add(t)
            cut(first, at, lo, t)
            cut(at + 1, last, t, hi)

    cut(1, n, x[0] - margin, x[-1] + margin)
    return sorted(found)


def plain_fit(x, y, x0, span=SPAN):
    """Value and slope of the weighted quadratic at x0; None where three hours do not have weight."""
    x, y = np.array(x, float), np.array(y, float)
    q = int(np.floor(len(x) * span + 1e-5))
    d = np.abs(x - x0)
    h = np.sort(d)[q - 1]
    if len(np.unique(x[d < h])) < 3:
        return None
    w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0)
    a = np.stack([np.ones_like(x), x - x0, (x - x0) ** 2], axis=1)
    b = np.linalg.lstsq(a * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    return b[0], b[1]


def rows_of(counts, seed=0):
    rng = random.Random(seed)
    return [(float(h), 20 + 3 * np.sin(h / 4) + rng.gauss(0, 1)) for h, n in counts.items() for _ in range(n)]


COUNTS = {
    "even": {h: 40 for h in range(24)},
    "one hot": {h: 1000 if h == 7 else 5 for h in range(24)},
    "hot end": {h: 500 if h == 23 else 11 for h in range(24)},
    "hot start": {h: 900 if h == 0 else 2 + h for h in range(24)},
    "gaps": {h: 3 + h * h for h in (0, 1, 5, 6, 7, 13, 22)},
    "rising": {h: 2**h // 8 + 1 for h in range(14)},
    "few": {h: 1 for h in range(10)},
}


@pytest.fixture(scope="module")
def groups(spark):
    rows = [(g, int(h), float(y)) for g, counts in COUNTS.items() for h, y in rows_of(counts)]
    rows += [(None, h, float(h)) for h in range(24) for _ in range(3)] + [("lone hour", 9, 5.0)] * 4 + [("lone row", 9, 5.0)]
    return spark.createDataFrame(rows, "g string, hour int, y double").repartition(5)


def test_vertices_equal_the_recursion(groups):
    counted = smooth._hour_counts(groups, ["g"], "y", SPAN)
    got = {r.g: r.v for r in counted.select("g", smooth.vertices(SPAN).alias("v")).collect()}
    for g, counts in COUNTS.items():
        assert got[g] == pytest.approx(plain_vertices([h for h, n in counts.items() for _ in range(n)]), abs=1e-12), g
    assert len(got["lone hour"]) >= 2 and len(got["lone row"]) == 2


def test_cubics_between_vertices(groups):
    """Each point lies on the cubic that has the values and slopes of direct fits at the vertices around it."""
    got = {}
    for r in smooth.loess_by_hour(groups, ["g"], "y", surface="interpolate").collect():
        got.setdefault(r.g, []).append((r.i, r.x0, r.fit))
    assert set(got) == {*COUNTS, None, "lone hour", "lone row"} and all(len(v) == 200 for v in got.values())
    for g in ("even", "one hot", "hot end", "gaps"):
        x, y = zip(*rows_of(COUNTS[g]), strict=True)
        v = plain_vertices(x)
        fits, compared = {at: plain_fit(x, y, at) for at in v}, 0
        for _, x0, fit in sorted(got[g])[::7]:
            k = max(i for i, at in enumerate(v[:-1]) if at <= x0)
            a, b = v[k], v[k + 1]
            h, t = b - a, (x0 - a) / (b - a)
            if fits[a] is None or fits[b] is None:
                continue
            compared += 1
            (fa, sa), (fb, sb) = fits[a], fits[b]
            want = (1 + 2 * t) * (1 - t) ** 2 * fa + t**2 * (3 - 2 * t) * fb + h * (t * (1 - t) ** 2 * sa - t**2 * (1 - t) * sb)
            assert fit == pytest.approx(want, rel=1e-6, abs=1e-6), (g, x0)
        assert compared > (20 if g == "even" else 5), g
    assert all(f == pytest.approx(5.0) for _, _, f in got["lone hour"] + got["lone row"])
    assert [f for _, _, f in sorted(got[None])][::50] == pytest.approx([x for _, x, _ in sorted(got[None])][::50], abs=1e-6)


def test_both_surfaces_are_close(groups):
    direct = {(r.g, r.i): r.fit for r in smooth.loess_by_hour(groups, ["g"], "y").collect()}
    between = {(r.g, r.i): r.fit for r in smooth.loess_by_hour(groups, ["g"], "y", surface="interpolate").collect()}
    assert direct.keys() == between.keys()
    assert max(abs(direct["even", i] - between["even", i]) for i in range(200)) < 0.2
    with pytest.raises(ValueError, match="unknown surface"):
        smooth.loess_by_hour(groups, ["g"], "y", surface="other")
