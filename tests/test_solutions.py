"""Joins of solutions with unbound variables against plain loops; no product in their plans."""

import contextlib
import io
import random

import pytest

from graphloom.operators import algebra as A
from graphloom.plans import registry

SF = "/root/testdata/sf0.001"


def compatible(x, y):
    return all(x[k] is None or y.get(k, x[k]) is None or x[k] == y.get(k, x[k]) for k in x)


def merged(x, y):
    return {k: x.get(k) if x.get(k) is not None else y.get(k) for k in {**x, **y}}


def overlap(x, y):
    return any(x[k] is not None and y.get(k) is not None for k in x)


def bag(rows, names):
    return sorted(str([r.get(n) for n in names]) for r in rows)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("sure", [True, False])
def test_unbound_against_loops(spark, seed, sure):
    rng = random.Random(seed)
    value = lambda often: rng.choice(["x", "y", "z"]) if rng.random() < often else None
    a = [{"k": rng.choice("pq"), "v": value(0.6), "w": value(0.5), "o": str(i)} for i in range(25)] + [{"k": "p", "v": None, "w": None, "o": "same"}] * 2
    b = [{"k": rng.choice("pq"), "v": value(0.5), "w": value(0.6), "q": str(i)} for i in range(18)]
    if not sure:
        a, b = ([{k: v for k, v in r.items() if k != "k"} for r in rows] for rows in (a, b))
    frame = lambda rows: A.values(spark, list(rows[0]), [tuple(v and A.lit(v) for v in r.values()) for r in rows])
    left, right = frame(a), frame(b)
    plain = lambda df: [{c: r[c] and r[c]["value"] for c in df.columns} for r in df.collect()]
    names = list({**a[0], **b[0]})
    met = [merged(x, y) for x in a for y in b if compatible(x, y)]
    assert bag(plain(A.join(left, right)), names) == bag(met, names) and met
    filtered = lambda x, y: compatible(x, y) and x["o"] < y["q"]
    kept = [merged(x, y) for x in a for y in b if filtered(x, y)] + [x for x in a if not any(filtered(x, y) for y in b)]
    assert bag(plain(A.optional(left, right, where=lambda v: v("o")["value"] < v("q")["value"])), names) == bag(kept, names)
    some = [x for x in a if not any(compatible(x, y) and overlap(x, y) for y in b[:4])]
    assert bag(plain(A.minus(left, frame(b[:4]))), list(a[0])) == bag(some, list(a[0]))
    for how, want in ((A.exists, True), (A.not_exists, False)):
        rest = [x for x in a if any(compatible(x, y) for y in b[:2]) == want]
        assert bag(plain(how(left, frame(b[:2]))), list(a[0])) == bag(rest, list(a[0]))
    bare = [{k: None for k in y} for y in b[:1]]
    if not sure:  # a solution that binds nothing takes nothing away, and is compatible with all
        assert A.minus(left, frame(bare)).count() == len(a) and A.exists(left, frame(bare)).count() == len(a)


@pytest.mark.parametrize("name", ["join_unbound", "optional_unbound", "minus_unbound", "not_exists_unbound"])
def test_no_product(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        registry.queries()[name](spark, SF).explain()
    assert "Cartesian" not in out.getvalue() and "NestedLoop" not in out.getvalue()
