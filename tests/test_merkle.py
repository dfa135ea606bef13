"""Versions as trees: diffs equal set differences, and few ranges are read for few changes."""

import random

from graphloom.operators import merkle

QUAD = "g string, s_kind string, s string, p string, o_kind string, o string, o_dt string, o_lang string"


def _layer(spark, keys):
    return spark.createDataFrame([("urn:g", "iri", f"urn:s{k}", "urn:p", "literal", str(k), None, None) for k in keys], QUAD)


def _line(k):
    return f'<urn:s{k}> <urn:p> "{k}" <urn:g> .'


def test_versions(spark, tmp_path):
    rng = random.Random(1)
    a = set(range(400))
    b = (a - set(rng.sample(sorted(a), 3))) | {1000, 1001}
    at = {n: f"file://{tmp_path}/{n}" for n in ("a", "b", "again", "none")}
    for name, keys in (("a", a), ("b", b), ("none", ())):
        merkle.write_version(_layer(spark, keys), at[name])
    shuffled = sorted(a, key=lambda k: -k)
    merkle.write_version(_layer(spark, shuffled + shuffled[:50]).repartition(7), at["again"])
    assert merkle.root(spark, at["a"]) == merkle.root(spark, at["again"]) != merkle.root(spark, at["b"]) and merkle.root(spark, at["none"]) is None
    got, n, every = merkle.diff(spark, at["a"], at["b"])
    assert {tuple(r) for r in got.collect()} == {("added", _line(k)) for k in b - a} | {("removed", _line(k)) for k in a - b}
    assert 1 <= n <= 5 and every > 150
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan
    same, n, _ = merkle.diff(spark, at["a"], at["again"])
    assert same.count() == 0 and n == 0
    gone, _, _ = merkle.diff(spark, at["a"], at["none"])
    assert {tuple(r) for r in gone.collect()} == {("removed", _line(k)) for k in a}
