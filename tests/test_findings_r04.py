"""What a review of round 4 found, on small tables that show it."""

import __spark_entry__ as entry
import duckdb

from graphloom.functions import terms as T
from graphloom.operators import algebra as A
from graphloom.operators import graph, similarity, store, validation
from graphloom.sources import mapping

SMALL = "/root/testdata/sf0.001"


def test_validation_broadcasts_no_table(spark, monkeypatch):
    """What a table weighs in its compressed file does not say what the driver would hold of it."""
    plans = []
    monkeypatch.setattr(validation, "FEW_PAIRS", 0, raising=False)
    for module, name in ((validation, "written"), (graph, "cut")):
        kept = lambda df, write=getattr(module, name): (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df))[1]
        monkeypatch.setattr(module, name, kept)
    validation.validate(mapping.to_schema(spark, SMALL), mapping.to_items(spark, SMALL))
    joins = [p for p in plans if "Join" in p]
    assert len(joins) > 5 and not [p for p in joins if "Broadcast" in p]


def test_paths_take_few_rounds(spark):
    """A chain, a ring and a literal at an end: rounds are the logarithm of the longest path."""
    n = 60
    links = [(f"urn:{i}", f"urn:{i + 1}") for i in range(n)] + [("urn:x", "urn:y"), ("urn:y", "urn:x")]
    rows = [("g", "iri", a, "urn:k", "iri", b, None, None) for a, b in links] + [("g", "iri", "urn:60", "urn:k", "literal", "urn:0", T.XSD + "string", None)]
    triples, jobs = spark.createDataFrame(rows, store.SCHEMA).drop("g"), spark.sparkContext
    jobs.setJobGroup("paths", "")
    told = A.path_plus(triples, "urn:k", "a", "b")
    done = len(jobs.statusTracker().getJobIdsForGroup("paths"))
    jobs.setLocalProperty("spark.jobGroup.id", None)
    want = {(f"urn:{i}", f"urn:{j}", "iri") for i in range(n) for j in range(i + 1, n + 1)} | {(f"urn:{i}", "urn:0", "literal") for i in range(n + 1)} | {(f"urn:{a}", f"urn:{b}", "iri") for a in "xy" for b in "xy"}
    got = [(r.a.value, r.b.value, r.b.kind) for r in told.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert done < 2 * n and not told.schema["a"].nullable and not told.schema["b"].nullable


def test_nearest_of_every_vector(spark, monkeypatch):
    """Each vector of the table is asked for, in cells that are smaller than it, and gets what the SQL gives it."""
    monkeypatch.setattr(similarity, "TOP_ROWS", 200, raising=False)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS FROM '{SMALL}/embeddings.parquet'")
    n = db.execute("SELECT count(*) FROM embeddings").fetchall()[0][0]
    want = db.execute(entry.oracle_sql()["topk_cosine"]).fetchall()
    got = entry.queries()["topk_cosine"](spark, SMALL).select("query_id", "rank", "id", "score").collect()
    assert n > 200 and len({r.query_id for r in got}) == n and len(got) == 10 * n
    assert sorted(map(tuple, got)) == sorted(want)
