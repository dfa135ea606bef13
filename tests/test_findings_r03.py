"""What a review of round 3 found, on small tables that show it."""

import glob
import hashlib
import json
import os
from types import SimpleNamespace

import __spark_entry__ as entry
import duckdb
import pyarrow as pa

from pyspark.sql import functions as F

from graphloom.llm import topk, toxicity
from graphloom.functions import evidence
from graphloom.functions import text as text_functions
from graphloom.operators import extraction, graph, mentions, pipelines, similarity, store, validation
from graphloom.sources import blobs, mapping, rdf

SMALL = "/root/testdata/sf0.001"


def against_sql(spark, name, tmp_path, **tables):
    """A query's rows and those of its SQL, over the small tables with some replaced by SQL of their own."""
    at, db = tmp_path / f"tables-{name}", duckdb.connect()
    at.mkdir()
    for file in os.listdir(SMALL):
        table = file.removesuffix(".parquet")
        db.execute(f"COPY ({tables.get(table, 'FROM old').replace('old', repr(f'{SMALL}/{file}'))}) TO '{at}/{file}' (FORMAT parquet)")
        db.execute(f"CREATE VIEW {table} AS FROM '{at}/{file}'")
    want = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = entry.queries()[name](spark, str(at)).select(names).collect()
    return sorted([*map(str, r)] for r in got), sorted([*map(str, r)] for r in want.fetchall())


def test_delete_axioms_counts_none(spark, tmp_path):
    got, want = against_sql(spark, "delete_axioms", tmp_path, part="SELECT * REPLACE (5::INTEGER AS p_size) FROM old")
    assert got == want and len(got) == 3 and "0" in {n for r in got for n in r}


def _star(subject, n):
    return [("g", "iri", subject, f"http://p/k{i % 2}", "literal", f"{i}", None, None) for i in range(n)]


def _written(spark, monkeypatch, at, write):
    """Files of 17 quads, one of them given twice, in documents of at most 3 statements."""
    monkeypatch.setattr(rdf, "DOCUMENT", 3)
    rows = _star("http://s/a", 10) + _star("http://s/b", 7)
    write(spark.createDataFrame(rows + rows[:1], store.SCHEMA).coalesce(1), str(at))
    return {(r[2], r[3], r[5]) for r in rows}


def test_rdfxml_documents_are_bounded(spark, tmp_path, monkeypatch):
    want = _written(spark, monkeypatch, tmp_path / "x", rdf.write_rdfxml)
    back = rdf.import_files(spark, str(tmp_path / "x"), "g", "rdfxml", max_triples=3).collect()
    assert {(r.s, r.p, r.o) for r in back} == want and len(back) == 17


def test_turtle_documents_are_bounded(spark, tmp_path, monkeypatch):
    want = _written(spark, monkeypatch, tmp_path / "t", rdf.write_turtle)
    back = rdf.import_files(spark, str(tmp_path / "t"), "g", "turtle", max_triples=3).collect()
    assert {(r.s, r.p, r.o) for r in back} == want and len(back) == 17


def test_jsonld_documents_are_bounded(spark, tmp_path, monkeypatch):
    want = _written(spark, monkeypatch, tmp_path / "j", rdf.write_jsonld)
    texts = [t for f in glob.glob(f"{tmp_path}/j/part-*") if (t := open(f, encoding="utf-8").read()).strip()]
    found = [[(o["@id"], p, v["@value"]) for o in json.loads(t) for p, vs in o.items() if p != "@id" for v in vs] for t in texts]
    assert max(map(len, found)) == 3 and {x for f in found for x in f} == want and sum(map(len, found)) == 17


def test_decisions_of_candidates_only(spark, tmp_path, monkeypatch):
    asked, merged = [], pipelines.duplicates_to_merge
    monkeypatch.setattr(pipelines, "duplicates_to_merge", lambda e, v, decisions, least: (asked.append(decisions.count()), merged(e, v, decisions, least))[1])
    got, want = against_sql(spark, "merged_duplicates_flow", tmp_path, part="SELECT * REPLACE (p_partkey % 3 || ' name' AS p_name) FROM old")
    assert got == want and asked[0] < duckdb.sql(f"SELECT count(*) FROM '{SMALL}/part.parquet'").fetchall()[0][0]


def test_hubs_of_disjoint_pairs(spark):
    """All of many nodes have a class that is in as many pairs; one node has another of them."""
    n = 3000
    sets = spark.range(n).selectExpr("concat('n', id) node", "if(id = 7, array('C', 'p9'), array('C')) has")
    pairs = spark.range(n).selectExpr("'C' a", "concat('p', id) b")
    assert [tuple(r) for r in graph.pairs_held(sets, pairs).collect()] == [("n7", "C", "p9")]


def test_slots_of_equal_classes(spark):
    """Facts conflict where each member class of the slot is disjoint with a class of the individual."""
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    up = frame([("A1", "A"), ("B1", "B"), ("X1", "X")], "node anc")
    disjoint = frame([("A", "X"), ("Y", "B1"), ("Q", "Z")], "a b")
    types = frame([("i", "X1"), ("i", "Y"), ("j", "X1"), ("k", "Q")], "ind cls")
    sets = validation.class_sets(types, up, validation.disjoint_classes(disjoint))
    assert sorted(tuple(r) for r in sets.select("ind", F.array_join("has", ",")).collect()) == [("i", "X,Y"), ("j", "X"), ("k", "Q")]
    members = frame([("p", "A1"), ("p", "B1"), ("q", "A"), ("r", "A"), ("r", "C")], "prop cls")
    links = frame([(p, i, f"{i}{p}") for p in "pqr" for i in "ijk"], "prop ind fact")
    got = validation.slot_conflicts(links, members, sets, disjoint, up, "domain").select("detail").collect()
    assert sorted(r.detail for r in got) == ["ip", "iq", "jq"]
    assert [r.detail for r in validation.disjoint_types(sets, frame([("Y", "X")], "a b")).select("detail").collect()] == ["X|Y"]


def test_toxicity_learns_from_every_row(spark, monkeypatch):
    """No bound on the training rows, and several shards agree on one model, in every run."""
    docs = spark.range(9000).selectExpr("id doc_id", "if(id % 3 = 0, 'you idiot scum', 'fine kind words') || ' w' || id % 50 text", "'en' lang")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) toxic")
    n = labels.filter(~toxicity.held_out(F.col("doc_id"))).count()
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 1500)
    rows, totals = toxicity.training_rows(docs, labels, toxicity.Settings())
    assert rows.count() == n == sum(totals.values()) and n > 5000 and rows.rdd.getNumPartitions() == -(-n // 1500)
    one, two = ({(r.doc_id, r.score): r.predicted for r in toxicity.classify(docs, labels).collect()} for _ in range(2))
    assert one == two and all(p == (i % 3 == 0) for (i, _), p in one.items())


def test_signature_of_sorted_blocks(spark):
    """A graph's lines are in many tasks and blocks, some of them twice; no task gathers a graph."""
    rows = [(g, "iri", f"http://s/{i % 3700}", "http://p", "literal", f"v{i % 3700}", None, None) for i in range(4000) for g in ("http://g", None)]
    quads = spark.createDataFrame(rows, store.SCHEMA).repartition(7)
    told = store.layer_signature(quads)
    plain = {g: sorted({f'<{s}> <{p}> "{o}"' + (f" <{g}> ." if g else " .") for h, _, s, p, _, o, *_ in rows if h == g}) for g in ("http://g", None)}
    want = {g: hashlib.sha256("".join(f"{x}\n" for x in lines).encode()).hexdigest() for g, lines in plain.items()}
    assert {r.g: r.signature for r in told.collect()} == want and told.count() == 2
    assert "collect_list" not in told._jdf.queryExecution().toString()


def test_closure_carries_on_the_farthest_pairs(spark, monkeypatch):
    """Rounds know how many steps a pair is apart, and each adds the pairs of up to twice as many."""
    links = {(i, i // 2) for i in range(1, 60)} | {(i, i + 1) for i in range(100, 130)} | {(130, 115), (7, 100), (5, 5), (40, 41), (41, 40)}
    rounds, written = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda d: (rounds.append(out := written(d)), out)[1])
    got = [tuple(r) for r in graph.ancestors(spark.createDataFrame([(a, b) for a, b in links], "child int, parent int")).collect()]
    want, more = set(links), set(links)
    while more:
        more = {(a, c) for a, b in more for x, c in links if x == b} - want
        want |= more
    assert len(got) == len(set(got)) and set(got) == want
    told = [r.agg(F.min("steps"), F.max("steps")).first() for r in rounds]
    assert all(r[0] is None or 2**i // 2 < r[0] <= r[1] <= 2**i for i, r in enumerate(told)) and len(told) > 4


def _asked(task, labels, texts):
    """What a task of mentions tells of one batch of texts."""
    forms = [f for b in mentions._forms(iter([pa.RecordBatch.from_arrays([pa.array(labels)], names=["label"])])) for f in zip(*(c.to_pylist() for c in b.columns))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["chunk_id", "text"])
    return list(task(SimpleNamespace(value=forms), True)(iter([batch])))


def test_mentions_are_told_in_batches():
    told = _asked(mentions._find, ["red ring", "bolt"], [f"a red ring {i} and a bolt" for i in range(500)])
    assert len(told) == 1 and told[0].num_rows == 1000


def test_declarations_are_told_once(spark, monkeypatch):
    """A label that is declared is not asked again, and texts without such words are not searched."""
    asked, whole = [], evidence.declared
    monkeypatch.setattr(evidence, "declared", lambda label, text: (asked.append(label), whole(label, text))[1])
    texts = ["the bolt is a part."] * 50 + ["The Bolt is an instance of it."] * 50
    told = _asked(mentions._find_declared, ["bolt", "ring"], texts)
    assert [r.to_pylist() for r in told] == [[{"label": "bolt", "chunk_id": 50}]] and asked == ["bolt"]


def test_values_are_read_below_the_join(spark):
    """A chunk's fields are read once, not once for each of its classes."""
    chunks = spark.createDataFrame([(1, "Size: 7 units\nType: bolt")], "chunk_id long, text string")
    classes = spark.createDataFrame([(1, i, x) for i, x in enumerate(["7 units", "bolt", "nut"])], "chunk_id long, pos int, label string")
    guarded = extraction.guard_classes(classes, chunks)
    assert {r.label: r.blocked for r in guarded.collect()} == {"7 units": "value", "bolt": None, "nut": "not grounded"}
    plan = guarded._jdf.queryExecution().optimizedPlan().toString()
    roles = next(line for line in plan.splitlines() if "EvalPython [structured_value_roles" in line)
    join = next(line for line in plan.splitlines() if "Join LeftOuter, (chunk_id" in line)
    assert plan.index(roles) > plan.index(join)


def test_plain_text_of_odd_signs():
    for x, want in (("A_b [l](u) <i>C</i> {{< ref text='D e' >}}", "a b l c d e"), ("\ufb01x \u2460 [水泵](x)_1号", "fix 1 水泵 1号"), (None, ""), ("x < y {{% z %}}", "x y")):
        assert evidence.plain_text(x) == want


def test_training_texts_travel_once(spark, monkeypatch):
    """Few ids are broadcast; many are joined in as many partitions as there are shards. Both give the same rows."""
    docs = spark.range(9000).selectExpr("id doc_id", "'fine kind words' || id text", "'en' lang")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) toxic")
    cut, plans = toxicity.cut, []
    monkeypatch.setattr(toxicity, "cut", lambda d: (plans.append(d._jdf.queryExecution().optimizedPlan().toString()), cut(d))[1])
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 1500)
    told = []
    for most in (10**6, 10):
        monkeypatch.setattr(toxicity, "BROADCAST_IDS", most)
        rows, totals = toxicity.training_rows(docs, labels, toxicity.Settings())
        assert rows.rdd.getNumPartitions() == -(-sum(totals.values()) // 1500)
        told.append({(r.doc_id, r.toxic, bytes(r.rows)) for r in rows.select("doc_id", "toxic", "rows").collect()})
    assert told[0] == told[1] and len(told[0]) > 5000
    assert "broadcast" in plans[0] and plans[0].count("RepartitionByExpression") == 1 and plans[1].count("RepartitionByExpression") == 2


def test_blobs_are_listed_in_tasks(spark, tmp_path):
    texts = [f"text {i % 70}" for i in range(90)] + [""]
    at = "file://" + str(tmp_path / "blobs")
    made = blobs.write_blobs(spark.createDataFrame([(x.encode(),) for x in texts], "content binary"), at)
    assert made.count() == 71
    back = blobs.read_blobs(spark, at)
    assert sorted((r.sha256, r.size_bytes, bytes(r.content)) for r in back.collect()) == sorted((hashlib.sha256(x.encode()).hexdigest(), len(x), x.encode()) for x in set(texts))
    assert "binaryFile" not in back._jdf.queryExecution().toString()


def test_top_k_by_slices(spark):
    """A task's slices merge: more vectors than are scored at once, with ties."""
    rows = [(i, [float(i % 7 + 1), float(i % 11), 1.0]) for i in range(2 * similarity.TOP_ROWS + 50)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>").coalesce(1)
    got = {(r.query_id, r.rank): r.id for r in similarity.vector_top_k(v, v.filter("id % 500 = 0"), 10).collect()}
    norm = lambda x: sum(a * a for a in x) ** 0.5
    for q in (0, 500, 1000):
        score = {i: -round(sum(a * b for a, b in zip(x, rows[q][1])) / norm(x) / norm(rows[q][1]), 9) for i, x in rows}
        assert [got[q, k + 1] for k in range(10)] == sorted(score, key=lambda i: (score[i], i))[:10]


def test_windows_leave_python_as_places(spark):
    told = spark.createDataFrame([("泵", "x" * 400 + "泵" + "y" * 400)], "label string, text string").select(text_functions.evidence_windows("label", "text").alias("w"))
    assert [(w.start, w.stop, w.text) for w in told.first()[0]] == [(80, 721, "x" * 320 + "泵" + "y" * 320)]
    assert "_window_spans" in told._jdf.queryExecution().toString()


def test_individuals_that_share_an_iri(spark, tmp_path):
    """The twelve hex digits of these two orders' IRIs are the same; each keeps its type and label."""
    more = "FROM old UNION ALL SELECT o.* REPLACE (k::BIGINT AS o_orderkey, 'F' AS o_orderstatus) FROM (FROM old LIMIT 1) o, (VALUES (1554834), (7195495)) v(k)"
    got, want = against_sql(spark, "merge_individuals", tmp_path, orders=more)
    assert got == want and {"Order 1554834", "Order 7195495"} <= {r[3] for r in got}


def test_line_items_are_told_apart_by_keys(spark, tmp_path, monkeypatch):
    """A task meets a bounded number of rows, as keys; rows that repeat or have no key give what the SQL gives."""
    line = "FROM old UNION ALL FROM old UNION ALL SELECT * REPLACE (NULL::BIGINT AS l_partkey) FROM old UNION ALL SELECT * REPLACE (NULL::INTEGER AS l_linenumber) FROM old"
    monkeypatch.setattr(mapping, "TASK_ROWS", 100)
    (tmp_path / "plain").mkdir()
    plain = "l_orderkey IS NOT NULL AND l_partkey IS NOT NULL AND l_linenumber IS NOT NULL"
    got, _ = against_sql(spark, "class_list", tmp_path, lineitem=line)
    assert got == against_sql(spark, "class_list", tmp_path / "plain", lineitem=f"FROM ({line}) WHERE {plain}")[1]
    items = mapping.to_items(spark, str(tmp_path / "tables-class_list"))
    n = spark.read.parquet(f"{tmp_path}/tables-class_list/lineitem.parquet").count()
    assert items.rdd.getNumPartitions() == 2 * -(-n // 100) and "Aggregate [l_orderkey" in items._jdf.queryExecution().optimizedPlan().toString()


def test_type_closure_in_parts(spark, monkeypatch):
    """Rows are dealt in parts of a bounded number; cycles and classes that are both given and inherited count once."""
    monkeypatch.setattr(validation, "TASK_ROWS", 100)
    types = spark.range(400).selectExpr("concat('i', id) ind", "explode(if(id % 2 = 0, array('A'), array('A', 'B', 'Z'))) cls")
    up = spark.createDataFrame([("A", "B"), ("A", "A"), ("B", "C")], "node string, anc string")
    told = validation.type_closure(types, up)
    want = {(f"i{i}", c) for i in range(400) for c in (["A", "B"] if i % 2 == 0 else ["A", "B", "C", "Z"])}
    assert sorted(map(tuple, told.collect())) == sorted(want) and told.rdd.getNumPartitions() == -(-(200 * 3 + 200 * (3 + 2 + 1)) // 100)


def test_vector_links_without_copies_meet_no_members(spark, monkeypatch):
    """Links of vectors that are there once have their ids; cells grow with the vectors, and copies still count."""
    rows = [(i, [float(i % 13 - 6), float(i % 7 - 3), float(i % 5 - 2) + i / 1000]) for i in range(200)]
    monkeypatch.setattr(similarity, "LEAST_BLOCK", 8)
    monkeypatch.setattr(similarity, "SLICE", 3)
    norm = lambda x: sum(a * a for a in x) ** 0.5
    for more in ([], [(200, rows[7][1]), (201, rows[7][1])]):
        every = rows + more
        told = similarity.vector_links(spark.createDataFrame(every, "id long, embedding array<float>"), 0.9)
        want = {(a, b) for a, x in every for b, y in every if a < b and sum(p * q for p, q in zip(x, y)) / norm(x) / norm(y) >= 0.9}
        got = [(r.a, r.b) for r in told.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert more or "Join" not in told._jdf.queryExecution().optimizedPlan().toString()


def test_search_brings_languages_together():
    """Documents of two languages, each with another most frequent word, lie apart; lists are long by block."""
    texts = [("the of" if i % 2 else "der und") + f" w{i} w{i} x{i % 7}" for i in range(1024)]
    (shard,) = topk._shards([(i, *topk.term_counts(t)) for i, t in enumerate(texts)]).to_pylist()
    ids = topk._unpacked(shard["ids"], "int64").tolist()
    assert sum(a % 2 != b % 2 for a, b in zip(ids, ids[1:])) == 1
    terms, counts, _ = topk.term_counts("the of w1")
    df = [1 if t == topk.term_counts("w1")[0][0] else 512 for t in terms]
    block = topk._Block(pa.table({"query_id": [7] * len(terms), "term": terms.view("int64"), "qtf": counts, "df": df}), 1024, 5.0)
    lists = topk._Lists(shard, block)
    assert sorted(len(rows) for rows, _, _ in lists.parts) == [0, 0, 2, 3] and lists.short.sum() == 0
    of, doc = lists.candidates(block.place * 0, block.place, block.weights, topk.np.zeros(1), 3)
    best = lists.exact(doc, block.place, block.weights)
    assert lists.ids[doc[best.argmax()]] == 1 and len(of) >= 3


def test_document_rows_are_dealt_by_number(spark, tmp_path, monkeypatch):
    """Parts of about TASK_ROWS rows, however little these weigh in the shuffle."""
    monkeypatch.setattr(mapping, "TASK_ROWS", 100)
    quads = spark.range(1200).selectExpr("'g' g", "'iri' s_kind", "concat('http://s/', id) s", "'http://p' p", "'literal' o_kind", "'v' o", "cast(null as string) o_dt", "cast(null as string) o_lang")
    rdf.write_jsonld(quads, str(tmp_path / "dealt"))
    sizes = [len(json.loads(t)) for f in glob.glob(f"{tmp_path}/dealt/part-*") if (t := open(f, encoding="utf-8").read()).strip()]
    assert sum(sizes) == 1200 and len(sizes) == 12


def test_shapes_read_the_data_once_a_side(spark):
    """Types and values are gone through once each and types once more for classes, not for each constraint."""
    rows = [("g", "iri", f"s{i}", p, k, o, None, None) for i in range(50) for p, k, o in ((validation.T.TYPE, "iri", "C"), ("v", "literal", "x"), ("other", "iri", "y"))]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    data = spark.createDataFrame(rows, store.SCHEMA).mapInArrow(counted, store.SCHEMA)
    shapes = spark.createDataFrame([("a", "C", "v", 2, validation.T.SH + "IRI", "d", "D"), ("b", "C", "v", None, validation.T.SH + "Literal", None, None)], "shape string, target string, path string, min_count int, node_kind string, datatype string, class_ string")
    got = validation.shacl(shapes, data).groupBy("shape", "constraint").count().collect()
    assert sorted(tuple(r) for r in got) == [("a", c, 50) for c in ("class", "datatype", "minCount", "nodeKind")]
    assert seen.value <= 3 * len(rows)


def test_long_literals_are_read(spark, tmp_path):
    """Plain characters are one step of the line's pattern, however many there are."""
    text = "long " * 60_000 + 'an "end" \\'
    rdf.write_nquads(spark.createDataFrame([("http://g", "iri", "http://s", "http://p", "literal", text, None, None)], store.SCHEMA), str(tmp_path / "long"))
    assert [(r.s, r.o) for r in rdf.read_nquads(spark, str(tmp_path / "long")).collect()] == [("http://s", text)]
