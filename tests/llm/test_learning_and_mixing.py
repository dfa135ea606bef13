"""Classifier by held-out accuracy, search and mixing against brute force, the pipeline stage by stage."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import mixing, secrets, simhash, topk, toxicity

SF = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_rows(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    got = toxicity.classify(docs, labels).cache()
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    tp = sum(r.predicted and r.toxic for r in rows)
    assert tp / max(1, sum(r.toxic for r in rows)) >= 0.8
    assert sum(r.predicted and not r.toxic for r in rows) <= 0.02 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    small = spark.read.parquet(f"{SF}/documents.parquet")
    one, two = ({r.doc_id: r.score for r in toxicity.classify(small, labels).collect()} for _ in range(2))
    assert one == two


def test_toxicity_odd_rows(spark):
    rows = [(i, ("you idiot scum " if i % 2 else "fine kind words ") * 5 + f"w{i}", ["en", None][i % 3 == 0]) for i in range(400)]
    docs = spark.createDataFrame([*rows, (1000, None, "xx"), (1001, "", None), (None, "idiot", "en"), (3, rows[3][1], "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)] + [(None, 1, 1), (7777, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == 404 and all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 400)
    kept = toxicity.clean_documents(docs.withColumn("score", F.lit(1)).select("doc_id", "text", "lang"), labels)
    assert kept.columns == docs.columns and kept.filter("doc_id % 2 = 1 and doc_id < 400").count() == 0
    assert {r.score for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def plain_score(model, text):
    """The classifier with plain loops over one text: every window, every filter, one at a time."""
    words = toxicity.words_of(text)
    vectors = [model.table[toxicity.features([w], model.settings.buckets)[0]].sum(axis=0) for w in words] or [np.zeros(model.settings.dims)]
    best = []
    for width, kernel in sorted(model.kernels.items()):
        for f in range(model.settings.filters):
            sums = [sum(float(vectors[i + j] @ kernel[j][:, f]) for j in range(width) if i + j < len(vectors)) for i in range(len(vectors))]
            best.append(max(0.0, max(0.0, *sums) + float(model.biases[width][f])))
    raw = sum(b * float(o) for b, o in zip(best, model.out)) + model.out_bias - model.shift
    return 1 / (1 + math.exp(-max(-30, min(30, raw + math.log(0.7 / 0.3)))))


def test_toxicity_scores_against_plain_loops(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i:c}{i}x" for i in range(97, 122)] + ["idiot", "scum", "kind", "fine"]
    texts = [" ".join(rng.choices(words, k=rng.choice((0, 1, 2, 3, 30)))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*texts, None, "", "1 2 3"])], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int("idiot" in t or "scum" in t)) for i, t in enumerate(texts)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, toxicity.Settings(least_steps=60))
    want = {r.doc_id: plain_score(model, r.text) for r in docs.collect()}
    for parts in (1, 7):  # neighbours in a batch do not matter
        got = {r.doc_id: r.score for r in toxicity.score(docs.repartition(parts), model, "doc_id").collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-4 for i in want)
    # a text of several MB in pieces; the cut falls inside a window that decides
    long = toxicity._Scorer(model)
    text = " ".join(rng.choices(["kind", "fine"], k=700_000)) + " idiot scum"
    assert len(text) > 3_000_000
    monkeypatch.setattr(toxicity, "SLICE_WORDS", 700_001)
    one = long.long(text)
    monkeypatch.setattr(toxicity, "SLICE_WORDS", 1000)
    assert abs(long.long(text) - one)[0] < 1e-6 and abs(one[0] - plain_score(model, "kind fine fine kind kind idiot scum")) < 0.2
    odd = " ".join(rng.choices(words, k=997))
    for size in (1, 3, 994, 995, 996, 997, 998, 5000):
        monkeypatch.setattr(toxicity, "SLICE_WORDS", size)
        assert abs(long.long(odd)[0] - plain_score(model, odd)) < 1e-4
        ids = toxicity.features(toxicity.words_of(odd), model.settings.buckets)
        assert abs(model.scores(toxicity._raw_of(model, ids))[0] - plain_score(model, odd)) < 1e-4


def test_toxicity_training_rows(spark):
    rows = [(1, "b", "en"), (1, "a", "en"), (1, "a", "fr"), (2, None, None), (3, "x " * 9, "en"), (6, "y", "en"), (None, "z", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (3, 1), (6, None), (None, 1), (99, 0)], "doc_id long, toxic int")
    settings = toxicity.Settings()
    held = {r.doc_id for r in labels.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).filter("h").collect()}
    sample, _ = toxicity.training_rows(docs.repartition(3), labels, settings)
    got = {r.doc_id: (r.toxic, r.n) for r in sample.collect()}
    assert got == {i: v for i, v in {1: (1, 1), 2: (0, 0)}.items() if i not in held}  # 3 has both labels
    many = spark.createDataFrame([(i, "w " * 10, "en") for i in range(90)], "doc_id long, text string, lang string")
    few = toxicity.training_rows(many, many.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"), toxicity.Settings(sample_words=100))[0]
    assert few.count() == 10


def brute_bm25(docs, queries, k):
    tf = [(d, Counter(w.lower() for w in (t or "").split())) for d, t in docs if d is not None]
    n, avg = len(tf), max(sum(sum(c.values()) for _, c in tf) / max(1, len(tf)), 1e-9)
    df = Counter(w for _, c in tf for w in c)
    out = {}
    for q, text in queries:
        qc = Counter(w.lower() for w in (text or "").split())
        scored = []
        for d, c in tf:
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * m * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avg)) for w, m in qc.items() if w in c)
            if s > 0:
                scored.append((-round(s, 6), d))
        out[q] = [(d, -s) for s, d in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_search_of_close_scores(spark, seed, monkeypatch):
    """Every document holds the one term, lengths lie close together and scores tie once rounded."""
    monkeypatch.setattr(topk, "SHARD_DOCS", 300)
    rng = random.Random(seed)
    docs = [(d, "a " + "b%d " % d * (rng.randint(494, 514))) for d in range(2000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([(7, "a"), (8, "a b3"), (9, "zzz")], "query_id long, text string")
    want = brute_bm25(docs, asked.collect(), 10)
    got = defaultdict(list)
    for r in topk.search(frame, asked).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    assert {q: [d for d, _ in got[q]] for q in (7, 8, 9)} == {q: [d for d, _ in want[q]] for q in (7, 8, 9)}


def test_search(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_DOCS", 16)
    rng = random.Random(2)
    vocab = [f"t{int(rng.paretovariate(0.6))}" for _ in range(400)]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    docs += [(400 + i, docs[0][1]) for i in range(15)] + [(500, None), (501, ""), (None, docs[1][1]), (2, docs[2][1])]
    queries = [(i, docs[i][1]) for i in range(0, 300, 20)] + [(900, None), (901, "unseen words"), (902, vocab[0])]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, query_id int").repartition(3)
    q = spark.createDataFrame([(*r, "x") for r in queries], "query_id long, text string, doc_id string")
    for bound in (topk.BLOCK_POSTINGS, 100):
        monkeypatch.setattr(topk, "BLOCK_POSTINGS", bound)
        got = defaultdict(list)
        for r in topk.search(d, q, 5).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.doc_id, r.score))
        want = brute_bm25(docs, queries, 5)
        for k in want:
            assert [x[0] for x in got[k]] == [x[0] for x in want[k]], k
            assert np.allclose([x[1] for x in got[k]], [x[1] for x in want[k]], atol=2e-6)
    assert topk.search(d, q.limit(0), 5).count() == 0
    assert topk.search(d.limit(0), q, 5).count() == 0


def test_mixing(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, "é", "\U0001f600"]), " ".join(["w"] * rng.randrange(0, 50))) for i in range(900)]
    rows += [(901, "empty", None), (902, "tiny", "one"), (None, "a", "x y"), (5, "b", "x y"), (5, "b", "x y")]
    docs = spark.createDataFrame([(d, s, t, 3) for d, s, t in rows], "doc_id long, source string, text string, size int")
    results = []
    for bound in (mixing.BUCKET_ROWS, 20):  # one bucket or many: the same mix
        monkeypatch.setattr(mixing, "BUCKET_ROWS", bound)
        got = mixing.mix(docs).collect()
        results.append(sorted((str(r.doc_id), str(r.source), r.size, r.taken) for r in got))
    assert results[0] == results[1]
    sizes = Counter()
    for d, s, t in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 51
    assert budget - 50 <= sum(taken.values()) <= budget
    assert mixing.mix(docs.limit(0)).count() == 0


def brute_mix(rows, seed=11):
    """rows: (key, doc_id, source, text); the copies of each row of the mix, by plain sorting."""
    sizes = {k: len((t or "").split()) for k, _, _, t in rows}
    of = defaultdict(list)
    for k, d, s, t in rows:
        order = hashlib.md5(f"{seed}:{d if d is not None else 'text:' + t if t is not None else ''}".encode()).hexdigest()
        of[s].append((order, sizes[k], k))
    total = {s: sum(x[1] for x in v) for s, v in of.items()}
    ranked = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in total if s is None]
    weight, budget, target, open_ = {s: (3, 1, 2)[i % 3] for i, s in enumerate(ranked)}, 1.5 * sum(total.values()), {}, set(ranked)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        target |= {s: 2.0 * total[s] for s in full} if full else {s: level * weight[s] for s in open_}
        open_ = open_ - full if full else set()
    offers = []
    for s, queue in of.items():
        cum = 0
        for order, size, k in sorted(queue):
            cum += size
            if size and target[s]:
                offers += [((e * total[s] + cum) / target[s], order, k, e, size) for e in (0, 1)]
    copies, words = Counter(), 0
    for _, _, k, _, size in sorted(offers):
        words += size
        if words > budget:
            break
        copies[k] += 1
    return copies


def test_mixed_documents_by_row(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(None, "a", "x " * n) for n in (1, 5, 9, 40)] + [(i, rng.choice(["a", "b", None]), "w " * rng.randrange(0, 30)) for i in range(200)] + [(3, "a", "q r s"), (3, "a", "t u v w"), (None, None, None), (7, "b", "")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, taken int, size int")
    want = brute_mix([(i, *r) for i, r in enumerate(rows)])
    for bound in (4096, 8):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", bound)
        got = mixing.mixed_documents(docs.repartition(3)).collect()
        assert sorted((str(r.doc_id), str(r.source), r.text, r.copies) for r in got) == sorted((str(rows[i][0]), str(rows[i][1]), rows[i][2], n) for i, n in want.items())
        assert all(r.taken == r.copies * len(r.text.split()) and r["size"] == 2 for r in got)
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def odd_tables(spark, tmp_path, rows, labels=True):
    at = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key int, copies int").write.parquet(f"{at}/documents.parquet")
    real = spark.read.parquet(f"{SF}/labels.parquet")
    (real if labels else real.limit(0)).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (None, None), (2, "tiny item"), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.mark.parametrize("labelled", [True, False])
def test_pipeline_on_odd_rows(spark, tmp_path, labelled):
    secret = "password = " + "Zx9qLm3kPv7"
    rows = [
        (None, None, None, None, None, 1, 2), (None, None, "en", None, 0, 1, 2), (1, "", "en", "web", 0, 1, 2), (2, "a clean text of its own words", "en", "web", 29, 1, 2), (2, "another clean text with the same id", "xx", "code", 35, 1, 2),
        (3, "x one two three four five six seven eight nine ten", "en", "web", 50, 1, 2), (4, "here a tiny item is quoted", None, "web", 26, 1, 2), (5, f"so {secret} it is", "en", None, 30, 1, 2), (None, f"and {secret} too, without an id", "en", "code", 40, 1, 2),
        (6, "the very same text twice", "en", "web", 24, 1, 2), (7, "the very same text twice", "en", "web", 24, 1, 2), (6, "the very same text twice", "en", "web", 24, 1, 2), (8, "long " + "word and other things " * 60_000, "en", "code", 9, 1, 2),
    ]
    at = odd_tables(spark, tmp_path, rows, labelled)
    got = corpus_pipeline.run(spark, at).collect()
    texts = Counter(r.text for r in got)
    assert all(n == 1 for n in texts.values()) and not any("Zx9qLm3kPv7" in (r.text or "") for r in got)
    assert {(r.doc_id, r.text[:20]) for r in got} <= {(2, "a clean text of its "), (2, "another clean text w"), (5, "so [secret] it is"), (None, "and [secret] too, wi"), (6, "the very same text t"), (8, "long word and other ")}
    assert len(got) >= 4 and all(r._key == 1 and r.taken == r.copies * len(r.text.split()) for r in got)
    empty = odd_tables(spark, tmp_path / "empty", [], labelled)
    none = corpus_pipeline.run(spark, empty)
    assert none.count() == 0 and "copies" in none.columns


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    kept = stage["toxicity"](spark, docs, SF)
    assert kept.columns == docs.columns
    model = toxicity.train(docs, labels)
    scores = {r.doc_id: (plain_score(model, r.text), model.thresholds.get(r.lang, 0.7)) for r in docs.filter("length(text) < 3000").collect()}
    assert ids(kept.filter("length(text) < 3000")) == {d for d, (score, least) in scores.items() if score < least}
    now = spark.createDataFrame(kept.collect(), kept.schema)

    from test_simhash import brute_components, brute_fp

    rows = [(r.doc_id, brute_fp(r.text)) for r in now.orderBy("doc_id").collect()]
    kept = stage["near_duplicates"](spark, now, SF)
    assert ids(kept) == set(brute_components(rows)) and kept.count() == len(set(brute_components(rows))) and kept.columns == docs.columns
    now = spark.createDataFrame(kept.collect(), kept.schema)

    from test_words_and_spans import brute_spans

    kept = stage["decontamination"](spark, now, SF)
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {tuple(w[i : i + 10]) for r in items.collect() if (w := plain(r.text)) for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    dirty = {r.doc_id for r in now.collect() if any(tuple(w[i : i + n]) in windows for w in [plain(r.text)] for n in sizes for i in range(len(w) - n + 1))}
    assert ids(kept) == ids(now) - dirty and kept.columns == docs.columns
    now = spark.createDataFrame(kept.collect(), kept.schema)

    before = {r.doc_id: r.text for r in now.collect()}
    kept = stage["secrets"](spark, now, SF)
    assert kept.columns == docs.columns
    after = {r.doc_id: r for r in kept.collect()}
    for d, r in after.items():
        assert (r.text == before[d]) == (not brute_spans(before[d]))
        assert r.text == before[d] or r.n_chars == len(r.text)
    now = spark.createDataFrame(list(after.values()), kept.schema)

    mixed = stage["mixing"](spark, now, SF)
    assert mixed.columns == [*docs.columns, "copies", "taken"]
    want = brute_mix([(r.doc_id, r.doc_id, r.source, r.text) for r in now.collect()])
    assert {r.doc_id: r.copies for r in mixed.collect()} == want
    assert secrets.KINDS and simhash.MAX_BITS == 4
