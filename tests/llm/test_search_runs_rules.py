"""Ranked search, periodic runs and the rule ensemble against brute force and held-out rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontam, quality, queries, ranked, runs, secrets, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute_ranked(docs, items, k):
    counted = [(d, Counter(terms(t))) for d, t in docs if d is not None]
    counted = [(d, c) for d, c in counted if c]
    n, words, df = len(counted), sum(sum(c.values()) for _, c in counted), Counter(t for _, c in counted for t in c)
    out, asked = {}, defaultdict(Counter)
    for i, t in items:
        if i is not None:
            asked[i] += Counter(terms(t))
    for i, query in asked.items():
        scored = []
        for d, c in counted:
            m = 100 - 75 + (75 * sum(c.values()) * n) // words
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in query.items() if t in c)
            if s > 0:
                scored.append((-s, d))
        out[i] = [(d, -s) for s, d in sorted(scored)[:k]]
    return {i: v for i, v in out.items() if v}


@pytest.mark.parametrize("block", [1024, 2])
def test_ranked_search(spark, monkeypatch, block):
    monkeypatch.setattr(ranked, "SHARD_DOCS", 17)
    monkeypatch.setattr(ranked, "BLOCK", block)
    rng = random.Random(3)
    vocab = [f"T{int(rng.paretovariate(0.5)) % 90}" for _ in range(300)] + ["Über", "É9", "a_b"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, n)))
    docs = [(i * 7 % 251, text(60)) for i in range(251)] + [(900 + i, "t1 t2 t1") for i in range(40)]
    docs += [(500, None), (501, ""), (502, "!! \x7f"), (None, "t1 t2"), (5, docs[3][1]), (5, docs[3][1]), (503, "t1 " * 3000), (-4, "t1 t2 t1")]
    items = [(i, text(25)) for i in range(20)] + [(90, None), (91, "unseen"), (92, "t1"), (93, "T1 t2 " * 200), (None, "t1"), (94, "t1 t2"), (94, "t1 q"), (95, "über a_b")]
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, item_id int, score string").repartition(3)
    q = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, doc_id int")
    want = brute_ranked(docs, items, 10)
    for terms_of_block in (ranked.BLOCK_TERMS, 40):
        monkeypatch.setattr(ranked, "BLOCK_TERMS", terms_of_block)
        got = defaultdict(list)
        for r in ranked.search(d, q, 10).orderBy("item_id", "rank").collect():
            got[r.item_id].append((r.doc_id, r.score))
            assert r.rank == len(got[r.item_id])
        assert dict(got) == want
    assert ranked.search(d, q.limit(0)).count() == 0 and ranked.search(d.limit(0), q).count() == 0


def test_ranked_sums_beyond_doubles():
    """A query of so many terms that doubles would not hold the sum goes through whole numbers."""
    b = ranked._Block(ranked.pa.table({"item_id": [1], "term": [b"a"], "times": [10**6]}))
    b.n, b.words, b.weights[0] = 1000, 1000, 40_000
    shard = ranked._Writer()
    for i in range(50):
        shard.add(i, "a " * (i + 1))
    row = ranked.pa.RecordBatch.from_pylist([shard.row()], schema=ranked._SHARD)
    lists = ranked._Lists({c: row.column(c)[0] for c in row.schema.names}, b)
    best: list = []
    lists.merge(b.place, b.times, False, best, 3)
    m = lambda n: 25 + 75 * n
    want = sorted((10**6 * 40_000 * ((10**9 * n) // (1000 * n + 8 * m(n))), -(n - 1)) for n in range(1, 51))[-3:]
    assert sorted(best) == want


def test_numbers_in_bytes():
    rng = np.random.default_rng(0)
    v = np.r_[0, 1, 127, 128, 16383, 16384, 2**40, rng.integers(0, 2**50, 500), rng.integers(0, 300, 500)]
    raw, size = ranked.to_bytes(v)
    assert size.sum() == len(raw) and (ranked.from_bytes(raw) == v).all() and len(ranked.from_bytes(raw[:0])) == 0


def brute_runs(w):
    n, out = len(w), set()
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            part = w[i : j + p]
            if j - i + p >= max(6, 4 * p) and j > i and not any(part[q:] == part[:-q] for q in range(1, p)):
                out.add((i, j - i + p, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_numbers(monkeypatch):
    rng = random.Random(1)
    for chunk in (64, 1, 3):
        monkeypatch.setattr(runs, "CHUNK", chunk)
        for _ in range(700):
            n, k = rng.randrange(0, 130), rng.choice((1, 2, 2, 3, 5, 40))
            w = [rng.randrange(k) for _ in range(n)]
            for _ in range(rng.randrange(4)):
                if n > 8:
                    a, p = rng.randrange(n), rng.randrange(1, max(2, n // 6))
                    for i in range(a + p, min(n, a + rng.randrange(p, p * 9))):
                        w[i] = w[i - p]
            assert runs.find_runs(np.array(w, np.int64)) == brute_runs(w), w
    assert runs.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert runs.find_runs(np.tile(np.arange(70_000), 5)[:290_000]) == [(0, 290_000, 70_000)]


def test_runs_of_texts(spark):
    rng = random.Random(2)
    rows = [(i, " \t".join(f"é{rng.randrange(6)}" for _ in range(rng.randrange(0, 50)))) for i in range(150)]
    rows += [(150, None), (151, ""), (152, " \n"), (153, "x " * 5), (154, "x " * 6), (None, "y " * 9), (7, rows[7][1]), (7, rows[7][1]), (155, "a b c " * 20000)]
    docs = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, runs int, _text string").repartition(3)

    def facts(d, t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        found = brute_runs(words) if n < 1000 else [(0, n, 2)]
        gone = {i for s, length, p in found for i in range(s + p, s + length)}
        best = min(((-length, s, p) for s, length, p in found), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        one = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        return (str(d), len(found), *one, sha("".join(f"{s},{length},{p}\n" for s, length, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))

    assert sorted(map(str, (facts(*r) for r in rows))) == sorted(str((str(r.doc_id), *r[1:])) for r in runs.facts(docs).collect())
    kept = runs.periodic_runs(docs, "doc_id", "_text").filter("doc_id in (153, 154)").orderBy("doc_id").collect()
    assert [(r.n_words, len(r.runs), r.collapsed, r._text) for r in kept] == [(5, 0, "x x x x x", "z"), (6, 1, "x", "z")]
    assert runs.facts(docs.limit(0)).count() == 0


def test_quality_on_held_out_rows(spark):
    at = "/root/testdata/sf0.1"
    got = queries.op13_quality_rules(spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.98 * len(held)
    assert sum(not r.predicted for r in held if not r.quality) >= 0.95 * sum(not r.quality for r in held)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    one, two = ({r.doc_id: r.score for r in quality.classify(d, labels).collect()} for d in (docs, docs.repartition(9)))
    assert one == two


def plain_statistics(text):
    text = text or ""
    words, lines = re.split(r"[\x20\x09-\x0D]+", text), [x for x in text.split("\n") if x.strip(" ")]
    words = [w for w in words if w]
    n, chars, rows = max(len(words), 1), max(len(text), 1), max(len(lines), 1)
    count = lambda chars_: sum(c in chars_ for c in text)
    return {
        "words": math.log1p(len(words)), "word_length": len(text) / n, "longest_word": math.log1p(max(map(len, words), default=0)), "short_words": sum(len(w) <= 3 for w in words) / n,
        "single_characters": sum(len(w) <= 1 for w in words) / n, "distinct_words": len(set(words)) / n, "same_as_next": sum(a == b for a, b in zip(words, words[1:])) / n,
        "lines": math.log1p(len(lines)), "distinct_lines": len(set(lines)) / rows, "words_of_line": len(words) / rows, "capitals": count(quality.UPPER) / chars, "small_letters": count(quality.LOWER) / chars,
        "digits": count(quality.DIGITS) / chars, "marks": count(quality.MARKS) / n, "bangs": count(quality.BANGS) / n, "stops": count(quality.STOPS) / n, "brackets": count(quality.BRACKETS) / n, "pipes": count("|") / n,
    }


def test_rules_as_columns(spark):
    """Compiled rules give what plain evaluation of statistics and rules gives; odd rows are scored."""
    rng = random.Random(4)
    good = lambda: " ".join(f"word{rng.randrange(900)}" for _ in range(rng.randrange(5, 60))) + ".\nNext line."
    bad = lambda: " ".join(rng.choice(["A|", "spam!!", "spam!!", "##"]) for _ in range(rng.randrange(5, 60)))
    rows = [(i, good() if i % 3 else bad()) for i in range(500)]
    odd = [(1000, None), (1001, ""), (1002, " \n\t"), (None, bad()), (None, good()), (3, rows[3][1]), (1003, "x" * 200_000), (1004, "a b " * 100_000)]
    docs = spark.createDataFrame([(*r, "q", 1.0) for r in rows + odd], "doc_id long, text string, score string, _words double")
    known = [(i, int(bool(i % 3))) for i in range(500)] + [(None, 1), (7777, 0), (3, 1), (4, None)]
    labels = spark.createDataFrame([(*r, "x") for r in known], "doc_id long, quality int, text string")
    model = quality.train(docs, labels)
    assert 0 < len(model.rules) < 200
    scored = quality.with_score(docs, model, "made")
    assert scored.columns == [*docs.columns, "made"]
    for r in scored.collect():
        s = plain_statistics(r.text)
        logit = model.bias - model.shift + sum(w for rule, w in model.rules if all((s[n] > at) == above for n, above, at in rule))
        assert r.made == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-9)
    told = {r.doc_id: r.predicted for r in quality.classify(docs, labels).collect() if r.doc_id is not None and r.doc_id < 500}
    assert all(told[i] == bool(i % 3) for i in range(500))
    ones = quality.classify(docs, labels.filter("quality = 1")).select("score").distinct().collect()
    assert [r.score for r in ones] == [1.0]
    assert [r.score for r in quality.classify(docs, labels.limit(0)).select("score").distinct().collect()] == [0.5]
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_lasso_shrinks():
    rng = np.random.default_rng(1)
    z = (rng.random((400, 12)) < 0.5).astype(np.float32)
    y = (rng.random(400) < 1 / (1 + np.exp(-(4 * z[:, 0] - 4 * z[:, 1])))).astype(float)
    strong, weak = quality.lasso(z, y, 0.05)[0], quality.lasso(z, y, 1e-4)[0]
    assert strong[0] > 0 > strong[1] and not strong[2:].any() and np.count_nonzero(weak) > 5
    assert not quality.lasso(z, y, 1.0)[0].any()


CLASH = ["_base", "_more", "_rest", "_old", "_secrets", "_text", "score", "_slot", "_key", "g_id", "g_key", "copies"]


def test_stages_beside_clashing_columns(spark):
    """No inner column meets a user's, and no column holds a secret that was redacted."""
    secret = 'token = "dfd1944d2e84f15e89902e" and KEYq8Z7xW2vB4nM6kL9pR3tY1uI5oP0aS'
    rows = [(i, f"fine words {i} " * 3 + (secret if i % 2 else ""), "en", "s", 5, *["keep"] * len(CLASH)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH))
    out = corpus_pipeline.redact_secrets(spark, docs, "")
    assert out.columns == docs.columns
    for r in out.collect():
        assert all("dfd1944d2e84" not in str(v) and "q8Z7xW2vB4nM6" not in str(v) for v in r) and all(r[c] == "keep" for c in CLASH)
        assert ("[secret]" in r.text) == bool(r.doc_id % 2) and r.n_chars == (len(r.text) if r.doc_id % 2 else 5)
    assert {r["score"] for r in secrets.find_secrets(docs, pieces=True).collect()} == {"keep"}
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    few = toxicity.Settings(least_steps=20)
    kept = toxicity.clean_documents(docs, labels, few)
    assert kept.columns == docs.columns and all(r["score"] == "keep" for r in kept.collect())
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    more = docs.withColumn("text", F.when(F.col("doc_id") == 5, F.lit(f"x {item} y")).otherwise(F.col("text")))
    clean = decontam.clean_documents(more, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(range(60)) - {5}


def test_phrase_that_many_items_share(spark):
    """A question stem is one phrase of the look-up, however many items begin with it."""
    stem = "which one of the following statements about this is right"
    items = spark.createDataFrame([(i, f"{stem} " + " ".join(f"i{i}w{j}" for j in range(9))) for i in range(120)], "item_id long, text string")
    docs = spark.createDataFrame([(d, f"a{d} {stem} b{d} " + (stem.replace("following", "following long") if d % 2 else "")) for d in range(50)], "doc_id long, text string")
    chosen, members, index = decontam.build_index(docs, items)
    assert decontam.candidates(chosen, index).filter(F.array_join("words", " ") == stem).count() == 50
    assert members.filter(F.col("phrase") == hashlib.md5(stem.encode()).hexdigest()).count() == 120
    got = decontam.contamination(docs, items).collect()
    ids = hashlib.sha256(",".join(sorted(map(str, range(120)))).encode()).hexdigest()
    assert all((r.n_hit, r.n_items, r.items_sha256, r.contaminated, r.n_near) == (10, 120, ids, True, 0) for r in got) and len(got) == 50


def brute_near(docs, items, slop):
    phrases = {tuple(w[i : i + 10]) for w in (terms(t) for _, t in items) if w for i in range(max(1, len(w) - 9))}
    out = {}
    for d, t in docs:
        w, n = terms(t), 0
        for p in phrases:
            if any(tuple(w[i : i + len(p)]) == p for i in range(len(w))):
                continue
            for i in range(len(w)):
                k = 0
                for word in w[i : i + len(p) + slop] if w[i] == p[0] else ():
                    k += k < len(p) and word == p[k]
                if k == len(p):
                    n += 1
                    break
        out[d] = n
    return out


def test_near_phrases(spark):
    rng = random.Random(6)
    items = [(i, " ".join(f"v{rng.randrange(30)}" for _ in range(rng.choice((4, 12, 20))))) for i in range(12)]
    docs = []
    for d in range(80):
        w = terms(rng.choice(items)[1])
        for _ in range(rng.randrange(0, 4)):
            w.insert(rng.randrange(len(w) + 1), f"v{rng.randrange(30)}")
        docs.append((d, " ".join([f"z{rng.randrange(9)}" for _ in range(rng.randrange(3))] + w)))
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute_near(docs, items, decontam.SLOP)
    assert {r.doc_id: r.n_near for r in got.collect()} == want and sum(want.values()) > 20
