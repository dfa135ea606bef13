import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import simhash


def brute_fp(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """rows: (doc_id, fp unsigned) -> component_id of each."""
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 4 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (d, _), x in zip(rows, label):
        if d is not None:
            least[x] = min(d, least.get(x, d))
    return [least.get(x) for x in label]


def test_golay_neighbours():
    table = simhash.golay_table()
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 300)
    sets = simhash.segment_indices(words, table)
    assert {len(s) for s in sets} <= {1, 6}
    for w, s in zip(words, sets):
        for _ in range(5):
            flips = rng.choice(23, 2, replace=False)
            other = simhash.segment_indices(np.array([w ^ (1 << flips[0]) ^ (1 << flips[1])]), table)[0]
            assert set(s) & set(other)


def test_fingerprint():
    for t in [None, "", "  ", "One", "a b c", "A b c d", "Straße x ÄB c d e\tf", "w " * 5000]:
        assert simhash.fingerprint(t) == brute_fp(t)


def test_links_lose_none(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base:
        for k in (1, 2, 3, 4, 5, 6):
            x = b
            for bit in rng.sample(range(64), k):
                x ^= 1 << bit
            fps.add(x)
    hub = rng.getrandbits(64)  # a dense cluster
    for _ in range(400):
        x = hub
        for bit in rng.sample(range(14), rng.randint(0, 5)):
            x ^= 1 << bit
        fps.add(x)
    rows = sorted(fps)
    frame = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in rows], "fp long")
    want = brute_components([(i, x) for i, x in enumerate(rows)])
    sizes = simhash.BUCKET_ROWS
    try:
        for bound in (sizes, 16):
            simhash.BUCKET_ROWS = bound
            roots = {r.node: r.root for r in simhash.components(simhash.links(frame)).collect()}
            got = [roots.get(s, s) for s in (int(np.uint64(x).astype(np.int64)) for x in rows)]
            pairs = set(zip(got, want))
            assert len(pairs) == len(set(got)) == len(set(want))
    finally:
        simhash.BUCKET_ROWS = sizes


def test_documents(spark):
    rows = [(5, "a b c d e f", "x"), (3, "a b c d e f", "y"), (7, None, "z"), (6, "", None), (None, "q r s t u v w", "x"), (3, "a b c d e f", "y")]
    rows += [(100 + i, " ".join(f"w{i}x{j}" for j in range(40)), "s") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((str(r.doc_id), int(np.int64(r.fp).astype(np.uint64)), r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = [(d, brute_fp(t)) for d, t, _ in rows]
    assert got == sorted((str(d), f, c) for (d, f), c in zip(fps, brute_components(fps)))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "6", "None"] + [str(100 + i) for i in range(5)])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_of_each_judges_rows(spark):
    text = " ".join(f"word{i}" for i in range(400))
    near = text + " more"
    other = " ".join(f"x{i}" for i in range(60))
    assert bin(brute_fp(text) ^ brute_fp(near)).count("1") <= 4
    rows = [(1, text, "a"), (2, text, "a"), (2, other, "a"), (None, text, "b"), (None, "no id here at all", "c"), (None, "no id here at all", "c"), (None, "no id here at all", "d"), (1, near, "e")]
    rows += [(4, "p q r s t", "a"), (4, "p q r s t", "b"), (4, "p q r s t", "b")]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, source string, _key int, g_id int, _slot int, key int")
    kept = simhash.one_of_each(docs.repartition(3)).collect()
    assert {(r.doc_id, r.text) for r in kept} in ({(1, t), (2, other), (None, "no id here at all"), (4, "p q r s t")} for t in (text, near))
    assert len(kept) == 4 and all(r[3:] == (1, 2, 3, 4) for r in kept)
    again = simhash.one_of_each(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, kept))
    texts = spark.createDataFrame([(f"id{i}", text if i % 2 else other) for i in range(6)], "doc_id string, text string")
    assert {r.doc_id for r in simhash.one_of_each(texts).collect()} == {"id0", "id1"}
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_hot_groups_are_spread(spark, monkeypatch):
    from graphloom.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(i if i % 3 else None, text) for i in range(300)] + [(1000 + i, f"{text} tail{i}") for i in range(40)] + [(i, f"own text of {i}") for i in range(2000, 2010)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), int(np.int64(r.fp).astype(np.uint64)), r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = [(d, brute_fp(t)) for d, t in rows]
    assert got == sorted((str(d), f, c) for (d, f), c in zip(fps, brute_components(fps)))


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, brute_fp(r.text)) for r in docs.orderBy("doc_id").collect()]
    got = [r.component_id for r in simhash.near_duplicates(docs).orderBy("doc_id").collect()]
    assert got == brute_components(rows)
