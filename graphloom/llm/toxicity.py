"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of three rows of one hashed table: the word, its first four and its
first five letters, so inflections of a word that was seen share most of its vector. Filters of
several widths run over the vectors, the largest response of each over the whole text is kept
(max pooling), and a logistic layer on those gives a raw score. Training follows the gradient
through the largest responses only, which makes it sparse. A split of the training rows fixes
the cut with the best F1 at the labels' own rate; scores are squeezed so that
this cut is DECISION. On the same split each language with enough rows gets its own threshold;
language serves for that decision only and is never an input of a score.

Training takes every labelled row that is not held out. Rows are dealt by their id to shards of
about SHARD_ROWS; in each of ROUNDS rounds a task goes over its shard from the common weights, in
pieces of PIECE_WORDS words, and the weights that come back are averaged, those of a table row
over the shards that moved it (sums of whole numbers, so reruns agree). The driver holds one
model, whatever the rows. Losses are weighted so that both labels weigh the same. The split for
the cut is scored in tasks and comes back as counts of scores rounded to 1/256.
Scoring is one Arrow pass over all documents: no shuffle, whole texts, memory bounded by a slice
of texts and a word cache. A text's windows begin at its own words only, so its score does not
depend on its neighbours in a batch, and long texts are scored in pieces that overlap by PAD words.

Defined results: null and empty texts get the score of no words; labelled rows without a document
or with a null label are not learned from, nor are ids that have both labels; where rows repeat a
doc_id, that with the smallest hash of its text is learned from; without both labels in the
training rows every score is 0; rows are kept as they are, repeats and null ids included; an
unknown or null language, or one with fewer than ``Settings.least_rows`` calibration rows, takes
DECISION as its threshold; other columns are ignored.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut, free_name

DECISION = 0.7
WORD = regex.compile(r"[^\W\d_]+")
SLICE_WORDS = 25_000
#: Texts of more characters are scored in pieces of SLICE_WORDS words.
LONG_CHARS = 6 * SLICE_WORDS
CACHE_WORDS = 60_000
#: Positions between texts, as wide as the widest filter less one.
PAD = 2
#: Training rows of a shard, words that a task learns from at a time, and rounds where there are several shards.
SHARD_ROWS, PIECE_WORDS, ROUNDS = 4000, 2_000_000, 3
#: Most labelled ids that are broadcast to their texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Weights travel as whole multiples of 1 / FIXED.
FIXED = float(1 << 30)


@dataclass(frozen=True)
class Settings:
    """``per_class``, ``sample_words``: a caller's bounds on the training rows of each label and on
    their words, none if unset; ``least_rows``: calibration rows that a language needs for a
    threshold of its own."""

    per_class: int | None = None
    buckets: int = 1 << 17
    dims: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 6
    least_steps: int = 800
    rate: float = 0.1
    batch: int = 32
    calibration: float = 0.25
    sample_words: int | None = None
    least_rows: int = 60
    seed: int = 7


def features(words: list[str], buckets: int) -> np.ndarray:
    """(n, 3) table rows of words: whole, first four letters, first five."""
    h = xxhash.xxh3_64_intdigest
    out = np.empty((len(words), 3), np.int64)
    for i, w in enumerate(words):
        out[i] = h(w) % (buckets - 1), h("4" + w[:4]) % (buckets - 1), h("5" + w[:5]) % (buckets - 1)
    return out


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


@dataclass
class Model:
    settings: Settings
    table: np.ndarray
    kernels: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    trained: bool = True

    def projected(self, vectors: np.ndarray) -> np.ndarray:
        """Word vectors times all kernels: one block of filters for each width and offset."""
        return vectors @ np.concatenate([k[j] for _, k in sorted(self.kernels.items()) for j in range(len(k))], axis=1)

    def pooled(self, part: np.ndarray, starts: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Largest responses of each text to its windows (where ``inner`` is true) and to an empty one.

        ``part``: projected words, each text followed by PAD zeros (or by the words that follow).
        """
        n, f = len(part), self.settings.filters
        outs, at = [], 0
        for width, _ in sorted(self.kernels.items()):
            response = part[:, at : at + f].copy()
            for j in range(1, width):
                response[: n - j] += part[j:, at + j * f : at + (j + 1) * f]
            at += width * f
            response[~inner] = 0
            outs.append(np.maximum.reduceat(response, starts, axis=0) + self.biases[width])
        return np.maximum(np.concatenate(outs, axis=1), 0)

    def scores(self, raw: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(raw))
        return 1 / (1 + np.exp(-np.clip(raw - self.shift + np.log(DECISION / (1 - DECISION)), -30, 30)))

    def raw(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.out + self.out_bias


def _laid_out(ids: list[np.ndarray], none: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows of texts end to end with PAD empty words after each, where texts begin, and which
    rows begin a window. A text without words has one empty word."""
    gap, blank = np.full((PAD, 3), none, np.int64), np.full((1, 3), none, np.int64)
    ids = [i if len(i) else blank for i in ids]
    sizes = np.array([len(i) for i in ids])
    inner = np.ones(int(sizes.sum()) + PAD * len(ids), bool)
    ends = np.cumsum(sizes + PAD)
    for j in range(1, PAD + 1):
        inner[ends - j] = False
    return np.concatenate([x for i in ids for x in (i, gap)]), ends - sizes - PAD, inner


def _start(s: Settings) -> tuple[Model, dict]:
    """A model before training, and the sums of squares that its steps go by."""
    rng = np.random.default_rng(s.seed)
    table = (rng.standard_normal((s.buckets, s.dims)) * 0.1).astype(np.float32)
    table[s.buckets - 1] = 0
    kernels = {w: (rng.standard_normal((w, s.dims, s.filters)) * 0.3).astype(np.float32) for w in s.widths}
    model = Model(s, table, kernels, {w: np.zeros(s.filters, np.float32) for w in s.widths}, (rng.standard_normal(len(s.widths) * s.filters) * 0.3).astype(np.float32), 0.0)
    memory = {"table": np.full(s.buckets, 1e-6, np.float32), "out": np.full(len(model.out), 1e-6, np.float32), "bias": 1e-6}
    memory |= {("k", w): np.full_like(k, 1e-6) for w, k in kernels.items()} | {("b", w): np.full(s.filters, 1e-6, np.float32) for w in s.widths}
    return model, memory


def _small(model: Model, memory: dict) -> np.ndarray:
    """All weights but the table's, end to end, with their sums of squares."""
    widths = model.settings.widths
    parts = [model.out, [model.out_bias], *(model.kernels[w].ravel() for w in widths), *(model.biases[w] for w in widths)]
    sums = [memory["out"], [memory["bias"]], *(memory["k", w].ravel() for w in widths), *(memory["b", w] for w in widths)]
    return np.concatenate([np.asarray(x, np.float64) for x in (*parts, *sums)])


def _set_small(model: Model, memory: dict, flat: np.ndarray) -> None:
    at = 0

    def take(like: np.ndarray) -> np.ndarray:
        nonlocal at
        at += like.size
        return flat[at - like.size : at].reshape(like.shape).astype(np.float32)

    widths, one = model.settings.widths, np.zeros(1)
    model.out, model.out_bias = take(model.out), float(take(one)[0])
    model.kernels, model.biases = {w: take(model.kernels[w]) for w in widths}, {w: take(model.biases[w]) for w in widths}
    memory["out"], memory["bias"] = take(memory["out"]), float(take(one)[0])
    for kind in "kb":
        for w in widths:
            memory[kind, w] = take(memory[kind, w])


def _fit(model: Model, memory: dict, ids: list[np.ndarray], labels: np.ndarray, weigh: np.ndarray, epochs: int, seed: int) -> None:
    """Goes over the rows and moves the model's weights; ``weigh``: how much each label weighs."""
    s, table = model.settings, model.table
    rng, none, kernels = np.random.default_rng(seed), s.buckets - 1, model.kernels

    def step(name, value, grad):
        memory[name] = memory[name] + grad * grad
        return value - s.rate * grad / np.sqrt(memory[name])

    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for b in range(0, len(order), s.batch):
            some = order[b : b + s.batch]
            rows, starts, inner = _laid_out([ids[i] for i in some], none)
            x = table[rows].sum(axis=1)
            n, docs = len(x), np.repeat(np.arange(len(some)), np.diff(np.r_[starts, len(rows)]))
            tops, pools = {}, []
            for w in s.widths:
                response = x @ kernels[w][0]
                for j in range(1, w):
                    response[: n - j] += x[j:] @ kernels[w][j]
                response[~inner] = 0
                best = np.maximum.reduceat(response, starts, axis=0)
                tops[w] = np.minimum.reduceat(np.where(response == best[docs], np.arange(n)[:, None], n), starts, axis=0)
                pools.append(best + model.biases[w])
            pre = np.concatenate(pools, axis=1)
            pooled = np.maximum(pre, 0)
            wrong = (1 / (1 + np.exp(-np.clip(model.raw(pooled), -30, 30))) - labels[some]) * weigh[labels[some].astype(int)] / len(some)
            back = (wrong[:, None] * model.out[None, :] * (pre > 0)).astype(np.float32)
            model.out = step("out", model.out, (pooled.T @ wrong).astype(np.float32))
            model.out_bias = float(step("bias", model.out_bias, wrong.sum()))
            touched, pulls = [], []
            for k, w in enumerate(s.widths):
                g = back[:, k * s.filters : (k + 1) * s.filters]
                model.biases[w] = step(("b", w), model.biases[w], g.sum(axis=0))
                g = g * inner[tops[w]]  # an empty window moves nothing but the bias
                grad = np.zeros_like(kernels[w])
                for j in range(w):
                    at = np.minimum(tops[w] + j, n - 1)
                    grad[j] = np.einsum("dfe,df->ef", x[at], g)
                    touched.append(at.ravel())
                    pulls.append((g[:, :, None] * kernels[w][j].T[None]).reshape(-1, s.dims))
                kernels[w] = step(("k", w), kernels[w], grad)
            at, pull = np.concatenate(touched), np.concatenate(pulls)
            live = np.abs(pull).sum(axis=1) > 0
            cells, where = np.unique(rows[at[live]].ravel(), return_inverse=True)
            grads = np.zeros((len(cells), s.dims), np.float32)
            np.add.at(grads, where, np.repeat(pull[live], 3, axis=0))
            real = cells != none
            cells, grads = cells[real], grads[real]
            memory["table"][cells] += (grads * grads).mean(axis=1)
            table[cells] -= s.rate * grads / np.sqrt(memory["table"][cells])[:, None]


def _best_cut(raw: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The middle of the cuts with the highest weighted F1."""
    order = np.argsort(raw)[::-1]
    r, hit = raw[order], labels[order] == 1
    tp, fp = np.cumsum(weights[order] * hit), np.cumsum(weights[order] * ~hit)
    score = 2 * tp / (tp + fp + (weights * (labels == 1)).sum())
    last = np.r_[r[1:] != r[:-1], True]
    best = np.nonzero(last & (score >= score[last].max() - 1e-12))[0]
    i = best[len(best) // 2]
    return float((r[i] + r[min(i + 1, len(r) - 1)]) / 2)


def _word_rows(buckets: int):
    """Task: (doc_id, toxic, lang, order, text) -> the same with the text's table rows as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                rows = features(words_of(one.column(4)[0].as_py()), buckets)
                yield pa.RecordBatch.from_arrays([*one.columns[:4], pa.array([len(rows)], pa.int64()), pa.array([rows.astype(np.int32).tobytes()])], names=["doc_id", "toxic", "lang", "order", "n", "rows"])

    return run


def training_rows(docs: DataFrame, labels: DataFrame, s: Settings) -> tuple[DataFrame, dict[int, int]]:
    """The rows to learn from (doc_id, toxic, lang, order, n, rows), a partition for each shard, and rows of each label.

    One row for each id: the labels must agree, and of rows that repeat the id that with the
    smallest hash of its text is taken.
    """
    mine = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
    mine = mine.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").drop("most")
    totals = {r["toxic"]: r["n"] for r in mine.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order, n = F.xxhash64(F.lit(s.seed), F.col("doc_id")), sum(totals.values())
    if s.per_class is not None:
        mine = mine.filter("toxic = 1").orderBy(order, "doc_id").limit(s.per_class).unionByName(mine.filter("toxic = 0").orderBy(order, "doc_id").limit(s.per_class))
        n = min(n, 2 * s.per_class)
    # texts travel once: few ids are broadcast, and many meet their texts where their shard is
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = docs.select("doc_id", text.alias("text"), F.col("lang").cast("string").alias("lang")).filter(~held_out(F.col("doc_id")))
    mine = mine.withColumn("doc_id", F.col("doc_id").try_cast(docs.schema["doc_id"].dataType)).filter("doc_id is not null")
    dealt = lambda d: d.repartition(max(1, -(-n // SHARD_ROWS)), "doc_id")
    met = dealt(known.join(F.broadcast(mine), "doc_id")) if n <= BROADCAST_IDS else dealt(known).join(dealt(mine).hint("merge"), "doc_id")
    one = (
        met.groupBy("doc_id", "toxic").agg(F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text"), "text", "lang")).alias("of"))
        .select("doc_id", "toxic", "of.lang", order.alias("order"), "of.text")
    )
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int, lang string, order long, n long, rows binary"
    counted = cut(one.mapInArrow(_word_rows(s.buckets), schema))
    if s.sample_words is None:
        return counted, totals
    before = Window.orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    within = counted.select("doc_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).filter(F.col("before") < s.sample_words)
    return counted.join(F.broadcast(within.select("doc_id")), "doc_id", "left_semi"), totals


def _pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(toxic, rows) of a task as table rows and labels, about PIECE_WORDS words at a time."""
    ids, labels, held = [], [], 0
    for batch in batches:
        for toxic, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(np.frombuffer(rows.as_buffer().to_pybytes(), np.int32).reshape(-1, 3))
            labels.append(toxic)
            held += len(ids[-1])
            if held >= PIECE_WORDS:
                yield ids, np.array(labels, np.float64)
                ids, labels, held = [], [], 0
    if ids:
        yield ids, np.array(labels, np.float64)


def _learned(rows: DataFrame, s: Settings, weigh: np.ndarray, epochs: int, rounds: int) -> Model:
    """A model trained on (toxic, rows): in each round every partition goes on from the common weights."""
    model, memory = _start(s)
    wide = s.dims + 1
    schema = "cell int, " + ", ".join(f"v{i} long" for i in range(wide))
    for turn in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast((model, memory))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            mine, sums = copy.deepcopy(shared.value)
            learned = False
            for ids, labels in _pieces_of(batches):
                _fit(mine, sums, ids, labels, weigh, epochs, s.seed + turn)
                learned = True
            if learned:
                old, _ = shared.value
                moved = np.nonzero((mine.table != old.table).any(axis=1))[0]
                flat = _small(mine, sums)
                flat = np.r_[flat, np.zeros(-len(flat) % wide)].reshape(-1, wide)
                values = np.r_[flat, np.c_[mine.table[moved], sums["table"][moved]]]
                fixed = np.rint(values * FIXED).astype(np.int64)
                cells = np.r_[-1 - np.arange(len(flat)), moved].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cells), *(pa.array(fixed[:, i]) for i in range(wide))], names=["cell", *(f"v{i}" for i in range(wide))])

        told = rows.mapInArrow(run, schema).groupBy("cell").agg(*[(F.sum(f"v{i}") / F.count(F.lit(1))).alias(f"v{i}") for i in range(wide)]).toArrow()
        shared.unpersist()
        cells, values = told["cell"].to_numpy(), np.stack([told[f"v{i}"].to_numpy() for i in range(wide)], axis=1) / FIXED
        few = cells < 0
        _set_small(model, memory, values[few][np.argsort(-cells[few])].ravel())
        model.table[cells[~few]], memory["table"][cells[~few]] = values[~few, :-1], values[~few, -1]
    return model


def _counted_scores(rows: DataFrame, model: Model) -> pa.Table:
    """(toxic, lang, at, n): how many rows of a label and language have the raw score at / 256."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [float(_raw_of(shared.value, np.frombuffer(x.as_buffer().to_pybytes(), np.int32).reshape(-1, 3))) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.rint(np.clip(raw, -60, 60) * 256).astype(np.int32))], names=["toxic", "lang", "at"])

    found = rows.select("toxic", "lang", "rows").mapInArrow(run, "toxic int, lang string, at int")
    return found.groupBy("toxic", "lang", "at").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("at", "ascending"), ("toxic", "ascending"), ("lang", "ascending")])


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns from the labelled rows of ``docs`` whose crc32(doc_id) modulo 3 is not 1."""
    s = settings
    empty = Model(s, np.zeros((s.buckets, s.dims), np.float32), {w: np.zeros((w, s.dims, s.filters), np.float32) for w in s.widths}, {w: np.zeros(s.filters, np.float32) for w in s.widths}, np.zeros(len(s.widths) * s.filters, np.float32), 0.0, trained=False)
    rows, totals = training_rows(docs, labels, s)
    if len(totals) < 2:
        return empty
    check = F.pmod(F.xxhash64(F.lit(s.seed + 1), F.col("doc_id")), F.lit(10_000)) < int(s.calibration * 10_000)
    counts = {(r["check"], r["toxic"]): r["n"] for r in rows.groupBy(check.alias("check"), "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len({c for _, c in counts}) < 2:
        return empty
    split = len(counts) == 4
    n = np.array([sum(k for (checked, c), k in counts.items() if c == label and not (split and checked)) for label in (0, 1)])
    fitted, checked = (rows.filter(~check), rows.filter(check)) if split else (rows, rows)
    # a small table is one shard and gone over more often; several shards meet after each round
    several = sum(counts.values()) > SHARD_ROWS
    epochs = -(-s.epochs // ROUNDS) if several else max(s.epochs, -(-s.least_steps * s.batch // int(n.sum())))
    model = _learned(fitted.select("toxic", "rows"), s, n.sum() / (2 * n), epochs, ROUNDS if several else 1)
    told = _counted_scores(checked, model)
    y, raw, times, langs = told["toxic"].to_numpy(), told["at"].to_numpy() / 256, told["n"].to_numpy(), np.array(told["lang"].to_pylist(), object)
    seen = np.array([times[y == c].sum() for c in (0, 1)])
    weights = times * np.array([totals[0], totals[1]])[y] / seen[y]
    model.shift = _best_cut(raw, y, weights)
    for lang in sorted({x for x in langs if x is not None}):
        of = langs == lang
        if times[of].sum() >= s.least_rows and len(set(y[of])) == 2:
            model.thresholds[lang] = float(model.scores(np.array([_best_cut(raw[of], y[of], weights[of])]))[0])
    return model


def _in_pieces(n: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of pieces of a text of n words."""
    for begin in range(0, max(n, 1), SLICE_WORDS):
        yield begin, min(n, begin + SLICE_WORDS)


def _raw_of(model: Model, ids: np.ndarray) -> np.ndarray:
    """The raw score of one text's table rows."""
    pools = []
    for begin, end in _in_pieces(len(ids)):
        rows, starts, inner = _laid_out([ids[begin : end + PAD]], model.settings.buckets - 1)
        inner[max(end - begin, 1) :] = False
        pools.append(model.pooled(model.projected(model.table[rows].sum(axis=1)), starts, inner))
    return model.raw(np.maximum.reduce(pools))


def held_out(doc_id):
    """crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class _Scorer:
    """Scores lists of texts; keeps the projections of words it has met, up to CACHE_WORDS."""

    def __init__(self, model: Model):
        self.model = model
        self.zero = model.projected(np.zeros((1, model.settings.dims), np.float32))
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = [self.zero]
        self.known = self.zero

    def _places(self, words: list[list[str]]):
        """A function from a word to its row of ``known``; words met first are added to it."""
        if len(self.at) > CACHE_WORDS:
            self._reset()
        fresh = list({w for ws in words for w in ws if w not in self.at})
        if fresh:
            first = len(self.known)
            self.at.update(zip(fresh, range(first, first + len(fresh)), strict=True))
            vectors = self.model.table[features(fresh, self.model.settings.buckets)].sum(axis=1)
            self.known = np.concatenate([self.known, self.model.projected(vectors)])
        return self.at.__getitem__

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """Scores of texts of usual length, all at once."""
        words = [words_of(t) for t in texts]
        of, rows, gap = self._places(words), [], [0] * PAD
        for ws in words:
            rows += map(of, ws) if ws else (0,)
            rows += gap
        sizes = np.fromiter((max(len(ws), 1) + PAD for ws in words), np.int64, len(words))
        ends = np.cumsum(sizes)
        inner = np.ones(len(rows), bool)
        for j in range(1, PAD + 1):
            inner[ends - j] = False
        return self.model.scores(self.model.raw(self.model.pooled(self.known[np.array(rows)], ends - sizes, inner)))

    def long(self, text: str) -> np.ndarray:
        """The score of one long text; a piece of its words is held at a time."""
        found = (m.group() for m in WORD.finditer(text.lower()))
        pools, held = [], list(islice(found, SLICE_WORDS + PAD))
        while True:
            last = len(held) < SLICE_WORDS + PAD
            rows = [*map(self._places([held]), held)] or [0]
            inner = np.arange(len(rows) + PAD) < (len(rows) if last else SLICE_WORDS)
            pools.append(self.model.pooled(self.known[np.array([*rows, *[0] * PAD])], np.zeros(1, np.int64), inner))
            if last:
                return self.model.scores(self.model.raw(np.maximum.reduce(pools)))
            held = held[SLICE_WORDS:] + list(islice(found, SLICE_WORDS))


def score(docs: DataFrame, model: Model, *keep: str, into: str = "score") -> DataFrame:
    """(text) -> the columns ``keep`` and ``into`` (none of them), one row for each row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    fields = docs.select(*keep).schema.fields
    names = [f.name for f in fields]
    at = names.index("text") if "text" in names and docs.schema["text"].dataType.simpleString() == "string" else None  # texts travel once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            texts, begin, held, out = batch.column(at or 0), 0, 0, []
            sizes = [n or 0 for n in pc.utf8_length(texts).to_pylist()]
            for i, n in enumerate([*sizes, 0]):
                held += n
                if begin < i and (held > LONG_CHARS or i == len(sizes)):
                    out.append(scorer(texts.slice(begin, i - begin).to_pylist()))
                    begin, held = i, n
                if n > LONG_CHARS:
                    out.append(scorer.long(texts[i].as_py()))
                    begin, held = i + 1, 0
            scores = pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[at is None :], scores], names=[*names, into])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    apart = [F.col("text").cast("string").alias(free_name(docs, "_text"))] if at is None else []
    return docs.select(*apart, *keep).mapInArrow(run, f"{schema}, `{into}` double")


def threshold(model: Model, lang):
    """The threshold of a row's language; DECISION where it has none of its own."""
    out = F.lit(DECISION)
    for name, value in sorted(model.thresholds.items()):
        out = F.when(lang == name, F.lit(value)).otherwise(out)
    return out


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold, flagged: one row for each row of ``docs``.

    ``predicted``: score at least DECISION; ``flagged``: score at least the language's threshold.
    """
    model = train(docs, labels, settings)
    scored = score(docs, model, "doc_id", "lang")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= DECISION).cast("int").alias("predicted"),
        threshold(model, F.col("lang")).alias("threshold"),
        (F.col("score") >= threshold(model, F.col("lang"))).alias("flagged"),
    )


def clean_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the rows that their language's threshold rejects."""
    model = train(docs, labels, settings)
    into = free_name(docs, "score")
    scored = score(docs, model, *docs.columns, into=into)
    return scored.filter(F.col(into) < threshold(model, F.col("lang"))).select(*docs.columns)
