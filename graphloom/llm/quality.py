"""Quality classifier: a sparse ensemble of rules over text statistics, scored by column expressions.

``statistics`` measures a whole text with column functions (shares of marks, capitals, pipes and
repeated words, shape of words and lines). Boosted trees of small depth are grown over those
statistics; every path from a root to a node is taken out as a conjunction of comparisons, and a
logistic regression with an L1 penalty gives each rule a weight, most of them zero. What is left is
compiled to Spark columns, so scoring is one scan without Python and without a shuffle.

Training takes at most ``Settings.per_class`` labelled rows of each label, those with the smallest
hash of their doc_id (the documented bound of the sample): only their statistics reach the driver.
The penalty is the largest whose log-loss on a calibration split is close to the best; the same
split fixes the cut with the best balanced accuracy, and scores are shifted so that it is DECISION.

Defined results: null and empty texts have the statistics of no words and are scored by them;
labelled rows without a document or with a null label are not learned from, nor are ids with both
labels; where rows repeat a doc_id, that with the smallest hash of its text is learned from; with
one label only among the training rows every score is that label, with none 0.5; rows are kept as
they are, repeats and null ids included (a null id is not held out); other columns
are ignored by ``classify`` and kept by ``with_score``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import LOWER, UPPER, bound, free_name, text_or_empty

DECISION = 0.3
DIGITS, MARKS, BANGS, STOPS, BRACKETS = "0123456789", "#%$*&@^~", "!?", ".,;:", "<>{}[]()=/\\"


@dataclass(frozen=True)
class Settings:
    """``per_class``: most training rows of each label (the documented bound of the sample)."""

    per_class: int = 8000
    trees: int = 40
    depth: int = 3
    rate: float = 0.3
    bins: int = 32
    least: int = 10
    rows_of_tree: float = 0.6
    penalties: tuple[float, ...] = (3e-2, 1e-2, 3e-3, 1e-3, 3e-4)
    slack: float = 1.25
    calibration: float = 0.3
    seed: int = 13


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, each a double that is never null or not a number."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    facts = bound(
        words,
        lambda w: F.struct(
            F.size(w).alias("n"),
            F.size(F.array_distinct(w)).alias("kinds"),
            F.size(F.filter(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: a.eqNullSafe(b)), lambda x: x)).alias("again"),
            F.coalesce(F.array_max(F.transform(w, F.length)), F.lit(0)).alias("longest"),
            F.size(F.filter(w, lambda x: F.length(x) <= 3)).alias("short"),
            F.size(F.filter(w, lambda x: F.length(x) <= 1)).alias("single"),
        ),
    )
    rows = bound(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("kinds")))
    left = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")
    share = lambda part, of: part.cast("double") / F.greatest(of, F.lit(1)).cast("double")
    n_chars = F.length(text)
    return {
        "words": F.log1p(facts["n"].cast("double")),
        "word_length": share(n_chars, facts["n"]),
        "longest_word": F.log1p(facts["longest"].cast("double")),
        "short_words": share(facts["short"], facts["n"]),
        "single_characters": share(facts["single"], facts["n"]),
        "distinct_words": share(facts["kinds"], facts["n"]),
        "same_as_next": share(facts["again"], facts["n"]),
        "lines": F.log1p(rows["n"].cast("double")),
        "distinct_lines": share(rows["kinds"], rows["n"]),
        "words_of_line": share(facts["n"], rows["n"]),
        "capitals": share(left(UPPER), n_chars),
        "small_letters": share(left(LOWER), n_chars),
        "digits": share(left(DIGITS), n_chars),
        "marks": share(left(MARKS), facts["n"]),
        "bangs": share(left(BANGS), facts["n"]),
        "stops": share(left(STOPS), facts["n"]),
        "brackets": share(left(BRACKETS), facts["n"]),
        "pipes": share(left("|"), facts["n"]),
    }


#: A comparison: (statistic, whether it must be above, threshold).
Rule = tuple[tuple[str, bool, float], ...]


@dataclass
class Model:
    """Rules with their weights; ``logit`` is ``bias`` plus the weights of the rules that hold."""

    rules: list[tuple[Rule, float]] = field(default_factory=list)
    bias: float = 0.0
    shift: float = 0.0
    constant: float | None = None

    def score(self, of) -> Column:
        """The score as a column; ``of(name)`` is the column of a statistic."""
        if self.constant is not None:
            return F.lit(self.constant)
        logit = F.lit(self.bias - self.shift)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for name, above, at in rule:
                holds = holds & (of(name) > at if above else of(name) <= at)
            logit = logit + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-logit))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def grown_rules(x: np.ndarray, y: np.ndarray, names: list[str], s: Settings) -> list[Rule]:
    """Paths of boosted trees, each told once."""
    rng = np.random.default_rng(s.seed)
    cuts = [_cuts(x[:, f], s.bins) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)  # x <= cuts[b] iff bin <= b
    logit = np.full(len(y), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    found: dict[Rule, None] = {}
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-logit))
        pull, weight = y - p, np.maximum(p * (1 - p), 1e-6)
        sampled = rng.random(len(y)) < s.rows_of_tree
        nodes: list[tuple[dict[tuple[int, bool], int], np.ndarray]] = [({}, np.ones(len(y), bool))]
        for depth in range(s.depth + 1):
            below = []
            for path, rows in nodes:
                some = np.nonzero(rows & sampled)[0]
                best = (1e-9, -1, -1)
                if depth < s.depth and len(some) >= 2 * s.least:
                    g, h = pull[some].sum(), weight[some].sum()
                    for f, c in enumerate(cuts):
                        if len(c):
                            at = binned[some, f]
                            gl, hl, nl = (np.cumsum(np.bincount(at, v, len(c) + 1))[:-1] for v in (pull[some], weight[some], None))
                            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                            gain[(nl < s.least) | (len(some) - nl < s.least)] = -1
                            b = int(np.argmax(gain))
                            best = max(best, (float(gain[b]), f, b))
                _, f, b = best
                if f < 0:
                    logit[rows] += s.rate * pull[some].sum() / (weight[some].sum() + 1)
                    continue
                for above in (False, True):
                    old = path.get((f, above))
                    edge = b if old is None else max(b, old) if above else min(b, old)
                    into = {**path, (f, above): edge}
                    below.append((into, rows & ((binned[:, f] > b) == above)))
                    found[tuple(sorted((names[i], up, float(cuts[i][k])) for (i, up), k in into.items()))] = None
            nodes = below
    return list(found)


def held(rules: list[Rule], x: np.ndarray, names: list[str]) -> np.ndarray:
    """Which rules hold for which rows, as 0 and 1."""
    at = {n: i for i, n in enumerate(names)}
    out = np.ones((len(x), len(rules)), np.float32)
    for r, rule in enumerate(rules):
        for name, above, edge in rule:
            out[:, r] *= (x[:, at[name]] > edge) == above
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with an L1 penalty, by accelerated proximal steps."""
    n = len(y)
    one = np.concatenate([z, np.ones((n, 1), np.float32)], axis=1)
    v = np.ones(one.shape[1])
    for _ in range(20):  # largest curvature, by power iteration
        v = one.T @ (one @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / float(np.linalg.norm(one.T @ (one @ v)) * 1.05)
    w = ahead = np.zeros(one.shape[1])
    t = 1.0
    for _ in range(steps):
        grad = one.T @ (1 / (1 + np.exp(-np.clip(one @ ahead, -30, 30))) - y) / n
        new = ahead - rate * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / after * (new - w), new, after
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, y: np.ndarray, names: list[str], s: Settings) -> Model:
    """The ensemble of the rows ``x`` (statistics in the order of ``names``) and labels ``y``."""
    if not len(y) or y.min() == y.max():
        return Model(constant=float(y[0]) if len(y) else 0.5)
    part = np.random.default_rng(s.seed).random(len(y)) < s.calibration
    if len(np.unique(y[part])) < 2 or len(np.unique(y[~part])) < 2:
        part = np.zeros(len(y), bool)
    learn, check = ~part, part if part.any() else ~part
    rules = grown_rules(x[learn], y[learn], names, s)
    z = held(rules, x, names)
    tried = []
    for penalty in s.penalties:
        w, bias = lasso(z[learn], y[learn], penalty)
        logit = np.clip(z[check] @ w + bias, -30, 30)
        tried.append((float(np.mean(np.log1p(np.exp(-logit)) + (1 - y[check]) * logit)), w, bias, logit))
    least = min(t[0] for t in tried)
    _, w, bias, logit = next(t for t in tried if t[0] <= least * s.slack)
    order = np.argsort(logit, kind="stable")
    sorted_logit, is_one = logit[order], y[check][order]
    fit_of = np.r_[0, np.cumsum(1 - 2 * is_one)]  # rows told right, but for a constant, with the cut before each row, and after all
    fit_of[1:-1][sorted_logit[1:] == sorted_logit[:-1]] = -len(order)
    k = int(np.argmax(fit_of))
    cut = (sorted_logit[max(k - 1, 0)] + sorted_logit[min(k, len(order) - 1)]) / 2
    kept = [(r, float(v)) for r, v in zip(rules, w, strict=True) if v]
    return Model(kept, bias, float(cut - math.log(DECISION / (1 - DECISION))))


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """The model of the labelled rows that are not held out; see the module's text for its bounds."""
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).filter("y = y2")
        .select("l_id", "y", F.xxhash64("l_id").alias("h"))
    )
    picked = [known.filter(F.col("y") == k).orderBy("h", "l_id").limit(s.per_class) for k in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 per_class rows
    text = docs.select(F.col("doc_id").cast("long").alias("d_id"), text_or_empty().alias("body"))
    own = text.join(picked, F.col("d_id") == F.col("l_id")).select("l_id", "y", "h", F.struct(F.xxhash64("body").alias("b"), F.struct(*[c.alias(n) for n, c in statistics(F.col("body")).items()]).alias("s")).alias("row"))
    rows = own.groupBy("l_id", "y", "h").agg(F.min("row").alias("row")).select("y", "h", "l_id", "row.s.*").toPandas().sort_values(["h", "l_id"])
    names = [c for c in rows.columns if c not in ("y", "h", "l_id")]
    return fit(rows[names].to_numpy(np.float64), rows["y"].to_numpy(np.float64), names, s)


def with_score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """``docs`` with the column ``into`` (replaced if there is one): the score of each row's text."""
    measures = statistics(text_or_empty())
    own = {n: free_name(docs, f"_{n}") for n in measures}
    # a column for each statistic: fields of one struct would be worked out again for each use
    measured = docs.withColumns({own[n]: c for n, c in measures.items()})
    return measured.withColumn(into, model.score(lambda n: F.col(own[n]))).drop(*own.values())


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted (score at least DECISION): one row for each row of ``docs``."""
    scored = with_score(docs.select("doc_id", "text"), train(docs, labels, settings))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= DECISION).cast("int").alias("predicted"))
