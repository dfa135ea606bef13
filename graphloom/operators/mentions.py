"""Many labels in many texts: automata over all forms of the labels, each text read once for each part.

A label is looked for as it is written, in lower case and between word bounds, and by its
normalized words in the text's normalized words (a CJK label also within a run of signs). All forms
go into Aho-Corasick automata. Forms are dealt by hash into parts of about PART_BYTES, measured
first, so that a part's automaton fits a task whatever the number of labels; a part is broadcast,
every text runs once through it, and hits are told by the number of a label. No join on words is
made, and no text or label is gathered: a label that a third of the texts hold is just more rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import evidence as E
from graphloom.plans.shared import fresh_dir
from graphloom.plans.shared import written as cut

#: Bytes of forms in one automaton; a node takes some 30 to 100 bytes of memory for each.
PART_BYTES = 2 << 20
#: Rows that a task tells at once.
TOLD_ROWS = 10_000


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label) -> (label, kind, form): kind 0 as written, 1 normalized words, 2 normalized with CJK signs."""
    for batch in batches:
        rows = []
        for label in batch.column(0).to_pylist():
            form, words = label.strip().lower(), E.plain_text(label)
            rows += [(label, 0, form)] if form else []
            rows += [(label, 2 if E.CJK.search(words) else 1, words)] if words else []
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string()), strict=True)] if rows else [pa.array([], t) for t in (pa.string(), pa.int32(), pa.string())], names=["label", "kind", "form"])


class Finder:
    """Automata of a part's forms: one over texts as written, one over normalized texts."""

    def __init__(self, forms: list[tuple[str, int, str]], loose: bool):
        self.loose, self.labels = loose, [label for label, _, _ in forms]
        at: tuple[dict, dict] = {}, {}
        for i, (_, kind, form) in enumerate(forms):
            at[min(kind, 1)].setdefault(form, []).append((i, kind))
        self.automata = []
        for found in at:
            automaton = ahocorasick.Automaton()
            for form, who in found.items():
                automaton.add_word(form, (len(form), who))
            if found:
                automaton.make_automaton()
            self.automata.append(automaton if found else None)

    def __call__(self, text: str) -> set[str]:
        """Labels that the text holds; ``loose``: also within words."""
        out: set[int] = set()
        written, plain = self.automata
        if written is not None:
            low = text.lower()
            for end, (n, who) in written.iter(low):
                around = low[end - n : end - n + 1] if end - n >= 0 else ""
                around += low[end + 1 : end + 2]
                if self.loose or not any(c == "-" or E._WORD.match(c) for c in around):
                    out.update(i for i, _ in who)
        if plain is not None:
            words = E.plain_text(text)
            for end, (n, who) in plain.iter(words):
                whole = (end - n < 0 or words[end - n] == " ") and (end + 1 == len(words) or words[end + 1] == " ")
                out.update(i for i, kind in who if whole or self.loose or kind == 2)
        return {self.labels[i] for i in out}


def _told(labels: list[str], chunks: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(chunks, kind)], names=["label", "chunk_id"])


def _find(part: Broadcast, loose: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(part.value, loose)
        for batch in batches:
            kind, labels, chunks = batch.schema.field(0).type, [], []
            for at, text in zip(*batch.columns, strict=True):
                found = sorted(finder(text.as_py()))
                labels += found
                chunks += [at.as_py()] * len(found)
                if len(labels) >= TOLD_ROWS:
                    yield _told(labels, chunks, kind)
                    labels, chunks = [], []
            if labels:
                yield _told(labels, chunks, kind)

    return run


def _find_declared(part: Broadcast, loose: bool):
    """Each label once for a task, with the first chunk there that declares it; what is told is not asked again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, done = Finder(part.value, loose), set()
        for batch in batches:
            for at, text in zip(*batch.columns, strict=True):
                text = text.as_py()
                if not E.may_declare(text):
                    continue
                new = [label for label in sorted(finder(text) - done) if E.declared(label, text)]
                done.update(new)
                if new:
                    yield _told(new, [at.as_py()] * len(new), batch.schema.field(0).type)

    return run


def mentions(labels: DataFrame, chunks: DataFrame, loose: bool = False, task=_find) -> DataFrame:
    """(label), (chunk_id, text) -> (label, chunk_id): the chunks that hold a label, each once.

    Holding is what ``evidence.grounded`` says; with ``loose`` a label's signs within words count too.
    Null labels and texts give nothing. Texts are dealt anew, since many small ones lie in one split.
    """
    spark, at = labels.sparkSession, fresh_dir(labels.sparkSession, "mentions")
    labels.select(F.col("label").cast("string")).filter("label is not null").distinct().mapInArrow(_forms, "label string, kind int, form string").write.parquet(f"{at}/forms")
    forms = spark.read.parquet(f"{at}/forms")
    size = forms.agg(F.coalesce(F.sum(F.octet_length("form") + F.octet_length("label")), F.lit(0)).alias("b")).first()["b"]
    parts = size // PART_BYTES + 1
    texts = chunks.select("chunk_id", F.col("text").cast("string").alias("text")).filter("text is not null").repartition("chunk_id")
    texts = cut(texts) if parts > 1 else texts
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    for i in range(parts):
        some = forms.filter(F.pmod(F.xxhash64("form"), F.lit(parts)) == i)
        shared = spark.sparkContext.broadcast([tuple(r) for r in some.collect()])  # about PART_BYTES
        texts.mapInArrow(task(shared, loose), f"label string, chunk_id {kind}").write.parquet(f"{at}/found/part={i}")
        shared.destroy()
    return spark.read.schema(f"label string, chunk_id {kind}, part int").parquet(f"{at}/found").select("label", "chunk_id").distinct()


def first_mentions(labels: DataFrame, chunks: DataFrame, most: int | None = 4) -> DataFrame:
    """(label, chunk_id): the first chunks that hold each label, all without ``most``."""
    found = mentions(labels, chunks)
    if most is None:
        return found
    order = F.row_number().over(Window.partitionBy("label").orderBy("chunk_id"))
    return found.withColumn("_i", order).filter(F.col("_i") <= most).select("label", "chunk_id")


def declared_anywhere(labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """(label): labels that some chunk declares to be one individual; only chunks with their signs are asked."""
    return mentions(labels, chunks, loose=True, task=_find_declared).select("label").distinct()
