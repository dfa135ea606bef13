"""History, provenance, releases and queues: joins and aggregations over the metadata tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.operators import store
from graphloom.plans.shared import cut, fresh_dir

SHARD_ROWS = (1_000, 5_000_000)


def rollback(current: DataFrame, changes: DataFrame, cutoff_event) -> DataFrame:
    """(line) after all events from ``cutoff_event`` on are undone.

    ``changes``: (event_id, group_id, created_at, op, line), op 'add' or 'remove'. An event of a
    group is undone with its whole group from the group's first event on. For each line the
    earliest undone event tells what was before: nothing if it added the line, the line if it
    removed it. No replay, one aggregation.
    """
    chosen = changes.filter(F.col("event_id") == cutoff_event).select("group_id", "created_at").distinct()
    group = changes.join(chosen.select(F.col("group_id").alias("_g")).filter("_g is not null").distinct(), F.col("group_id") == F.col("_g"), "left_semi")
    start = chosen.select("created_at").unionByName(group.select("created_at")).agg(F.min("created_at")).first()[0]
    undone = changes.filter(F.col("created_at") >= F.lit(start))
    first = undone.groupBy("line").agg(F.min_by("op", F.struct("created_at", "event_id")).alias("op"))
    both = current.select("line", F.lit(True).alias("now")).distinct().join(first, "line", "full_outer")
    return both.filter(F.when(F.col("op").isNull(), F.col("now")).otherwise(F.col("op") == "remove")).select("line")


def history_page(events: DataFrame, category: str | None = None, text: str | None = None, most: int = 200) -> DataFrame:
    """Newest events first, by category prefix and text in any case."""
    if category:
        events = events.filter(F.col("action").like(f"{category}.%"))
    if text:
        events = events.filter(F.contains(F.lower("summary"), F.lit(text.lower())) | F.contains(F.lower("action"), F.lit(text.lower())))
    return events.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(most)


def activity(events: DataFrame, users: DataFrame, most: int = 30) -> DataFrame:
    """(id, created_at, action, name): the newest events with their users' names, ``?`` where unknown."""
    named = events.join(users.select(F.col("user_id").alias("_u"), "name"), F.col("user_id") == F.col("_u"), "left")
    return named.select("id", "created_at", "action", F.coalesce("name", F.lit("?")).alias("name")).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(most)


def replace_chunks(chunks: DataFrame, parsed: DataFrame) -> DataFrame:
    """Chunks after documents were parsed again: theirs are the new ones, others stay."""
    again = parsed.select(F.col("document_id").alias("_d")).distinct()
    return chunks.join(again, F.col("document_id") == F.col("_d"), "left_anti").unionByName(parsed)


def trace(provenance: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(key, chunk_id, document_id, filename): where keys come from; a lost document is '(deleted)'."""
    c = chunks.select(F.col("chunk_id").alias("_c"), "document_id")
    d = documents.select(F.col("document_id").alias("_d"), "filename")
    out = provenance.join(c, F.col("chunk_id") == F.col("_c"), "left").join(d, F.col("document_id") == F.col("_d"), "left")
    return out.select("key", "chunk_id", "document_id", F.coalesce("filename", F.lit("(deleted)")).alias("filename"))


def provenance_counts(traced: DataFrame) -> DataFrame:
    """(document_id, keys, chunks): distinct keys and chunks of each document."""
    return traced.groupBy("document_id").agg(F.countDistinct("key").alias("keys"), F.countDistinct("chunk_id").alias("chunks"))


def contribution(traced: DataFrame, document_id) -> DataFrame:
    """(keys, only_here): a document's keys, and those that no other document supports."""
    per_key = traced.groupBy("key").agg(F.max((F.col("document_id") == document_id).cast("int")).alias("here"), F.countDistinct("document_id").alias("n"))
    return per_key.filter("here = 1").agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("n") == 1).alias("only_here"))


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without documents ``gone`` (document_id): chunks, provenance and resolutions follow."""
    g = gone.select(F.col("document_id").alias("_gone")).distinct()
    lost = tables["chunk"].join(g, F.col("document_id") == F.col("_gone"), "left_semi").select(F.col("chunk_id").alias("_lost"))
    out = {n: tables[n].join(g, F.col("document_id") == F.col("_gone"), "left_anti") for n in ("document", "chunk")}
    for n in ("axiom_provenance", "abox_provenance", "entity_resolution"):
        if n in tables:
            out[n] = tables[n].join(lost, F.col("chunk_id") == F.col("_lost"), "left_anti")
    return out


def folder_path(x: Column) -> Column:
    """``/a/b`` form of a folder."""
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "^[/ ]+|[/ ]+$", ""), "/+", "/"))


def select_documents(documents: DataFrame, ks_id, ids: list | None = None, folders: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """Documents of a knowledge system that are named by id or lie in one of the folders."""
    mine = documents.filter(F.col("ks_id") == ks_id)
    hit = F.col("document_id").isin(ids) if ids else F.lit(False)
    for folder in folders or []:
        path = "/" + "/".join(p for p in folder.split("/") if p.strip())
        at = folder_path(F.col("folder"))
        hit = hit | (at == path)
        if recursive:
            hit = hit | F.startswith(at, F.lit(path.rstrip("/") + "/"))
    return mine.filter(hit) if ids or folders else mine


def queue(rows: DataFrame, statuses: list[str], text: str | None = None, take: int = 50, most: int = 200) -> DataFrame:
    """Queue entries by status and text, oldest first."""
    rows = rows.filter(F.col("status").isin(statuses))
    if text:
        rows = rows.filter(F.contains(F.lower("surface_form"), F.lit(text.lower())))
    return rows.orderBy("created_at", "id").limit(max(1, min(take, most)))


def current_release(deployments: DataFrame) -> DataFrame:
    """(ks_id, release_id): the newest deployment of each knowledge system."""
    return deployments.groupBy("ks_id").agg(F.max_by("release_id", F.struct("created_at", "release_id")).alias("release_id"))


def next_version(releases: DataFrame) -> DataFrame:
    """(ks_id, next, lowest_free): one more than the largest version, and the smallest unused one."""
    own = releases.select("ks_id", "version").distinct()
    most = own.groupBy("ks_id").agg((F.max("version") + 1).alias("next"))
    after = own.select("ks_id", (F.col("version") + 1).alias("version")).unionByName(own.select("ks_id", F.lit(1).alias("version"))).distinct()
    free = after.join(own, ["ks_id", "version"], "left_anti").groupBy("ks_id").agg(F.min("version").alias("lowest_free"))
    return most.join(free, "ks_id")


def gate(conflicts: DataFrame, violations: DataFrame, proposals: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Counts that a release must bring to zero, and their sum: one row."""
    parts = {
        "conflicts": conflicts.filter("status = 'open' and severity = 'error'"), "violations": violations.filter("severity = 'error'"),
        "proposals": proposals.filter("status = 'pending'"), "resolutions": resolutions.filter("status = 'pending'"),
    }
    every = None
    for name, rows in parts.items():
        tagged = rows.select(F.lit(name).alias("kind"))
        every = tagged if every is None else every.unionByName(tagged)
    return every.agg(*[F.count_if(F.col("kind") == name).alias(name) for name in parts], F.count(F.lit(1)).alias("blocking"))


def release_diff(before: DataFrame, after: DataFrame, samples: int = 20) -> DataFrame:
    """(g, op, n, sample): what changed in each layer, with the first lines in order."""
    old, new = before.select("g", T.line_of().alias("line")).distinct(), after.select("g", T.line_of().alias("line")).distinct()
    both = new.subtract(old).withColumn("op", F.lit("added")).unionByName(old.subtract(new).withColumn("op", F.lit("removed")))
    both = cut(both)
    rank = F.row_number().over(Window.partitionBy("g", "op").orderBy("line"))
    first = both.withColumn("_n", rank).filter(F.col("_n") <= samples)  # the limit reaches the map side
    shown = first.groupBy("g", "op").agg(F.array_sort(F.collect_list("line")).alias("sample"))
    return both.groupBy("g", "op").agg(F.count(F.lit(1)).alias("n")).join(shown, ["g", "op"])


def export(quads: DataFrame, folder: str, layers: dict[str, str], shard_rows: int = 100_000) -> DataFrame:
    """Writes each layer's N-Quads in shards of at most ``shard_rows`` lines; (layer, file, lines, sha256).

    Counts and hashes are taken from the files as written, file by file in tasks.
    """
    if not SHARD_ROWS[0] <= shard_rows <= SHARD_ROWS[1]:
        raise ValueError(f"a shard has {SHARD_ROWS[0]} to {SHARD_ROWS[1]} lines")
    spark, parts = quads.sparkSession, []
    for layer, graph_iri in layers.items():
        store.lines(quads.filter(F.col("g") == graph_iri)).write.option("maxRecordsPerFile", shard_rows).text(f"{folder}/{layer}")
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/{layer}")
        n = F.length("content") - F.octet_length(F.replace(F.decode("content", "UTF-8"), F.lit("\n"), F.lit("")))
        parts.append(files.select(F.lit(layer).alias("layer"), "path", n.cast("long").alias("lines"), F.sha2("content", 256).alias("sha256")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    manifest = f"{folder}/_manifest"
    out.write.json(manifest)
    return spark.read.schema("layer string, path string, lines long, sha256 string").json(manifest)


def capture(quads: DataFrame, provenance: DataFrame, root: str, version: int) -> str:
    """A release: a snapshot of the layers and, beside it, the provenance of their statements."""
    at = f"{root.rstrip('/')}/release-{version}"
    quads.write.partitionBy("g").parquet(f"{at}/quads")
    keyed = quads.select("g", T.triple_key(F.col("s"), F.col("p"), T.object_text(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang"))).alias("key")).distinct()
    provenance.join(keyed, "key").write.parquet(f"{at}/provenance")
    return at


def merge_counts(merges: DataFrame) -> DataFrame:
    """Sums of the counters of merge records."""
    return merges.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c, t in merges.dtypes if t in ("int", "bigint")])


def directory_hash(spark: SparkSession, folder: str) -> str:
    """SHA-256 over the sorted relative paths and content hashes of a folder's files.

    The files are hashed in tasks; the list of their names and hashes is put together in one.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = re.sub(r"^[a-z0-9]+:(?://[^/]*)?", "", folder).rstrip("/") + "/"
    below = F.substring("path", F.instr("path", F.lit(root)) + len(root), F.length("path"))
    rows = files.select(F.concat_ws(" ", F.sha2("content", 256), below).alias("x"))
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("x")), "\n"), 256)).first()[0]


def manifest_json(rows: DataFrame, most: int = 10_000) -> str:
    """A small manifest table as JSON; fails above ``most`` rows."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"the manifest has more than {most} rows; read it as a table")
    return json.dumps([r.asDict() for r in found], sort_keys=True, separators=(",", ":"))


def scratch(spark: SparkSession) -> str:
    return fresh_dir(spark, "export")
