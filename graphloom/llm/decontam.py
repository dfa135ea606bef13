"""Benchmark decontamination with a distributed positional inverted index.

Test items are cut into phrases of consecutive words, each told once however many items hold it
(which items do is a table beside). The corpus frequency of the items' terms tells the rarest
terms of each phrase; phrases with the same rarest terms at the same distances are one entry of
the look-up. Only postings (term, document, position) of rarest terms are stored. A posting's position less the term's distance from the rarest is the place where
that rarest term would be; intersecting the offset-adjusted lists is one aggregation by (document,
entry, place). What survives is compared word by word with the document, for exact phrases, and
for near ones: all the phrase's words in order within ``slop`` words more. Near phrases allow
places to differ by ``slop``, by aggregating over zones of that width.

The terms of the items are broadcast while there are at most ``BROADCAST_TERMS`` of them (they
are counted first) and joined by a shuffle beyond that, after words have been counted in their
tasks; what is broadcast of the corpus has a fixed number of slots. Aggregation keys hold the
document, so a passage that a third of the corpus shares does not meet in one task. The items of
a document are looked up once for each different set of phrases.

Defined results: null texts and texts without words match nothing; an item of fewer words than a
phrase needs is one phrase; rows that repeat a doc_id are judged each by its own text, rows that
repeat an item_id count once by that id; null ids are kept (a null item_id is left out of lists
of ids); empty tables give no matches; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import ALNUM_WORD, ascii_lower, bound, fresh_dir, row_key, slot, slots_of, spread_join, text_or_empty, without

PHRASE_WORDS = 10
#: How many rarest terms of each phrase are looked up.
LISTS = 2
#: Words by which a near phrase may be longer.
SLOP = 3
#: Most terms, and bytes of terms, that are broadcast.
BROADCAST_TERMS, BROADCAST_BYTES = 200_000, 32 << 20
_GAP = ALNUM_WORD.replace("[^", "[")


def cells_of(text: Column) -> Column:
    """Lower-cased words in order, with an empty cell before (after) them if the text begins (ends)
    with no word. Positions in documents count cells; the empty ones match no term."""
    return F.split(ascii_lower(text), _GAP, -1)


def leading(cells: Column) -> Column:
    """1 if the first cell is empty."""
    return F.when(F.get(cells, F.lit(0)) == "", 1).otherwise(0)


def n_words(cells: Column) -> Column:
    last = F.when((F.size(cells) > 1) & (F.element_at(cells, -1) == ""), 1).otherwise(0)
    return (F.size(cells) - leading(cells) - last).cast("long")


def words_of(text: Column) -> Column:
    """Lower-cased words, in order."""
    return F.filter(cells_of(text), lambda w: w != "")


def phrases(items: DataFrame, n: int = PHRASE_WORDS) -> DataFrame:
    """(item_id, text) -> (phrase, item_id, words): every n consecutive words of an item; ``phrase`` names the words."""
    cut = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(text_or_empty()).alias("all")).distinct()
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - n, F.lit(0)))
    each = cut.filter(F.size("all") > 0).select("item_id", F.explode(F.transform(starts, lambda i: F.slice("all", i + 1, n))).alias("words"))
    return each.select(F.md5(F.array_join("words", " ")).alias("phrase"), "item_id", "words").distinct()


def _small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has at most BROADCAST_TERMS rows and BROADCAST_BYTES of terms."""
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if size["rows"] <= BROADCAST_TERMS and size["bytes"] <= BROADCAST_BYTES else df


def rarest_terms(phr: DataFrame, docs: DataFrame, lists: int = LISTS) -> DataFrame:
    """(phrase, words) -> (phrase, words, first, entry, terms): the phrase's rarest different terms.

    ``terms``: array<struct<term, shift>>, rarest first, with each one's distance from the rarest;
    ``first``: the place of the rarest in the phrase; ``entry``: a hash of ``terms``. Phrases with a
    term that the corpus lacks cannot match and are dropped.
    """
    terms = phr.select(F.explode("words").alias("term")).distinct()
    wanted, every = _small(terms), docs.select(F.explode(cells_of(text_or_empty())).alias("term"))
    if wanted is terms:  # too many to broadcast: words are counted in their tasks before they meet the terms
        counts = every.groupBy("term").count().join(terms, "term", "left_semi")
    else:
        counts = every.join(wanted, "term", "left_semi").groupBy("term").count()
    known = terms.join(counts, "term", "left")
    each = phr.select("phrase", F.posexplode("words").alias("place", "term")).join(known, "term")
    order = Window.partitionBy("phrase").orderBy(F.col("count").asc_nulls_first(), "term")
    ranked = (
        each.groupBy("phrase", "term").agg(F.min("place").alias("place"), F.first("count").alias("count"))
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= lists)
        .groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("rank", "place", "term", "count"))).alias("r"))
        .filter(F.col("r")[0]["count"].isNotNull())
        .select(F.col("phrase").alias("r_phrase"), F.col("r")[0]["place"].alias("first"), F.transform("r", lambda x: F.struct(x["term"].alias("term"), (x["place"] - F.col("r")[0]["place"]).alias("shift"))).alias("terms"))
    )
    return phr.join(ranked, F.col("phrase") == F.col("r_phrase")).select("phrase", "words", "first", F.xxhash64("terms").alias("entry"), "terms")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, doc_key, pos): the positional index of ``terms`` (term), one row for each occurrence."""
    every = docs.select("doc_id", row_key("doc_id", "text").alias("doc_key"), F.posexplode(cells_of(text_or_empty())).alias("pos", "term"))
    return every.join(_small(terms), "term", "left_semi").select("term", "doc_id", "doc_key", "pos")


def build_index(docs: DataFrame, items: DataFrame, n: int = PHRASE_WORDS, lists: int = LISTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases with their rarest terms, which items hold them, postings of rarest terms), each written once."""
    spark, at = docs.sparkSession, fresh_dir(docs.sparkSession, "index")
    phrases(items, n).write.parquet(f"{at}/members")
    members = spark.read.parquet(f"{at}/members")
    rarest_terms(members.select("phrase", "words").distinct(), docs, lists).write.parquet(f"{at}/phrases")
    chosen = spark.read.parquet(f"{at}/phrases")
    wanted = chosen.select(F.explode("terms").alias("t")).select("t.term").distinct()
    postings(docs, wanted).write.parquet(f"{at}/postings")
    return chosen, members.select("phrase", "item_id"), spark.read.parquet(f"{at}/postings")


def candidates(chosen: DataFrame, index: DataFrame, slop: int = 0) -> DataFrame:
    """(doc_id, doc_key, start, phrase, words): where all rarest terms of a phrase line up within ``slop`` words.

    ``start`` is where the rarest says the phrase begins.
    """
    entries = chosen.groupBy("entry").agg(F.first("terms").alias("terms"))
    looked = entries.select("entry", F.size("terms").alias("roles"), F.posexplode("terms").alias("role", "t")).select("entry", "roles", "role", "t.term", "t.shift")
    met = index.join(_small(looked), "term").select("doc_id", "doc_key", "entry", "roles", "role", (F.col("pos") - F.col("shift")).alias("place"))
    zone = F.floor(F.col("place") / (slop + 1))
    near = F.when(F.col("role") == 0, F.array(zone)).otherwise(F.array(zone - 1, zone, zone + 1) if slop else F.array(zone))
    lined = met.withColumn("zone", F.explode(near)).groupBy("doc_id", "doc_key", "entry", "roles", "zone").agg(F.collect_set(F.struct("role", "place")).alias("met"))
    roles = F.size(F.array_distinct(F.transform("met", lambda x: x["role"])))
    others = lambda lead: F.filter("met", lambda y: F.abs(y["place"] - lead["place"]) <= slop)
    whole = lambda lead: (lead["role"] == 0) & (F.size(F.array_distinct(F.transform(others(lead), lambda y: y["role"]))) == F.col("roles"))
    lead = lined.filter(roles == F.col("roles")).select("doc_id", "doc_key", F.col("entry").alias("l_entry"), F.explode(F.filter("met", whole)).alias("lead"))
    start = F.col("lead")["place"] - F.col("first")
    return lead.join(chosen, F.col("l_entry") == F.col("entry")).filter(start >= -slop).select("doc_id", "doc_key", start.alias("start"), "phrase", "words")


def matches(docs: DataFrame, chosen: DataFrame, index: DataFrame, slop: int = 0) -> DataFrame:
    """``docs``' rows as (doc_id, doc_key, n_words, exact, near).

    ``exact``: array<struct<start, stop, phrase>> of the phrases' occurrences in words; ``near``:
    array<struct<start, extra, phrase>> of places where all words of a phrase occur in order with
    1 to ``slop`` words more between them. Texts travel only where their key's slot holds a candidate.
    """
    at = fresh_dir(docs.sparkSession, "candidates")
    candidates(chosen, index, slop).groupBy(F.col("doc_id").alias("c_id"), F.col("doc_key").alias("c_key")).agg(
        F.collect_list(F.struct("start", "phrase", "words")).alias("tries")
    ).write.parquet(at)
    tried = docs.sparkSession.read.parquet(at)
    keyed = docs.select("doc_id", text_or_empty().alias("text"), row_key("doc_id", "text").alias("doc_key")).withColumn("n_words", n_words(cells_of(F.col("text"))))
    marked = keyed.join(slots_of(tried, "c_key"), slot(F.col("doc_key")) == F.col("_slot"), "left")
    light = marked.select("doc_id", "doc_key", "n_words", F.when(F.col("_slot").isNotNull(), F.col("text")).alias("text"))
    joined = light.join(tried, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("doc_key") == F.col("c_key")), "left")

    def same(cells: Column, t: Column) -> Column:
        return (t["start"] >= 0) & (F.slice(cells, F.greatest(t["start"], F.lit(0)) + 1, F.size(t["words"])) == t["words"])

    def extra(cells: Column, t: Column, begin: Column) -> Column:
        """Words more than the phrase's from ``begin`` to its last word, met one after another; null if it is not met."""
        n = F.size(t["words"])
        part = F.slice(cells, F.greatest(begin, F.lit(0)) + 1, n + slop)
        zero = F.struct(F.lit(0).alias("met"), F.lit(0).alias("read"))
        step = lambda acc, c: F.struct((acc["met"] + F.when(c == F.get(t["words"], acc["met"]), 1).otherwise(0)).alias("met"), (acc["read"] + F.when(acc["met"] < n, 1).otherwise(0)).alias("read"))
        return F.when((begin >= 0) & (F.get(cells, F.greatest(begin, F.lit(0))) == F.get(t["words"], F.lit(0))), F.aggregate(part, zero, step, lambda acc: F.when(acc["met"] == n, acc["read"] - n)))

    def check(cells: Column) -> Column:
        lead = leading(cells)
        hits = F.transform(F.filter("tries", lambda t: same(cells, t)), lambda t: F.struct((t["start"] - lead).alias("start"), (t["start"] - lead + F.size(t["words"])).alias("stop"), t["phrase"].alias("phrase")))
        if not slop:
            return F.struct(hits.alias("exact"), F.array().cast(_NEAR).alias("near"))
        begins = F.sequence(F.lit(0), F.lit(slop))
        loose = F.filter("tries", lambda t: ~same(cells, t))
        each = lambda t: F.transform(begins, lambda d: F.struct((t["start"] - d - lead).alias("start"), extra(cells, t, t["start"] - d).alias("extra"), t["phrase"].alias("phrase")))
        found = F.filter(F.flatten(F.transform(loose, each)), lambda x: x["extra"] > 0)
        return F.struct(hits.alias("exact"), F.array_distinct(found).alias("near"))

    none = F.struct(F.array().cast(_EXACT).alias("exact"), F.array().cast(_NEAR).alias("near"))
    found = F.when(F.col("tries").isNotNull(), bound(cells_of(F.col("text")), check))
    return joined.select("doc_id", "doc_key", "n_words", F.coalesce(found, none).alias("f")).select("doc_id", "doc_key", "n_words", "f.exact", "f.near")


_EXACT, _NEAR = "array<struct<start:int,stop:int,phrase:string>>", "array<struct<start:int,extra:int,phrase:string>>"


def covered(spans: Column) -> Column:
    """Words inside the union of sorted spans."""

    def step(acc: Column, s: Column) -> Column:
        return F.struct(
            F.greatest(acc["upto"], s["stop"]).alias("upto"),
            (acc["n"] + F.greatest(s["stop"] - F.greatest(acc["upto"], s["start"]), F.lit(0))).alias("n"),
        )

    return F.aggregate(spans, F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")), step, lambda acc: acc["n"]).cast("long")


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = SLOP, n: int = PHRASE_WORDS, lists: int = LISTS) -> DataFrame:
    """(doc_id, item_id, start, spread): phrases of items whose words all occur in order, with at most
    ``slop`` words more between them; ``spread`` is how many. One row for each document, item and
    start, by its least spread; exact occurrences have spread 0.
    """
    chosen, members, index = build_index(docs, items, n, lists)
    found = matches(docs, chosen, index, slop)
    exact = F.transform("exact", lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("spread"), x["phrase"].alias("phrase")))
    near = F.transform("near", lambda x: F.struct(x["start"].alias("start"), x["extra"].alias("spread"), x["phrase"].alias("phrase")))
    each = found.select("doc_id", F.explode(F.concat(exact, near)).alias("m")).select("doc_id", "m.start", "m.spread", F.col("m.phrase").alias("m_phrase"))
    met = each.join(members, F.col("m_phrase") == F.col("phrase"))
    return met.groupBy("doc_id", "item_id", "start").agg(F.min("spread").alias("spread"))


def contamination(docs: DataFrame, items: DataFrame, n: int = PHRASE_WORDS, slop: int = SLOP) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near: one row for each row of ``docs``.

    ``n_near``: different phrases that occur nearly (see ``matches``) and nowhere exactly.
    """
    chosen, members, index = build_index(docs, items, n)
    names = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda x: x["phrase"])))
    spans = F.array_sort(F.transform("exact", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))))
    found = matches(docs, chosen, index, slop).select("doc_id", "n_words", covered(spans).alias("n_hit"), names("exact").alias("held"), F.size(F.array_except(names("near"), names("exact"))).cast("long").alias("n_near"))
    at = fresh_dir(docs.sparkSession, "matches")
    found.withColumn("set", F.when(F.size("held") > 0, F.md5(F.array_join("held", "")))).write.parquet(at)
    found = docs.sparkSession.read.parquet(at)
    # each set of phrases once, with the items that hold one of them
    sets = found.filter("set is not null").groupBy(F.col("set").alias("s_set")).agg(F.count(F.lit(1)).alias("rows"), F.first("held").alias("held"))
    each = sets.select("s_set", "rows", F.explode("held").alias("m_phrase")).join(members, F.col("m_phrase") == F.col("phrase"), "left")
    ids = each.groupBy("s_set", "rows").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    told = ids.select("s_set", "rows", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "n_near"]
    hit = spread_join(found.filter("set is not null").drop("held"), told, "set", "s_set", "rows").select(*columns)
    clean = found.filter("set is null").withColumns({"n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256)})
    return hit.unionByName(clean.select(*columns))


def clean_documents(docs: DataFrame, items: DataFrame, n: int = PHRASE_WORDS) -> DataFrame:
    """``docs`` without the rows that hold an exact phrase of an item."""
    at = fresh_dir(docs.sparkSession, "contaminated")
    chosen, _, index = build_index(docs, items, n)
    found = matches(docs, chosen, index).filter(F.size("exact") > 0)
    found.select(F.col("doc_id").alias("g_id"), F.col("doc_key").alias("g_key")).distinct().write.parquet(at)
    return without(docs, docs.sparkSession.read.parquet(at), row_key("doc_id", "text"))
