"""Benchmark passages in training documents, by a positional inverted index of the documents.

Words: ASCII capitals are lower-cased; words are runs of characters other than 0x00-0x2F, 0x3A-0x60 and
0x7B-0x7F. The index holds a posting (term, doc, pos) for every word of every document that is a test term,
and a posting of term 0 at the position after each document's last word, which carries its doc_id. It is
written once, each file sorted by term, so the list of a rare term is read by row-group statistics; all
later steps read only the index.

A window is `window` consecutive words of an item (a shorter item is one window). Windows with a term that
no document has are out at once. For the others, the lists of the two rarest terms, each moved back by the
term's offset in the item, are intersected: what is left are (item, document, start) diagonals on which
both stand. On those, the lists of all the item's terms are intersected the same way, and runs of
consecutive matched offsets as long as a window are its occurrences.

Nothing here runs outside of Spark's own operators. Test terms and anchors are broadcast up to a checked
number of rows and joined by a shuffle beyond it. NULL texts have no words; NULL or repeated ids are rows
of their own, as documents are told apart by their place in the index. Items without words match nothing;
NULL item_ids are not counted as items, but their windows are hits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sievework.llm.common import rows_of, stored
from sievework.session import cut

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = 0
#: Rows up to which a side is sent to all tasks: a few words and numbers each, some 50 MB at most.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """The words of a text; NULL has none."""
    known = F.coalesce(text, F.lit(""))
    plain = F.octet_length(known) == F.char_length(known)
    lowered = F.when(plain, F.lower(known)).otherwise(F.translate(known, UPPER, LOWER))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def bounded(df: DataFrame) -> DataFrame:
    """df, to be sent to all tasks if it is small enough. It must be stored already."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


@dataclass
class Tests:
    """items: text (a number), n, need (words of its windows). places: text, offset, term. ids: text, item_id."""

    items: DataFrame
    places: DataFrame
    ids: DataFrame
    terms: DataFrame


def tests_of(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> Tests:
    """The test items by their distinct word sequences, and the numbered test terms."""
    raw = rows_of(items, item_id=items[id_col], words=words_of(items[text_col].cast("string"))).where(F.size("words") > 0)
    raw = cut(raw)
    texts = cut(raw.groupBy("words").agg(F.count(F.lit(1)).alias("copies")).withColumn("text", F.monotonically_increasing_id()))
    words = texts.select("text", F.posexplode("words").alias("offset", "word"))
    terms = cut(words.select("word").distinct().withColumn("term", F.monotonically_increasing_id() + 1))
    places = cut(words.join(terms, "word").select("text", "offset", "term"))
    ids = cut(raw.join(texts, "words").where(F.col("item_id").isNotNull()).select("text", "item_id").distinct())
    n = F.size("words")
    return Tests(texts.select("text", n.alias("n"), F.least(n, F.lit(window)).alias("need")), places, ids, terms)


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (term, doc, pos, doc_id) of the numbered terms, stored; doc_id is on the end postings only."""
    named = terms.select("word", "term")
    ends = cut(named.unionByName(named.sparkSession.createDataFrame([("", END)], "word string, term long")))
    words = rows_of(docs, doc_id=id_col, text=docs[text_col].cast("string")).select(
        "doc_id", F.monotonically_increasing_id().alias("doc"), F.concat(words_of(F.col("text")), F.array(F.lit(""))).alias("words")
    )
    postings = words.select("doc_id", "doc", F.posexplode("words").alias("pos", "word")).join(bounded(ends), "word")
    return stored(
        postings.select("term", "doc", "pos", F.when(F.col("term") == END, F.col("doc_id")).alias("doc_id")).sortWithinPartitions("term", "doc", "pos"),
        "postings",
    )


def _rarest(index: DataFrame, tests: Tests) -> DataFrame:
    """text, first (offset of the window), offset, term, rank 1 or 2: the two rarest terms of each window."""
    counts = index.where(F.col("term") != END).groupBy("term").agg(F.count(F.lit(1)).alias("n_postings"))
    counted = cut(tests.places.join(counts, "term", "left").join(tests.items, "text"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("offset") - F.col("need") + 1), F.least(F.col("offset"), F.col("n") - F.col("need")))
    covering = counted.select("text", "offset", "term", "need", "n_postings", F.explode(starts).alias("first"))
    window = W.partitionBy("text", "first")
    ranked = covering.select(
        "text", "first", "offset", "term", F.least("need", F.lit(2)).alias("lists"),
        F.count("n_postings").over(window).alias("known"), "need",
        F.row_number().over(window.orderBy("n_postings", "offset")).alias("rank"),
    )
    return ranked.where("known = need and rank <= 2").drop("known", "need")


def phrase_runs(index: DataFrame, tests: Tests) -> DataFrame:
    """text, doc, start, length: maximal runs of an item's words in a document, a window long at least."""
    anchors = cut(_rarest(index, tests))
    # Offset-adjusted lists of the rarest terms, and their intersection.
    both = (
        index.where(F.col("term") != END).select("term", "doc", "pos").join(bounded(anchors), "term")
        .groupBy("text", "first", "lists", "doc", (F.col("pos") - F.col("offset")).alias("diagonal"))
        .agg(F.count(F.lit(1)).alias("found")).where("found = lists")
    )
    diagonals = cut(both.select("text", "doc", "diagonal").distinct())
    wanted = diagonals.join(tests.places, "text").select("text", "doc", "diagonal", "offset", "term", (F.col("diagonal") + F.col("offset")).alias("pos"))
    near = index.select("term", "doc", "pos").join(bounded(cut(diagonals.select("doc").distinct())), "doc", "left_semi")
    matched = wanted.join(near, ["doc", "term", "pos"])
    in_row = W.partitionBy("text", "doc", "diagonal").orderBy("offset")
    runs = (
        matched.withColumn("run", F.col("offset") - F.row_number().over(in_row))
        .groupBy("text", "doc", "diagonal", "run").agg(F.min("pos").alias("start"), F.count(F.lit(1)).cast("int").alias("length"))
    )
    return runs.join(tests.items, "text").where("length >= need").select("text", "doc", "start", "length")


def proximity(index: DataFrame, tests: Tests, span: int) -> DataFrame:
    """text, doc, start: `span` words from start hold every term of the item, in any order; start holds one.

    Documents that lack the item's rarest term are out first, then those that lack any other.
    """
    needed = tests.places.select("text", "term").distinct()
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("n_postings"))
    ranked = needed.join(counts, "term", "left").select(
        "text", "term", F.row_number().over(W.partitionBy("text").orderBy(F.coalesce("n_postings", F.lit(0)), "term")).alias("rank"),
        F.count(F.lit(1)).over(W.partitionBy("text")).alias("terms"),
    )
    ranked = cut(ranked)
    lists = index.where(F.col("term") != END).select("term", "doc", "pos")
    docs = lists.join(bounded(cut(ranked.where("rank = 1"))), "term").select("text", "doc").distinct()
    hits = lists.join(bounded(ranked), "term").join(cut(docs), ["text", "doc"], "left_semi")
    frame = W.partitionBy("text", "doc").orderBy("pos").rangeBetween(0, span - 1)
    seen = hits.select("text", "doc", "pos", "terms", F.size(F.collect_set("term").over(frame)).alias("seen"))
    return seen.where("seen = terms").select("text", "doc", F.col("pos").alias("start")).distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted item_ids as strings), contaminated: a row per document."""
    tests = tests_of(items, window)
    index = build_index(docs, tests.terms)
    runs = cut(phrase_runs(index, tests))
    hits = (
        runs.select("doc", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos"))
        .distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("n_hit"))
    )
    matched = (
        runs.select("doc", "text").distinct().join(tests.ids, "text").select("doc", F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy("doc").agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    found = cut(hits.join(matched, "doc", "left"))
    ends = index.where(F.col("term") == END).select("doc", "doc_id", F.col("pos").cast("long").alias("n_words"))
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return ends.join(found, "doc", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"), items_of.alias("items"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text holds no window of an item.

    Decided by text, so that rows with a NULL or a repeated id are kept or dropped each for what it holds.
    """
    sha = F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256)
    found = contamination(docs.select(sha.alias("doc_id"), docs[text_col].alias("text")), items, window)
    hit = cut(found.where("contaminated").select(F.col("doc_id").alias("_sha")).distinct())
    return docs.join(hit, sha == hit["_sha"], "left_anti")
