"""Benchmark decontamination on a positional inverted index.

The words of all documents that occur in the benchmark are stored once as
postings (document, position, term).  Every benchmark window (ten consecutive
words, or a whole shorter item) is then looked up from its rarest term: that
term's postings, shifted by its offset, are the only candidate starts; they
are intersected with the shifted postings of the second rarest term, and the
survivors with those of all remaining terms.  A candidate that meets every
term at its offset is an exact phrase match; one that meets the second rarest
term within ``slop`` positions is a proximity match.

The index is written by the scan without a shuffle (postings of a document
stay together).  The vocabulary and the windows grow with the benchmark, not
with the corpus; they are broadcast only below a size limit, else joined by
shuffle.  Candidates and postings meet by (document, position, term), so a
frequent term or passage is spread evenly.  Only DataFrame functions are used.

Cases: null or wordless texts have no words, no hits and are clean; a null or
wordless item has no window; an item of fewer than ten words is one window;
equal windows of several items count for each item; rows equal in doc_id and
text get equal results, rows that share a doc_id only are separate documents;
empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescope.llm.common import ascii_lower, bounded_broadcast, lit_or_empty, stage

NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
DOC = ["_id", "_k"]     # a document: its id (null-safe) and a hash of its text


def alnum_words(text: Column) -> Column:
    """ASCII-lower-cased words of letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(ascii_lower(lit_or_empty(text)), NOT_WORD), "")


def doc_key(docs: DataFrame) -> list[Column]:
    return [F.struct("doc_id").cast("string").alias("_id"),
            F.xxhash64(lit_or_empty(F.col("text"))).alias("_k")]


def benchmark_windows(benchmark: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(win, ws): distinct windows; (win, item_id): the items they are of."""
    items = benchmark.select("item_id", alnum_words(F.col("text")).alias("w")).where("size(w) > 0")
    per_item = items.select("item_id", F.explode(F.when(
        F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n),
                                      lambda i: F.slice("w", i + 1, n)))
        .otherwise(F.array("w"))).alias("ws")).distinct()
    windows = stage(per_item.select("ws").distinct()
                    .withColumn("win", F.monotonically_increasing_id()), "windows")
    return windows, stage(per_item.join(windows, "ws").select("win", "item_id"), "window-items")


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Staged positional index (document, pos, term) over the vocabulary."""
    tokens = docs.select(*doc_key(docs), F.posexplode(alnum_words(F.col("text")))
                         .alias("pos", "word"))
    return stage(tokens.join(bounded_broadcast(vocabulary), "word").select(*DOC, "pos", "term"),
                 "postings")


def window_matches(index: DataFrame, windows: DataFrame, terms: DataFrame,
                   slop: int = 2) -> tuple[DataFrame, DataFrame]:
    """(document, start, win, len) of exact matches, and (document, win) of
    proximity matches."""
    seen = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rank = Window.partitionBy("win").orderBy("df", "off")
    # A window with a term that no document has is gone here.
    plan = stage(terms.join(seen, "term").withColumn("rank", F.row_number().over(rank))
                 .withColumn("known", F.count(F.lit(1)).over(Window.partitionBy("win")))
                 .join(windows.select("win", F.size("ws").alias("len")), "win")
                 .where("known = len").select("win", "len", "rank", "off", "term"), "lookup")
    seeds = plan.where("rank = 1").select("win", "len", "off", "term")
    starts = index.join(bounded_broadcast(seeds), "term") \
                  .select(*DOC, (F.col("pos") - F.col("off")).alias("start"), "win", "len") \
                  .where("start >= 0")
    starts = stage(starts.distinct(), "candidates")
    second = plan.where("rank = 2").select("win", "off", "term")
    near = (starts.where("len > 1").join(bounded_broadcast(second), "win")
            .select(*DOC, "start", "win", "len", "term",
                    F.explode(F.sequence(F.lit(-slop), F.lit(slop))).alias("d"),
                    F.col("off"))
            .select(*DOC, "start", "win", "len", "term", "d",
                    (F.col("start") + F.col("off") + F.col("d")).alias("pos")))
    rare = index.join(bounded_broadcast(second.select("term").distinct()), "term", "left_semi")
    pairs = stage(near.join(rare.distinct(), [*DOC, "pos", "term"])
                  .select(*DOC, "start", "win", "len", "d"), "pairs")
    proximate = pairs.select(*DOC, "win").union(starts.where("len = 1").select(*DOC, "win"))
    two = pairs.where("d = 0").select(*DOC, "start", "win", "len")
    rest = two.where("len > 2").join(
        bounded_broadcast(plan.where("rank > 2").select("win", "off", "term")), "win") \
        .select(*DOC, "start", "win", "len", "term", (F.col("start") + F.col("off")).alias("pos"))
    # Only documents that still have a candidate are looked up again.
    open_docs = stage(two.where("len > 2").select(*DOC).distinct(), "open-documents")
    full = index.join(bounded_broadcast(open_docs), DOC, "left_semi").distinct()
    whole = (rest.join(full, [*DOC, "pos", "term"])
             .groupBy(*DOC, "start", "win", "len").agg(F.count(F.lit(1)).alias("met"))
             .where("met = len - 2").drop("met"))
    exact = whole.union(two.where("len = 2")) \
                 .union(starts.where("len = 1").select(*DOC, "start", "win", "len"))
    return exact, proximate


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, slop: int = 2) -> DataFrame:
    """Per document with a match (key columns DOC): n_hit, n_items,
    items_sha256, n_near."""
    windows, items = benchmark_windows(benchmark, n)
    terms = windows.select("win", F.posexplode("ws").alias("off", "word"))
    vocabulary = stage(terms.select("word").distinct()
                       .withColumn("term", F.monotonically_increasing_id()), "vocabulary")
    index = postings(docs, vocabulary)
    exact, proximate = window_matches(index, windows,
                                      terms.join(vocabulary, "word").drop("word"), slop)
    exact = stage(exact, "matches")
    hits = exact.select(*DOC, F.explode(F.sequence("start", F.col("start") + F.col("len") - 1))
                        .alias("pos")).distinct().groupBy(*DOC) \
                .agg(F.count(F.lit(1)).alias("n_hit"))
    found = exact.select(*DOC, "win").distinct().join(bounded_broadcast(items), "win") \
                 .select(*DOC, F.col("item_id").cast("string").alias("item")).distinct() \
                 .groupBy(*DOC).agg(F.count("item").alias("n_items"),
                                    F.array_sort(F.collect_list("item")).alias("found"))
    near = proximate.distinct().groupBy(*DOC).agg(F.count(F.lit(1)).alias("n_near"))
    return hits.join(found, DOC).join(near, DOC, "left").select(
        *DOC, "n_hit", "n_items",
        F.sha2(F.array_join("found", ","), 256).alias("items_sha256"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"))


def flag_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """One row per document: word count, hit words, items and verdict."""
    hits = contamination(docs, benchmark, n)
    mine = docs.select("doc_id", *doc_key(docs),
                       F.size(alnum_words(F.col("text"))).cast("long").alias("n_words"))
    hit = F.coalesce("n_hit", F.lit(0))
    return mine.join(hits, DOC, "left").select(
        "doc_id", "n_words", hit.cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (hit > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).alias("n_near"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The documents (all their columns) without any benchmark window."""
    hits = contamination(docs, benchmark, n).select(*DOC)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       *doc_key(docs))
    return rows.join(bounded_broadcast(stage(hits, "contaminated")), DOC, "left_anti") \
               .select("_row.*")
