"""Spelling variants grouped by a relational trie frontier.

The vocabulary is held as a path-compressed trie in edge tables, one per
level: (parent, first character, label, child).  A level is one aggregate: the
words of a node and next character share the longest common prefix of their
smallest and largest one, which is the label.  The frontier holds states
(word, position, node, edits) and meets the edge table of the next level:

* a state without edits is a word at a node on its own path.  It branches to
  the node's other edges by replacing, inserting or deleting one character;
* a state with one edit follows the one edge that agrees with the rest of its
  word.  Where it ends together with the word, two words are neighbours.

Branching near the root would meet most of the vocabulary, so every word runs
through the trie twice, read forwards (behind '0') and backwards (behind '1'),
and branches only in its second half: an edit lies in one of the two.  A word
branches to at most the letters of the alphabet per node, and a state with an
edit never branches, so the frontier grows with the vocabulary.

The number of levels is the largest number of branching nodes above a word, not
its length.  Every level is written as Parquet in the checkpoint folder.

Cases: null and empty texts have no words; runs in rows with a null doc_id are
never changed; repeated rows count again; long runs are words like any other;
of neighbours with equal numbers the smaller in code-point order is the form;
without words there are no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.llm.common import ascii_lower, let, stage

LETTER = "[A-Za-zÀ-ÿ]"


def vocabulary(docs: DataFrame, damage: int = 97, least_length: int = 5,
               least_count: int = 3) -> DataFrame:
    """word, n: lower-cased runs, one in ``damage`` of them without one letter.
    Shorter runs give no word, so they are not extracted."""
    runs = docs.select("doc_id", F.explode(
        F.regexp_extract_all("text", F.lit(f"{LETTER}{{{least_length},}}"), F.lit(0)))
        .alias("run")) \
        .select("doc_id", ascii_lower(F.col("run")).alias("run"))
    code = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
    size = F.char_length("run")
    at = (F.pmod(F.col("h"), size)).cast("int")
    word = F.when(F.pmod(F.col("h"), F.lit(damage)) == 0,
                  F.concat(F.substring("run", F.lit(1), at),
                           F.substring("run", at + 2, size))).otherwise(F.col("run"))
    return runs.withColumn("h", code).select(word.alias("word")) \
        .where(F.char_length("word") >= least_length) \
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading characters that two strings share."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    return F.when(a == b, F.char_length(a)).otherwise(
        (let(same, lambda s: F.array_position(s, False)) - 1).cast("int"))


def _part(text: str, at: Column, size: Column) -> Column:
    """``size`` characters after the first ``at``."""
    return F.substring(F.col(text), at + 1, size)


def trie_levels(words: DataFrame):
    """Yields (edges, at): the edge table of a level and where it leaves the
    words that share their path with others.

    edges: parent, c, label, child, depth, ends (a word ends at the child),
    many (other edges follow).  at: w, m, least, node, depth, ends, c (the next
    character, empty at the end of the word).
    """
    m, half = F.char_length("word"), F.floor(F.char_length("word") / 2).cast("int")
    oriented = words.select(F.explode(F.array(
        F.struct(F.concat(F.lit("0"), "word").alias("w"), (half + 1).alias("least")),
        F.struct(F.concat(F.lit("1"), F.reverse("word")).alias("w"),
                 (m - half + 1).alias("least")))).alias("x")).select("x.*")
    at = oriented.select("w", F.char_length("w").alias("m"), "least", F.lit("").alias("node"),
                         F.lit(0).alias("depth"), F.lit(False).alias("ends"),
                         F.substring("w", 1, 1).alias("c"))
    level = 0
    while True:
        groups = at.where("c <> ''").groupBy(F.col("node").alias("parent"), "c").agg(
            F.first("depth").alias("from"), F.min("w").alias("child"), F.max("w").alias("last"))
        edges = groups.withColumn("depth", common_prefix(F.col("child"), F.col("last")))
        edges = stage(edges.select(
            "parent", "c", "child", "depth",
            _part("child", F.col("from"), F.col("depth") - F.col("from")).alias("label"),
            (F.char_length("child") == F.col("depth")).alias("ends"),
            (F.col("child") != F.col("last")).alias("many")), f"trie-edges-{level}")
        below = at.select("w", "m", "least", F.col("node").alias("parent"), "c").join(
            edges.where("many"), ["parent", "c"])
        at = stage(below.select("w", "m", "least", F.col("child").alias("node"), "depth", "ends",
                                _part("w", F.col("depth"), F.lit(1)).alias("c")),
                   f"trie-at-{level}")
        yield edges, at
        if at.isEmpty():
            return
        level += 1


def _branches(at: DataFrame, edges: DataFrame) -> DataFrame:
    """States with one edit: words at a node against its other edges."""
    e = edges.withColumnRenamed("depth", "below").withColumnRenamed("c", "first") \
             .withColumnRenamed("ends", "full")
    size, d, tail = F.char_length("label"), F.col("depth"), F.expr("substring(label, 2)")
    more = F.col("m") > d
    pos = F.array(
        F.when(more & (_part("w", d + 1, size - 1) == tail), d + size),            # replaced
        F.when(_part("w", d, size - 1) == tail, d + size - 1),                     # inserted
        F.when(more & (_part("w", d + 1, size) == F.col("label")), d + 1 + size))  # deleted
    return at.where("depth >= least").drop("ends").join(
        e, (F.col("node") == F.col("parent")) & (F.col("c") != F.col("first"))) \
        .withColumn("pos", F.explode(F.array_compact(pos))) \
        .select("w", "m", "child", "pos", F.col("full").alias("ends"), "many")


def _followed(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States with one edit along the edge that agrees with the word."""
    on = states.where("NOT hit").select(
        "w", "m", F.col("child").alias("parent"), "pos", _part("w", F.col("pos"), F.lit(1)).alias("c"))
    size = F.char_length("label")
    return on.join(edges, ["parent", "c"]) \
        .where(_part("w", F.col("pos"), size) == F.col("label")) \
        .select("w", "m", "child", (F.col("pos") + size).alias("pos"), "ends", "many")


def _read(w: Column) -> Column:
    """The word behind its direction."""
    rest = F.expr(f"substring({w}, 2)")
    return F.when(F.col(w).startswith("0"), rest).otherwise(F.reverse(rest))


def neighbours(words: DataFrame) -> DataFrame:
    """word, other: all pairs (both ways) of words one edit apart."""
    found, states, above = [], None, None
    for level, (edges, at) in enumerate(trie_levels(words)):
        if above is not None:
            new = _branches(above, edges)
            if states is not None:
                new = new.unionByName(_followed(states, edges))
            # Only states that end here (a hit) or can go on, in folders of their own.
            states = stage(new.where("(ends AND pos = m) OR (many AND pos < m)").select(
                "w", "m", "child", "pos", (F.col("pos") == F.col("m")).alias("hit")),
                f"trie-states-{level}", ["hit"])
            found.append(states.where("hit").select("w", F.col("child").alias("o")))
        # A word that ends at the node, and those with one more character.
        found.append(at.where("ends AND m = depth + 1 AND depth >= least")
                     .select("w", F.col("node").alias("o")))
        above = at
    return reduce(DataFrame.unionByName, found) \
        .select(_read("w").alias("word"), _read("o").alias("other")).distinct()


def _roots(links: DataFrame) -> DataFrame:
    """word, root: links (word, form) followed to their ends by doubling."""
    at = stage(links.select("word", F.col("form").alias("root")), "trie-roots")
    while True:
        known = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = stage(at.join(known, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"),
            F.col("next").isNotNull().alias("moved")), "trie-roots")
        if at.where("moved").isEmpty():
            return at.drop("moved")


def group_variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of a staged vocabulary (word, n)."""
    other = words.select(F.col("word").alias("other"), F.col("n").alias("m"))
    best = neighbours(words).join(other, "other").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    strong = -F.col("best.less") >= 2 * F.col("n")
    rows = stage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(strong, F.col("best.other")).alias("form"),
        F.when(strong, -F.col("best.less")).alias("form_n")), "trie-forms")
    roots = _roots(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    return group_variants(stage(vocabulary(docs), "trie-words"))
