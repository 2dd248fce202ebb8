"""Quality rules as weak supervision.

Every rule looks at one density of a text and votes good (+1), bad (-1) or
abstains (0).  A two-class latent model (class prior, and per rule and class
the chances of its three outcomes, from which its accuracy follows) is
estimated by expectation-maximisation over *all* documents, without labels.
Documents enter the estimation as counts of vote patterns: with R rules at
most 3^R rows, whatever the size of the corpus.  Each EM step is one aggregate
over that small table and returns one row of sums.  The posterior probability that
a document is good replaces the usual "all rules must pass" filter; it is a
row expression over the estimated log odds, so scoring needs no join and no
shuffle.

Cases: a null text counts as empty (every rule abstains on texts of fewer than
MIN_WORDS words, and the base check fails them); a text of any length is read whole;
ties and repeated rows are scored alike; an empty table returns no rows (the
initial accuracies stay); other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.llm.common import WHITESPACE, let, lit_or_empty, stage, words

# Words so common that running prose of the language cannot
# avoid them.
FUNCTION_WORDS = [
    "the", "of", "and", "to", "a", "in", "is", "that", "for", "with", "on", "as", "was", "by",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im",
    "le", "la", "les", "des", "et", "en", "un", "du", "une", "que", "est", "pour", "dans", "au",
    "el", "los", "de", "que", "y", "las", "del", "se", "por", "con", "una", "su", "al", "es",
]
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20


@dataclass(frozen=True)
class Rule:
    """Votes bad outside ``bad`` = (lowest, highest), good inside ``good``;
    in between it abstains.  On texts too short to judge the vote is null:
    they tell nothing about the rules and take no part in the estimation."""
    name: str
    bad: tuple[float, float]
    good: tuple[float, float]

    def vote(self, c: Column, n_words: Column) -> Column:
        return (F.when(n_words < MIN_WORDS, F.lit(None).cast("int"))
                .when((c < self.bad[0]) | (c > self.bad[1]), -1)
                .when((c >= self.good[0]) & (c <= self.good[1]), 1).otherwise(0))


TOP = 1e9
# Parameters of the production rules (densities per word unless noted).
RULES = [
    Rule("symbols", (0.0, 0.10), (0.0, 0.03)),
    Rule("capitals", (0.0, 0.50), (0.0, 0.25)),           # of the word characters
    Rule("exclamations", (0.0, 0.30), (0.0, 0.05)),
    Rule("repeats", (0.0, 0.30), (0.0, 0.10)),            # words in repeated windows
    Rule("same_lines", (0.0, 0.30), (0.0, 0.10)),         # of the lines with a word
    Rule("word_length", (2.5, 15.0), (3.0, 12.0)),        # characters
    Rule("function_words", (0.02, TOP), (0.08, TOP)),     # kinds met, of 100 words
    Rule("distinct_words", (0.15, 1.0), (0.30, 1.0)),
    Rule("sentences", (0.004, 0.5), (0.02, 0.3)),
]


def text_features(text: Column) -> Column:
    """Struct of the counts that rules and base check use, in one pass over
    the words of a row."""
    text = lit_or_empty(text)

    def windows(w: Column) -> Column:
        """Hash of every 8-word window."""
        return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.when(
            F.size(h) >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW),
                        lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        ).otherwise(F.array().cast("array<bigint>")))

    def repeated(h: Column) -> Column:
        """Number of words inside windows whose hash occurs twice or more."""
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = let(ranked, lambda s: F.sort_array(F.transform(F.filter(
            s, lambda e, j: (F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False))
                             | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)))),
            lambda e: e["i"])))
        covered = F.aggregate(
            starts, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, i: F.struct(i.alias("last"),
                                    (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"]))
                                    .cast("long").alias("n")),
            lambda acc: acc["n"])
        # Most texts repeat no window: one hash set tells.
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")) \
                .otherwise(covered)

    def count_of(klass: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{klass}]+", "")).cast("long")

    lines = F.filter(F.split(text, "\n", -1), lambda s: F.btrim(s, F.lit(WHITESPACE)) != "")
    return let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        count_of("#*$%&|<>").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .alias("n_dup_lines"),
        let(windows(w), repeated).alias("n_repeat_words"),
        let(lines, lambda x: F.size(x).cast("long")).alias("n_lines"),
        count_of("A-Z").alias("n_capitals"),
        count_of("!").alias("n_exclamations"),
        F.regexp_count(text, F.lit("[.?!](?=[ \\n]|$)")).cast("long").alias("n_sentences"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        F.size(F.array_intersect(w, F.array(*[F.lit(x) for x in dict.fromkeys(FUNCTION_WORDS)])))
        .cast("long").alias("n_function_kinds"),
    ))


def densities(f: Column) -> dict[str, Column]:
    n = F.greatest(f["n_words"], F.lit(1)).cast("double")
    return {
        "symbols": f["n_symbols"] / n,
        "capitals": f["n_capitals"] / F.greatest(f["word_chars"], F.lit(1)),
        "exclamations": f["n_exclamations"] / n,
        "repeats": f["n_repeat_words"] / n,
        "same_lines": f["n_dup_lines"] / F.greatest(f["n_lines"], F.lit(1)),
        "word_length": f["word_chars"] / n,
        # kinds of function words met, against what a text this long should meet
        "function_words": f["n_function_kinds"] / F.least(n, F.lit(100.0)),
        "distinct_words": f["n_distinct"] / n,
        "sentences": f["n_sentences"] / n,
    }


@dataclass(frozen=True)
class LabelModel:
    """Class prior, and per rule the chances of (bad, abstain, good) votes on
    good and on bad documents."""
    prior: float
    on_good: list[tuple[float, float, float]]
    on_bad: list[tuple[float, float, float]]

    def log_odds(self, votes: list[Column]) -> Column:
        out = F.lit(math.log(self.prior / (1 - self.prior)))
        for v, a, b in zip(votes, self.on_good, self.on_bad):
            out = out + F.when(v == 1, math.log(a[2] / b[2])) \
                         .when(v == -1, math.log(a[0] / b[0])) \
                         .when(v == 0, math.log(a[1] / b[1])).otherwise(0.0)
        return out

    def posterior(self, votes: list[Column]) -> Column:
        return 1.0 / (1.0 + F.exp(-self.log_odds(votes)))

    def accuracies(self) -> list[tuple[float, float]]:
        """Per rule: P(right | it votes) on good and on bad documents."""
        return [(a[2] / (a[0] + a[2]), b[0] / (b[0] + b[2]))
                for a, b in zip(self.on_good, self.on_bad)]


def fit_label_model(votes: DataFrame, names: list[str], max_steps: int = 40,
                    tolerance: float = 1e-4, smoothing: float = 0.5,
                    prior: float = 0.9) -> LabelModel:
    """EM over counts of vote patterns (at most 3^len(names) rows).  The start
    says only that rules seldom vote bad on good documents and often enough on
    bad ones."""
    patterns = stage(votes.dropna(how="all", subset=names).groupBy(*names).agg(F.count(F.lit(1)).alias("_n")), "vote-patterns")
    cols = [F.col(n) for n in names]
    model = LabelModel(prior, [(0.01, 0.04, 0.95)] * len(names),
                       [(0.35, 0.15, 0.50)] * len(names))
    for _ in range(max_steps):
        step = patterns.withColumn("_good", F.col("_n") * model.posterior(cols)) \
                       .withColumn("_bad", F.col("_n") - F.col("_good"))
        sums = [F.sum("_n"), F.sum("_good")]
        for c in cols:
            sums += [F.sum(F.when(c == v, F.col(y))) for y in ("_good", "_bad")
                     for v in (-1, 0, 1)]
        row = [float(x or 0.0) for x in step.agg(*sums).first()]
        total, n_good = row[0], row[1]
        if not total:
            return model

        def chances(counts: list[float]) -> tuple[float, float, float]:
            n = sum(counts) + 3 * smoothing
            return tuple((x + smoothing) / n for x in counts)

        six = [row[2 + 6 * i: 8 + 6 * i] for i in range(len(names))]
        new = LabelModel((n_good + smoothing) / (total + 2 * smoothing),
                         [chances(q[:3]) for q in six], [chances(q[3:]) for q in six])
        moved = max(abs(x - y) for a, b in zip(
            [(new.prior,), *new.on_good, *new.on_bad],
            [(model.prior,), *model.on_good, *model.on_bad]) for x, y in zip(a, b))
        model = new
        if moved < tolerance:
            break
    return model


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 20) | (100 * f["n_repeat_words"] > 30 * f["n_words"])


def with_votes(df: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Adds ``_f`` (features) and one vote column ``_v<i>`` per rule."""
    df = df.withColumn("_f", text_features(F.col(text)))
    d = densities(F.col("_f"))
    return df.withColumns({f"_v{i}": r.vote(d[r.name], F.col("_f")["n_words"]) for i, r in enumerate(rules)})


def score_quality(docs: DataFrame, rules: list[Rule] = RULES, threshold: float = 0.5) -> DataFrame:
    """One row per document: counts, base check, posterior and verdict.  The
    features are staged once (a few numbers per document), so the texts are
    read a single time."""
    names = [f"_v{i}" for i in range(len(rules))]
    feats = stage(with_votes(docs.select("doc_id", "text"), rules=rules)
                  .select("doc_id", "_f", *names), "quality-features")
    model = fit_label_model(feats, names)
    f = F.col("_f")
    p = model.posterior([F.col(n) for n in names])
    return feats.select(
        "doc_id", f["n_words"].alias("n_words"), f["word_chars"].alias("word_chars"),
        f["n_symbols"].alias("n_symbols"), f["n_dup_lines"].alias("n_dup_lines"),
        f["n_repeat_words"].alias("n_repeat_words"), base_failed(f).alias("base_failed"),
        (~base_failed(f) & (p >= threshold)).alias("kept"), p.alias("posterior"),
        *[F.col(n).alias(f"vote_{r.name}") for n, r in zip(names, rules)])


def keep_quality(docs: DataFrame, rules: list[Rule] = RULES, threshold: float = 0.5) -> DataFrame:
    """The documents (all their columns) that pass.  They are staged once with
    their votes, so that features are computed a single time and the verdict is
    a row expression."""
    names = [f"_v{i}" for i in range(len(rules))]
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.col("text").alias("_text"))
    scored = stage(with_votes(mine, "_text", rules).select(
        "_row", base_failed(F.col("_f")).alias("_failed"), *names), "quality-votes")
    p = fit_label_model(scored, names).posterior([F.col(n) for n in names])
    return scored.where(~F.col("_failed") & (p >= threshold)).select("_row.*")
