"""Toxic spans by a linear-chain conditional random field.

States: clean (0) and toxic (1).  A token's features are its word and its
prefixes; the score of state 1 is a bias plus the weights of the features the
model knows, and there are weights for the state transitions.  The forward-
backward recursions give each token's marginal chance of being toxic; a
document's score is the largest marginal (an order statistic, so long clean
texts do not add up to a suspicion), and tokens at 0.5 or more form the
offending spans, given as code-point offsets.

Fitting.  Only documents carry labels.  Per-class document counts of the
features come from a bounded sample of labelled documents (``max_docs`` per
class, smallest hashes); a token of a toxic document is labelled toxic when one of
its features is tied to toxic documents by a log odds of at least
``min_log_odds``.  The field is then fitted by gradient ascent on at most
``max_segments`` segments of SEGMENT tokens per kind (with a toxic token, with
a clean token that shares a tied feature, with neither).  Both bounds are parameters; everything else covers all rows.

Scoring maps whole texts in Arrow batches without a shuffle; the recursions
of all texts of a slice run in step.

Cases: a null or wordless text has no token and scores 0; null or missing
labels are not used; repeated rows get equal results; no toxic or no clean
labelled row gives a model that finds nothing; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.llm.common import ship_package, stage, text_slices, utf8

PREFIXES = (3, 4, 5, 6)
SEGMENT = 64
EDGES = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def features(word: bytes) -> list[str]:
    """Features of a lower-cased token: the word without outer punctuation,
    and its prefixes."""
    w = word.decode("utf-8", "ignore").strip(EDGES)
    return [f"={w}"] + [w[:k] for k in PREFIXES if len(w) > k] if w else []


@dataclass
class Field:
    """Weights of state 1 by feature; ``moves`` = (01, 10, 11) transition
    scores against 00."""
    bias: float = -8.0
    weights: dict[str, float] = field(default_factory=dict)
    moves: tuple[float, float, float] = (0.0, 0.0, 0.0)


class Scores(dict):
    """Score of state 1 by token, filled on demand; emptied when large."""

    def __init__(self, model: Field, most: int = 400_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word: bytes) -> float:
        if len(self) > self.most:
            self.clear()
        w = self.model.weights
        s = self[word] = self.model.bias + sum(w.get(f, 0.0) for f in features(word))
        return s


def recursions(e: np.ndarray, sizes: np.ndarray, moves) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward ratios (state 1 over state 0) of sequences laid
    end to end, longest first.  ``e`` = exp(score of state 1)."""
    a01, a10, a11 = (math.exp(x) for x in moves)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    fwd, bwd = np.empty_like(e), np.ones_like(e)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # sizes > t
    r = np.zeros(len(sizes))
    for t in range(longest):
        n = active[t]
        at = first[:n] + t
        prev = r[:n]
        r[:n] = e[at] * (a01 + a11 * prev) / (1.0 + a10 * prev)
        fwd[at] = r[:n]
    q = np.ones(len(sizes))
    for t in range(longest - 2, -1, -1):
        n = active[t + 1]
        at = first[:n] + t
        x = e[at + 1] * q[:n]
        q[:n] = (a10 + a11 * x) / (1.0 + a01 * x)
        bwd[at] = q[:n]
    return fwd, bwd


# ------------------------------------------------------------------- fitting

def training_sample(docs: DataFrame, labels: DataFrame, max_docs: int) -> DataFrame:
    """Staged (text, toxic) of at most ``max_docs`` distinct labelled texts of
    either class; held-out documents never."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL") \
                  .select(F.col("doc_id").alias("_id"), (F.col("toxic") > 0).alias("toxic")) \
                  .where(~held_out(F.col("_id")))
    order = [F.xxhash64("_id"), "_id"]
    picked = known.where("toxic").orderBy(*order).limit(max_docs).union(
        known.where("NOT toxic").orderBy(*order).limit(max_docs))
    return stage(docs.select("doc_id", "text")
                 .join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
                 .select("text", "toxic").dropDuplicates(["text", "toxic"]), "crf-sample")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for batch in batches:
        for text, toxic in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
            words = set(text.lower().split())
            seen[toxic].update({f for w in words for f in features(w)} | {""})
    rows = [(f, n, toxic) for toxic, c in seen.items() for f, n in c.items()]
    cols = list(zip(*rows)) or [(), (), ()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()),
         pa.array(cols[2], pa.bool_())], names=["feature", "n", "toxic"])


def fit_field(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, max_features: int = 4000,
              max_segments: int = 4000, min_share: float = 0.03, min_log_odds: float = 3.0,
              steps: int = 80) -> Field:
    ship_package(docs.sparkSession)
    sample = training_sample(docs, labels, max_docs)
    counts = stage(sample.mapInArrow(_count, "feature string, n long, toxic boolean")
                   .groupBy("feature").agg(
                       F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("t"),
                       F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("c")),
                   "crf-counts")
    total = counts.where("feature = ''").first()    # '' counts the documents
    if total is None or not total["t"] or not total["c"]:
        return Field()
    n_t, n_c = total["t"], total["c"]
    odds = F.log((F.col("t") + 0.5) / (n_t + 1.0)) - F.log((F.col("c") + 0.5) / (n_c + 1.0))
    least_t, least_c = max(4, min_share * n_t), max(4, min_share * n_c)
    # Bounded by max_features.
    rows = (counts.where("feature <> ''").where((F.col("t") >= least_t) | (F.col("c") >= least_c))
            .withColumn("odds", odds).orderBy(F.desc("odds"), "feature").limit(max_features)
            .collect())
    names = [r["feature"] for r in rows]
    number = {f: i + 1 for i, f in enumerate(names)}    # 0: none
    tied = {r["feature"] for r in rows if r["odds"] >= min_log_odds and r["t"] >= least_t}
    width = 1 + len(PREFIXES)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, toxic in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
                words = text.lower().split()
                for at in range(0, len(words), SEGMENT):
                    fs = [features(w) for w in words[at:at + SEGMENT]]
                    ids = np.zeros((len(fs), width), np.int16)
                    for i, f in enumerate(fs):
                        k = [number[x] for x in f if x in number]
                        ids[i, :len(k)] = k
                    like = np.array([any(x in tied for x in f) for f in fs], bool)
                    y = (like & toxic).astype(np.int8)
                    out.append((ids.tobytes(), y.tobytes(), int(like.any()) + int(y.any())))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()),
                 pa.array(cols[2], pa.int32())], names=["ids", "y", "kind"])

    cut = stage(sample.mapInArrow(segments, "ids binary, y binary, kind int"), "crf-segments")
    order = [F.xxhash64("ids", "y"), "ids"]
    # 2: with toxic tokens; 1: clean ones that look like them; 0: all others.
    picked = [r for kind in (2, 1, 0) for r in
              cut.where(F.col("kind") == kind).orderBy(*order).limit(max_segments).collect()]
    return _ascend(picked, names, width, steps)


def _ascend(rows, names: list[str], width: int, steps: int) -> Field:
    """Adaptive gradient ascent on the conditional log-likelihood of the
    labelled segments (bounded by the sample)."""
    seqs = sorted(((np.frombuffer(r["ids"], np.int16).reshape(-1, width),
                    np.frombuffer(r["y"], np.int8)) for r in rows), key=lambda s: -len(s[1]))
    seqs = [s for s in seqs if len(s[1])]
    if not seqs:
        return Field()
    x = np.concatenate([s[0] for s in seqs]).astype(np.int64)
    y = np.concatenate([s[1] for s in seqs]).astype(float)
    sizes = np.array([len(s[1]) for s in seqs])
    ends = np.cumsum(sizes)
    inner = np.ones(len(y), bool)       # tokens with a successor
    inner[ends - 1] = False
    heads = ends - sizes
    w = np.zeros(len(names) + 1)
    p = np.array([-4.0, 0.0, 0.0, 0.0])     # bias and transitions
    gw, gp = np.full_like(w, 1e-6), np.full_like(p, 1e-6)
    here = np.flatnonzero(inner)
    pair = y[here], y[here + 1]
    for _ in range(steps):
        e = np.exp(np.clip(p[0] + w[x].sum(1), -30, 30))
        f, b = recursions(e, sizes, p[1:])
        odds = f * b
        d = y - odds / (1.0 + odds)
        grad = np.bincount(x.ravel(), np.repeat(d, width), len(w)) - 0.01 * w
        grad[0] = 0.0
        a01, a10, a11 = np.exp(p[1:])
        nxt = e[here + 1] * b[here + 1]
        cells = np.stack([np.ones(len(here)), a01 * nxt, a10 * f[here], a11 * f[here] * nxt])
        cells /= cells.sum(0)
        m0 = (odds / (1.0 + odds))[heads]   # a virtual clean token comes first
        seen = [((1 - pair[0]) * pair[1]).sum() + y[heads].sum(),
                (pair[0] * (1 - pair[1])).sum(), (pair[0] * pair[1]).sum()]
        due = [cells[1].sum() + m0.sum(), cells[2].sum(), cells[3].sum()]
        g = np.array([d.sum(), *(np.array(seen) - due)]) - 0.01 * p
        gw += grad ** 2
        gp += g ** 2
        w += 0.5 * grad / np.sqrt(gw)
        p += 0.2 * g / np.sqrt(gp)
    return Field(float(p[0]), {n: float(v) for n, v in zip(names, w[1:]) if v},
                 tuple(float(v) for v in p[1:]))


# ------------------------------------------------------------------- scoring

def tag_documents(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, score (largest marginal), n_toxic_words and ``spans``, the
    offending code-point ranges (start, end exclusive, mean marginal)."""
    ship_package(docs.sparkSession)
    schema = ("score double, n_toxic_words long, "
              "spans array<struct<start:int,end:int,chance:double>>")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()),
                               ("chance", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model)
        for big in batches:
            for batch in text_slices(big, 1):
                texts = utf8(batch.column(1))
                words = [t.lower().split() for t in texts]
                sizes = np.array([len(w) for w in words], np.int64)
                order = np.argsort(-sizes, kind="stable")
                e = np.fromiter((s for i in order for s in map(scores.__getitem__, words[i])),
                                np.float64, int(sizes.sum()))
                e = np.exp(np.clip(e, -30, 30))
                f, b = recursions(e, sizes[order], model.moves)
                m = f * b
                m /= 1.0 + m
                score = np.zeros(len(texts))
                tagged = np.zeros(len(texts), np.int64)
                spans: list[list] = [[] for _ in texts]
                ends = np.cumsum(sizes[order])
                for i, end in zip(order, ends):
                    if not sizes[i]:
                        continue
                    mine = m[end - sizes[i]:end]
                    score[i] = mine.max()
                    if score[i] >= 0.5:
                        tagged[i] = int((mine >= 0.5).sum())
                        spans[i] = offending(texts[i], mine)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(score), pa.array(tagged), pa.array(spans, span)],
                    names=["doc_id", "score", "n_toxic_words", "spans"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {schema}")


def offending(text: bytes, chances: np.ndarray) -> list[dict]:
    """Runs of tokens with a chance of 0.5 or more, as code-point ranges."""
    out, at, n = [], 0, 0
    run: list[float] = []
    for (a, z), c in zip((m.span() for m in WORD.finditer(text)), chances):
        if c < 0.5:
            run = []
            continue
        n += len(text[at:a].decode("utf-8", "ignore"))
        size = len(text[a:z].decode("utf-8", "ignore"))
        if run:
            run.append(float(c))
            out[-1] |= {"end": n + size, "chance": sum(run) / len(run)}
        else:
            run = [float(c)]
            out.append({"start": n, "end": n + size, "chance": float(c)})
        at, n = z, n + size
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and the spans as text."""
    tagged = tag_documents(docs, fit_field(docs, labels))
    return tagged.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic_words",
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
        .alias("spans"))
