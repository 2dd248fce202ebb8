"""Language-model score by prediction by partial matching over bytes.

The model holds every byte context of up to ORDER bytes met in training, with
the counts of the byte that follows it.  A byte is coded in the longest
context met; an escape (method D: chance = distinct / (2 total)) passes to the
next shorter context, from whose counts the bytes already excluded are left
out, down to a uniform choice among the bytes never excluded.  Texts are
ASCII-lower-cased, coded after ORDER zero bytes and ended by a byte that UTF-8
never uses, so the scores of all texts are chances of one distribution.

The chance of a byte depends on its (ORDER + 1)-gram only.  The scan deals
texts into groups of about GROUP_BYTES and sends each distinct gram of a group
once, with its training count.  Grams are dealt into buckets by a hash of the
three bytes before the coded one, so a bucket holds all that was met of its
contexts of three bytes and more.  They travel as packed rows, one per group
and bucket: sorted, as differences, a few bytes per gram.

The model is a staged table that grows with the corpus: the counts of every
gram by bucket, summed from the groups.  Only contexts of at most two bytes
are met in many buckets; their counts are summed over all and broadcast (at
most 2^24 byte triples, of which UTF-8 leaves some five million).  A second
pass over the buckets answers the groups with the costs of their grams, and
each group sums them over its texts.  A task holds the counts of one bucket
(there are at least BUCKETS, and no fewer than shuffle partitions) and one
packed row of a group, or the texts and grams of one group.

The exclusion takes from a context the total, in it, of the bytes that follow
the next longer one (whatever follows a context also follows each of its
endings).

Base score: unigram words with add-one smoothing.  Words above 1 / HOT_SHARE of
the training tokens (so at most HOT_SHARE) are scored by the scan; all others meet
their counts in a join, where no word can hold more than such a share of the
rows of training texts.

Cases: a null text counts as empty (one end token, one end byte); repeated
rows are scored each; without training rows the model is uniform; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.llm.common import ship_package, shuffle_partitions, stage, text_slices, utf8
from salescope.session import delete_tables, recorded_tables

ORDER = 5
END = b"\xff"
HOT_SHARE = 1 << 18
# Texts of a group share the rows of their grams: a group ends at either size.
GROUP_BYTES, GROUP_GRAMS = 24 << 20, 2_000_000
# Contexts of at most SHORT bytes are shared by all buckets; their counts are
# merged in PARTS parts.
BUCKETS, SHORT, PARTS = 512, 2, 32


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


# ------------------------------------------------------------------ training

def grams(texts: list[bytes]) -> np.ndarray:
    """All (ORDER + 1)-grams of lower-cased texts, the coded byte lowest."""
    pad = b"\0" * ORDER
    parts = [pad + t + END for t in texts]
    a = np.frombuffer(b"".join(parts), np.uint8)
    code = np.zeros(len(a) - ORDER, np.int64)
    for j in range(ORDER + 1):
        code = (code << 8) | a[j:len(a) - ORDER + j]
    coded = np.ones(len(a), bool)       # the padding itself is not coded
    starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
    coded[(starts[:, None] + np.arange(ORDER)).ravel()] = False
    return code[coded[ORDER:]]


def _distinct(texts: list[bytes], train: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of the texts and their counts in the training texts."""
    k, n = np.unique(grams([t for t, x in zip(texts, train) if x] or [b""]), return_counts=True)
    if not any(train):
        k, n = k[:0], n[:0]
    rest = [t for t, x in zip(texts, train) if not x]
    if not rest:
        return k, n
    other = np.unique(grams(rest))
    return _merged(k, n, other, np.zeros(len(other), np.int64))


def _merged(k: np.ndarray, n: np.ndarray, k2: np.ndarray, n2: np.ndarray):
    both, at = np.unique(np.concatenate([k, k2]), return_inverse=True)
    return both, np.bincount(at, np.concatenate([n, n2]), len(both)).astype(np.int64)


def squeezed(a: np.ndarray) -> bytes:
    """Numbers by byte planes, so that their empty high bytes cost nothing."""
    return zstandard.compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes(), 1)


def expanded(b: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def squeezed_keys(k: np.ndarray) -> bytes:
    return squeezed(np.diff(k, prepend=0))


def expanded_keys(b: bytes) -> np.ndarray:
    return np.cumsum(expanded(b, np.int64))


def bucket_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    """By the SHORT + 1 bytes before the coded one."""
    context = ((gram >> 8) & ((1 << (8 * (SHORT + 1))) - 1)).astype(np.uint64)
    return ((context * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema,
                           options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


SCANNED = "batch long, texts binary, bucket int, grams binary, times binary, token binary, n long"


def _scan(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (batch, texts), (batch, bucket, grams, times) and (token, n).
    ``texts`` packs a slice of lower-cased texts with row, doc_id and held_out;
    times and n count training texts only; b'' is the end token."""
    from pyspark import TaskContext
    first = TaskContext.get().partitionId() << 32
    words: Counter = Counter()
    keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
    group, held = 0, 0                  # texts of a group are counted in ``held`` bytes
    types = {"batch": pa.int64(), "texts": pa.binary(), "bucket": pa.int32(),
             "grams": pa.binary(), "times": pa.binary(), "token": pa.binary(), "n": pa.int64()}

    def rows(count, **have):
        return pa.RecordBatch.from_arrays(
            [have[c] if c in have else pa.nulls(count, t) for c, t in types.items()],
            names=list(types))

    def group_rows(keys, sums):
        if not len(keys):
            return
        bucket = bucket_of(keys, buckets).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        keys, sums, bucket = keys[order], sums[order], bucket[order]
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(keys)]
        spans = list(zip(cuts, cuts[1:]))
        yield rows(len(spans), batch=pa.array(np.full(len(spans), first + group)),
                   bucket=pa.array(bucket[cuts[:-1]]),
                   grams=pa.array([squeezed_keys(keys[lo:hi]) for lo, hi in spans], pa.binary()),
                   times=pa.array([squeezed(sums[lo:hi]) for lo, hi in spans], pa.binary()))

    def word_rows(w):
        return rows(len(w), token=pa.array(list(w), pa.binary()),
                    n=pa.array(list(w.values()), pa.int64()))

    for big in batches:
        for batch in text_slices(big, 3, 1 << 20):
            texts = [t.lower() for t in utf8(batch.column(3))]
            train = [not x for x in batch.column(2).to_pylist()]
            for t, x in zip(texts, train):
                if x:
                    words.update(t.split())
            if any(train):
                words[b""] += sum(train)
            keys, sums = _merged(keys, sums, *_distinct(texts, train))
            yield rows(1, batch=pa.array([first + group]), texts=pa.array([_pack(
                pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.binary())],
                                           names=["row", "doc_id", "held_out", "text"]))]))
            held += sum(map(len, texts))
            if held >= GROUP_BYTES or len(keys) >= GROUP_GRAMS:     # bounded task memory
                yield from group_rows(keys, sums)
                keys, sums, group, held = keys[:0], sums[:0], group + 1, 0
            if len(words) > 300_000:
                yield word_rows(words)
                words = Counter()
    yield from group_rows(keys, sums)
    if words:
        yield word_rows(words)


@dataclass
class Trie:
    """The same model in memory, for corpora of a few contexts: the plain form
    of ``gram_costs``.  Nodes, node 0 being the empty context.  ``context`` and ``depth`` name
    a node by its last bytes; (node, byte, n) are the counts."""
    context: np.ndarray
    depth: np.ndarray
    node: np.ndarray
    byte: np.ndarray
    n: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """letter[byte]; child[width * node + letter of the earlier byte] (0:
        none); cost[width * node + letter], the log10 chance of the byte.
        Bytes never met in training share one letter."""
        met = np.union1d(np.unique(self.byte), np.unique(self.context & 255))
        width = len(met) + 1
        letter = np.full(256, len(met), np.int64)
        letter[met] = np.arange(len(met))
        size = len(self.context)
        number = {(int(d), int(c)): i for i, (d, c) in enumerate(zip(self.depth, self.context))}
        child = np.zeros(width * size, np.int32)
        parent = np.zeros(size, np.int64)
        for (d, c), i in number.items():
            if d:
                older = c >> (8 * (d - 1))
                parent[i] = number[(d - 1, c & ((1 << (8 * (d - 1))) - 1))]
                child[width * parent[i] + letter[older]] = i
        counts = np.zeros((size, width), np.float32)
        counts[self.node, letter[self.byte]] = self.n
        cost = np.empty((size, width), np.float32)
        for lo in range(0, size, 4096):
            mine = np.arange(lo, min(lo + 4096, size))
            cost[mine] = _coded(counts, parent, self.depth, mine, 257 - width)
        return letter, child, cost.ravel()


def _coded(counts, parent, depth, mine, others: int) -> np.ndarray:
    """log10 chances of all letters in nodes ``mine``, by escape (method D)
    and exclusion.  The last letter stands for ``others`` bytes."""
    width = counts.shape[1]
    chance = np.zeros((len(mine), width))
    excluded = np.zeros((len(mine), width), bool)
    passed = np.ones(len(mine))         # chance of having escaped so far
    at, more = mine.copy(), np.ones(len(mine), bool)
    while more.any():
        c = np.where(excluded, 0.0, counts[at]) * more[:, None]
        total, kinds = c.sum(1), (c > 0).sum(1)
        whole = np.maximum(2.0 * total, 1.0)
        chance += passed[:, None] * np.where(c > 0, 2.0 * c - 1.0, 0.0) / whole[:, None]
        passed = np.where(kinds > 0, passed * kinds / whole, passed)
        excluded |= c > 0
        more &= depth[at] > 0
        at = np.where(more, parent[at], at)
    size = np.ones(width)
    size[-1] = others
    left = (~excluded) @ size
    chance += np.where(excluded, 0.0, (passed / np.maximum(left, 1.0))[:, None])
    return np.log10(np.maximum(chance, 1e-300))


# -------------------------------------------------------------- bucket passes

def _summed(k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their sums."""
    k, at = np.unique(k, return_inverse=True)
    return k, np.bincount(at, n, len(k)).astype(np.int64)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows of a partition sorted by bucket, bucket by bucket."""
    one_by_one = (r for b in batches for i in range(len(b)) for r in b.slice(i, 1).to_pylist())
    return groupby(one_by_one, key=lambda r: r["bucket"])


def _total(rows: Iterator[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of packed rows and the sums of their counts."""
    k, n = [], []
    for r in rows:
        k.append(expanded_keys(r["grams"]))
        n.append(expanded(r["times"], np.int64))
        if len(k) > 1 and sum(map(len, k[1:])) > max(1 << 20, len(k[0])):
            sums = _summed(np.concatenate(k), np.concatenate(n))
            k, n = [sums[0]], [sums[1]]
    return _summed(np.concatenate(k), np.concatenate(n))


def _counted(bucket: int, k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int32()), pa.array([squeezed_keys(k)], pa.binary()),
         pa.array([squeezed(n)], pa.binary())], names=["bucket", "grams", "times"])


COUNTED = "bucket int, grams binary, times binary"


def _sum_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket its grams and training counts; then the counts that the task
    has of byte triples (SHORT bytes of context and the coded one), in PARTS
    rows with negative numbers."""
    short = np.empty(0, np.int64), np.empty(0, np.int64)
    for bucket, mine in _by_bucket(batches):
        k, n = _total(mine)
        yield _counted(bucket, k, n)
        met = n > 0
        short = _merged(*short, *_summed(k[met] & ((1 << (8 * (SHORT + 1))) - 1), n[met]))
    for part in range(PARTS):
        mine = short[0] % PARTS == part
        if mine.any():
            yield _counted(-1 - part, short[0][mine], short[1][mine])


def _merge_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, mine in _by_bucket(batches):
        yield _counted(bucket, *_total(mine))


def _dealt(rows: DataFrame, *then) -> DataFrame:
    """Rows in as many tasks as there are shuffle partitions, sorted by bucket."""
    return rows.repartition(shuffle_partitions(rows.sparkSession), "bucket") \
               .sortWithinPartitions("bucket", *then)


def _shorter_levels(k: np.ndarray, n: np.ndarray, top: int, least: int = 0) -> dict:
    """Distinct endings (d bytes of context and the coded one) and counts for d
    from ``top``, at which they are given, down to ``least``."""
    level = {top: (k, n)}
    for d in range(top - 1, least - 1, -1):
        k, n = level[d + 1]
        level[d] = _summed(k & ((1 << (8 * (d + 1))) - 1), n)
    return level


def _find(sorted_keys: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of k and whether they are there."""
    if not len(sorted_keys):
        return np.zeros(len(k), np.int64), np.zeros(len(k), bool)
    at = np.minimum(np.searchsorted(sorted_keys, k), len(sorted_keys) - 1)
    return at, sorted_keys[at] == k


def _nodes(level: dict, d: int):
    """Contexts of d bytes: their total, number of bytes, and the total of
    those bytes in the context one byte shorter."""
    k, n = level[d]
    context, at = np.unique(k >> 8, return_inverse=True)
    below = np.zeros(len(k))
    if d:
        below = level[d - 1][1][_find(level[d - 1][0], k & ((1 << (8 * d)) - 1))[0]]
    return (context, np.bincount(at, n, len(context)), np.bincount(at, minlength=len(context)),
            np.bincount(at, below, len(context)))


def gram_costs(gram: np.ndarray, n: np.ndarray, short: dict) -> np.ndarray:
    """log10 chances of the grams of a bucket, given their training counts (0
    for grams that are only to be scored).  ``short`` holds the levels of up to
    SHORT bytes of context, of all buckets."""
    met = n > 0
    level = {**_shorter_levels(gram[met], n[met], ORDER, SHORT + 1), **short}
    cost = np.full(len(gram), np.nan)
    todo = np.arange(len(gram))
    passed, less, fewer = np.zeros(len(gram)), np.zeros(len(gram)), np.zeros(len(gram))
    for d in range(ORDER, -1, -1):
        context, total, kinds, shorter = _nodes(level, d)
        key = gram[todo] & ((1 << (8 * (d + 1))) - 1)
        at, there = _find(context, key >> 8)
        if not len(context):
            continue                    # nothing met: no escape, nothing excluded
        left = 2.0 * (total[at] - less)
        own, coded = _find(level[d][0], key)
        with np.errstate(divide="ignore", invalid="ignore"):
            cost[todo[coded]] = (passed + np.log10((2.0 * level[d][1][own] - 1) / left))[coded]
            escaped = there & (kinds[at] > fewer)
            passed = np.where(escaped, passed + np.log10((kinds[at] - fewer) / left), passed)
        less, fewer = np.where(there, shorter[at], 0.0), np.where(there, kinds[at], 0.0)
        todo, passed, less, fewer = todo[~coded], passed[~coded], less[~coded], fewer[~coded]
    cost[todo] = passed - np.log10(256.0 - fewer)
    return cost


def bucket_sums(asked: DataFrame) -> DataFrame:
    """The model: rows (bucket, grams, times); buckets below 0 are byte triples."""
    return stage(_dealt(asked.select("bucket", "grams", "times"))
                 .mapInArrow(_sum_buckets, COUNTED), "ppm-sums")


def gram_answers(asked: DataFrame, sums: DataFrame) -> DataFrame:
    """(batch, grams, costs) for the packed grams that the groups asked for."""
    spark = asked.sparkSession
    parts = _dealt(sums.where("bucket < 0")).mapInArrow(_merge_parts, COUNTED).collect()
    k, n = (np.concatenate([np.empty(0, np.int64), *x]) for x in (
        [expanded_keys(bytes(r["grams"])) for r in parts],
        [expanded(bytes(r["times"]), np.int64) for r in parts]))
    triples = spark.sparkContext.broadcast(_summed(k, n))      # at most 2^24, in PARTS rows

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = _shorter_levels(*triples.value, SHORT)
        for _, mine in _by_bucket(batches):
            known = next(mine)          # nulls first: the row of the model
            gram = expanded_keys(known["grams"])
            cost = gram_costs(gram, expanded(known["times"], np.int64), short).astype(np.float32)
            for r in mine:
                mine_cost = cost[np.searchsorted(gram, expanded_keys(r["grams"]))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["batch"]], pa.int64()), pa.array([r["grams"]], pa.binary()),
                     pa.array([squeezed(mine_cost)], pa.binary())],
                    names=["batch", "grams", "costs"])

    rows = sums.where("bucket >= 0").unionByName(
        asked.select("batch", "bucket", "grams"), allowMissingColumns=True)
    return stage(_dealt(rows.select("bucket", "batch", "grams", "times"),
                        F.col("batch").asc_nulls_first())
                 .mapInArrow(answered, "batch long, grams binary, costs binary"), "ppm-answers")


# ------------------------------------------------------------------- scoring

class Costs:
    """Costs of the grams of a group of texts.  Most are met by one probe of a
    table of hash slots; those that lost their slot by binary search."""

    def __init__(self, gram: np.ndarray, cost: np.ndarray):
        order = np.argsort(gram)
        self.gram, self.cost = gram[order], cost[order]
        self.shift = np.uint64(64 - max(10, int(4 * len(gram)).bit_length()))
        self.slot = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.slot[self._hash(self.gram)] = np.arange(len(gram), dtype=np.int32)

    def _hash(self, gram: np.ndarray) -> np.ndarray:
        return (gram.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __getitem__(self, gram: np.ndarray) -> np.ndarray:
        at = self.slot[self._hash(gram)]
        lost = np.flatnonzero(self.gram[at] != gram)
        at[lost] = np.searchsorted(self.gram, gram[lost])
        return self.cost[at]


def code_lengths(texts: list[bytes], costs: Costs) -> np.ndarray:
    """log10 chance of every (lower-cased) text."""
    value = costs[grams(texts)].astype(np.float64)
    return np.add.reduceat(value, np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]))


def score_texts(rows: DataFrame, hot: dict[bytes, int], id_type: str) -> DataFrame:
    """doc_id, held_out, score, n_tokens, and the base score's parts: the sum
    over hot words, and the rest as token and count arrays.  ``rows`` are packed
    texts, and packed grams with their costs, of a batch each."""
    spark = rows.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(hot)
    schema = ("score double, n_tokens long, hot_log double, hot_known long, "
              "tokens array<binary>, times array<int>")

    def scored(part: list[pa.RecordBatch], known: dict[bytes, float]):
        costs = Costs(*(np.concatenate([read(x.as_py()) for b in part
                                        for x in b.column(c).drop_null()])
                        for c, read in (("grams", expanded_keys),
                                        ("costs", lambda x: expanded(x, np.float32)))))
        for mine in part:
            for packed in mine.column("texts").drop_null():
                batch = pa.ipc.open_stream(packed.as_buffer()).read_next_batch()
                texts = batch.column(3).to_pylist()
                logs, n_known, sizes, tokens, times = [], [], [], [], []
                for t in texts:
                    c = Counter(t.split())
                    c[b""] = 1
                    sizes.append(c.total())
                    at_hot = [(known[w], n) for w, n in c.items() if w in known]
                    logs.append(math.fsum(x * n for x, n in at_hot))
                    n_known.append(sum(n for _, n in at_hot))
                    rest = [(w, n) for w, n in c.items() if w not in known]
                    tokens.append([w for w, _ in rest])
                    times.append([n for _, n in rest])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(code_lengths(texts, costs)),
                     pa.array(sizes, pa.int64()), pa.array(logs, pa.float64()),
                     pa.array(n_known, pa.int64()), pa.array(tokens, pa.list_(pa.binary())),
                     pa.array(times, pa.list_(pa.int32()))],
                    names=["row", "doc_id", "held_out", "score", "n_tokens", "hot_log",
                           "hot_known", "tokens", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: math.log10(c + 1) for w, c in model.value.items()}
        at, part = None, []
        for big in batches:
            name = big.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(name)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(name)]):
                if lo == hi:
                    continue
                if name[lo] != at:
                    if part:
                        yield from scored(part, known)
                    at, part = name[lo], []
                part.append(big.slice(lo, hi - lo))
        if part:
            yield from scored(part, known)

    return rows.select("batch", "texts", "grams", "costs") \
               .repartition(shuffle_partitions(spark), "batch").sortWithinPartitions("batch") \
               .mapInArrow(run, f"row long, doc_id {id_type}, held_out boolean, {schema}")


def score_documents(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    ship_package(spark)
    buckets = max(BUCKETS, shuffle_partitions(spark))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    with recorded_tables() as scanned:
        scan = stage(
            docs.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                        held_out(F.col("doc_id")).alias("held_out"), "text")
            .mapInArrow(lambda batches: _scan(batches, buckets), SCANNED), "ppm-scan")
    asked = scan.where("grams IS NOT NULL").select("batch", "bucket", "grams", "times")
    with recorded_tables() as summed:
        sums = bucket_sums(asked)
    with recorded_tables() as answered:
        answers = gram_answers(asked, sums)
    delete_tables(spark, summed)        # read once, by the staged answers
    vocabulary = stage(scan.where("token IS NOT NULL").groupBy("token")
                       .agg(F.sum("n").alias("c")), "ppm-words")
    total, kinds = vocabulary.agg(F.sum("c"), F.count(F.lit(1))).first()
    total = total or 0
    # At most HOT_SHARE words.
    hot = {bytes(r["token"]): r["c"] for r in
           vocabulary.where(F.col("c") * HOT_SHARE > total).collect()}
    texts = scan.where("texts IS NOT NULL").select("batch", "texts")
    scored = stage(score_texts(texts.unionByName(answers, allowMissingColumns=True), hot,
                               id_type), "ppm-scored")
    delete_tables(spark, scanned + answered)
    rest = (scored.select("row", F.explode(F.arrays_zip("tokens", "times")).alias("x"))
            .select("row", F.col("x.tokens").alias("token"), F.col("x.times").alias("times"))
            .join(vocabulary.where(F.col("c") * HOT_SHARE <= total), "token")
            .groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("log"),
                                F.sum("times").alias("known")))
    each = F.col("n_tokens") * math.log10(total + kinds + 1)
    return scored.drop("tokens", "times").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("hot_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("hot_log") + F.coalesce("log", F.lit(0.0)) - each).alias("base_score"), "score")
