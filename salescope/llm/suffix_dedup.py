"""Exact substring de-duplication by a distributed merge of sorted suffixes.

Every byte covered by a SPAN-byte string that also starts anywhere else is
removed.  Only suffixes that can matter are sorted: anchors are the minima of a
rolling hash over windows of WINDOW positions, so any SPAN bytes hold one whose
BLOCK following bytes are inside, chosen by content alone; two equal strings
hold the same anchor at the same offset.  Anchors whose block hash occurs once
in the corpus are left out.

The suffixes at the other anchors (SPAN bytes) are sorted in the tasks that
hold their texts and sent as front-coded runs (shared prefix length with the
previous suffix, then the rest) to ranges of blocks, with the bytes before the
anchor as payload; equal suffixes with equal payload of a run are one entry.  A range
merges its runs with a loser tree that carries every contender's common prefix
with the last winner: prefixes already known to agree are never compared again,
and the merged common prefix lengths delimit the groups of equal blocks.  In a
group, windows equal at equal offset from the anchor are found by the classes
of their two parts; those met twice are covered.

Cases: a null text counts as empty; texts shorter than SPAN lose nothing;
texts are read whole, matches never cross documents; overlapping and
self-overlapping repeats count; repeated rows cover each other wholly; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.llm.common import (bounded_broadcast, ship_package, shuffle_partitions, stage,
                                  text_slices, utf8)

SPAN = 200
GRAM = 8
BLOCK = 40
WINDOW = SPAN - BLOCK - GRAM + 1    # an anchor, its gram and its block fit into SPAN bytes
CHUNK = 1 << 20
FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
           0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]
RUN_BYTES = 48 << 20
FEW = 16        # entries of a group that are compared pair by pair
CELLS = 1 << 20 # entries times offsets that are looked at together


def rolling(a: np.ndarray) -> np.ndarray:
    """Mixed hash of every GRAM bytes."""
    h = np.zeros(len(a) - GRAM + 1, np.uint64)
    for j in range(GRAM):
        h += (a[j:len(a) - GRAM + 1 + j].astype(np.uint64) + np.uint64(1)) * np.uint64(FACTORS[j])
        h ^= h >> np.uint64(32)
    return h * np.uint64(FACTORS[0])


def window_minima(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive keys, from prefix and suffix minima of
    blocks of w."""
    n = len(keys)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = keys
    grid = full.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


def anchors(data: bytes) -> np.ndarray:
    """Positions chosen by some window (its leftmost minimum)."""
    if len(data) < SPAN:
        return np.empty(0, np.int64)
    h = rolling(np.frombuffer(data, np.uint8))
    out = []
    step = CHUNK - WINDOW + 1
    for at in range(0, len(h) - WINDOW + 1, step):
        part = h[at:at + CHUNK]
        low = np.uint64(CHUNK - 1)
        keys = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        out.append(np.unique(window_minima(keys, WINDOW) & low).astype(np.int64) + at)
    pos = np.unique(np.concatenate(out))
    return pos[pos + BLOCK <= len(data)]


def block_hashes(data: bytes, pos: np.ndarray) -> np.ndarray:
    if not len(pos):
        return np.empty(0, np.int64)
    a = np.frombuffer(data, np.uint8)
    words = a[pos[:, None] + np.arange(BLOCK)].copy().view(np.uint64)
    h = np.zeros(len(pos), np.uint64)
    for j in range(words.shape[1]):
        h = (h ^ words[:, j]) * np.uint64(FACTORS[j % 8])
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def entries(docs: DataFrame) -> DataFrame:
    """Staged rows: row, doc_id, compressed text, anchors with block hashes,
    and for a 1024th of the blocks the bytes (to cut the ranges)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for big in batches:
            for batch in text_slices(big, 2):
                texts = utf8(batch.column(2))
                where = [anchors(t) for t in texts]
                hashes = [block_hashes(t, p) for t, p in zip(texts, where)]
                some = [[t[p:p + BLOCK] for p in ps[(hs & 1023) == 0]]
                        for t, ps, hs in zip(texts, where, hashes)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1),
                     pa.array([pack.compress(t) for t in texts], pa.binary()),
                     pa.array([p.astype(np.int32) for p in where], pa.list_(pa.int32())),
                     pa.array(hashes, pa.list_(pa.int64())),
                     pa.array(some, pa.list_(pa.binary()))],
                    names=["row", "doc_id", "z", "pos", "hash", "some"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return stage(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
                 .mapInArrow(run, f"row long, doc_id {id_type}, z binary, pos array<int>, "
                                  "hash array<long>, some array<binary>"), "suffix-entries")


# ------------------------------------------------------------ front-coded runs
# A run is (heads, bytes, numbers): per entry its shared prefix length, the
# lengths of rest and payload, and how many occurrences it has; then all rests
# and payloads (compressed); then row and position of every occurrence.

def front_code(suffixes: list[tuple[bytes, bytes, int, int]]) -> tuple[bytes, bytes, bytes]:
    """Encodes sorted (suffix, payload, row, position)."""
    heads, body, numbers = [], [], []
    last = last_left = None
    for right, left, row, pos in suffixes:
        if right == last and left == last_left:
            heads[-1][3] += 1
        else:
            n = common(last, right, 0) if last is not None else 0
            heads.append([n, len(right) - n, len(left), 1])
            body += [right[n:], left]
            last, last_left = right, left
        numbers += [row, pos]
    return (np.array(heads, np.int32).tobytes(), zstandard.compress(b"".join(body), 3),
            np.array(numbers, np.int64).tobytes())


def read_run(heads: bytes, body: bytes, numbers: bytes):
    """Yields (shared prefix length, suffix, payload, occurrences) lazily."""
    last, at, k = b"", 0, 0
    body = zstandard.decompress(body)
    occ = np.frombuffer(numbers, np.int64).reshape(-1, 2)
    for n, rest, left, count in np.frombuffer(heads, np.int32).reshape(-1, 4).tolist():
        last = last[:n] + body[at:at + rest]
        at += rest + left
        yield n, last, body[at - left:at], occ[k:k + count]
        k += count


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that agree on ``known``."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    lo, hi = known, n       # agree on lo, differ before hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def merge_runs(runs: list):
    """Merges sorted runs with a loser tree.  Yields (common prefix with the
    previous suffix, suffix, payload, occurrences)."""
    size = 1
    while size < len(runs):
        size *= 2
    runs = [iter(r) for r in runs] + [iter(()) for _ in range(size - len(runs))]
    head: list = [next(r, None) for r in runs]
    known = [0] * size      # each contender's common prefix with the last winner

    def first(i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser learns its prefix with the winner."""
        if head[j] is None or head[i] is None:
            return (i, j) if head[j] is None else (j, i)
        if known[i] != known[j]:
            return (i, j) if known[i] > known[j] else (j, i)
        a, b = head[i][1], head[j][1]
        n = common(a, b, known[i])
        w, x = (i, j) if a[n:n + 1] <= b[n:n + 1] else (j, i)
        known[x] = n
        return w, x

    losers = [0] * size
    def play(node: int) -> int:
        if node >= size:
            return node - size
        w, x = first(play(2 * node), play(2 * node + 1))
        losers[node] = x
        return w

    winner = play(1) if size > 1 else 0
    while head[winner] is not None:
        yield known[winner], *head[winner][1:]
        head[winner] = nxt = next(runs[winner], None)
        known[winner] = nxt[0] if nxt is not None else 0
        node = (winner + size) // 2
        while node:
            w, x = first(winner, losers[node])
            winner, losers[node] = w, x
            node //= 2


def pairwise(group: list) -> list[tuple[int, int]]:
    """Per entry the least and the largest offset (from the anchor back to the
    window's start) of its windows that another occurrence has.  The prefixes
    that the merge found give the common lengths to the right."""
    out = [[SPAN, -1] for _ in group]
    back = [left[::-1] for _, _, left, _ in group]

    def note(i: int, right: int, left: int) -> None:
        least, most = max(0, SPAN - right), min(left, SPAN - BLOCK)
        if least <= most:
            out[i][0] = min(out[i][0], least)
            out[i][1] = max(out[i][1], most)

    for i, (_, right, left, occ) in enumerate(group):
        if len(occ) > 1:
            note(i, len(right), len(left))
        shared = SPAN
        for j in range(i + 1, len(group)):
            shared = min(shared, group[j][0], len(right))
            if shared < BLOCK:
                break
            both = common(back[i], back[j], 0)
            note(i, shared, both)
            note(j, shared, both)
    return [tuple(x) for x in out]


def by_classes(group: list) -> tuple[np.ndarray, np.ndarray]:
    """As ``pairwise``, for many entries.  Windows at one offset are equal if
    their parts after the anchor and before it are: entries stand in the order
    of the first, and in another order of the second, so that neighbours'
    common lengths number the classes of either part."""
    m = len(group)
    right, left, times = (np.array([len(x[i]) for x in group]) for i in (1, 2, 3))
    shared = np.array([x[0] for x in group])
    back = [x[2][::-1] for x in group]
    order = np.array(sorted(range(m), key=back.__getitem__))
    before = np.array([0] + [common(back[a], back[b], 0) for a, b in zip(order, order[1:])])
    least, most = np.full(m, SPAN), np.full(m, -1)
    step = max(1, CELLS // m)
    for at in range(0, SPAN - BLOCK + 1, step):
        offset = np.arange(at, min(at + step, SPAN - BLOCK + 1))[:, None]
        key = np.empty((len(offset), m), np.int64)
        key[:, order] = np.cumsum(before < offset, axis=1)
        key += np.cumsum(shared < SPAN - offset, axis=1) * (m + 1)
        whole = (right >= SPAN - offset) & (left >= offset)
        key = np.where(whole, key, -1 - np.arange(m))       # like no other
        by_key = np.argsort(key, axis=1)
        key = np.take_along_axis(key, by_key, 1)
        same = key[:, 1:] == key[:, :-1]
        met = np.zeros(key.shape, bool)
        met[:, 1:] |= same
        met[:, :-1] |= same
        hit = np.empty(key.shape, bool)
        np.put_along_axis(hit, by_key, met, 1)
        hit |= whole & (times > 1)
        least = np.minimum(least, np.where(hit, offset, SPAN).min(axis=0))
        most = np.maximum(most, np.where(hit, offset, -1).max(axis=0))
    return least, most


def covered(group: list) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of the repeated windows of entries with one block.
    Neighbouring windows overlap: only a gap of SPAN or more would part them,
    and offsets span less."""
    if len(group) == 1 and len(group[0][3]) < 2:
        return
    spread = pairwise(group) if len(group) <= FEW else zip(*(x.tolist() for x in by_classes(group)))
    for (_, _, _, occ), (least, most) in zip(group, spread):
        if most >= least:
            for row, pos in occ.tolist():
                yield row, pos - most, pos - least + SPAN


# --------------------------------------------------------------------- the job

def repeated_ranges(ent: DataFrame) -> DataFrame:
    """(row, start, end): byte ranges covered by repeated strings."""
    spark = ent.sparkSession
    each = ent.select("row", F.explode(F.arrays_zip("pos", "hash")).alias("x")) \
              .select("row", F.col("x.pos").alias("pos"), F.col("x.hash").alias("hash"))
    twice = stage(each.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                  .select("hash"), "repeated-blocks")
    mine = stage(each.join(bounded_broadcast(twice), "hash", "left_semi").groupBy("row")
                 .agg(F.sort_array(F.collect_list("pos")).alias("at")), "repeated-anchors")
    n = 2 * shuffle_partitions(spark)
    # Cuts of the ranges, from a bounded sample of blocks (balance only).
    sample = sorted(bytes(r[0]) for r in ent.select(F.explode("some").alias("b")).distinct()
                    .orderBy(F.xxhash64("b")).limit(20_000).collect())
    cuts = sample[len(sample) // n::max(1, len(sample) // n)][:n - 1]

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        parts: dict[int, list] = {}
        held = 0

        def flush():
            rows = [(p, *front_code(sorted(s))) for p, s in parts.items()]
            parts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()),
                 *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)]],
                names=["part", "heads", "body", "numbers"])

        for batch in batches:
            for row, z, at in zip(*(c.to_pylist() for c in batch.columns)):
                t = unpack.decompress(z)
                for p in at:
                    parts.setdefault(bisect_right(cuts, t[p:p + BLOCK]), []).append(
                        (t[p:p + SPAN], t[max(0, p - SPAN + BLOCK):p], row, p))
                    held += 2 * SPAN + 200
                if held > RUN_BYTES:
                    yield flush()
                    held = 0
        yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranges(runs):
            group, out = [], []
            for entry in merge_runs([read_run(*r) for r in runs]):
                if entry[0] < BLOCK and group:
                    out += covered(group)
                    group = []
                group.append(entry)
                if len(out) > 50_000:
                    yield out
                    out = []
            yield out + list(covered(group) if group else ())

        def batches_of(runs):
            for rows in ranges(runs):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()),
                     pa.array([r[1] for r in rows], pa.int32()),
                     pa.array([r[2] for r in rows], pa.int32())], names=["row", "start", "end"])

        runs, now = [], None
        for batch in batches:
            for part, *run in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    yield from batches_of(runs)
                    runs, now = [], part
                runs.append(run)
        yield from batches_of(runs)

    sent = ent.select("row", "z").join(mine, "row").select("row", "z", "at") \
              .mapInArrow(suffixes, "part int, heads binary, body binary, numbers binary")
    return sent.repartition(n, "part").sortWithinPartitions("part") \
               .mapInArrow(merge, "row long, start int, end int")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``kept`` (the bytes
    left) for every document."""
    ship_package(docs.sparkSession)
    ent = entries(docs)
    found = stage(repeated_ranges(ent).groupBy("row").agg(
        F.collect_list(F.struct("start", "end")).alias("ranges")), "repeated-ranges")
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for z, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                t = unpack.decompress(z)
                kept, at, gone, spans = [], 0, 0, 0
                end = -1
                for r in sorted((x["start"], x["end"]) for x in ranges or ()):
                    if r[0] > end:
                        spans += 1
                        kept.append(t[at:r[0]])
                        gone -= r[0]
                        end = r[1]
                        gone += end
                    elif r[1] > end:
                        gone += r[1] - end
                        end = r[1]
                    at = end
                left = b"".join(kept) + t[at:]
                rows.append((len(t), gone, spans, hashlib.sha256(left).hexdigest(), left))
            cols = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(list(c), t) for c, t in zip(cols, types)]],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return ent.select("row", "doc_id", "z").join(found, "row", "left") \
              .select("doc_id", "z", "ranges").mapInArrow(run, f"doc_id {id_type}, {schema}")


def removal_digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).drop("kept")
