"""The scoring model holds every context: compared with plain PPM."""

import math
import zlib
from collections import Counter, defaultdict

import pytest


def plain_ppm(train, texts, order=5):
    """log10 chances by the definition: all contexts, method D, exclusion."""
    seen = defaultdict(Counter)
    for t in train:
        a = b"\0" * order + t + b"\xff"
        for i in range(order, len(a)):
            for d in range(order + 1):
                seen[a[i - d:i]][a[i]] += 1
    out = []
    for t in texts:
        a, score = b"\0" * order + t + b"\xff", 0.0
        for i in range(order, len(a)):
            gone, chance = set(), 1.0
            for d in range(order, -1, -1):
                c = {x: n for x, n in seen.get(a[i - d:i], {}).items() if x not in gone}
                if a[i] in c:
                    chance *= (2 * c[a[i]] - 1) / (2 * sum(c.values()))
                    break
                if c:
                    chance *= len(c) / (2 * sum(c.values()))
                gone |= set(c)
            else:
                chance /= 256 - len(gone)
            score += math.log10(chance)
        out.append(score)
    return out


def rare(i):
    """A text of contexts met once or twice."""
    return f"Head {zlib.crc32(b'%d' % i):x} body {zlib.crc32(b'%d' % (i // 2)) ** 3} Ünd {'x' * (i % 7)}"


def test_ppm_keeps_every_context(spark):
    from salescope.llm import ppm_model
    texts = [None, "", "a", *(rare(i) for i in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    low = [(t or "").encode().lower() for t in texts]
    train = [t for i, t in enumerate(low) if zlib.crc32(str(i).encode()) % 7 != 2]
    assert 0 < len(train) < len(low)
    want = plain_ppm(train, low)
    got = {r["doc_id"]: r["score"] for r in ppm_model.score_documents(docs).collect()}
    assert [got[i] for i in range(len(low))] == pytest.approx(want, rel=1e-6)
    # Without training rows the model is uniform.
    held = docs.where(ppm_model.held_out(docs["doc_id"]))
    assert {r["doc_id"]: r["score"] for r in ppm_model.score_documents(held).collect()} == \
        pytest.approx({i: -(len(low[i]) + 1) * math.log10(256) for i in got
                       if zlib.crc32(str(i).encode()) % 7 == 2})


def test_ppm_groups_share_one_model(spark):
    """Scores do not depend on how the scan groups texts."""
    from salescope.llm import ppm_model
    docs = spark.createDataFrame([(i, rare(i)) for i in range(40)], "doc_id long, text string")
    one = {r["doc_id"]: r["score"] for r in ppm_model.score_documents(docs.coalesce(1)).collect()}
    many = {r["doc_id"]: r["score"] for r in ppm_model.score_documents(docs.repartition(7)).collect()}
    assert one == pytest.approx(many, rel=1e-6)
