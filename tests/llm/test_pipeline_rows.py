"""One row of every group of near-copies stays, whatever the ids."""

from collections import Counter, defaultdict


def near_groups(rows, n=5, percent=80):
    """Components of row numbers by comparing all pairs."""
    sets = []
    for r in rows:
        w = (r[1] or "").lower().split()
        sets.append({tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    groups = defaultdict(list)
    for i, x in enumerate(label):
        groups[x].append(rows[i])
    return list(groups.values())


def prose(k, changed=""):
    words = [f"{w}{k}" for w in "the small grey house by river stands open and old with".split()]
    return " ".join(words * 2 + [f"w{k}x{j}" for j in range(40)]) + changed


def test_one_row_of_each_group_stays(spark):
    import corpus_pipeline
    rows = [(1, prose("a"), "en")] * 30                         # one repeated row
    rows += [(None, prose("b"), "en"), (None, prose("b", " end"), "en")]
    rows += [(2, prose("c"), "en"), (None, prose("c"), "en"), (None, prose("c", " end"), None)]
    rows += [(5, prose("d"), "en"), (9, prose("d"), "en"),      # both groups need 5 and 9 apart
             (5, prose("e"), "en"), (3, prose("e"), "en"), (9, prose("f"), "en")]
    rows += [(7, prose("g"), "en"), (7, prose("g"), None), (None, None, None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    out = [tuple(r) for r in corpus_pipeline.near_duplicate(spark, docs, "").collect()]
    groups = near_groups(rows)
    assert len(out) == len(groups)
    for g in groups:
        stay = [r for r in out if r in g and r[1]]
        ids = [r[0] for r in g if r[0] is not None]
        if g[0][1]:
            assert len(stay) == 1 and stay[0][0] == min(ids, default=None)
    assert out.count((None, None, None)) == 2                   # linked with nothing
    assert corpus_pipeline.near_duplicate(spark, docs.limit(0), "").count() == 0
    # After the quality rules too no text is left twice.
    kept = corpus_pipeline.near_duplicate(spark, corpus_pipeline.quality(spark, docs, ""), "")
    seen = Counter(r["text"] for r in kept.collect())
    assert all(n == 1 for t, n in seen.items() if t)
