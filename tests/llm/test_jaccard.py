"""Near duplicates at a Jaccard similarity of 0.8, held against brute force over all pairs."""

import random

import numpy as np

from recordloom.llm import jaccard, simhash

RNG = random.Random(5)


def fresh(n):
    return [f"w{RNG.randrange(10**6)}" for _ in range(n)]


def edited(words, at):
    return [f"e{RNG.randrange(10**6)}" if i in at else w for i, w in enumerate(words)]


BASE, OTHER = fresh(127), fresh(100)
GROUP = [edited(OTHER, {RNG.randrange(100)}) for _ in range(60)]
#: Three words of 127 edited: similar at 0.8, yet more than 4 bits of the fingerprint differ.
FAR = next(x for x in (edited(BASE, {20, 60, 62}) for _ in range(1000)) if (simhash.fingerprint(" ".join(x)) ^ simhash.fingerprint(" ".join(BASE))).bit_count() > 4)
TEXTS = [None, "", " \n", " ".join(BASE), " ".join(BASE).upper() + "\n", " ".join(FAR), " ".join(edited(BASE, {10, 40, 70, 100})), "a b c", "A  b c", "a b", *(" ".join(x) for x in GROUP), " ".join(fresh(5000))]


def brute_sets():
    out = []
    for t in TEXTS:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_labels():
    sets = brute_sets()
    label = list(range(len(TEXTS)))
    for _ in label:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_near_groups(spark):
    docs = spark.createDataFrame([(k * 3, t, 0.5) for k, t in enumerate(TEXTS)], "doc_id long, text string, score double").repartition(3)
    label = brute_labels()
    assert label[5] == label[3] != label[6]
    got = {r.doc_id: r.component_id for r in jaccard.near_groups(docs).collect()}
    assert got == {k * 3: label[k] * 3 for k in range(len(TEXTS))}
    kept = jaccard.near_dedup(docs.unionAll(docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({x * 3 for x in label}) and kept.columns == docs.columns
    assert jaccard.near_groups(docs.limit(0)).count() == 0


def test_forest_connects_all_links():
    sets = [jaccard.shingles(" ".join(x)) for x in [*GROUP, BASE, FAR]]
    plain = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in [*GROUP, BASE, FAR]]

    def parts(pairs):
        label = list(range(len(sets)))
        for _ in label:
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    links = jaccard.forest(sets)
    assert parts(links) == parts([(i, j) for i, a in enumerate(plain) for j, b in enumerate(plain) if i != j and 5 * len(a & b) >= 4 * len(a | b)])
    assert len(links) == len(sets) - len(set(parts(links)))


def test_pipeline_stage_drops_texts_similar_at_0_8(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, " ".join(BASE)), (2, " ".join(FAR)), (3, " ".join(OTHER))], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()} == {1, 3}


def grown(rng, n):
    """Sets of shingle hashes a and b of a similarity of 0.8 or just more, a of n members."""
    a = [rng.getrandbits(64) for _ in range(n)]
    b = a[n - n * 8 // 9 :] if n > 8 else a[1:]
    while 5 * len(set(a) & set(b)) > 4 * len(set(a) | set(b)) and n > 8:
        b = [*b, rng.getrandbits(64)]
    while 5 * len(set(a) & set(b)) < 4 * len(set(a) | set(b)):
        b = b[:-1]
    return [np.sort(np.array(x, dtype=np.uint64)) for x in (a, b)]


def test_fingerprints_of_sets_at_0_8_meet_in_a_segment():
    """For several widths of the index, similar sets share a segment and are alike by their signs; unlike ones aren't."""
    rng = random.Random(8)
    for n in (10, 50_000, 10**7):
        bits, segments = jaccard.plan(n)
        width = jaccard.SIGN + bits * segments
        for size in (5, 9, 18, 40, 126, 700):
            for _ in range(10):
                a, b = grown(rng, size)
                assert jaccard.near(len(np.intersect1d(a, b)), len(a), len(b))
                cut = [np.unpackbits(np.frombuffer(jaccard.fingerprint(x, width), np.uint8)) for x in (a, b)]
                cells = [x[jaccard.SIGN : width].reshape(segments, bits) for x in cut]
                assert (cells[0] == cells[1]).all(axis=1).any(), (n, size)
                signs = np.array([np.packbits(x[: jaccard.SIGN]) for x in cut]).view("<u8")
                assert [sorted(g) for g in jaccard.groups(signs, np.array([len(a), len(b)]))] == [[0, 1]], (n, size)
    assert jaccard.fingerprint(a[:3], 512) is None


def test_pipeline_stage_goes_by_fingerprints(spark, monkeypatch):
    """With fingerprints that are all unlike, no texts but copies meet: the links come through them."""
    import corpus_pipeline

    docs = spark.createDataFrame([(1, " ".join(BASE)), (2, " ".join(FAR)), (3, " ".join(BASE))], "doc_id long, text string")
    monkeypatch.setattr(jaccard, "fingerprint", lambda hashes, bits: None, raising=False)
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()} == {1, 2}


def test_large_clusters_go_by_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HELD", 2, raising=False)
    test_near_groups(spark)


def test_packed_rows_go_by_lookups_not_by_partitions(spark, monkeypatch, tmp_path):
    """Many partitions that Spark doesn't merge pack the lookups as tightly as few; every lookup is made and no link is lost."""
    spread, made = jaccard._spread, str(tmp_path / "made")

    def counted(*args):
        def run(batches):
            for batch in spread(*args)(batches):
                with open(made, "a") as out:
                    out.write("".join(f"{len(x)}\n" for x in batch.column(1).to_pylist()))
                yield batch

        return run

    monkeypatch.setattr(jaccard, "_spread", counted)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(old, ("24", "false")):
            spark.conf.set(k, v)
        docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(24)
        got = {r.doc_id: r.component_id for r in jaccard.near_groups(docs).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == dict(enumerate(brute_labels()))
    sizes = [int(x) for x in open(made)]
    sets = {frozenset(x) for x in brute_sets() if x}
    lookups = sum(jaccard.plan(len(TEXTS))[1] for x in sets if len(x) >= jaccard.LEAST)
    assert sum(sizes) == lookups * jaccard._row().itemsize
    assert len(sizes) * jaccard.PACK <= lookups


def test_many_small_slices_give_the_same_components(spark, monkeypatch):
    for name, value in (("SLICE", 8), ("PACK", 1), ("BATCH", 5)):
        monkeypatch.setattr(jaccard, name, value)
    test_near_groups(spark)
