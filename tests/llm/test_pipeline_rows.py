"""The rows that run() returns, held against a plain version of every stage."""

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

RNG = random.Random(23)
WORDS = ["the", "of", "alpha", "beta", "gamma", "delta", "and"]
KEY = "".join(RNG.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))


def prose(n):
    return [RNG.choice(WORDS) + str(RNG.randint(0, 40)) for _ in range(n)]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_rows_of_run(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline

    rows, toxic = [], set()
    for k in range(300):
        w = prose(30)
        if k % 5 == 0:
            w.insert(RNG.randrange(30), "rotter")
            toxic.add(k)
        rows.append((k, " ".join(w)))
    base, passage = prose(127), prose(30)
    near = ["x0" if i in (20, 60, 62) else w for i, w in enumerate(base)]
    far = ["x0" if i % 10 == 0 else w for i, w in enumerate(base)]
    rows += [(300, " ".join(base)), (301, " ".join(near)), (302, " ".join(far)), (303, " ".join(prose(15) + passage + prose(10))), (304, " ".join(prose(25)) + f" KEY={KEY} " + " ".join(prose(5))), (305, rows[1][1]), (306, " ".join(prose(900) + passage + prose(900)))]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    left = [(k, t) for k, t in rows if k not in toxic]
    sets, label = {k: shingles(t) for k, t in left}, {k: k for k, _ in left}
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in pairs:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    left = [(k, t) for k, t in left if label[k] == k]
    wins = {tuple(passage[i : i + 13]) for i in range(18)}

    def hit(words):
        return {i + j for i in range(len(words) - 12) if tuple(words[i : i + 13]) in wins for j in range(13)}

    left = [(k, t) for k, t in left if not hit(t.split())]
    assert {k for k, _ in rows} - {k for k, _ in left} == toxic | {301, 303, 305, 306}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {k: sp.encode(t.replace(KEY, "[SECRET]")) for k, t in left}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == len(want) and {r.doc_id: list(r.ids) for r in out} == want
    assert all(r.n_pieces == len(want[r.doc_id]) and r.round_trip for r in out)
