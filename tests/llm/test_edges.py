"""Repeated ids, nulls, clashing columns, very long texts and overlapping repeats, each against a plain version."""

import hashlib
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["score", "predicted", "n_lines", "n_removed", "fp", "k1", "k2", "th", "row", "group", "g_id"]


def docs_of(spark, rows):
    """Documents with further columns named like those that operators use inside."""
    wide = [(i, t, None, None, None if t is None else len(t), *range(100, 100 + len(CLASHES))) for i, t in rows]
    return spark.createDataFrame(wide, DOCS + "".join(f", {c} long" for c in CLASHES))


# ---------------------------------------------------------------- line de-duplication


def _kept_lines(rows, window, long_chars=300, long_words=50):
    """Brute force: every run of ``window`` lines, and every long line, against all that come before."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], i))
    first, gone = {}, {i: set() for i in order}
    for i in order:
        lines = (rows[i][1] or "").split("\n")
        spans = [(s, window) for s in range(len(lines) - window + 1)]
        spans += [(s, 1) for s, x in enumerate(lines) if len(x) >= long_chars or len([w for w in x.split(" ") if w]) >= long_words]
        for s, m in spans:
            key = (m, *lines[s : s + m])
            d, at = first.setdefault(key, (i, s))
            if d != i or s >= at + m:
                gone[i] |= set(range(s, s + m))
    return {i: None if rows[i][1] is None else "\n".join(x for k, x in enumerate(rows[i][1].split("\n")) if k not in gone[i]) for i in order}


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_winnowed_runs_match_brute_force(spark, window):
    from registra.llm.lines import drop_repeated_lines

    rng = random.Random(window)
    rows = []
    for i in range(60):  # few different lines, so that runs overlap and repeat in all ways
        bag = ["", "a", "b", "c", "dd", "e e"] if i % 2 else [f"l{rng.randrange(40)}" for _ in range(12)] + ["w " * 60]
        rows.append((i, "\n".join(rng.choice(bag) for _ in range(rng.randrange(0, 25)))))
    rows += [(100, None), (101, ""), (102, "x\n" * 400), (103, "\n".join(map(str, range(3000)))), (104, "z\n" + "\n".join(map(str, range(1, 3001))))]
    got = {r.doc_id: r.text for r in drop_repeated_lines(docs_of(spark, rows), window=window).collect()}
    want = _kept_lines(rows, window)
    assert got == {rows[i][0]: t for i, t in want.items()}


def test_selected_lines_are_window_minima(spark):
    from registra.llm.lines import winnow

    texts = [(1, "\n".join(f"line {i % 7}" for i in range(40)))]
    rows = winnow(docs_of(spark, texts).select("doc_id", "text"), window=4, long_lines=False).collect()
    windows = sorted(w.s for r in rows for w in r.wins)
    assert windows == list(range(37)) and len(rows) < 37  # each window once, fewer lines than windows
    for r in rows:
        for w in r.wins:
            part = r.around[w.s - r.lo : w.s - r.lo + 4]
            assert min(part) == r.fp and w.s <= r.p < w.s + 4 and not any(x == r.fp for x in part[r.p - w.s + 1 :])


@pytest.mark.parametrize("window", [2, 4, 9])
def test_fingerprints_prune_before_windows_are_listed(spark, window):
    from registra.llm.lines import recurring, winnow

    rng = random.Random(3)
    fresh = [(i, "\n".join(f"{i} {k} {rng.random()}" for k in range(300))) for i in range(20)]
    docs = docs_of(spark, fresh).select("doc_id", "text")
    lines = 20 * 300
    assert winnow(docs, window, False).count() < 1.15 * lines * 2 / (window + 1)  # window minima are few
    assert recurring(docs, window, False).count() == 0  # and nothing of a text without repeats is looked up
    passage = "\n".join(f"shared {k}" for k in range(40))
    some = docs_of(spark, fresh + [(50 + i, f"{i} own\n{passage}\n{i} end") for i in range(30)]).select("doc_id", "text")
    kept = recurring(some, window, False).collect()
    assert kept and all(r.doc_id >= 50 for r in kept) and len(kept) < winnow(some, window, False).count() / 2
    count = Counter((r.a, r.b) for r in kept)
    assert min(count.values()) > 1


@pytest.mark.parametrize("window", [2, 3])
def test_what_follows_a_long_line_goes_only_as_a_run(spark, window):
    from registra.llm.lines import drop_repeated_lines

    long = "w " * 60
    rows = [(1, f"{long}\nshort\n{long}\nshort\n{long}"), (2, f"p\n{long}\nshort\nq"), (3, f"short\n{long}\n\n{long}")]
    got = {r.doc_id: r.text for r in drop_repeated_lines(docs_of(spark, rows), window=window).collect()}
    assert got == {rows[i][0]: t for i, t in _kept_lines(rows, window).items()}


# ---------------------------------------------------------------- near duplicates: one of each group


def test_one_of_each_group_keeps_other_texts_of_an_id(spark):
    from registra.llm.simhash import one_of_each_group

    rows = [(1, "aa bb cc dd"), (5, "qq ww ee rr tt"), (5, "aa bb cc dd"), (None, "aa bb cc dd"), (None, "only here it is"), (7, None), (8, ""), (9, "twice the same row"), (9, "twice the same row")]
    docs = docs_of(spark, rows)
    got = one_of_each_group(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, "aa bb cc dd"), (5, "qq ww ee rr tt"), (None, "only here it is"), (7, None), (9, "twice the same row")], key=str)
    assert one_of_each_group(docs.limit(0)).count() == 0


def test_fingerprint_of_a_very_long_text():
    import xxhash

    from registra.llm.simhash import CHUNK, fingerprint

    words = [f"w{i * i % 977}" for i in range(CHUNK + 500)]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert fingerprint(" ".join(words)) == want


# ---------------------------------------------------------------- quality classifier


def test_random_indexing_matches_a_plain_dictionary():
    from registra.llm import quality as Q

    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "Hand", "of", "x1", "in--g", "zug", "ÉÉ"]) for _ in range(rng.randrange(0, 30))) for _ in range(40)]
    words = Q.Words()
    words.learn(texts)
    seen = Counter(w for t in texts for w in t.split())
    drawn = lambda w, seed: Q.index_vectors(Q._hash([w], seed))[0]
    index = {w: drawn(Q.shape(w), 1) + n / (n + Q.PRIOR) * drawn(w, 0) for w, n in seen.items()}
    own, form, kinds = {}, {}, Counter()
    for t in texts:
        ws = t.split()
        for i, w in enumerate(ws):
            kinds[Q.shape(w)] += 1
            for j in range(max(0, i - Q.REACH), min(len(ws), i + Q.REACH + 1)):
                if j != i:
                    own[w] = own.get(w, 0) + index[ws[j]]
                    form[Q.shape(w)] = form.get(Q.shape(w), 0) + index[ws[j]]
    for w in [*seen, "unseen", "Zzz"]:
        want = own.get(w, 0) + Q.PRIOR * form[Q.shape(w)] / kinds[Q.shape(w)]
        assert np.allclose(words.vectors_of([w])[0], want / np.linalg.norm(want), atol=1e-4)
    assert not words.vectors_of(["9-9"])[0].any()  # a new word of a new shape


def test_contexts_do_not_end_at_a_slice(monkeypatch):
    from registra.llm import quality as Q

    text = " ".join(random.Random(5).choice(["the", "Hand", "of", "x1"]) for _ in range(50))
    whole, cut = Q.Words(), Q.Words()
    whole.learn([text])
    monkeypatch.setattr(Q, "SLICE", 7)
    cut.learn([text])
    assert np.allclose(whole.of_word, cut.of_word, atol=1e-5) and np.allclose(whole.of_form, cut.of_form, atol=1e-5)


def test_network_and_temperature_match_plain_loops(monkeypatch):
    """The same fit in plain Python: forward and backward sums by loops, Adam by its formulas, the temperature by trying all."""
    from registra.llm import quality as Q

    monkeypatch.setattr(Q, "HIDDEN", 3)
    monkeypatch.setattr(Q, "EPOCHS", 4)
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(70, 4)), (rng.random(70) < 0.6).astype(float), rng.random(70) + 0.5
    net = Q.Network(x, y, w)
    rng = np.random.default_rng(Q.SEED)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    rows = ((x - mean) / scale).tolist()
    w1, w2 = rng.normal(0, 1 / 2, (4, 3)).tolist(), rng.normal(0, 1 / math.sqrt(3), (3, 1))[:, 0].tolist()
    p = [v for r in w1 for v in r] + [0.0] * 3 + w2 + [0.0]  # 12 weights, 3 biases, 3 weights, 1 bias
    m, v, step = [0.0] * 19, [0.0] * 19, 0

    def forward(r):
        h = [max(0.0, sum(r[i] * p[3 * i + j] for i in range(4)) + p[12 + j]) for j in range(3)]
        return h, sum(h[j] * p[15 + j] for j in range(3)) + p[18]

    for _ in range(4):
        order = rng.permutation(70)
        for at in range(0, 70, 64):
            batch, g = order[at : at + 64], [0.0] * 19
            for b in batch:
                h, z = forward(rows[b])
                d = (1 / (1 + math.exp(-z)) - y[b]) * w[b] / len(batch)
                g[18] += d
                for j in range(3):
                    g[15 + j] += h[j] * d
                    if h[j] > 0:
                        g[12 + j] += d * p[15 + j]
                        for i in range(4):
                            g[3 * i + j] += rows[b][i] * d * p[15 + j]
            step += 1
            for k in range(19):
                full = g[k] + (1e-4 * p[k] if k < 12 or 15 <= k < 18 else 0)
                m[k], v[k] = 0.9 * m[k] + 0.1 * full, 0.999 * v[k] + 0.001 * full * full
                p[k] -= 0.003 * (m[k] / (1 - 0.9**step)) / (math.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    logits = [forward(r)[1] for r in rows]
    assert np.allclose(net.logit(x), logits, atol=1e-9)

    def loss(t):
        s = [min(max(1 / (1 + math.exp(-z / t)), 1e-9), 1 - 1e-9) for z in logits]
        return -sum(c * (math.log(q) if k else math.log(1 - q)) for c, q, k in zip(w, s, y))

    net.calibrate(x, y, w)
    tried = [0.3 * (10 / 0.3) ** (k / 59) for k in range(60)]
    assert abs(net.temperature - min(tried, key=loss)) < 1e-9
    assert np.allclose(net.score(x), [1 / (1 + math.exp(-z / net.temperature)) for z in logits])


def test_pooling_does_not_depend_on_neighbours():
    from registra.llm import quality as Q

    words = Q.Words()
    words.learn(["a b c d e f g"] * 9)
    long = " ".join(f"a{i % 500}" for i in range(2 * Q.SLICE + 77))
    assert len(long) > 2 * Q.SLICE  # split off in parts
    texts = ["a b c", None, "", long, "zz", " \n "]
    together = words.pool(texts)
    for i, t in enumerate(texts):
        assert np.allclose(together[i], words.pool([t])[0], atol=1e-6)
    v = words.vectors_of(long.split()[:1000] + [])  # plain mean over the whole long text
    whole = words.vectors_of(long.split())
    assert np.allclose(together[3][: Q.DIMS], whole.mean(axis=0), atol=1e-3) and len(v) == 1000
    assert not together[1].any() and not together[2].any()
    assert words.pool(["a a b b b a"])[0][2 * Q.DIMS] == 3 / 6


@needs_tables
def test_quality_on_held_out_rows_only(spark):
    from registra.llm.quality import op8_quality_classifier

    got = op8_quality_classifier(spark, SF).toPandas()
    held = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(got[got.held_out], on="doc_id")
    assert len(held) and (held.predicted == held.quality).mean() > 0.85
    assert ((got.score >= 0.7).astype(int) == got.predicted).all() and got.score.between(0, 1).all()


# ---------------------------------------------------------------- language


def test_only_letters_make_a_language(spark):
    from registra.llm.langid import identify, normalize, train

    assert [normalize(t) for t in ("½ ² ①", "Ⅷ", "3 4", None, "", "a½", "É 1 b")] == ["", "", "", "", "", "a½", "é b"]
    taught = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("the hand of the king", "en"), ("la main du roi", "fr")] * 20)], "doc_id long, text string, lang string")
    models = train(taught)
    edge = identify(docs_of(spark, [(1, "½ ² ①"), (2, "the king"), (3, "la main " * 200_000), (4, None)]), models).collect()
    assert {r.doc_id: r.lang_pred for r in edge} == {1: "und", 2: "en", 3: "fr", 4: "und"}


def test_entropy_of_a_long_text_is_that_of_its_characters():
    from registra.llm import langid as L

    taught = ["the hand of the king and the queen", "there is a hand in the land"]
    models = L.Models(["a"], [L.KneserNey(taught)])
    models.lay(taught)
    text = "the king in the land " * (L.SLICE // 20)
    short = "the king in the land " * 50
    assert len(text) > L.SLICE
    assert math.isclose(models.cross_entropy([text])[0][0], models.cross_entropy([short])[0][0], rel_tol=0.02)
    assert np.allclose(models.cross_entropy(["x", text, short])[1:], [models.cross_entropy([text])[0], models.cross_entropy([short])[0]])


# ---------------------------------------------------------------- repeated byte strings in very long texts


def test_repeats_across_slices(spark):
    from registra.llm.suffixes import SLICE, remove_repeats

    rng = np.random.default_rng(1)
    long = "".join(map(chr, rng.integers(97, 123, SLICE + 5000)))
    shared = long[SLICE - 40 : SLICE + 40]
    got = {r.doc_id: r for r in remove_repeats(docs_of(spark, [(1, long), (2, "before " + shared + " after"), (None, shared), (3, None)])).collect()}
    assert got[1].n_removed == 80 and got[1].n_spans == 1 and got[2].n_removed == 80 and got[2].n_bytes == 93 and got[None].n_removed == 0
    assert got[1].kept_sha256 == hashlib.sha256((long[: SLICE - 40] + long[SLICE + 40 :]).encode()).hexdigest()
    assert got[3].kept_sha256 == hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- pipeline


@needs_tables
def test_stages_on_odd_rows(spark):
    import corpus_pipeline
    from registra.llm.common import settle, table

    bench = table(spark, SF, "benchmark").first().text
    good = [r.text for r in table(spark, SF, "documents").join(table(spark, SF, "labels"), "doc_id").filter("quality = 1").orderBy("doc_id").limit(4).collect()]
    rows = [(1, good[0]), (1, good[0]), (2, good[0]), (3, None), (4, ""), (None, good[1]), (5, good[2] + "\n" + bench), (6, "x" * 50_000), (1, good[3])]
    docs = settle(docs_of(spark, rows))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).collect()
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert all(r.score == 100 and r.k1 == 105 for r in out), name  # the documents' own columns, not the operator's
        ids = sorted((r.doc_id for r in out), key=str)
        if name == "line dedup":
            assert len(out) == len(rows) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)
        elif name == "SimHash near-dedup":
            assert ids == sorted([1, 1, 3, None, 5, 6], key=str)  # nulls and empty texts are one group, copies go
        elif name == "benchmark decontamination":
            assert ids == sorted([1, 1, 2, 3, 4, None, 6, 1], key=str)
        else:
            assert {1, 2} <= set(ids)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == len(rows) and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


@needs_tables
def test_pipeline_follows_its_stages(spark):
    """run() against the stages put together by hand from plain versions where there is one."""
    import corpus_pipeline
    from registra.llm import quality
    from registra.llm.common import table

    docs = table(spark, SF, "documents")
    scored = quality.score(docs.select("doc_id", "text"), quality.trained_on(spark, SF)).filter("predicted = 1")
    rows = sorted((r.doc_id, r.text) for r in scored.collect())
    rows = sorted((rows[i][0], t) for i, t in _kept_lines(rows, 2).items())
    from registra.llm.simhash import fingerprint

    prints = [fingerprint(t) for _, t in rows]
    low = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = low[i], low[j]
                low = [min(a, b) if x in (a, b) else x for x in low]
    rows = [r for i, r in enumerate(rows) if low[i] == i]
    from tests.llm.test_operators import _similar_windows

    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    dirty = {d for d, _, _ in _similar_windows([t for _, t in rows], items)}
    want = {i: hashlib.sha256(t.encode()).hexdigest() for k, (i, t) in enumerate(rows) if k not in dirty}
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


# ---------------------------------------------------------------- nearest neighbours


def test_neighbours_with_repeats_lengths_and_clashes(spark):
    from registra.llm.neighbours import cosine, nearest

    rng = np.random.default_rng(7)
    m = rng.normal(size=(300, 8))
    m[100:160] = m[50]  # many equal vectors: ties go to smaller ids
    rows = [(i if i < 290 else 0, [float(x) for x in v], 7) for i, v in enumerate(m)] + [(1000 + i, [float(i + 1), 1.0], 7) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf long").withColumn("id", F.lit(50)).withColumn("query_id", F.lit(1))
    got = nearest(df, F.col("id") % 50 == 0, recall=1.0).toPandas()
    assert set(got.query_id) == {0, 50, 100, 150, 200, 250, 1000}
    ids = np.array([r[0] for r in rows[:300]])
    for q in (50, 100, 150, 200, 250):
        s = cosine(m[q], m)
        best = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:5]
        mine = got[got.query_id == q].sort_values("rank")
        if q in (50, 100, 150):
            assert list(mine.vec_id) == [int(ids[j]) for j in best]  # ties included
        assert np.allclose(mine.score, s[best])
    assert sorted(got[got.query_id == 1000].vec_id) == [1001, 1002, 1003]  # another length: searched among its own
    zero = got[got.query_id == 0].groupby("rank").size()
    assert (zero >= 1).all() and 0 not in set(got[got.query_id == 0].vec_id)  # rows that share an id are one another's self


@needs_tables
def test_recall_on_queries_that_were_not_asked(spark):
    import pandas as pd

    from registra.llm.neighbours import brute_force, nearest, unit_vectors

    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = nearest(vectors, F.col("id") % 2 == 0).toPandas()  # 250 queries, of which 200 calibrate
    asked = unit_vectors(vectors, "vec_id", "embedding").filter("id % 2 = 0").toPandas()
    truth = brute_force(unit_vectors(vectors, "vec_id", "embedding"), pd.DataFrame({"query_id": asked.id, "q": asked.v}), 5)
    hit = len(got.merge(truth, on=["query_id", "vec_id"]))
    assert hit / len(truth) >= 0.9


# ---------------------------------------------------------------- why decontamination does not rest on SimHash


def test_simhash_loses_pairs_at_the_threshold():
    """Windows that share eight ninths of their shingles (similarity 0.8) differ in more than 17 of 64 bits now and then: those links would be lost."""
    rng = np.random.default_rng(8)
    lost = pairs = 0
    for m in (9, 18, 36, 54):
        bits = rng.integers(0, 2, (3000, m + m // 9, 64), dtype=np.int8)
        one, other = bits[:, :m].sum(axis=1), bits[:, m // 9 :].sum(axis=1)
        far = ((2 * one > m) != (2 * other > m)).sum(axis=1)
        lost, pairs = lost + int((far > 17).sum()), pairs + len(far)
    assert 0 < lost / pairs < 0.02


# ---------------------------------------------------------------- WARC


@pytest.mark.parametrize("how", ["gzip", "none"])
def test_large_records_are_stepped_over(spark, tmp_path, how):
    from registra.llm.warc import plan_records, read_warc, write_warc

    pages = [(i, f"u{i}", chr(97 + i) * (3 << 20) if i % 2 == 0 else f"small {i}", 7) for i in range(6)]
    path = str(tmp_path / how)
    write_warc(plan_records(spark.createDataFrame(pages, "page_id long, url string, html string, n int").coalesce(1)), path, compression=how)
    assert sorted(r.page_id for r in read_warc(spark, path, where="target_uri IN ('u1', 'u5')").collect()) == ["1", "5"]
    assert sorted(r.page_id for r in read_warc(spark, path).collect()) == [str(i) for i in range(6)]
    back = {r.page_id: len(r.payload) for r in read_warc(spark, path, payload=True).collect()}
    assert back == {str(i): len(h) for i, _, h, _ in pages}
