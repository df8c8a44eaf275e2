"""The training-data operators against brute force, exact round trips and held-out labels."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    """Documents; a clashing extra column rides along."""
    rows = [(i if ids is None else ids[i], t, None, None, None, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS + ", score long")


def some_texts(seed, n, words=40):
    rng = random.Random(seed)
    bag = ["the", "hand", "of", "inting", "érable", "zug", "ßtein", "on", "and", "whor", "lyes", "tion"]
    out = [" ".join(rng.choice(bag) + str(rng.randrange(30)) for _ in range(rng.randrange(1, words))) for _ in range(n)]
    return out


EDGES = [None, "", " ", "\n\n\n", "a", "漢字😀", "x" * 5000, "a b c d e f g " * 200, "same text here now", "same text here now"]


# ---------------------------------------------------------------- 9


def test_simhash_matches_brute_force(spark):
    from registra.llm.simhash import covering_masks, fingerprint, near_duplicates

    texts = some_texts(1, 60) + EDGES
    texts += [t + " extra" for t in texts[:30] if t] + texts[:10]
    got = {r.doc_id: r for r in near_duplicates(docs_of(spark, texts)).collect()}
    prints = [fingerprint(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert {i: root(i) for i in range(len(texts))} == {i: r.component_id for i, r in got.items()}
    assert got[60].fingerprint == "0" * 16  # the null text
    masks = [int(m) for m in covering_masks(4)]
    rng = random.Random(2)
    for _ in range(300):  # any four differing bits are kept by none of some mask's bits
        diff = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(m & diff == 0 for m in masks)


def test_large_buckets_lose_no_link():
    from registra.llm import simhash as S

    rng = np.random.default_rng(5)
    base = np.uint64(0x0123456789ABCDEF)
    fp = np.unique(np.array([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 3, replace=False))) for _ in range(3000)], np.uint64))
    mask = np.uint64(0)
    whole = S._stars(fp, *S._links(fp, np.zeros(len(fp), np.int64), np.full(len(fp), mask), 4))
    old, S.DIRECT = S.DIRECT, 10**9
    try:
        direct = S._stars(fp, *S._links(fp, np.zeros(len(fp), np.int64), np.full(len(fp), mask), 4))
    finally:
        S.DIRECT = old
    assert (whole == direct).all()


def test_simhash_of_nothing(spark):
    from registra.llm.simhash import near_duplicates

    assert near_duplicates(docs_of(spark, [])).count() == 0
    assert near_duplicates(docs_of(spark, ["a b", None], [None, None])).count() == 2


# ---------------------------------------------------------------- 2


def test_suffix_arrays_match_brute_force(spark):
    from registra.llm.suffixes import remove_repeats

    rng = random.Random(4)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(45, 160))) for _ in range(6)]
    texts = ["".join(rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice("ijklmnop ") for _ in range(30)) for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    texts += EDGES + ["de " * 60, "de " * 90, "é" * 80, "é" * 70]
    want, first = {}, {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        hit, new = bytearray(len(raw)), set()
        for s in range(len(raw) - 49):
            w = raw[s : s + 50]
            if w in first:
                hit[s : s + 50] = b"\1" * 50
            new.add(w)
        for w in new:
            first.setdefault(w, i)
        kept = bytes(c for c, h in zip(raw, hit) if not h)
        spans = sum(1 for j in range(len(raw)) if hit[j] and (j == 0 or not hit[j - 1]))
        want[i] = (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs_of(spark, texts)).collect()}
    assert got == want
    assert remove_repeats(docs_of(spark, [])).count() == 0


def test_suffix_shards_are_merged():
    from registra.llm import suffixes as S

    rng = random.Random(6)
    pieces = list({"".join(rng.choice("ab") for _ in range(rng.randrange(50, 84))).encode() for _ in range(60)})
    pieces += [p[3:] + b"zz" for p in pieces if len(p) > 60]
    docs = np.arange(len(pieces))[::-1].copy()
    least = {}
    for p, d in zip(pieces, docs):
        for j in range(len(p) - 49):
            least[p[j : j + 50]] = min(least.get(p[j : j + 50], 10**9), d)
    old = S.SHARD
    try:
        for S.SHARD in (200, 10**9):
            found = S.least_documents(pieces, docs)
            assert [[least[p[j : j + 50]] for j in range(len(p) - 49)] for p in pieces] == [f.tolist() for f in found]
    finally:
        S.SHARD = old


# ---------------------------------------------------------------- 3


def test_decontamination(spark):
    from registra.llm.decontam import contamination

    item = " ".join(f"w{i}" for i in range(40))
    near = item.replace("w39", "other")
    far = " ".join(f"w{i}" for i in range(0, 40, 2))
    texts = [f"before {item} after", f"x y z {near} q", far, item.upper() + "!", "short one here", None, "", "two words", item.split("w20")[0]]
    items = spark.createDataFrame([(1, item), (2, "two words"), (3, None), (4, ""), (1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in contamination(docs_of(spark, texts), items).collect()}
    assert {i for i, r in got.items() if r.contaminated} == {0, 1, 3, 7}
    assert got[0].similarity == 1.0 and got[0].start_word == 1 and got[7].item_id == 2
    assert contamination(docs_of(spark, texts), items.limit(0)).filter("contaminated").count() == 0
    assert contamination(docs_of(spark, []), items).count() == 0


def _similar_windows(texts, items):
    def cut(ws, k):
        return Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))

    found = {}
    for d, text in enumerate(texts):
        ws = re.findall(r"[^\W_]+", (text or "").lower())
        for item_id, item in items:
            goal = re.findall(r"[^\W_]+", item.lower())
            k = min(5, len(goal))
            b = cut(goal, k)
            for start in range(max(1, len(ws) - len(goal) + 1)) if ws else ():
                a = cut(ws[start : start + len(goal)], k)
                both = sum((a & b).values())
                if a and both / (a.total() + b.total() - both) >= 0.8:
                    found[d, item_id, start] = round(both / (a.total() + b.total() - both), 9)
    return found


def test_decontamination_matches_brute_force(spark):
    from registra.llm.decontam import contaminated_windows, contamination

    rng = random.Random(3)
    halves = [" ".join(f"{h}{i}" for i in range(50)) for h in "ab"]
    items = [(1, " ".join(halves)), (2, "one"), (3, "one two one two one two one two one two one two"), (4, " ".join(f"v{rng.randrange(9)}" for _ in range(30)))]
    texts = [f"x y z {halves[1]} {halves[0]} q r", f"{halves[1]} {halves[0]}", " ".join(halves[::-1]).replace("a7 ", "other "), "one two " * 12, "two one " * 5 + "x " + "one two " * 9]
    for _ in range(40):
        ws = items[rng.choice([0, 3])][1].split()
        for _ in range(rng.randrange(4)):
            at, to = rng.randrange(len(ws)), rng.randrange(len(ws))
            ws = rng.choice([ws[at:] + ws[:at], ws[:at] + ["new"] + ws[at + 1 :], ws[:at] + ws[at + 1 :], ws[:at] + ws[to:]]) or ws
        texts.append(" ".join([f"p{i}" for i in range(rng.randrange(30))] + ws + ["s"] * rng.randrange(30)))
    want = _similar_windows(texts, items)
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, texts)
    got = {(r.doc_id, r.item_id, r.start): round(r.similarity, 9) for r in contaminated_windows(docs.union(docs), table).collect()}
    assert got == want and {0, 1, 2, 3, 4} <= {d for d, _, _ in want}
    assert {r.doc_id for r in contamination(docs, table).collect() if r.contaminated} == {d for d, _, _ in want}


# ---------------------------------------------------------------- 4


def test_neighbours(spark):
    from registra.llm.neighbours import cosine, nearest

    rng = np.random.default_rng(1)
    m = rng.normal(size=(600, 16))
    m[5] = m[7]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None), (901, [0.0] * 16), (902, [None] + [1.0] * 15), (903, [float("nan")] * 16), (904, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df, F.col("id") % 50 == 0).toPandas()
    hit = 0
    for q in range(0, 600, 50):
        s = cosine(m[q], m)
        s[q] = -9
        best = np.lexsort((np.arange(600), -s))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == [1, 2, 3, 4, 5] and np.allclose(mine.score, s[mine.vec_id])
        hit += len(set(mine.vec_id) & set(best))
    assert hit / 60 >= 0.9
    few = nearest(df.filter("vec_id < 3"), F.col("id") == 0)
    assert few.count() == 2
    assert nearest(df.limit(0), F.col("id") == 0).count() == 0


def test_neighbours_go_on_from_small_leaves(spark):
    from registra.llm.neighbours import nearest

    m = np.random.default_rng(4).normal(size=(600, 16))
    ids = [0 if i % 100 == 0 else i for i in range(600)]  # six rows are one another's self
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, m)], "vec_id long, embedding array<double>")
    got = nearest(df, F.col("id") % 7 == 0, recall=0.01).groupBy("query_id").agg(F.sort_array(F.collect_list("rank")).alias("ranks")).collect()
    assert {r.query_id for r in got} == {i for i in ids if i % 7 == 0} and all(r.ranks == [1, 2, 3, 4, 5] for r in got)


# ---------------------------------------------------------------- 5


def test_warc_round_trip(spark, tmp_path):
    from registra.llm.warc import plan_records, read_warc, write_warc

    tricky = "é\r\n\r\nWARC/1.1\r\n\r\n" * 100
    rows = [(1, None, "x" * 1500), (2, "u\r\nv", "x" * 1500), (2, "w", "x" * 1500), (None, "z", None), (5, "q", ""), (6, "é", tricky), (7, "é", tricky), (8, "s", "y" * 999), (9, "s", "y" * 999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for how in ("gzip", "none"):
        path = str(tmp_path / how)
        write_warc(plan_records(pages), path, compression=how)
        back = read_warc(spark, path, payload=True).collect()
        kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in back)
        assert kinds == Counter([("1", "revisit", "2"), ("2", "response", None), ("2", "response", None), (None, "response", None), ("5", "response", None), ("6", "revisit", "7"), ("7", "response", None), ("8", "response", None), ("9", "response", None)])
        assert all(hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest[5:] for r in back if r.record_type == "response")
        assert bytes(next(r.payload for r in back if r.page_id == "7")) == tricky.encode()
        only = read_warc(spark, path, where="record_type = 'revisit' AND target_uri = 'é'")
        assert [r.page_id for r in only.collect()] == ["6"]
    empty = str(tmp_path / "empty")
    write_warc(plan_records(pages.limit(0)), empty)
    assert read_warc(spark, empty).count() == 0


# ---------------------------------------------------------------- 6


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores_match_brute_force(spark, order):
    import math

    from registra.llm.ngrams import BACKOFF, score, tokens

    texts = some_texts(8, 30, 60) + EDGES
    lists = [tokens(t) for t in texts]

    def cut(ws):  # n-grams of all orders, those that reach before the text with None
        padded = [None] * (order - 1) + ws
        found = Counter(tuple(padded[i - k + order : i + order]) for i in range(len(ws)) for k in range(1, order + 1))
        return found + Counter({(None,) * k: 1 for k in range(1, order)} if ws else {})

    own = [cut(ws) for ws in lists]
    whole, total = sum(own, Counter()), sum(map(len, lists))
    got = {r.doc_id: r for r in score(docs_of(spark, texts), order=order).collect()}
    for i, ws in enumerate(lists):
        others = lambda g: whole[g] - own[i][g]  # noqa: B023, E731
        s, missed, padded = 0.0, 0, [None] * (order - 1) + ws
        for j in range(len(ws)):
            k, weight = order, 1.0
            gram = tuple(padded[j : j + order])
            missed += not others(gram)
            while k > 1 and not others(gram):
                k, weight, gram = k - 1, weight * BACKOFF, gram[1:]
            s += math.log(weight * (others(gram) / others(gram[:-1]) if k > 1 else (others(gram) or BACKOFF) / max(total - len(ws), 1)))
        assert got[i].n_words == len(ws) and got[i].n_backed_off == missed
        assert (got[i].log_score is None) == (not ws) and (not ws or abs(got[i].log_score - s) < 1e-6)
    assert score(docs_of(spark, []), order=order).count() == 0


def test_lm_scores_of_repeats_and_large_ids(spark):
    from registra.llm.ngrams import score

    big = 2**62 + 1
    got = score(docs_of(spark, ["a b c", "a b c", None, "a b"], [big, big, None, 3])).collect()
    twins = [r for r in got if r.doc_id == big]
    assert len(twins) == 2 and twins[0] == twins[1] and twins[0].n_backed_off == 0
    assert [r.log_score for r in got if r.doc_id is None] == [None]


# ---------------------------------------------------------------- 7


def test_line_dedup(spark):
    from registra.llm.lines import drop_repeated_lines

    texts = ["a\nb\nc", "z\nb\nc\nd", "b\nc", "x\nx\nx\nx\nx", "c\nb", None, "", "one", "one"]
    got = {r.doc_id: r for r in drop_repeated_lines(docs_of(spark, texts)).collect()}
    assert [got[i].text for i in range(9)] == ["a\nb\nc", "z\nd", "", "x\nx", "c\nb", None, "", "one", "one"]
    assert [got[i].n_removed for i in range(9)] == [0, 2, 2, 3, 0, 0, 0, 0, 0]
    assert "score" in drop_repeated_lines(docs_of(spark, texts)).columns
    assert drop_repeated_lines(docs_of(spark, [])).count() == 0


def test_single_long_lines_go(spark):
    from registra.llm.lines import drop_repeated_lines

    words, signs, short = " ".join(f"w{i}" for i in range(50)), "漢" * 300, " ".join(f"w{i}" for i in range(49))
    texts = [f"a\n{words}\nb", f"c\n{words}\nd", words, f"{signs}\ne\n{signs}", signs, f"f\n{short}\ng", f"h\n{short}\ni", f"{words}\nd", None]
    got = {r.doc_id: r for r in drop_repeated_lines(docs_of(spark, texts)).collect()}
    assert [got[i].text for i in range(9)] == [texts[0], "c\nd", "", f"{signs}\ne", "", texts[5], texts[6], "", None]
    assert [got[i].n_removed for i in range(9)] == [0, 1, 1, 1, 1, 0, 0, 2, 0]


@needs_tables
@pytest.mark.parametrize("name", ["op7_line_dedup", "op7_long_line_dedup"])
def test_line_dedup_gives_the_rows_of_its_sql(spark, name):
    import duckdb

    from registra.llm.queries import ORACLES, QUERIES

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = QUERIES[name](spark, SF)
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


# ---------------------------------------------------------------- 1, 8


def _kneser_ney(texts, order=4, discount=0.75):
    """Interpolated Kneser-Ney from dictionaries of strings: a function of (context, character)."""
    grams = [(t[i - order + 1 : i + 1]) for t in (" " * (order - 1) + t + " " for t in texts) for i in range(order - 1, len(t))]
    counts = {order: Counter(grams)}
    for n in range(order - 1, 0, -1):  # in how many different characters does what is one longer begin?
        counts[n] = Counter(g[1:] for g in {g[order - n - 1 :] for g in grams})

    def p(context, c):
        if len(context) == 0:
            kinds, total = len(counts[1]), sum(counts[1].values())
            return max(counts[1][c] - discount, 0) / total + discount * kinds / total / (kinds + 1)
        seen = {g: k for g, k in counts[len(context) + 1].items() if g[:-1] == context}
        lower = p(context[1:], c)
        if not seen:
            return lower
        return max(seen.get(context + c, 0) - discount, 0) / sum(seen.values()) + discount * len(seen) / sum(seen.values()) * lower

    return p


def test_kneser_ney_equals_a_plain_version():
    from registra.llm.langid import KneserNey, Models, _codes, _hashes

    rng = random.Random(5)
    texts = {"a": ["the hand of the king", "then there", ""], "b": ["la main du roi", "elle est la"]}
    texts["c"] = ["".join(rng.choice("abcd  ") for _ in range(rng.randrange(1, 60))) for _ in range(12)]
    models = Models(list(texts), [KneserNey(t) for t in texts.values()])
    models.lay([x for t in texts.values() for x in t])
    plain = [_kneser_ney(t) for t in texts.values()]
    signs = sorted({c for t in texts.values() for x in t for c in x + " "})
    contexts = ["the", " la", "   ", "  e", "zzq", "qab"] + ["".join(rng.choice("abcdelh ") for _ in range(3)) for _ in range(40)]
    for context in contexts:
        for c in [*signs, "\u00df"]:
            codes = np.frombuffer((context + c).encode("utf-32-le"), np.uint32).astype(np.uint64)
            grams = {n: _hashes(codes, n) for n in range(5)}
            before = {n: np.concatenate([np.zeros(1, np.uint64), grams[n][:-1]]) for n in range(4)}
            got = np.exp(models._logp(grams, before, np.array([3]))[0])
            assert np.allclose(got, [p(context, c) for p in plain], rtol=1e-9, atol=0), (context, c)
    for p, t in zip(plain, texts.values()):  # with one place for all unseen characters it is a distribution
        assert abs(sum(p("the", c) for c in {*" ".join(t), "\u00df"}) - 1) < 1e-9
    one, many = models.cross_entropy(["the king"]), models.cross_entropy(["du roi", "the king", "x" * 2000])
    assert np.allclose(one[0], many[1])
    text = "then la king"
    want = [-np.mean([np.log(p(("   " + text)[i : i + 3], c)) for i, c in enumerate(text + " ")]) for p in plain]
    assert np.allclose(models.cross_entropy([text])[0], want, rtol=1e-9)


@needs_tables
def test_language_id_on_held_out_documents(spark):
    from registra.llm.langid import identify, op1_language_id, train

    got = op1_language_id(spark, SF).toPandas()
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas().merge(got, on="doc_id")
    held = lang[lang.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (held.lang == held.lang_pred).mean() > 0.95
    edge = identify(docs_of(spark, EDGES), train(spark.read.parquet(f"{SF}/documents.parquet"))).toPandas().sort_values("doc_id")
    assert list(edge.lang_pred[:4]) == ["und"] * 4 and edge.score.between(0, 1).all()
    assert identify(docs_of(spark, EDGES), None).filter("lang_pred <> 'und'").count() == 0


@needs_tables
def test_quality_on_labelled_documents(spark):
    from registra.llm.quality import op8_quality_classifier, score, train

    got = op8_quality_classifier(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(got, on="doc_id")
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert (labels.predicted == labels.quality).mean() > 0.85
    none = train(docs_of(spark, []), spark.createDataFrame([], "doc_id long, quality int"))
    edge = score(docs_of(spark, EDGES), none).toPandas()
    assert edge.score.between(0, 1).all() and len(edge) == len(EDGES)


# ---------------------------------------------------------------- 10


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/piece_bpe_32k.model"), reason="the vocabulary is not here")
def test_pieces(spark):
    import sentencepiece

    from registra.llm import pieces as P

    texts = some_texts(11, 20) + EDGES + ["  two  blanks ", "▁mark", "a\tb\x00", "nächste Straße"]
    df = P.encode(docs_of(spark, texts), digest=True).toPandas().sort_values("doc_id")
    plain = [(t or "").replace(P.BLANK, " ") for t in texts]
    assert [hashlib.sha256(t.encode()).hexdigest() for t in plain] == list(df.decoded_sha256)
    back = P.decode(P.encode(docs_of(spark, texts))).toPandas().sort_values("doc_id")
    assert list(back.text) == plain
    # a plain search for the best score over all segmentations, and the library's pieces and scores
    library = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    score = {library.id_to_piece(i): library.get_score(i) for i in range(library.get_piece_size()) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))}
    unknown = min(score.values()) - P.UNKNOWN_COST
    for i, t in enumerate(texts):
        if not t or len(t) > 200:
            continue
        line = P.BLANK + t.replace(P.BLANK, " ").replace(" ", P.BLANK)
        best = [0.0] + [-1e18] * len(line)
        for end in range(1, len(line) + 1):
            for start in range(max(0, end - 16), end):
                piece = line[start:end]
                value = score.get(piece, unknown if end - start == 1 else -1e18)
                best[end] = max(best[end], best[start] + value)
        pieces, at, total = [library.id_to_piece(int(x)) for x in df.ids.iloc[i]], 0, 0.0
        while at < len(pieces):
            if re.fullmatch("<0x..>", pieces[at]):
                lead = int(pieces[at][3:5], 16)
                at += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                total += unknown
            else:
                total += score[pieces[at]]
                at += 1
        assert total == pytest.approx(best[-1], rel=1e-12), t


# ---------------------------------------------------------------- pipeline


@needs_tables
def test_pipeline_stages(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        from registra.llm.common import settle

        out = settle(stage(spark, docs, SF))
        if name != names[-1]:
            assert out.columns == docs.columns
        seen.append(out.count())
        docs = out
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.5 * seen[0]
    assert docs.select("doc_id").distinct().count() == seen[-1]
