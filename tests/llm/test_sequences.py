"""Conversation repair, byte-level BPE and spelling variants against plain versions."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")

# ---------------------------------------------------------------- conversation repair

NAMES = {"u": "user:", "a": "assistant:"}
AFTER = {"": "u", "s": "u", "u": "a", "a": "u"}
FITS = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text, how == 0)] * (2 if how == 3 else 1)
    return out


def _cheapest(rows):
    """Forward over whole prefixes: for each last initial the cheapest way, its audit and its lines."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:40], (xxhash.xxh64_intdigest(r[2], 42) ^ 1 << 63)))
    seen, faults = set(), ""
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults += "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "-"
        seen.add((role, text))

    def with_insertions(ways):
        for _ in range(3):
            for at, (cost, audit, lines) in list(ways.items()):
                to = AFTER[at]
                way = (cost + 5, audit + "I", (*lines, NAMES[to]))
                ways[to] = min(ways.get(to, way), way, key=lambda w: w[:2])
        return ways

    ways = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults):
        found = defaultdict(list)
        for at, (cost, audit, lines) in with_insertions(ways).items():
            found[at].append((cost + 2, audit + "D", lines))
            if fault in "t-":
                cost += 5 * (fault == "t")
                if (at, role[:1]) in FITS:
                    found[role[0]].append((cost, audit + "K", (*lines, f"{role}:{text}")))
                found[AFTER[at]].append((cost + 1, audit + "R", (*lines, NAMES[AFTER[at]] + text)))
        ways = {at: min(w, key=lambda w: w[:2]) for at, w in found.items()}
    ways = with_insertions(ways)
    cost, audit, lines = min((ways[k] for k in ("", "a") if k in ways), key=lambda w: w[:2])
    turns = {t for t, _, _ in rows} - {None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def _expected(rows):
    by = defaultdict(list)
    for conv, turn, role, text, gone in _damage(rows):
        by[conv] += [] if gone else [(turn, role, text)]
    return {conv: _cheapest(own) for conv, own in by.items()}


def _repaired(spark, rows, **how):
    from registra.llm.conversations import damaged, repair_conversations

    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, code int, cid string")
    got = repair_conversations(damaged(df.repartition(3)), **how).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r[c] for c in FIELDS) for r in got}


def _conversation(rng, conv, n):
    rows = []
    for turn in range(n):
        role = rng.choice(["user", "assistant", "system", "", "other"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
        text = rng.choice(["ok.", "", "  \n", "hello there", "why?", "yes!", "x" * rng.randrange(1, 50) + "."]) if rng.random() < 0.5 else f"row {turn}."
        null = lambda x: None if rng.random() < 0.03 else x
        rows.append((conv, null(turn), null(role), null(text)))
    return rows


@pytest.mark.parametrize("how", [{}, {"ranges": 40, "chunk": 3}], ids=["whole", "chunks"])
def test_short_conversations_are_repaired_at_least_cost(spark, how):
    rng = random.Random(4)
    rows = [r for conv in range(150) for r in _conversation(rng, conv or None, rng.randrange(1, 12))]
    rows += rows[:40]  # repeated rows, and rows of one turn
    assert _repaired(spark, rows, **how) == _expected(rows)


def test_large_conversations_are_cut_into_chunks(spark):
    rng = random.Random(5)
    rows = [r for conv in range(12) for r in _conversation(rng, conv, 4)] + _conversation(rng, 100, 1500)
    rows += [(101, i, "user", "same.") for i in range(600)] + [(102, 7, "assistant", "twin.")] * 300 + [(103, i, "user", f"q{i}?") for i in range(150)]
    rows += [(104, 0, "user", "long " * 2000 + "."), (104, 1, "assistant", "a" * 5000)]
    expected = _expected(rows)
    assert _repaired(spark, rows, ranges=7, chunk=50) == expected
    assert _repaired(spark, rows, ranges=2, held=3000) == expected


def test_odd_conversations(spark):
    lost = [(c, 0, "user", "all gone.") for c in range(300) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert lost and set(_repaired(spark, lost).values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    rows = [(1, 1, "other", "a."), (1, 1, "", "b."), (2, 5, "system", "s."), (None, None, None, None), (3, None, "user", "x?"), (3, None, "user", "x?")]
    assert _repaired(spark, rows) == _expected(rows)
    assert _repaired(spark, []) == {}


def test_a_rerun_stops_where_vectors_differ_by_a_constant():
    from registra.llm.conversations import END, Grammar

    rng, grammar = random.Random(6), Grammar()
    for _ in range(200):
        codes = [rng.choice([0, 1, 2, 3, 5, 6, 9]) for _ in range(rng.randrange(40))]
        old = grammar.back(codes, END)
        other = grammar.back([rng.choice([1, 2]) for _ in range(3)], END)[0]
        assert grammar.again(codes, END, old, other) == grammar.back(codes, other)
    normal, steps = [1, 2] * 500, []
    plain = Grammar.step

    class Counting(Grammar):
        def step(self, code, after):
            steps.append(code)
            return plain(self, code, after)

    Counting().again(normal, END, grammar.back(normal, END), (2, 0, 0, 0))
    assert len(steps) < 20  # of 2000


@needs_tables
def test_conversation_query(spark):
    import duckdb

    from registra.llm.conversations import OP11_SQL, op11_conversation_repair

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in FIELDS) for r in op11_conversation_repair(spark, SF).collect()}
    assert got == _expected(rows)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert {r[0]: r[1:] for r in duck.execute(OP11_SQL).fetchall()} == got


# ---------------------------------------------------------------- byte-level BPE


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    from registra.llm.bytepairs import PATTERN, load_ranks

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(), special_tokens={})


TEXTS = [None, "", " ", "\n\n \t", "a", "漢字 😀 ñandú", "it's we've I'll 'tis", "x" * 3000, "<|endoftext|> plain", "\x1c\x85  z", "a b  c   d\n\n e 123 45,6!?", "same", "same"]


def test_ids_are_those_of_the_library(spark, library):
    from registra.llm.bytepairs import decode, digests, encode

    rng = random.Random(7)
    texts = TEXTS + ["".join(rng.choice(bag) for _ in range(rng.randrange(300))) for bag in ("a", "ab", "abc ", " ae'st", "the quick\n\t é漢", "aA1! \n") for _ in range(15)]
    docs = spark.createDataFrame([(i, t, 5, "n") for i, t in enumerate(texts)], "doc_id long, text string, ids int, raw string")
    coded = encode(docs)
    assert coded.columns == ["doc_id", "text", "raw", "ids"]
    got = {r.doc_id: r for r in decode(coded).collect()}
    sums = {r.doc_id: r for r in digests(docs).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i].ids == ids and bytes(got[i].raw) == (t or "").encode()
        assert sums[i].n_tokens == len(ids) and sums[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert sums[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert encode(docs.limit(0)).count() == 0 and digests(docs.limit(0)).count() == 0


def test_tree_and_slices(library, monkeypatch):
    from registra.llm import bytepairs as B

    rng = random.Random(8)
    texts = B.Texts(B.load_ranks())
    assert texts.encoder.whole
    for raw in (b"a" * 5001, bytes(rng.choice(b"abcdefgh") for _ in range(4000)), "漢é".encode() * 700, b"=" * 999 + b"-" * 998):
        whole = texts.encoder.merge(raw)
        assert texts.encoder.tree(raw) == whole and texts.encoder.decode(whole) == raw
        for cut in (1, 7, len(raw) // 3):
            assert texts.encoder.join(texts.encoder.merge(raw[:cut]), texts.encoder.merge(raw[cut:])) == whole
    assert texts.encoder.join([], [5]) == [5] and texts.encoder.join([5], []) == [5]
    monkeypatch.setattr(B, "SLICE", 10)
    text = "".join(rng.choice("ab \n.,'s1") for _ in range(5000)) + "y" * 300
    assert texts.ids(text).tolist() == library.encode_ordinary(text)
    assert texts.digests(text)[0] == len(library.encode_ordinary(text))


def test_tokens_that_do_not_encode_to_themselves_are_merged_whole():
    from registra.llm.bytepairs import Encoder

    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"ab": 257, b"abc": 258, b"abcd": 259}
    e = Encoder(ranks)
    assert not Encoder(ranks | {b"xyz": 300}).whole  # no merge leads to it
    assert e.encode(b"xabcx") == e.merge(b"xabcx") and e.encode(b"abcd") == [259]


@needs_tables
def test_byte_pair_query(spark, library):
    from registra.llm.bytepairs import op12_byte_level_bpe

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = op12_byte_level_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# ---------------------------------------------------------------- spelling variants


def _grouped(counts, ratio=2):
    """All pairs by their common one-letter deletions; then forms and roots."""
    near, gaps = defaultdict(set), defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            less = w[:k] + w[k + 1 :]
            gaps[k, less].add(w)
            if less in counts:
                near[w].add(less)
                near[less].add(w)
    for same in gaps.values():
        for w in same:
            near[w] |= same - {w}
    out = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda o: (-counts[o], o), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (form, n, len(near[w]), None if form is None else counts[form])

    def root(w):
        return w if out[w][0] is None else root(out[w][0])

    return {w: (form, root(w), n, k, m) for w, (form, n, k, m) in out.items()}


def _rows(df):
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def test_spellings_match_all_pairs(spark):
    from registra.llm.spellings import group_spellings

    rng = random.Random(9)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randrange(0, 8))): rng.choice([1, 1, 2, 3, 5, 8, 16, 40]) for _ in range(1500)}
    words |= {"a" * k: 3**k for k in range(12)} | {"long" * 40: 1, "long" * 40 + "x": 2, "漢字": 4, "漢": 8, "😀字": 1}
    rows = [(w, n, "x", 0) for w, n in words.items()] + [(None, 4, "x", 0), ("void", None, "x", 0)]
    rows += [("aaa", 1, "y", 1), ("aaa", 2, "y", 1)]  # repeated words add up
    words["aaa"] += 3
    df = spark.createDataFrame(rows, "word string, n long, form string, key long")
    assert _rows(group_spellings(df)) == _grouped(words)
    assert _rows(group_spellings(df, ratio=5)) == _grouped(words, 5)
    assert group_spellings(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        group_spellings(df, ratio=1)


def test_near_words_share_a_signature_and_few_others_do(spark):
    from registra.llm.spellings import PARTS, signatures

    rng = random.Random(10)
    words = list({"".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(5, 12))) for _ in range(400)})
    rows = signatures(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()
    by = defaultdict(set)
    for r in rows:
        by[r.key].add(r.word)
    assert len(rows) <= len(words) * 4 * PARTS * (PARTS - 1) // 2
    met = sum(len(g) * (len(g) - 1) // 2 for g in by.values())
    assert met < len(words) ** 2 / 50


def test_words_are_counted_over_whole_texts(spark):
    from registra.llm.spellings import corpus_words

    texts = [None, "", "été ÉTÉ étés Große×Straße abc", "hello " * 50 + "Hello-HELLO_hello9", "word " * 9, "word " * 9, "ſtrange ſtrange"]
    ids = [0, 1, 2, None, 4, 4, 5]
    docs = spark.createDataFrame([(i, t, 7) for i, t in zip(ids, texts)], "doc_id long, text string, n long")
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for i, t in zip(ids, texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(up)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 7 == 0 else run] += 1
    got = {r.word: r.n for r in corpus_words(docs, least_length=3, least_n=1, slip=7).collect()}
    assert got == {w: n for w, n in counts.items() if len(w) >= 3}


@needs_tables
def test_spelling_query_and_sql(spark):
    import duckdb

    from registra.llm.spellings import OP13_SQL, op13_spelling_variants

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cursor = duck.execute(OP13_SQL)
    names = [d[0] for d in cursor.description]
    want = {tuple(dict(zip(names, r))[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in cursor.fetchall()}
    got = _rows(op13_spelling_variants(spark, SF))
    assert {(w, *v) for w, v in got.items()} == want
