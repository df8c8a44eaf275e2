"""Repair of conversation structure: the cheapest edits that make roles follow one another, by rank-convergence parallel Viterbi.

Rows are sorted by range partitions of (conversation, turn). A conversation that lies inside one partition and is not long is repaired where
it lies, in one pass. Rows of all others (the first and the last one of a partition, and long ones) form chunks of at most ``CHUNK``
rows, whatever their conversation's size:

* Each chunk computes, from its last row to its first, what it costs to go on from each state of the grammar. It starts from a
  speculative vector, that of a conversation's end.
* Fix-up passes compare the vector that a chunk started from with the one that the next chunk arrived at, both less their least cost. Where they
  differ, the chunk is run again, beside its old run, until the two vectors differ by a constant only: from there on they would
  stay so. The passes end when every chunk started from what its neighbour has.
* The constants add up to the conversation's cost. The backward costs show at each row which edits lie on a cheapest path, and the
  least letter among those gives the least audit. A chunk is traced from each state that it may be entered in; its
  neighbours' exits then tell which one holds.

Rows that must be deleted change no difference between states; chunks of nothing else are left out of the passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import partitions, settle, shared_folder, table

CHUNK = 16_384  #: rows of a chunk at most
HELD = 1_000_000  #: characters of a conversation that is repaired where it lies
RANGE_CHARS = 40  #: characters of a text that take part in the order of rows of one turn

# states: nothing yet, after system, after user, after assistant
KEEP = {0: (1, None, None, None), 1: (2, 2, None, 2), 2: (None, None, 3, None), 3: (None,) * 4}  #: by role initial s, u, a, other
NEXT = (2, 2, 3, 2)  #: where an inserted or reroled row leads
ROLE = {2: "user", 3: "assistant"}
LEGAL = {(0, 1), (1, 2), (2, 1)}
DELETE, REROLE, INSERT, CUT = 2, 1, 5, 5
END = (0, 10, 5, 0)  #: what it costs to end in each state
CLOSING = ("", "II", "I", "")
KIND, TRUNCATED, FORCED = 3, 4, 8  #: bits of a row's code

Vector = tuple[int, int, int, int]


class Grammar:
    """Costs of rows, and edits on cheapest paths, each found once and remembered: there are few different vectors."""

    def __init__(self) -> None:
        self.steps: dict[tuple[int, Vector], tuple[Vector, int]] = {}
        self.edits: dict[tuple[int, Vector, int], tuple[str, int]] = {}

    def step(self, code: int, after: Vector) -> tuple[Vector, int]:
        """Costs before a row from those after it, less their least, and that least."""
        if code & FORCED:
            return after, DELETE
        found = self.steps.get((code, after))
        if found is None:
            cut = CUT if code & TRUNCATED else 0
            costs = [min(DELETE + after[s], REROLE + cut + after[NEXT[s]], *([cut + after[to]] if (to := KEEP[code & KIND][s]) is not None else [])) for s in range(4)]
            for _ in range(2):
                costs = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
            least = min(costs)
            found = self.steps[code, after] = (tuple(c - least for c in costs), least)
        return found

    def back(self, codes: Iterable[int], end: Vector) -> tuple[Vector, int]:
        """Costs before the first row, less their least, and that least."""
        total = 0
        for code in reversed(codes):
            end, least = self.step(code, end)
            total += least
        return end, total

    def again(self, codes: Iterable[int], old_end: Vector, old: tuple[Vector, int], end: Vector) -> tuple[Vector, int]:
        """``back`` from another end, only as far as the vectors differ by more than a constant from those of the old run."""
        was = now = 0
        for code in reversed(codes):
            old_end, x = self.step(code, old_end)
            end, y = self.step(code, end)
            was, now = was + x, now + y
            if end == old_end:
                return old[0], old[1] + now - was
        return end, now

    def edit(self, code: int, after: Vector, state: int) -> tuple[str, int]:
        """The least letters of a cheapest way over one row, insertions before it included, and the state behind it."""
        if code & FORCED:
            return "D", state
        found = self.edits.get((code, after, state))
        if found is None:
            before, least = self.step(code, after)
            out, s, cut = "", state, CUT if code & TRUNCATED else 0
            while True:
                cost, to = before[s] + least, KEEP[code & KIND][s]
                if DELETE + after[s] == cost:
                    out, to = out + "D", s
                elif INSERT + before[NEXT[s]] == before[s]:
                    out, s = out + "I", NEXT[s]
                    continue
                elif to is not None and cut + after[to] == cost:
                    out += "K"
                else:
                    out, to = out + "R", NEXT[s]
                break
            found = self.edits[code, after, state] = (out, to)
        return found

    def trace(self, codes: list[int], end: Vector, entries: Iterable[int]) -> list[tuple[list[str], int]]:
        """For each state of entry: the state before and the edits of each row, as in "2IK", and the state behind the last row."""
        behind = []
        for code in reversed(codes):
            behind.append(end)
            end = self.step(code, end)[0]
        behind.reverse()
        out = []
        for s in entries:
            edits = []
            for code, after in zip(codes, behind):
                before = s
                letters, s = self.edit(code, after, s)
                edits.append(f"{before}{letters}")
            out.append((edits, s))
        return out


def lines_of(edits: str, role: str, text: str) -> list[str]:
    """The repaired lines of one row from the state before and its edits."""
    lines, state = [], int(edits[0])
    for e in edits[1:]:
        if e in "IR":
            state = NEXT[state]
            lines.append(f"{ROLE[state]}:{text if e == 'R' else ''}")
        elif e == "K":
            lines.append(f"{role}:{text}")
    return lines


def closing_lines(state: int) -> list[str]:
    return [f"{ROLE[s]}:" for s in ((2, 3) if state == 1 else (3,) if state == 2 else ())]


def _illegal(kinds: list[int]) -> int:
    return sum(pair not in LEGAL for pair in zip(kinds, kinds[1:]))


# ---------------------------------------------------------------- rows


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): nulls as one blank, then damage by crc32("conv_id:turn") modulo 20; dropped rows stay as marks."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), how.alias("how"))
    text = F.when(F.col("how").isin(0, 1), "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("how") == 0).alias("gone"), F.explode(times).alias("copy")).drop("copy")


def _code() -> Column:
    """Role initial, truncated and blank as bits."""
    first = F.left(F.col("role"), F.lit(1))
    kind = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ends = F.right(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), F.lit(1)).isin(".", "!", "?")
    return (kind + F.when(blank, FORCED).when(~ends, TRUNCATED).otherwise(0)).cast("int")


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ROW = "pid int, k long, i int, turn long, role string, text string, code int, gone boolean"


def _repair_one(grammar: Grammar, conv_id: object, rows: list[tuple]) -> dict:
    """The result of one whole conversation: its rows (turn, role, text, code, gone) in order."""
    rows = [r for r in rows if not r[4]]
    seen: set[tuple[str, str]] = set()
    codes, blank, duplicate = [], 0, 0
    for _, role, text, code, _ in rows:
        if code & FORCED:
            blank += 1
        elif (role, text) in seen:
            duplicate += 1
            code = code & KIND | FORCED
        else:
            seen.add((role, text))
        codes.append(code)
    (edits, state), (start, cost) = grammar.trace(codes, END, [0])[0], grammar.back(codes, END)
    lines = [x for e, (_, role, text, _, _) in zip(edits, rows) for x in lines_of(e, role, text)]
    turns = {r[0] for r in rows} - {None}
    return {
        "conv_id": conv_id, "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "blank": blank, "duplicate": duplicate, "truncated": sum(bool(c & TRUNCATED) for c in codes),
        "illegal": _illegal([c & KIND for c in codes]), "cost": cost + start[0], "audit": "".join(e[1:] for e in edits) + CLOSING[state],
        "repaired_sha256": hashlib.sha256("\n".join(lines + closing_lines(state)).encode("utf-8", "surrogatepass")).hexdigest(),
    }


def _dealt(schema: pa.Schema, chunk: int, held: int):
    """Sorted rows of a partition: conversations that are surely whole are repaired, rows of others come back in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, pid = Grammar(), TaskContext.get().partitionId()
        out: list[dict] = []
        now, rows, chars, k, open_ = (), [], 0, 0, True  # ``open_``: the conversation is not known to be whole
        size = 0

        def as_rows() -> None:
            nonlocal rows, chars, k, size
            out.extend({"whole": False, "conv_id": now[0], "pid": pid, "k": k, "i": i, "turn": t, "role": r, "text": x, "code": c, "gone": g} for i, (t, r, x, c, g) in enumerate(rows))
            size += chars
            rows, chars, k = [], 0, k + 1

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "code", "gone")]
            for conv_id, *row in zip(*columns):
                if now != (conv_id,):
                    if rows and not open_:
                        out.append({"whole": True} | _repair_one(grammar, now[0], rows))
                        rows, chars = [], 0
                    elif rows:
                        as_rows()
                    open_, now = not now, (conv_id,)
                rows.append(row)
                chars += len(row[2])
                if len(rows) >= chunk or chars >= held:
                    open_ = True
                    as_rows()
                if len(out) >= 5000 or size > 4 * held:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out.clear()
                    size = 0
        if rows:
            as_rows()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


# ---------------------------------------------------------------- chunks


def _on_chunks(df: DataFrame, make, schema: str) -> DataFrame:
    """``make(grammar, row)`` gives the new columns of each chunk."""

    names = T.StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = Grammar()
        for part in batches:
            made = [(*make(grammar, r), r.pid, r.k) for r in part.itertuples(index=False)]
            yield pd.DataFrame(made, columns=names)

    return df.mapInPandas(run, schema)


def _vectors(chunks: DataFrame) -> DataFrame:
    """(start, delta, used, pid, k) of each chunk, once all passes have run."""
    kept = "start array<int>, delta long, used array<int>, pid int, k long"

    def first(grammar: Grammar, r) -> tuple:
        start, delta = grammar.back(list(r.codes), END)
        return list(start), delta, list(END)

    def rerun(grammar: Grammar, r) -> tuple:
        start, delta = grammar.again(list(r.codes), tuple(r.used), (tuple(r.start), r.delta), tuple(r.need))
        return list(map(int, start)), int(delta), list(r.need)

    chunks = chunks.filter("free")
    now = _on_chunks(chunks.select("codes", "pid", "k"), first, kept)
    beside = Window.partitionBy("cid").orderBy("pid", "k")
    while True:
        now = settle(now)
        asked = chunks.select("cid", "pid", "k").join(now, ["pid", "k"])
        asked = asked.withColumn("need", F.coalesce(F.lead("start").over(beside), F.array(*map(F.lit, END)))).drop("cid")
        todo = asked.filter("need <> used")
        if todo.isEmpty():
            return now
        fixed = _on_chunks(todo.join(chunks.select("codes", "pid", "k"), ["pid", "k"]), rerun, kept)
        now = asked.filter("need = used").select(fixed.columns).union(fixed)


def _entered(exits: pd.DataFrame) -> pd.DataFrame:
    """The state in which each chunk of a conversation is entered and left; a row for each chunk."""
    exits = exits.sort_values(["pid", "k"])
    state, entry, leaves = 0, [], []
    for to in exits["exits"]:
        entry.append(state)
        state = int(to[state])
        leaves.append(state)
    return pd.DataFrame({"pid": exits.pid, "k": exits.k, "entry": entry, "leaves": leaves})


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each conversation's lines, which come sorted; only the digest is held."""
    now, digest = None, None
    for part in batches:
        done = []
        for cid, line in zip(part.cid, part.line):
            if cid != now:
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = cid, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(line.encode("utf-8", "surrogatepass"))
        yield pd.DataFrame(done, columns=["cid", "repaired_sha256"])
    if now is not None:
        yield pd.DataFrame([(now, digest.hexdigest())], columns=["cid", "repaired_sha256"])


def _lines(each: DataFrame) -> DataFrame:
    """(cid, pid, k, i, line) of rows that leave lines behind."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            lines = ["\n".join(lines_of(e, r, x)) for e, r, x in zip(part.edits, part.role, part.text)]
            yield part[["cid", "pid", "k", "i"]].assign(line=lines)

    return each.mapInPandas(run, "cid string, pid int, k long, i int, line string")


def _repair_chunks(rows: DataFrame) -> DataFrame:
    """Results of conversations whose rows (_ROW and cid) lie in chunks; ``pid, k, i`` is their order."""
    place = F.struct("pid", "k", "i")
    kept = rows.filter("NOT gone").withColumns({"a": F.xxhash64("role", "text"), "b": F.xxhash64(F.lit(1), "text", "role")})
    firsts = kept.filter(F.col("code").bitwiseAND(F.lit(FORCED)) == 0).groupBy("cid", "a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    marked = kept.select("cid", "a", "b", "pid", "k", "i", "turn", "code").join(settle(firsts.filter("n > 1").drop("n")), ["cid", "a", "b"], "left")
    again = F.coalesce(F.col("first") != place, F.lit(False)) & (F.col("code").bitwiseAND(F.lit(FORCED)) == 0)
    code = F.when(again, F.col("code").bitwiseAND(F.lit(KIND)).bitwiseOR(F.lit(FORCED))).otherwise(F.col("code"))
    marked = settle(marked.select("cid", "pid", "k", "i", "turn", code.alias("code"), again.alias("again")))

    # at most CHUNK rows a group
    chunks = marked.groupBy("cid", "pid", "k").agg(F.array_sort(F.collect_list(F.struct("i", "code"))).alias("rows"))
    codes, places = F.transform("rows", lambda r: r["code"]), F.transform("rows", lambda r: r["i"])
    chunks = settle(chunks.select("cid", "pid", "k", codes.alias("codes"), places.alias("places"), F.exists(codes, lambda c: c.bitwiseAND(F.lit(FORCED)) == 0).alias("free")))
    vectors = _vectors(chunks)

    def traced(grammar: Grammar, r) -> tuple:
        ways = grammar.trace(list(r.codes), tuple(r.used), range(4))
        return [s for _, s in ways], [e for e, _ in ways]

    ways = _on_chunks(chunks.join(vectors, ["pid", "k"]).select("codes", "used", "pid", "k"), traced, "exits array<int>, ways array<array<string>>, pid int, k long")
    ways = settle(ways)
    entries = chunks.select("cid", "pid", "k").join(ways.select("pid", "k", "exits"), ["pid", "k"])
    entries = settle(entries.groupBy("cid").applyInPandas(lambda x: _entered(x), "pid int, k long, entry int, leaves int"))

    # audits, costs and counts by conversation
    took = chunks.join(entries, ["pid", "k"], "left").join(ways.select("pid", "k", "ways"), ["pid", "k"], "left").join(vectors.select("pid", "k", "start", "delta"), ["pid", "k"], "left")
    edits = F.when(F.col("free"), F.get("ways", F.col("entry"))).otherwise(F.transform("codes", lambda c: F.lit("0D")))
    took = settle(took.select("cid", "pid", "k", "free", "entry", "leaves", "start", "delta", "codes", "places", edits.alias("edits")))
    kinds = F.transform("codes", lambda c: c.bitwiseAND(F.lit(KIND)))
    legal = lambda x, y: F.array_contains(F.array(*[F.lit(4 * p + q) for p, q in sorted(LEGAL)]), 4 * x + y)
    inner = F.size(F.filter(F.arrays_zip(F.slice(kinds, 1, F.size("codes") - 1).alias("x"), F.slice(kinds, 2, F.size("codes")).alias("y")), lambda p: ~legal(p["x"], p["y"])))
    before = F.lag(F.element_at(kinds, -1)).over(Window.partitionBy("cid").orderBy("pid", "k"))
    seen = took.withColumn("illegal", inner + F.when(before.isNotNull() & ~legal(before, F.get(kinds, F.lit(0))), 1).otherwise(0))
    by_place = lambda c: F.when(F.col("free"), F.struct("pid", "k", c))
    audits = seen.groupBy("cid").agg(
        F.sum("illegal").cast("long").alias("illegal"),
        (F.sum(F.coalesce("delta", F.lit(DELETE) * F.size("codes"))) + F.coalesce(F.get(F.min(by_place("start"))["start"], F.lit(0)), F.lit(END[0]))).cast("long").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pid", "k", F.array_join(F.transform("edits", lambda e: F.substring(e, 2, 1 << 20)), "").alias("e")))), lambda x: x["e"]), "").alias("audit"),
        F.coalesce(F.max(by_place("leaves"))["leaves"], F.lit(0)).alias("leaves"),
    )
    audits = audits.withColumn("audit", F.concat("audit", F.get(F.array(*map(F.lit, CLOSING)), F.col("leaves"))))
    bit = lambda b: F.col("code").bitwiseAND(F.lit(b)) != 0
    faults = marked.groupBy("cid").agg(F.count_if(bit(FORCED) & ~F.col("again")).alias("blank"), F.count_if("again").alias("duplicate"), F.count_if(bit(TRUNCATED)).alias("truncated"))
    turns = marked.filter("turn IS NOT NULL").groupBy("cid", "turn").agg(F.lit(1).alias("one")).groupBy("cid").agg((F.max("turn") - F.min("turn") + 1 - F.count("one")).alias("gaps"))

    # the repaired lines, in order, one conversation after the other
    each = took.filter("free").select("pid", "k", F.explode(F.arrays_zip("places", "edits")).alias("z")).select("pid", "k", F.col("z.places").alias("i"), F.col("z.edits").alias("edits"))
    each = each.filter(F.col("edits").rlike("[IKR]")).join(kept.select("cid", "pid", "k", "i", "role", "text"), ["pid", "k", "i"])
    ends = audits.filter(F.col("leaves").isin(1, 2)).select("cid", F.lit(2**31 - 1).alias("pid"), F.lit(0).cast("long").alias("k"), F.lit(0).alias("i"), F.col("leaves").alias("state"))
    end_line = F.when(F.col("state") == 1, "\n".join(closing_lines(1))).otherwise("\n".join(closing_lines(2)))
    lines = _lines(each).union(ends.select("cid", "pid", "k", "i", end_line))
    digests = lines.repartition(partitions(rows.sparkSession), "cid").sortWithinPartitions("cid", "pid", "k", "i").select("cid", "line").mapInPandas(_hashed, "cid string, repaired_sha256 string")

    out = rows.groupBy("cid").agg(F.first("conv_id").alias("conv_id"))
    for part in (faults, turns, audits, digests):
        out = out.join(part, "cid", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repair_conversations(rows: DataFrame, chunk: int = CHUNK, held: int = HELD, ranges: int | None = None) -> DataFrame:
    """(conv_id, turn, role, text, gone) -> one row per conv_id with its faults, cost, audit and digest.

    Rows marked ``gone`` are not there, but their conversation is. Rows stand by turn, nulls first; rows of one turn by role, then by the first
    ``RANGE_CHARS`` characters of the text, so equal rows are neighbours. Each row's first fault counts: blank (nothing but blanks), duplicate
    (role and text seen before), truncated (its last character other than a blank is not one of .!?). Edits cost: K (keep) 0, R (to user or
    assistant) 1, D (delete, required for blank and duplicate rows) 2, I (an empty row of user or assistant, anywhere) 5; a
    truncated row that stays adds 5. The audit has the letters of the cheapest edits after which role initials read (s?(ua)+)?, of several the
    least in ASCII order; a role that does not begin with s, u or a (an empty one too) cannot be kept. Roles and texts must not be null. A null conv_id is a conversation.
    Conversations without rows have zeros, an empty audit and the digest of an empty text; an empty table stays empty.
    """
    n = ranges or partitions(rows.sparkSession)
    rows = rows.select("conv_id", "turn", "role", "text", "gone", _code().alias("code"))
    order = [F.col("conv_id"), F.col("turn"), F.col("role"), F.left("text", F.lit(RANGE_CHARS)), F.xxhash64("text"), F.col("copy")]
    rows = rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("copy")
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = T.StructType.fromDDL(f"whole boolean, conv_id {kind}, {_RESULT}, {_ROW}")
    path = shared_folder(rows.sparkSession)
    rows.mapInArrow(_dealt(to_arrow_schema(schema), chunk, held), schema).write.partitionBy("whole").parquet(path)
    dealt = rows.sparkSession.read.schema(schema).parquet(path)
    whole = dealt.filter("whole").select("conv_id", *T.StructType.fromDDL(_RESULT).fieldNames())
    # null ids join too
    cid = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    return whole.union(_repair_chunks(dealt.filter("NOT whole").select(cid.alias("cid"), "conv_id", *T.StructType.fromDDL(_ROW).fieldNames())))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: its faults after damage, and the cheapest repair."""
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))


#: The same by a forward search: each element of the folded list is a row (x) or the cheapest way into each state so far (w: cost, audit, state, lines).
OP11_SQL = r"""
WITH crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
     b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS x FROM conversations),
     h AS (SELECT b.*, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(x), 2), lambda p: CAST('0x' || substr(x, p, 2) AS BIGINT))),
                                                   lambda a, y: xor(a >> 8, t[1 + xor(a & 255, y)]))) % 20 AS how FROM b, crc),
     d AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
                  CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
           FROM h, unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) q(copy) WHERE how <> 0),
     n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 40), copy) AS i FROM d),
     f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                          WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
                  left(role, 1) AS k, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
     g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND before || k NOT IN ('su', 'ua', 'au')) AS illegal,
                  list({'w': CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, s INT, r VARCHAR)[]), 'role': role, 'text': text, 'fault': fault, 'k': k} ORDER BY i) AS rows
           FROM f GROUP BY conv_id),
     e AS (SELECT *, list_reduce(list_concat([{'w': [{'c': 0::BIGINT, 'a': '', 's': 0, 'r': ''}, {'c': 5::BIGINT, 'a': 'I', 's': 2, 'r': chr(10) || 'user:'}, {'c': 10::BIGINT, 'a': 'II', 's': 3, 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}],
                                               'role': '', 'text': '', 'fault': '', 'k': ''}], rows), lambda z, x: {'w':
             list_transform(list_transform([list_concat(list_filter(list_transform(range(4), lambda q: list_min(list_filter(flatten(list_transform(z.w, lambda o: [
                   {'c': o.c + 2, 'a': o.a || 'D', 's': o.s, 'r': o.r},
                   CASE WHEN x.fault IN ('b', 'd') THEN NULL WHEN x.k = 's' AND o.s = 0 OR x.k = 'u' AND o.s <> 2 OR x.k = 'a' AND o.s = 2
                        THEN {'c': o.c + CASE x.fault WHEN 't' THEN 5 ELSE 0 END, 'a': o.a || 'K', 's': CASE x.k WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'r': o.r || chr(10) || x.role || ':' || x.text} END,
                   CASE WHEN x.fault IN ('b', 'd') THEN NULL
                        ELSE {'c': o.c + CASE x.fault WHEN 't' THEN 6 ELSE 1 END, 'a': o.a || 'R', 's': CASE o.s WHEN 2 THEN 3 ELSE 2 END, 'r': o.r || chr(10) || CASE o.s WHEN 2 THEN 'assistant:' ELSE 'user:' END || x.text} END])),
                 lambda m: m IS NOT NULL AND m.s = q))), lambda m: m IS NOT NULL), [])],
               lambda l: list_concat(l, list_transform(l, lambda o: {'c': o.c + 5, 'a': o.a || 'I', 's': CASE o.s WHEN 2 THEN 3 ELSE 2 END, 'r': o.r || chr(10) || CASE o.s WHEN 2 THEN 'assistant:' ELSE 'user:' END}),
                                        list_transform(l, lambda o: {'c': o.c + 10, 'a': o.a || 'II', 's': CASE o.s WHEN 2 THEN 2 ELSE 3 END,
                                                                     'r': o.r || chr(10) || CASE o.s WHEN 2 THEN 'assistant:' || chr(10) || 'user:' ELSE 'user:' || chr(10) || 'assistant:' END}))),
               lambda l: list_filter(list_transform(range(4), lambda q: list_min(list_filter(l, lambda m: m.s = q))), lambda m: m IS NOT NULL))[1],
             'role': '', 'text': '', 'fault': '', 'k': ''}) AS last FROM g),
     o AS (SELECT *, list_min(list_filter(last.w, lambda m: m.s IN (0, 3))) AS best FROM e)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN o ON c.conv_id IS NOT DISTINCT FROM o.conv_id
"""
