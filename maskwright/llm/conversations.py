"""Repair of conversation structure, by dynamic programming over grammar-compressed sequences.

Every row of a conversation is a symbol, its role's initial and its first fault.  The cheapest edits
that leave the roles ``(s?(ua)+)?`` are a shortest path through four states, and a run of rows is a
4 x 4 matrix over (cost, audit): entries are added along a path, and the smaller cost, then the
ASCII-least audit, is taken.  The product is associative, so runs are evaluated apart and composed:

1. Rows are dealt in order by range, so a conversation with a third of all rows lies in many tasks.
   They are written with their place, and cut into chunks of at most CHUNK rows.
2. Re-Pair: over the chunks' distinct strings the most frequent pairs of symbols become new ones, round
   by round.  Pairs replaced in one round share no symbol, so their order doesn't matter.  One matrix a rule, with
   ropes for audits, is evaluated bottom-up from the two it is made of and serves all conversations.
3. A chunk's matrix is the product along its short compressed string.  Chunks are composed by a tree,
   2^FAN_OUT_BITS neighbours at a time.
4. The audit goes back to the rows, which are read in order, one conversation after the other.

Two audits between the same states never have one as the beginning of the other: they hold as many
K, R and D as there are rows, and what follows the last of them is inserts that cost more.  That is why the
least of the parts gives the least of the whole.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import written

CHUNK_BITS = 10
CHUNK = 1 << CHUNK_BITS  # rows of a chunk at most
FAN_OUT_BITS = 6
ROUNDS = 6  # of Re-Pair
PAIRS = 64  # replaced in a round at most
LEAST = 4  # occurrences of a pair that is replaced

# fixed values: costs of the edits
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
ROLES = {"u": "user", "a": "assistant"}
#: Marks of a row: initial s, u, a or other (x), then no fault, truncated, duplicate, blank.
MARKS = "suax" "SUAX" "1234" "5678"
#: Of those, rows that have to go count alike.
SYMBOLS = "suax" "SUAX" "-"
_REDUCED = str.maketrans(MARKS, "suax" "SUAX" "--------")
_INITIALS = str.maketrans(MARKS, "suax" * 4)
_FIRST_RULE = 0x4E00  # the characters of rules: one plane of letters that are no marks

# --- ropes and matrices ---------------------------------------------------------------------------

Rope = str | tuple


def _leaves(rope: Rope) -> Iterator[str]:
    stack = [rope]
    while stack:
        r = stack.pop()
        if isinstance(r, str):
            yield r
        else:
            stack += (r[1], r[0])


def flat(rope: Rope) -> str:
    return "".join(_leaves(rope))


def _joined(a: Rope, b: Rope) -> Rope:
    return b if a == "" else a if b == "" else (a, b)


def _before(a: Rope, b: Rope) -> bool:
    """Whether audit a is ASCII-less than b; read only up to the first difference."""
    if a is b:
        return False
    letters = lambda rope: (c for leaf in _leaves(rope) for c in leaf)
    for x, y in zip_longest(letters(a), letters(b), fillvalue=""):
        if x != y:
            return x < y
    return False


#: (from, to) -> (cost, audit); states: 0 nothing yet, 1 after s, 2 after u, 3 after a.
Matrix = dict[tuple[int, int], tuple[int, Rope]]
STATES, START, ENDS = range(4), 0, (0, 3)
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def _offer(m: Matrix, at: tuple[int, int], cost: int, audit: Rope) -> None:
    if at not in m or cost < m[at][0] or cost == m[at][0] and _before(audit, m[at][1]):
        m[at] = cost, audit


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = {}
    for (i, k), (cost, audit) in a.items():
        for j in STATES:
            if (k, j) in b:
                more, rest = b[k, j]
                _offer(out, (i, j), cost + more, _joined(audit, rest))
    return out


def _inserts() -> Matrix:
    """Any number of inserted rows."""
    one: Matrix = {}
    for (i, role), j in AFTER.items():
        if role in ROLES:
            _offer(one, (i, j), INSERT, "I")
    every: Matrix = {(i, i): (0, "") for i in STATES}
    for _ in STATES:
        for at, (cost, audit) in product(every, one).items():
            _offer(every, at, cost, audit)
    return every


INSERTS = _inserts()


@cache
def row_matrix(symbol: str) -> Matrix:
    """Inserts, then one row that is kept, given another role or deleted."""
    edits: Matrix = {}
    for i in STATES:
        _offer(edits, (i, i), DELETE, "D")
    if symbol != "-":
        more = TRUNCATED if symbol.isupper() else 0
        for (i, role), j in AFTER.items():
            if role == symbol.lower():
                _offer(edits, (i, j), more, "K")
            elif role in ROLES:
                _offer(edits, (i, j), REROLE + more, "R")
    return product(INSERTS, edits)


IDENTITY: Matrix = {(i, i): (0, "") for i in STATES}


# --- grammar --------------------------------------------------------------------------------------


class Grammar:
    """Rules new symbol -> pair, in the order of their replacement."""

    def __init__(self, pairs: tuple[str, ...] = ()):
        self.pairs = pairs
        self.symbols = [chr(_FIRST_RULE + k) for k in range(len(pairs))]
        self.matrices = {s: row_matrix(s) for s in SYMBOLS}
        for symbol, (left, right) in zip(self.symbols, pairs):
            self.matrices[symbol] = product(self.matrices[left], self.matrices[right])

    def compressed(self, text: str) -> str:
        for symbol, pair in zip(self.symbols, self.pairs):
            if len(text) < 2:
                break
            text = text.replace(pair, symbol)
        return text

    def matrix(self, text: str) -> Matrix:
        """Of a whole string of SYMBOLS."""
        out = IDENTITY
        for symbol in self.compressed(text):
            out = product(out, self.matrices[symbol])
        return out


def pair_counts(text: str) -> Counter:
    """Pairs of neighbours that can be replaced at once: a run of n equal symbols holds n // 2."""
    found, last, open_pair = Counter(), "", False
    for pair in map("".join, zip(text, text[1:])):
        open_pair = not open_pair if pair == last and pair[0] == pair[1] else True
        found[pair] += open_pair
        last = pair
    return found


def learn(strings: DataFrame, rounds: int = ROUNDS) -> tuple[str, ...]:
    """Pairs of a grammar of the distinct ``strings`` (s); at most PAIRS a round reach the driver."""
    pairs: tuple[str, ...] = ()
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], so_far: tuple[str, ...] = pairs) -> Iterator[pa.RecordBatch]:
            grammar, found = Grammar(so_far), Counter()
            for b in batches:
                for text in b.column(0).to_pylist():
                    found.update(pair_counts(grammar.compressed(text)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["pair", "n"]
            )

        counted = strings.select("s").mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        best = counted.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "pair").limit(PAIRS).collect()
        taken, new = set(), []
        for r in best:
            if not taken & set(r.pair):
                new.append(r.pair)
                taken |= set(r.pair)
        if not new:
            break
        pairs += tuple(new)
    return pairs


@lru_cache(1)
def _grammar(pairs: tuple[str, ...]) -> Grammar:
    return Grammar(pairs)


# --- rows -----------------------------------------------------------------------------------------


def in_order(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, pos) written; pos grows with conv_id and turn, nulls first.

    Rows of one turn are ordered by role and text; equal rows stay beside each other.
    """
    keys = ["conv_id", "turn", "role", "text", "_tie"]
    # equal rows are told apart, so that a range can end between them
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(dealt.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("pos")), "turns")


def _mark(role: Column, text: Column, repeated: Column) -> Column:
    end = F.substring(F.rtrim(text, F.lit(BLANKS)), -1, 1)
    fault = F.when(end == "", 12).when(repeated, 8).when(~end.isin(".", "!", "?"), 4).otherwise(0)
    initial = F.when(role == "", 0).otherwise(F.instr(F.lit("sua"), F.substring(role, 1, 1)))
    return F.substring(F.lit(MARKS), fault + F.when(initial == 0, 4).otherwise(initial), F.lit(1))


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, mark): every row's initial and first fault.

    Earlier rows of the same role and text are found by the least place of a 128-bit hash, which is
    summed up before it is shuffled; rows are then looked up by place, which no two rows share.
    """
    first = (
        rows.groupBy("conv_id", F.xxhash64("role", "text").alias("h"), F.xxhash64("text", F.lit(1), "role").alias("g"))
        .agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    )
    return rows.join(first, "pos", "left").select(
        "conv_id", "pos", _mark(F.col("role"), F.col("text"), F.col("first").isNull()).alias("mark")
    )


# --- segments -------------------------------------------------------------------------------------

SEGMENT = (
    "at long, first string, last string, n_rows long, blank long, duplicate long, truncated long, illegal long, "
    "ways array<struct<i int, j int, cost long, audit string>>"
)
_NAMES = [c.split()[0] for c in SEGMENT.split(", ")[:9]]
LEGAL = ("su", "ua", "au")


def _segment(at: int, marks: str, grammar: Grammar) -> tuple:
    initials = marks.translate(_INITIALS)
    illegal = sum(pair not in LEGAL for pair in map("".join, zip(initials, initials[1:])))
    count = lambda letters: sum(map(marks.count, letters))
    ways = [(i, j, c, flat(a)) for (i, j), (c, a) in grammar.matrix(marks.translate(_REDUCED)).items()]
    return (at, initials[0], initials[-1], len(marks), count("5678"), count("1234"), count("SUAX"), illegal, ways)


def _composed(at: int, segments: list[dict]) -> tuple:
    """One segment of several, which are given in order."""
    whole, illegal = IDENTITY, 0
    for k, s in enumerate(segments):
        whole = product(whole, {(w["i"], w["j"]): (w["cost"], w["audit"]) for w in s["ways"]})
        illegal += s["illegal"] + (k > 0 and segments[k - 1]["last"] + s["first"] not in LEGAL)
    sums = [sum(s[c] for s in segments) for c in ("n_rows", "blank", "duplicate", "truncated")]
    ways = [(i, j, c, flat(a)) for (i, j), (c, a) in whole.items()]
    return (at, segments[0]["first"], segments[-1]["last"], *sums, illegal, ways)


def _with_segments(df: DataFrame, segment, column: str) -> DataFrame:
    """(conv_id, at, ...): ``segment(at, value)`` of every row (conv_id, at, ``column``)."""
    kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5]
    ways = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                found = [segment(at, v) for at, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                columns = list(zip(*found))
                made = [dict(zip("ij", w[:2])) | {"cost": w[2], "audit": w[3]} for row in columns[8] for w in row]
                edges = [0]
                for row in columns[8]:
                    edges.append(edges[-1] + len(row))
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(made, ways.value_type))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds)), lists], ["conv_id", *_NAMES]
                )

    return df.select("conv_id", "at", column).mapInArrow(run, "conv_id long, " + SEGMENT)


def segments(marks: DataFrame, bits: int) -> DataFrame:
    """One segment a conversation, of (conv_id, pos, mark); places within a range take ``bits`` bits."""
    place = F.shiftright("pos", 33) * (1 << bits) + F.col("pos").bitwiseAND((1 << 33) - 1)
    chunks = written(
        marks.groupBy("conv_id", F.floor(place / CHUNK).cast("long").alias("at"))
        # at most CHUNK rows: a chunk is a range of places
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mark"))), lambda x: x["mark"]), "").alias("s")),
        "chunks",
    )
    reduced = F.translate("s", MARKS, "suax" "SUAX" "--------")
    pairs = learn(chunks.select(reduced.alias("s")).distinct())
    out = written(_with_segments(chunks, lambda at, s: _segment(at, s, _grammar(pairs)), "s"), "segments")
    while out.groupBy("conv_id").count().where("count > 1").limit(1).count():
        up = F.shiftright("at", FAN_OUT_BITS)
        # at most 2^FAN_OUT_BITS segments: neighbours by place
        near = out.groupBy("conv_id", up.alias("up")).agg(F.array_sort(F.collect_list(F.struct(*_NAMES))).alias("near"))
        out = written(_with_segments(near.withColumnRenamed("up", "at"), _composed, "near"), "segments")
    return out


# --- results --------------------------------------------------------------------------------------


def _cheapest(segment: DataFrame) -> DataFrame:
    """(conv_id, ..., cost, audit): the best way from the start to an end, inserts at the end included."""
    kinds = {"conv_id": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for ways in b.column("ways").to_pylist():
                ended = product({(w["i"], w["j"]): (w["cost"], w["audit"]) for w in ways if w["i"] == START}, INSERTS)
                cost, audit = min((ended[START, e][0], flat(ended[START, e][1])) for e in ENDS if (START, e) in ended)
                found.append((cost, audit))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in kinds), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())],
                [*kinds, "cost", "audit"],
            )

    schema = ", ".join(f"{c} long" for c in [*kinds, "cost"]) + ", audit string"
    return segment.select(*kinds, "ways").mapInArrow(run, schema)


def _gaps(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps): turns that are missing between the least and the greatest."""
    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1))
    return turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")
    )


class Repair:
    """Faults, cheapest edits and repaired rows of conversations (conv_id, turn, role, text).

    Rows of a conversation are taken by turn, nulls first, then by role and text.  Null roles and
    texts count as one space, so a null text is blank.  Rows without a conv_id are one
    conversation.  Equal rows are rows of their own: all but the first are duplicates.  An empty
    table gives empty results.  Other columns are not read.
    """

    def __init__(self, conversations: DataFrame):
        rows = conversations.select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        )
        self.rows = in_order(rows)
        most = self.rows.agg(F.max(F.col("pos").bitwiseAND((1 << 33) - 1))).first()[0] or 0
        found = _cheapest(segments(marked(self.rows), max(CHUNK_BITS, most.bit_length())))
        self.found = written(found, "repairs")

    def report(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation."""
        gaps = _gaps(self.rows).withColumnRenamed("conv_id", "_conv")
        joined = self.found.join(gaps, F.col("conv_id").eqNullSafe(F.col("_conv")))
        return joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def repaired(self) -> DataFrame:
        """(conv_id, place, edit, turn, role, text) of the rows after repair.

        A conversation's rows are in one partition, one after the other, places from 0; edit is K, R
        or I.  A conversation without rows left has one row with a null place, so it can be counted.
        Rows are streamed: a task holds a batch and one audit, however long a conversation is.
        """
        rows = self.rows.unionByName(
            self.found.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                              F.col("audit").alias("text"), F.lit(-1).cast("long").alias("pos"))
        )
        return rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_edited, REPAIRED)


REPAIRED = "conv_id long, place long, edit string, turn long, role string, text string"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, audit, at, state, place = None, "", 0, START, 0
    out: list[tuple] = []
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = [c.split()[0] for c in REPAIRED.split(", ")]

    def emit(edit: str, turn: int | None, role: str | None, text: str) -> None:
        nonlocal state, place
        if role is None:
            role = "a" if state == 2 else "u"
            initial, role = role, ROLES[role]
        else:
            initial = role[0]
        out.append((conv, place, edit, turn, role, text))
        state, place = AFTER[state, initial], place + 1

    def inserts() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            emit("I", None, None, "")
            at += 1

    def close() -> None:
        inserts()
        if not place:
            out.append((conv, None, None, None, None, None))

    def packed() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(names)
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        out.clear()
        return batch

    begun = False
    for whole in batches:
        for start in range(0, whole.num_rows, 1024):
            b = whole.slice(start, 1024)
            for c, turn, role, text, pos in zip(*(b.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "pos"))):
                if pos < 0:
                    if begun:
                        close()
                    begun, conv, audit, at, state, place = True, c, text, 0, START, 0
                    continue
                inserts()
                edit, at = audit[at], at + 1
                if edit == "K":
                    emit("K", turn, role, text)
                elif edit == "R":
                    emit("R", turn, None, text)
            yield packed()
    if begun:
        close()
        yield packed()


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of every conversation's ``role:text``, joined by line feeds.

    Takes ``repaired()`` as it comes, without a shuffle.  A digest depends on all rows before, so a conversation
    is one stream through one task; it holds a batch of rows and the state of the digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for b in batches:
            done: list[tuple] = []
            for c, place, role, text in zip(*(x.to_pylist() for x in b.columns)):
                if not place:  # the first row of a conversation, or the only one of an empty one
                    if digest:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                if place is not None:
                    digest.update(f"{role}:{text}".encode())
            yield _digests(done)
        yield _digests([(conv, digest.hexdigest())] if digest else [])

    def _digests(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())],
            ["conv_id", "repaired_sha256"],
        )

    return repaired.select("conv_id", "place", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults of known kinds, chosen by CRC-32 of ``conv_id:turn``; for rehearsals.

    Nulls count as one space.  Of twenty rows one is dropped, emptied, loses its ends of sentences, is repeated,
    or becomes the user's.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    kind = F.pmod(F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    copies = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"),
    ).drop("copy")
