"""Repair of damaged conversations by a forward Viterbi search over the grammar of turns.

Turns must read ``(s?(ua)+)?`` by their roles' initials: nothing yet, after the system
turn, after a user turn, after an assistant turn are the four states.  Each turn is
kept, given the role that the state allows, or deleted; turns may be inserted between.
For each state the search carries the least (cost, audit string) that leads there, and
after each turn the layer is closed under insertions, of which two at most help.

Rows are dealt out by ranges of (conversation, turn) and cut into pieces, so no task
holds a conversation whole that is longer than a piece.  A conversation that lies in
one piece is repaired there.  Of one that goes on over several, each piece gives what
the search does from each of the four states, and one row a piece is folded; only then
do its pieces write their turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyspark
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, stored

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Turns and characters that a piece holds at most, but for one longer turn.
PIECE_TURNS, PIECE_CHARS = 1024, 1 << 20

#: Grammar states: nothing yet, after s, after u, after a; what each allows next, and where a conversation may end.
_NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
_GIVEN = {0: "u", 1: "u", 2: "a", 3: "u"}
_MAY_END = (0, 3)
_ROLE = {"u": "user", "a": "assistant"}

Layer = tuple[tuple[int, str] | None, ...]


def _closed(layer: list[tuple[int, str] | None]) -> Layer:
    """A layer with what insertions reach from it."""
    for _ in range(2):
        for state, best in enumerate(list(layer)):
            if best:
                to, found = _NEXT[state][_GIVEN[state]], (best[0] + INSERT, best[1] + "I")
                if layer[to] is None or found < layer[to]:
                    layer[to] = found
    return tuple(layer)


@lru_cache(maxsize=256)
def _turn(symbol: str) -> tuple[tuple[int, int, int, str], ...]:
    """(from, to, cost, letter) of what may be done with a turn.

    symbol: a role's initial, or ``x`` for others, in upper case if truncated; ``-`` for a turn that must go.
    """
    moves = [(state, state, DELETE, "D") for state in _NEXT]
    if symbol != "-":
        more = TRUNCATED * symbol.isupper()
        for state, allowed in _NEXT.items():
            if symbol.lower() in allowed:
                moves.append((state, allowed[symbol.lower()], more, "K"))
            moves.append((state, allowed[_GIVEN[state]], REROLE + more, "R"))
    return tuple(moves)


@lru_cache(maxsize=20_000)
def search(symbols: str, begin: int | None = None) -> Layer:
    """The least (cost, audit) for each state after these turns; from ``begin``, or from the start with insertions before the first."""
    layer: Layer = tuple((0, "") if state == (begin or 0) else None for state in _NEXT)
    if begin is None:
        layer = _closed(list(layer))
    for symbol in symbols:
        after: list[tuple[int, str] | None] = [None] * len(_NEXT)
        for state, to, cost, letter in _turn(symbol):
            best = layer[state]
            if best:
                found = (best[0] + cost, best[1] + letter)
                if after[to] is None or found < after[to]:
                    after[to] = found
        layer = _closed(after)
    return layer


def _apply(audit: str, state: int, roles: list[str], texts: list[str]) -> tuple[int, list[tuple[str, str]]]:
    """The state after an audit string, and the turns that it leaves."""
    out, i = [], 0
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        given = _GIVEN[state]
        if letter == "I":
            out.append((_ROLE[given], ""))
            state = _NEXT[state][given]
            continue
        role = roles[i] if letter == "K" else _ROLE[given]
        out.append((role, texts[i]))
        state = _NEXT[state][role[0]]
        i += 1
    return state, out


class _Faults:
    """Counts and symbols of turns in order, over pieces that follow one another."""

    def __init__(self) -> None:
        self.low = self.high = self.turn = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last: str | None = None
        self.first: str | None = None
        self.symbols: list[str] = []

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        if self.first is None:
            self.first = initial
        self.last = initial
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
            self.distinct += 1
        said = text.rstrip(BLANKS)
        if not said:
            self.blank += 1
        elif seen:
            self.duplicate += 1
        else:
            cut = said[-1] not in ENDS
            self.truncated += cut
            symbol = initial if initial in ("s", "u", "a") else "x"
            self.symbols.append(symbol.upper() if cut else symbol)
            return
        self.symbols.append("-")

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_PIECE = "_part int, _seq int, _turns array<long>, _roles array<string>, _texts array<string>"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def _table(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.rsplit(" ", 1) for x in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _pieces(batches: Iterator[pa.RecordBatch], most_turns: int, most_chars: int) -> Iterator[pa.RecordBatch]:
    """Rows in order: repaired conversations, and pieces of those that may go on elsewhere (the first and last of the range, and long ones)."""
    part, seq = pyspark.TaskContext.get().partitionId(), 0
    ddl = f"conv_key string, {_REPORT}, roles array<string>, texts array<string>, {_PIECE}"
    key, turns, roles, texts, chars = None, [], [], [], 0
    opened, cut = False, True  # whether a row was read; whether the conversation has a piece, or began before this range

    def piece() -> tuple:
        nonlocal seq, turns, roles, texts, chars
        seq += 1
        row = (key, *[None] * 9, part, seq - 1, turns, roles, texts)
        turns, roles, texts, chars = [], [], [], 0
        return row

    def whole() -> tuple:
        faults, seen = _Faults(), set()
        for turn, role, text in zip(turns, roles, texts, strict=True):
            faults.add(turn, role, text, (role, text) in seen)
            seen.add((role, text))
        layer = search("".join(faults.symbols))
        cost, audit = min(layer[s] for s in _MAY_END if layer[s])
        _, left = _apply(audit, 0, roles, texts)
        return (key, faults.gaps(), faults.blank, faults.duplicate, faults.truncated, faults.illegal, cost, audit, [r for r, _ in left], [t for _, t in left], None, None, None, None, None)

    out: list[tuple] = []
    size = 0
    for batch in batches:
        for k, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_key", "turn", "role", "text")), strict=True):
            if not opened or k != key:
                if opened:
                    out.append(piece() if cut else whole())
                    size += len(out[-1][-1] or out[-1][9] or ())
                    cut, turns, roles, texts, chars = False, [], [], [], 0
                key, opened = k, True
            if role is None:  # dropped: the row only tells that there is such a conversation
                continue
            if len(texts) >= most_turns or texts and chars + len(text) > most_chars:
                out.append(piece())
                cut, size = True, size + len(out[-1][-1])
            turns.append(turn)
            roles.append(role)
            texts.append(text)
            chars += len(text)
            if size > 4096:
                yield _table(ddl, out)
                out, size = [], 0
    if opened:
        out.append(piece())
    yield _table(ddl, out)
    release()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a piece: its counts, and the search from each state."""
    ddl = "conv_key string, _part int, _seq int, low long, high long, n_distinct long, blank long, duplicate long, truncated long, illegal long, first string, last string, n int, costs array<long>, audits array<string>"
    for batch in batches:
        out = []
        for key, part, seq, turns, roles, texts, new in zip(*(batch.column(c).to_pylist() for c in ("conv_key", "_part", "_seq", "_turns", "_roles", "_texts", "_new")), strict=True):
            faults, new = _Faults(), set(new or ())
            for i, (turn, role, text) in enumerate(zip(turns, roles, texts, strict=True)):
                faults.add(turn, role, text, i not in new)
            layers = [search("".join(faults.symbols), s) for s in _NEXT]
            costs, audits = [x and x[0] for layer in layers for x in layer], [x and x[1] for layer in layers for x in layer]
            out.append((key, part, seq, faults.low, faults.high, faults.distinct, faults.blank, faults.duplicate, faults.truncated, faults.illegal, faults.first, faults.last, len(turns), costs, audits))
        yield _table(ddl, out)


class _Fold:
    """The search over a conversation's pieces.

    Strings that reach the states share their beginnings; what they share is set
    aside, so that a step handles what differs only.
    """

    def __init__(self) -> None:
        self.shared: list[str] = []
        self.layer: Layer = search("")
        self.sums, self.last = [0] * 5, None
        self.low = self.high = None
        self.sizes: list[tuple[int, int, int]] = []

    def add(self, row: dict) -> None:
        merged = row["n_distinct"] - (row["low"] is not None and row["low"] == self.high)
        joint = self.last is not None and row["first"] is not None and self.last + row["first"] not in ("su", "ua", "au")
        self.sums = [a + b for a, b in zip(self.sums, (merged, row["blank"], row["duplicate"], row["truncated"], row["illegal"] + joint), strict=True)]
        if row["low"] is not None:
            self.low = row["low"] if self.low is None else self.low
            self.high = row["high"]
        self.last = row["last"] if row["last"] is not None else self.last
        self.sizes.append((row["_part"], row["_seq"], row["n"]))
        if not row["n"]:
            return
        after: list[tuple[int, str] | None] = [None] * len(_NEXT)
        for state, best in enumerate(self.layer):
            for to in range(len(_NEXT)):
                cost = row["costs"][state * len(_NEXT) + to]
                if best and cost is not None:
                    found = (best[0] + cost, best[1] + row["audits"][state * len(_NEXT) + to])
                    if after[to] is None or found < after[to]:
                        after[to] = found
        strings = [x[1] for x in after if x]
        low, high = min(strings), max(strings)
        n = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
        self.shared.append(low[:n])
        self.layer = tuple(x and (x[0], x[1][n:]) for x in after)

    def ends(self) -> list[tuple]:
        """A row for each piece: its place, the state before it and its audit; the last has the report too."""
        cost, tail = min(self.layer[s] for s in _MAY_END if self.layer[s])
        audit = "".join([*self.shared, tail])
        left = len(audit) - audit.count("D")  # turns in the end; an odd number begins with s
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.sums[0]
        out, at, done = [], 0, 0
        for k, (part, seq, n) in enumerate(self.sizes):
            begin, last = at, k == len(self.sizes) - 1
            while at < len(audit) and (n or last or audit[at] == "I"):
                n -= audit[at] != "I"
                at += 1
            state = 0 if not done else 1 if left % 2 and done == 1 else 3 if (done - left) % 2 == 0 else 2
            out.append((part, seq, k, int(last), state, audit[begin:at], *((gaps, *self.sums[1:], cost, audit) if last else [None] * 7)))
            done += at - begin - audit.count("D", begin, at)
        return out


_ENDS = f"e_part int, e_seq int, segment int, last int, state int, piece_audit string, {_REPORT}"
_REPAIRED = f"conv_key string, segment int, last int, {_REPORT}, roles array<string>, texts array<string>"


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fold, key = None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if fold is None or row["conv_key"] != key:
                out += fold.ends() if fold else []
                fold, key = _Fold(), row["conv_key"]
            fold.add(row)
        yield _table(_ENDS, out)
    if fold:
        yield _table(_ENDS, fold.ends())


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in _REPORT.split(", ")]
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            _, left = _apply(row["piece_audit"], row["state"], row["_roles"], row["_texts"])
            out.append((row["conv_key"], row["segment"], row["last"], *[row[n] for n in names], [r for r, _ in left], [t for _, t in left]))
        yield _table(_REPAIRED, out)


def _first_said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, part, seq, roles, texts in zip(*(batch.column(c).to_pylist() for c in ("conv_key", "_part", "_seq", "_roles", "_texts")), strict=True):
            first: dict[bytes, int] = {}
            for i, (role, text) in enumerate(zip(roles, texts, strict=True)):
                first.setdefault(_digest(role, text), i)
            out += [(key, part, seq, i, d) for d, i in first.items()]
        yield _table("conv_key string, _part int, _seq int, i int, digest binary", out)


def repair(turns: DataFrame, present: Column | None = None, piece_turns: int = PIECE_TURNS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Repaired conversations: conv_id, segment, last, the report, and the roles and texts of the turns left.

    Reads conv_id, turn, role and text.  Turns follow one another by ``turn``, nulls
    first, equal ones by role and text (the first 200 characters, then a hash of the
    whole).  A null role or text is one space; a turn with an empty role is never kept
    as it is.  A row where ``present`` is not true is
    no turn, but its conversation is reported: one without turns has an empty audit
    and zeros.  Rows with a null conv_id are one conversation.  A conversation of one
    piece is one row; a longer one has its turns in several, numbered ``segment``, and
    the report in the ``last``.  An empty table gives no rows.
    """
    kind = turns.schema["conv_id"].dataType
    is_turn = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    rows = turns.select(
        F.col("conv_id").cast("string").alias("conv_key"),
        F.when(is_turn, F.col("turn").cast("long")).alias("turn"),
        F.when(is_turn, F.coalesce(F.col("role").cast("string"), F.lit(" "))).alias("role"),
        F.when(is_turn, F.coalesce(F.col("text").cast("string"), F.lit(" "))).alias("text"),
    )
    order = ["conv_key", "turn", "role", "_start", "_hash", "_tie"]
    placed = rows.withColumns({"_start": F.substring("text", 1, 200), "_hash": F.xxhash64("text"), "_tie": F.monotonically_increasing_id()})
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_key", "turn", "role", "text")
    found = stored(ordered.mapInArrow(lambda batches: _pieces(batches, piece_turns, piece_chars), f"conv_key string, {_REPORT}, roles array<string>, texts array<string>, {_PIECE}"), "conversations")
    done = found.where("_part is null").select("conv_key", F.lit(0).alias("segment"), F.lit(1).alias("last"), *[x.split(" ")[0] for x in _REPORT.split(", ")], "roles", "texts")
    pieces = found.where("_part is not null").select("conv_key", *[x.split(" ")[0] for x in _PIECE.split(", ")])
    # where each (role, text) of a conversation that is cut stands first, a list for each piece
    said = pieces.select("conv_key", "_part", "_seq", "_roles", "_texts").mapInArrow(_first_said, "conv_key string, _part int, _seq int, i int, digest binary")
    first = said.groupBy("conv_key", "digest").agg(F.min(F.struct("_part", "_seq", "i")).alias("at")).groupBy(F.col("at._part").alias("n_part"), F.col("at._seq").alias("n_seq")).agg(F.collect_list("at.i").alias("_new"))
    known = pieces.join(first, (F.col("_part") == F.col("n_part")) & (F.col("_seq") == F.col("n_seq")), "left")
    summaries = known.mapInArrow(_summaries, "conv_key string, _part int, _seq int, low long, high long, n_distinct long, blank long, duplicate long, truncated long, illegal long, first string, last string, n int, costs array<long>, audits array<string>")
    folded = summaries.repartition("conv_key").sortWithinPartitions("conv_key", "_part", "_seq").mapInArrow(_folded, _ENDS)
    met = pieces.join(folded, (F.col("_part") == F.col("e_part")) & (F.col("_seq") == F.col("e_seq")))
    out = done.unionByName(met.mapInArrow(_written, _REPAIRED))
    return out.select(F.col("conv_key").cast(kind).alias("conv_id"), "segment", (F.col("last") == 1).alias("last"), *out.columns[3:])


def report(repaired: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, the report, and the SHA-256 of its turns as ``role:text`` lines.

    A conversation of several segments is hashed as a stream of them, in order, in
    constant memory: such a hash of one text can't be made in parts.
    """
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    names = [x.split(" ")[0] for x in _REPORT.split(", ")]
    whole = repaired.where("segment = 0 and last").select("conv_id", *names, F.sha2(lines, 256).alias("repaired_sha256"))
    cut = repaired.where("segment > 0 or not last").select(F.col("conv_id").cast("string").alias("conv_key"), "segment", "last", *names, F.size("roles").alias("n"), lines.alias("lines"))
    schema = f"conv_key string, {_REPORT}, repaired_sha256 string"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, begun = hashlib.sha256(), False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["n"]:
                    state.update(b"\n" * begun + row["lines"].encode("utf-8", "surrogatepass"))
                    begun = True
                if row["last"]:
                    out.append((row["conv_key"], *[row[n] for n in names], state.hexdigest()))
                    state, begun = hashlib.sha256(), False
            yield _table(schema, out)

    streamed = cut.repartition("conv_key").sortWithinPartitions("conv_key", "segment").mapInArrow(hashed, schema)
    return whole.unionByName(streamed.withColumn("conv_id", F.col("conv_key").cast(repaired.schema["conv_id"].dataType)).drop("conv_key"))


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): turns with faults by the CRC-32 of ``conv_id:turn``, for trying the repair.

    Of 20 values 0 drops the turn (present is false), 1 empties its text, 2 takes its
    ``.!?`` away, 3 repeats it, 4 makes the user say it.  Nulls are one space.
    """
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, F.lit(2)).otherwise(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") != 0).alias("present"), F.explode(times).alias("copy")).drop("copy")
