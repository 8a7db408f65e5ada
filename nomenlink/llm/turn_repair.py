"""Conversations brought back into order at the least cost, by Hirschberg's method.

A repaired conversation is empty, or a first system turn if any and then user
and assistant in turn. What has been written so far is one of four states:
nothing, the system turn, a user turn last, an assistant turn last. A row moves
from state to state by an edit (delete, keep, change the role), after any turns
inserted before it; what can follow a state is always one of user and
assistant, so the letters of the edits alone tell the repair.

Half way through, a forward vector of four costs meets a backward one. The
states where they add up to the least cost are the optimal crossings; the one
whose letters so far come first is taken and both halves are solved likewise.
No letters are kept for that: the letters by which two states are reached never
begin alike without differing, so a rank among the four is carried along with
the costs. Space is linear, and a vector is a pair of four small numbers.

Rows are dealt by range over conversation and turn, so that one conversation
may lie in many tasks. One that lies inside a task is solved there. Those that
touch the border of a task, or are long, are solved by slices: each slice
leaves the costs from each state to each state, the same method finds the
crossings between slices, and then the letters inside each slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenlink.llm.scratch import Scratch

DELETE, REROLE, INSERT, TRUNCATED_COST = 2, 1, 5, 5
# Characters of a conversation that a task holds at most; longer ones are solved by slices.
HELD_CHARS = 16_000_000
_BLANKS = " \t\n\x0b\f\r"
_ENDS = ".!?"
_EMITTED = 4096

_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
# The state that a user or assistant turn leads to; the state names its role.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
_INITIALS = "sua"
_SOUND, _DOOMED, _CUT = range(3)
# What must be inserted after the last row, and its cost.
_TAIL = ("", "II", "I", "")

# From each state to each state: cost and letters (or their rank), None where there is no way.
Step = tuple[tuple[tuple | None, ...], ...]
# By state: cost and rank of the letters so far, None where the state is not reached.
Vector = tuple[tuple[int, int] | None, ...]


@cache
def step_of(code: int) -> Step:
    """All ways over one row. ``code`` is three times the initial's number, plus the fault."""
    initial, fault = divmod(code, 3)
    ways: list[list] = [[None] * 4 for _ in range(4)]
    for state in range(4):
        here, cost, before = state, 0, ""
        for _ in range(3):  # a third insertion comes back to a state at a higher cost
            offers = [(here, DELETE, "D")]
            if fault != _DOOMED:
                more = TRUNCATED_COST if fault == _CUT else 0
                offers.append((_NEXT[here], REROLE + more, "R"))
                if (initial, here) == (0, _NOTHING):
                    offers.append((_SYSTEM, more, "K"))
                elif initial in (1, 2) and _NEXT[here] == initial + 1:
                    offers.append((_NEXT[here], more, "K"))
            for target, price, letter in offers:
                found = (cost + price, before + letter)
                if ways[state][target] is None or found < ways[state][target]:
                    ways[state][target] = found
            here, cost, before = _NEXT[here], cost + INSERT, before + "I"
    return tuple(map(tuple, ways))


def start(state: int) -> Vector:
    return tuple((0, 0) if s == state else None for s in range(4))


def advance(vector: Vector, step: Step) -> Vector:
    """The forward vector behind a further step: least costs, and among them the least letters."""
    best: list[tuple | None] = [None] * 4
    for held, ways in zip(vector, step):
        if held is not None:
            for target, way in enumerate(ways):
                if way is not None:
                    found = (held[0] + way[0], held[1], way[1])
                    if best[target] is None or found < best[target]:
                        best[target] = found
    order = sorted((x[1], x[2], t) for t, x in enumerate(best) if x is not None)
    ranks = {t: rank for rank, (_, _, t) in enumerate(order)}
    return tuple(None if x is None else (x[0], ranks[t]) for t, x in enumerate(best))


def retreat(costs: tuple, step: Step) -> tuple:
    """The backward costs before a step, from those behind it."""
    return tuple(
        min((w[0] + c for w, c in zip(ways, costs) if w is not None and c is not None), default=None) for ways in step
    )


def _shifted(values: tuple, by: int, pairs: bool) -> tuple:
    return tuple(None if v is None else ((v[0] + by, v[1]) if pairs else v + by) for v in values)


# Vectors whose least cost is zero are few, so a row of a known kind is looked up.
@cache
def _advanced(vector: Vector, code: int) -> tuple[Vector, int]:
    found = advance(vector, step_of(code))
    least = min(v[0] for v in found if v is not None)
    return _shifted(found, -least, True), least


@cache
def _retreated(costs: tuple, code: int) -> tuple[tuple, int]:
    found = retreat(costs, step_of(code))
    least = min(c for c in found if c is not None)
    return _shifted(found, -least, False), least


def over(codes: Sequence[int], vector: Vector) -> Vector:
    """The forward vector behind all rows of ``codes``."""
    total = 0
    for code in codes:
        vector, more = _advanced(vector, code)
        total += more
    return _shifted(vector, total, True)


def _over_steps(steps: Sequence[Step], vector: Vector) -> Vector:
    for step in steps:
        vector = advance(vector, step)
    return vector


def _back(codes: Sequence[int], costs: tuple) -> tuple:
    for code in reversed(codes):
        costs, _ = _retreated(costs, code)  # what all states add does not move a crossing
    return costs


def _back_steps(steps: Sequence[Step], costs: tuple) -> tuple:
    for step in reversed(steps):
        costs = retreat(costs, step)
    return costs


def crossings(steps: Sequence, entry: int, end: int) -> list[int]:
    """States before, between and behind ``steps`` on the least of the cheapest ways.

    ``steps`` are row codes (bytes) or ways over whole slices.
    """
    forward, backward = (over, _back) if isinstance(steps, bytes) else (_over_steps, _back_steps)
    states = [entry] * (len(steps) + 1)
    states[-1] = end
    parts = [(0, len(steps))]
    while parts:
        low, high = parts.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        ahead = forward(steps[low:middle], start(states[low]))
        goal = tuple(0 if s == states[high] else None for s in range(4))
        behind = backward(steps[middle:high], goal)
        meeting = [(a[0] + b, a[1], s) for s, (a, b) in enumerate(zip(ahead, behind)) if a is not None and b is not None]
        states[middle] = min(meeting)[2]
        parts += [(low, middle), (middle, high)]
    return states


def letters(codes: bytes, entry: int, end: int) -> list[str]:
    """The edits of each row, insertions before it included."""
    states = crossings(codes, entry, end)
    return [step_of(code)[a][b][1] for code, a, b in zip(codes, states, states[1:])]


def last_state(vector: Vector) -> tuple[int, int]:
    """Least cost of a whole conversation, and the state behind its last row."""
    cost, _, state = min((v[0] + INSERT * len(_TAIL[s]), v[1], s) for s, v in enumerate(vector) if v is not None)
    return cost, state


def written(edits: str, state: int, role: str, text: str) -> tuple[list[str], int]:
    """Lines of the repaired conversation that a row's edits give, and the state behind them."""
    lines = []
    for letter in edits:
        if letter == "D":
            continue
        if letter == "K":
            lines.append(f"{role}:{text}")
            state = _SYSTEM if role[:1] == "s" else _NEXT[state]
        else:
            state = _NEXT[state]
            lines.append(f"{_ROLE[state]}:{text if letter == 'R' else ''}")
    return lines, state


class _Digest:
    """Running digest, and if asked the text, of lines joined by newlines."""

    def __init__(self, texts: bool):
        self.sha, self.any, self.lines = hashlib.sha256(), False, [] if texts else None

    def add(self, lines: list[str]) -> None:
        for line in lines:
            if self.any:
                self.sha.update(b"\n")
            self.sha.update(line.encode())
            self.any = True
        if self.lines is not None:
            self.lines += lines

    def values(self) -> list:
        return [self.sha.hexdigest(), *([] if self.lines is None else ["\n".join(self.lines)])]


def _code(role: str, fault: int) -> int:
    initial = _INITIALS.find(role[:1]) if role else 3
    return 3 * (initial if initial >= 0 else 3) + fault


_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_SLICE = ("blank", "duplicate", "truncated", "illegal", "turns", "first", "last", "opening", "closing")


class _Counts:
    """What a run of rows, in order, adds to the report."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.opening = self.closing = None

    def add(self, turn: int | None, role: str, ending: str, again: bool) -> int:
        """Count a row; its code."""
        fault = _SOUND
        if ending == "":
            self.blank += 1
            fault = _DOOMED
        elif again:
            self.duplicate += 1
            fault = _DOOMED
        elif ending not in _ENDS:
            self.truncated += 1
            fault = _CUT
        code = _code(role, fault)
        self._follow(code // 3, code // 3)
        if turn is not None:
            self._see(turn, turn, 1)
        return code

    def _follow(self, opening: int, closing: int) -> None:
        if self.opening is None:
            self.opening = opening
        elif (self.closing, opening) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.closing = closing

    def _see(self, first: int, last: int, turns: int) -> None:
        """Rows come by turn, so equal turns are neighbours."""
        self.turns += turns - (first == self.last)
        self.first = first if self.first is None else self.first
        self.last = last

    def join(self, other: dict) -> None:
        """Add the counts of the rows that follow."""
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + other[name])
        self._follow(other["opening"], other["closing"])
        if other["turns"]:
            self._see(other["first"], other["last"], other["turns"])

    def values(self) -> list[int]:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal]

    def row(self) -> list:
        return [getattr(self, name) for name in _SLICE]


def _emit(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, bool, list]]:
    """Rows in order, with their key (the first columns) and whether it is a new one."""
    last = None
    for batch in batches:
        for begin in range(0, batch.num_rows, _EMITTED):
            part = batch.slice(begin, _EMITTED)
            for row in zip(*[c.to_pylist() for c in part.columns], strict=True):
                key = row[:keys]
                yield key, key != last, row[keys:]
                last = key


def _solved(rows: list, texts: bool) -> list:
    """Report of a conversation: rows of turn, role, text, ending."""
    counts, seen, codes = _Counts(), set(), bytearray()
    for turn, role, text, ending in rows:
        codes.append(counts.add(turn, role, ending, (role, text) in seen))
        seen.add((role, text))
    codes = bytes(codes)
    cost, end = last_state(over(codes, start(_NOTHING)))
    edits = letters(codes, _NOTHING, end) if codes else []
    digest, state = _Digest(texts), _NOTHING
    for (_, role, text, _), edit in zip(rows, edits):
        lines, state = written(edit, state, role, text)
        digest.add(lines)
    digest.add(written(_TAIL[state], state, "", "")[0])
    return [*counts.values(), cost, "".join(edits) + _TAIL[state], *digest.values()]


def _inside(batches: Iterator[pa.RecordBatch], schema: pa.Schema, texts: bool) -> Iterator[pa.RecordBatch]:
    """Conversations that begin and end in this task, solved; rows of all others as they are."""
    part, seq, width = TaskContext.get().partitionId(), -1, len(_REPORT) + 2 + texts
    out: list[list] = []
    key, held, chars, passing = None, [], 0, True  # the first conversation may have begun before

    def leave(row: tuple) -> list:
        return [key, *[None] * width, True, part, *row]

    size = 0
    for (conv,), fresh, (turn, role, text, ending, gone) in _runs(batches, 1):
        seq += 1
        if fresh:
            if seq and not passing:
                out.append([key, *_solved([r[1:5] for r in held if not r[5]], texts), False, *[None] * 7])
            passing, held, chars, key = seq == 0, [], 0, conv
        row = (seq, turn, role, text, ending, gone)
        if not passing:
            held.append(row)
            chars += 100 + len(text)
            if chars > HELD_CHARS:
                out += [leave(r) for r in held]
                passing, held = True, []
        else:
            out.append(leave(row))
            size += len(text)
        if len(out) >= _EMITTED or size > HELD_CHARS // 4:
            yield _emit(out, schema)
            out, size = [], 0
    out += [leave(r) for r in held]  # the last one may go on in the next task
    if out:
        yield _emit(out, schema)


def _slices(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Counts and ways of each run of rows of one conversation and part."""
    key, counts, vectors, totals = None, None, [], []

    def row() -> list:
        ways = [v for vector, total in zip(vectors, totals) for v in _shifted(vector, total, True)]
        return [*key, *counts.row(), [None if v is None else list(v) for v in ways]]

    for found, fresh, (_, turn, role, ending, again) in _runs(batches, 2):
        if fresh:
            if key:
                yield _emit([row()], schema)
            key, counts, vectors, totals = found, _Counts(), [start(s) for s in range(4)], [0] * 4
        code = counts.add(turn, role, ending, again)
        for state, vector in enumerate(vectors):
            vectors[state], more = _advanced(vector, code)
            totals[state] += more
    if key:
        yield _emit([row()], schema)


def _joined(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Entry and end of each slice of a conversation, and the report on its first slice's row."""

    def solve(conv, rows: list) -> list[list]:
        counts = _Counts()
        steps = []
        for row in rows:
            counts.join(dict(zip(_SLICE, row[1:])))
            ways = [None if v is None else tuple(v) for v in row[-1]]
            steps.append(tuple(tuple(ways[4 * s : 4 * s + 4]) for s in range(4)))
        cost, end = last_state(_over_steps(steps, start(_NOTHING)))
        states = crossings(steps, _NOTHING, end)
        reports = [[*counts.values(), cost], *[[None] * len(_REPORT)] * (len(rows) - 1)]
        return [[conv, row[0], a, b, *r] for row, a, b, r in zip(rows, states, states[1:], reports)]

    key, rows = None, []
    for found, fresh, row in _runs(batches, 1):
        if fresh and rows:
            yield _emit(solve(key[0], rows), schema)
            rows = []
        key = found
        rows.append(row)
    if rows:
        yield _emit(solve(key[0], rows), schema)


def _edits(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Edits of every row of a slice whose entry and end are known."""

    def solve(part: int, seqs: list, codes: bytearray, ends: tuple) -> Iterator[pa.RecordBatch]:
        found = letters(bytes(codes), *ends)
        for begin in range(0, len(seqs), _EMITTED):
            rows = zip(seqs[begin : begin + _EMITTED], found[begin : begin + _EMITTED])
            yield _emit([[part, seq, edit] for seq, edit in rows], schema)

    key, seqs, codes, ends = None, [], bytearray(), ()
    for found, fresh, (seq, _, role, ending, again, entry, end) in _runs(batches, 2):
        if fresh:
            if seqs:
                yield from solve(key[1], seqs, codes, ends)
            key, seqs, codes, ends = found, [], bytearray(), (entry, end)
        fault = _DOOMED if ending == "" or again else _SOUND if ending in _ENDS else _CUT
        seqs.append(seq)
        codes.append(_code(role, fault))
    if seqs:
        yield from solve(key[1], seqs, codes, ends)


def _read_out(batches: Iterator[pa.RecordBatch], schema: pa.Schema, texts: bool) -> Iterator[pa.RecordBatch]:
    """Audit and digest of each conversation, its rows passing by in order."""
    key, audit, digest, state = None, [], None, _NOTHING

    def row() -> list:
        digest.add(written(_TAIL[state], state, "", "")[0])
        return [key[0], "".join(audit) + _TAIL[state], *digest.values()]

    for found, fresh, (_, _, role, text, edits) in _runs(batches, 1):
        if fresh:
            if key:
                yield _emit([row()], schema)
            key, audit, digest, state = found, [], _Digest(texts), _NOTHING
        if edits is not None:
            audit.append(edits)
            lines, state = written(edits, state, role, text)
            digest.add(lines)
    if key:
        yield _emit([row()], schema)


def damaged(talks: DataFrame) -> DataFrame:
    """Rows of ``talks`` after the damage that the digest of conversation and turn names.

    Of each twenty digests 0 drops the row (it stays, marked ``gone``, so that
    its conversation is not lost), 1 empties the text, 2 takes out full stops,
    exclamation and question marks, 3 repeats the row, 4 makes it the user's.
    Null texts, roles and, in the digest, null ids and turns are one space.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *shown).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = talks.select("conv_id", F.col("turn").cast("long").alias("turn"), kind.alias("kind"), role.alias("role"), text.alias("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") < 2, "").when(F.col("kind") == 2, F.translate("text", _ENDS, "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("gone"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def _ending(text: Column) -> Column:
    """The last character that is no white space; none for a blank text."""
    return F.right(F.rtrim(text, F.lit(_BLANKS)), F.lit(1))


def repair_conversations(rows: DataFrame, texts: bool = True) -> DataFrame:
    """Faults, cheapest repair and repaired text of each conversation.

    Reads ``conv_id``, ``turn``, ``role``, ``text`` and, if there, the boolean
    ``gone`` (the row is not there, but its conversation is); other columns are
    ignored, whatever their names. Rows are taken by turn, nulls first; rows of
    one turn by role, the first 64 characters of the text and a digest of it.

    A row's first fault counts: ``blank``, ``duplicate`` (role and text seen
    earlier in the conversation), ``truncated`` (the last character that is no
    white space is not ``.``, ``!`` or ``?``). Keeping a row costs 0, another
    role 1, deleting 2 (a must for blank and duplicate rows), inserting an
    empty user or assistant turn 5, and 5 more each truncated row that stays.
    ``audit`` has the initials of the cheapest edits (D, I, K, R), the first of
    them in order of ASCII where several are as cheap; ``repaired_sha256`` is
    that of the repaired ``role:text`` lines joined by newlines, and
    ``repaired`` those lines if ``texts`` is set. ``gaps`` counts the turns
    missing between the first and the last, ``illegal`` the neighbours whose
    roles must not follow each other.

    A null role or text is one space; a null conversation is one of its own;
    null turns come first and count for no gap. A role without characters can
    only be changed or deleted. Repeated rows are duplicates. Texts are read
    whole. A conversation whose rows are all gone has zeros, an empty audit and
    the digest of the empty text. No rows give none.
    """
    scratch = Scratch(rows.sparkSession, "turn-repair")
    kind = rows.schema["conv_id"].dataType.simpleString()
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    source = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        gone.alias("gone"),
        F.monotonically_increasing_id().alias("salt"),
    ).withColumn("ending", _ending(F.col("text")))
    # Rows that are equal in all else are told apart by the salt, so no value is too frequent for a range.
    order = ["conv_id", "turn", "role", F.substring("text", 1, 64), F.xxhash64("text"), "salt"]
    dealt = source.repartitionByRange(*order).sortWithinPartitions(*order)

    report = "".join(f"{name} long, " for name in _REPORT)
    solved = f"audit string, repaired_sha256 string{', repaired string' if texts else ''}"
    schema = f"conv_id {kind}, {report}{solved}, open boolean, part int, seq long, turn long, role string, text string, ending string, gone boolean"
    names = ["conv_id", "turn", "role", "text", "ending", "gone"]
    first = _mapped(dealt.select(*names), schema, lambda b, s: _inside(b, s, texts))
    first = scratch.keep(first, "first")
    columns = ["conv_id", *_REPORT, "audit", "repaired_sha256", *(["repaired"] if texts else [])]
    done = first.where("not open").select(*columns)

    border = first.where("open").select("conv_id", "part", "seq", "turn", "role", "text", "ending", "gone")
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    seen = border.where("not gone and ending <> ''").select("conv_id", "role", digest, F.struct("part", "seq").alias("at"))
    repeated = seen.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))
    repeated = repeated.where("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "at")
    facts = border.where("not gone").select("conv_id", "part", "seq", "turn", "role", "ending", digest)
    same = F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("r") == F.col("role")) & (F.col("d") == F.col("digest"))
    again = F.coalesce(F.struct("part", "seq") > F.col("at"), F.lit(False)).alias("again")
    codes = facts.join(repeated, same, "left").select("conv_id", "part", "seq", "turn", "role", "ending", again)
    codes = scratch.keep(codes, "codes")

    counts = "".join(f"{name} long, " for name in _SLICE)
    ordered = codes.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "seq")
    slices = _mapped(ordered, f"conv_id {kind}, part int, {counts}ways array<array<int>>", _slices)
    slices = slices.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    joined = _mapped(slices, f"conv_id {kind}, part int, entry int, end int, {report[:-2]}", _joined)
    joined = scratch.keep(joined, "slices")

    ends = joined.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "entry", "end")
    bounded = codes.join(ends, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("p") == F.col("part"))).drop("c", "p")
    bounded = bounded.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "seq")
    edits = _mapped(bounded, "part int, seq long, edits string", _edits)

    lines = border.join(edits, ["part", "seq"], "left").select(
        "conv_id", "part", "seq", F.when(F.col("edits").rlike("[KR]"), F.col("role")).otherwise("").alias("role"),
        F.when(F.col("edits").rlike("[KR]"), F.col("text")).otherwise("").alias("text"), "edits",
    )
    # A digest is made from first to last: a conversation's lines pass one task, a batch at a time.
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    texts_out = _mapped(lines, f"conv_id {kind}, {solved}", lambda b, s: _read_out(b, s, texts))
    totals = joined.where("cost is not null").select(F.col("conv_id").alias("c"), *_REPORT)
    rest = texts_out.join(totals, F.col("c").eqNullSafe(F.col("conv_id")), "left").select(
        "conv_id", *[F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in _REPORT], *columns[len(_REPORT) + 1 :]
    )
    return done.unionByName(rest)


def _mapped(df: DataFrame, schema: str, function: Callable) -> DataFrame:
    """``function`` over the batches of each task, with the Arrow form of its schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(lambda batches: function(batches, arrow), schema)


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repairing each conversation costs after the damage, and its digest."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_conversations(damaged(talks), texts=False)


# States as in the module's text; each recursion takes one row of every conversation.
OP11_SQL = r"""
with recursive keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key
  from conversations
), kinds as (
  select *, xor(list_reduce(
      flatten(list_transform(range(1, length(key) + 1), lambda i: [ord(key[i])::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end, 4294967295::bigint),
    4294967295) % 20 as kind
  from keyed
), bad as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
  from (select *, unnest(case kind when 0 then [] when 3 then [0, 1] else [0] end) as copy from kinds)
), ordered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from bad
), placed as (
  select *, row_number() over (partition by conv_id, role, text order by i) as copy,
    right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as ending
  from ordered
), rows as materialized (
  select *, case when ending = '' then 'blank' when copy > 1 then 'duplicate'
      when ending not in ('.', '!', '?') then 'truncated' else 'sound' end as fault,
    lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair
  from placed
), counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, count(*) as n
  from rows group by conv_id
), inserts(state, target, price, before, added) as (
  values (0, 0, 0, '', []::varchar[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
    (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']), (3, 2, 5, 'I', ['user:']),
    (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:']),
    (2, 2, 10, 'II', ['assistant:', 'user:']), (3, 3, 10, 'II', ['user:', 'assistant:'])
), ways as (
  select r.conv_id, r.i, s.state, s.before, s.added, e.letter, e.target, r.role, r.text,
    s.price + e.price + case when e.letter <> 'D' and fault = 'truncated' then 5 else 0 end as price
  from rows r, inserts s, (
    select *, case letter when 'D' then state when 'K' then case initial when 's' then 1 when 'u' then 2 else 3 end
        else case state when 2 then 3 else 2 end end as target,
      case letter when 'D' then 2 when 'K' then 0 else 1 end as price
    from (values ('D'), ('K'), ('R')) l(letter), (values (0), (1), (2), (3)) st(state), (values ('s'), ('u'), ('a'), ('-')) q(initial)
    where letter <> 'K' or (initial = 's' and state = 0) or (initial = 'u' and state <> 2) or (initial = 'a' and state = 2)
  ) e
  where e.state = s.target and e.initial = case when left(r.role, 1) in ('s', 'u', 'a') then left(r.role, 1) else '-' end
    and (e.letter = 'D' or r.fault in ('sound', 'truncated'))
), walk(conv_id, i, state, best) as (
  select distinct conv_id, 0::bigint, 0, {'cost': 0::bigint, 'audit': '', 'lines': []::varchar[]} from rows
  union all
  select w.conv_id, w.i + 1, y.target, min({
      'cost': w.best.cost + y.price, 'audit': w.best.audit || y.before || y.letter,
      'lines': w.best.lines || y.added || case letter when 'D' then [] when 'K' then [y.role || ':' || y.text]
        else [case y.target when 2 then 'user:' else 'assistant:' end || y.text] end})
  from walk w join ways y on y.conv_id is not distinct from w.conv_id and y.i = w.i + 1 and y.state = w.state
  group by w.conv_id, w.i, y.target
), ended as (
  select c.conv_id, min({
      'cost': best.cost + t.price, 'audit': best.audit || t.before, 'lines': best.lines || t.added}) as best
  from counted c join walk w on w.conv_id is not distinct from c.conv_id and w.i = c.n
  join inserts t on t.state = w.state and t.target = case when w.state = 0 then 0 else 3 end
  group by c.conv_id
)
select a.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(e.best.cost, 0)::bigint as cost,
  coalesce(e.best.audit, '') as audit, sha256(coalesce(array_to_string(e.best.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) a
left join counted c on c.conv_id is not distinct from a.conv_id
left join ended e on e.conv_id is not distinct from a.conv_id
"""
