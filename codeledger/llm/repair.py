"""Structure repair of conversations: the cheapest edits that make a legal sequence of roles.

A conversation's turns are read in order (null turns first, then by turn, role and text). Each row is
kept, given another role, or deleted, and empty turns may be put in anywhere, so that the role initials
become ``(s?(ua)+)?``. The audit is the edits' initials; of equally cheap ones the least in ASCII order.

The dynamic program has a state for what may follow. Its audits are nodes that share their prefixes
(:class:`Audits`); a tie is decided where two audits first differ, which ancestors and rolling hashes
find in a logarithmic number of steps.

Rows are dealt by ranges of conversation and turn, so a conversation of any size is spread over tasks. A
task holds at most ``SEGMENT_ROWS`` rows of one at a time. What lies wholly within a task is finished there; the
segments of the others are summed up from each state to each state and joined in order. Only their
answer's own parts come together: the audit, which is one cell, and the hash over the repaired text,
which is a chain by definition and is fed from a stream of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeledger.llm.common import stored

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
ENDS = ".!?"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
#: What has been put out: nothing, a system turn, a user turn last, an assistant turn last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
FINAL = (START, ASSISTANT)
#: The state after a kept row of this initial.
FOLLOWS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state after a turn of the role that is wanted next, and that role.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Rows and text bytes of a conversation that a task holds at once.
SEGMENT_ROWS, SEGMENT_BYTES = 4096, 16_000_000
#: Rows of a result batch, and text bytes of one.
OUT_ROWS = 2048

MODULUS, BASE = (1 << 61) - 1, 1_000_003


class Audits:
    """Edit sequences as nodes of a tree: a node is its parent's sequence and one letter more.

    Every node keeps its depth, a rolling hash, and its ancestors 1, 2, 4, ... letters up.
    Node 0 is the empty sequence.
    """

    def __init__(self) -> None:
        self.parent, self.letter, self.depth, self.hash, self.up = [0], [""], [0], [0], [[]]

    def add(self, parent: int, letter: str) -> int:
        node = len(self.parent)
        self.parent.append(parent)
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * BASE + ord(letter)) % MODULUS)
        up, k, at = [parent], 0, parent
        while k < len(self.up[at]):  # the ancestor 2^k up has one 2^k up of its own
            at = self.up[at][k]
            up.append(at)
            k += 1
        self.up.append(up)
        return node

    def ancestor(self, node: int, depth: int) -> int:
        """The prefix of the given length."""
        k = self.depth[node] - depth
        while k > 0:
            jump = k.bit_length() - 1
            node = self.up[node][jump]
            k -= 1 << jump
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether sequence a comes before b in ASCII order."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if x == y or (self.hash[x] == self.hash[y] and self._same(x, y)):
            return self.depth[a] < self.depth[b]
        if self.hash[x] == self.hash[y]:  # two sequences of one hash
            return self.text(a) < self.text(b)
        # The shortest prefixes that differ: go up while the prefixes still do.
        for jump in range(len(self.up[x]) - 1, -1, -1):
            if jump < len(self.up[x]) and self.hash[self.up[x][jump]] != self.hash[self.up[y][jump]]:
                x, y = self.up[x][jump], self.up[y][jump]
        if not self._same(self.parent[x], self.parent[y]):  # equal hashes hid a difference
            return self.text(a) < self.text(b)
        return self.letter[x] < self.letter[y]

    def _same(self, x: int, y: int) -> bool:
        """Whether two sequences of one length are equal, letter by letter up to where they share a node."""
        while x != y:
            if self.letter[x] != self.letter[y]:
                return False
            x, y = self.parent[x], self.parent[y]
        return True

    def text(self, node: int) -> str:
        letters = []
        while node:
            letters.append(self.letter[node])
            node = self.parent[node]
        return "".join(reversed(letters))


# For each state the cost so far and the audit's node, or None where it can't be reached.
Reached = list[tuple[int, int] | None]


def _better(audits: Audits, reached: Reached, state: int, cost: int, parent: int, letter: str) -> None:
    there = reached[state]
    if there is None or cost < there[0]:
        reached[state] = (cost, audits.add(parent, letter))
    elif cost == there[0]:
        node = audits.add(parent, letter)
        if audits.less(node, there[1]):
            reached[state] = (cost, node)


def _inserted(audits: Audits, reached: Reached) -> Reached:
    """What inserts reach from here. Two suffice: a third returns to a state at a higher cost."""
    new = list(reached)
    for _ in range(2):
        before = list(new)
        for state in STATES:
            if before[state] is not None:
                cost, node = before[state]
                _better(audits, new, NEXT[state], cost + COSTS[INSERT], node, INSERT)
    return new


def _row(audits: Audits, reached: Reached, initial: str, gone: bool, cut: bool) -> Reached:
    """One row further: deleted, kept or given the wanted role, then inserts."""
    new: Reached = [None] * 4
    extra = TRUNCATED_COST if cut else 0
    for state in STATES:
        if reached[state] is None:
            continue
        cost, node = reached[state]
        _better(audits, new, state, cost + COSTS[DELETE], node, DELETE)
        if gone:
            continue
        if (state, initial) in FOLLOWS:
            _better(audits, new, FOLLOWS[state, initial], cost + COSTS[KEEP] + extra, node, KEEP)
        _better(audits, new, NEXT[state], cost + COSTS[REROLE] + extra, node, REROLE)
    return _inserted(audits, new)


def walk(rows: Iterable[tuple[str, bool, bool]], start: int, begin: bool) -> list[tuple[int, str] | None]:
    """Cheapest cost and audit from a state to every state over rows of (initial, must go, truncated).

    ``begin`` allows inserts before the first row; later segments have had them after the row before.
    """
    audits, reached = Audits(), [None] * 4
    reached[start] = (0, 0)
    if begin:
        reached = _inserted(audits, reached)
    for initial, gone, cut in rows:
        reached = _row(audits, reached, initial, gone, cut)
    return [there and (there[0], audits.text(there[1])) for there in reached]


def cheapest(ends: list[tuple[int, str] | None]) -> tuple[int, str]:
    return min(ends[state] for state in FINAL if ends[state] is not None)


def applied(rows: Iterable[tuple[str, str]], audit: str, state: int = START) -> Iterator[tuple[str, str]]:
    """The repaired turns (role, text): the audit's edits carried out on the rows, from a state on."""
    rows = iter(rows)
    for letter in audit:
        if letter == INSERT:
            state = NEXT[state]
            yield ROLE[state], ""
            continue
        role, text = next(rows)
        if letter == KEEP:
            state = FOLLOWS[state, role[:1]]
            yield role, text
        elif letter == REROLE:
            state = NEXT[state]
            yield ROLE[state], text


def _after(rows: Iterable[tuple[str, str]], audit: str, state: int) -> int:
    """The state at the end of a piece."""
    rows = iter(rows)
    for letter in audit:
        if letter == INSERT:
            state = NEXT[state]
            continue
        role = next(rows)[0]
        state = FOLLOWS[state, role[:1]] if letter == KEEP else NEXT[state] if letter == REROLE else state
    return state


class Hash:
    """The hash of turns as ``role:text`` joined by newlines."""

    def __init__(self) -> None:
        self.sum, self.first = hashlib.sha256(), True

    def add(self, role: str, text: str) -> None:
        self.sum.update(f"{'' if self.first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.first = False


# --- Rows of all conversations, in order -----------------------------------------------------------

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COUNTS = "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, last_turn long, first_turn long, first string, last string"
# kind: done (a result), part (a segment's sums), turn (a row of a segment that is not finished).
_PASS = f"conv_id long, part long, seq long, pos long, cost long, audit string, repaired_sha256 string, gaps long, {_COUNTS}, costs array<long>, audits array<string>, role string, text string, kind string"
_COLUMNS = [name.split()[0] for name in _PASS.split(", ")]
_LONGS = {field.split()[0] for field in _PASS.split(", ") if field.endswith(" long")}
_ARROW = pa.schema([(name, pa.int64() if name in _LONGS else pa.list_(pa.int64()) if name == "costs" else pa.list_(pa.string()) if name == "audits" else pa.string()) for name in _COLUMNS])


class Segment:
    """Successive rows of a conversation and what is counted over them."""

    def __init__(self, conv: int | None, seq: int, limit: int = SEGMENT_ROWS) -> None:
        self.conv, self.seq, self.limit, self.bytes, self.rows = conv, seq, limit, 0, []
        self.steps: list[tuple[str, bool, bool]] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first_turn = self.last_turn = self.first = self.last = None

    def add(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool, cut: bool) -> None:
        initial = role[:1]
        self.rows.append((role, text))
        self.steps.append((initial, blank or duplicate, cut and not blank and not duplicate))
        self.bytes += len(text) + len(role) + 100
        self.blank += blank
        self.duplicate += duplicate and not blank
        self.truncated += cut and not blank and not duplicate
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.first = initial if self.first is None else self.first
        self.last = initial
        if turn is not None:
            self.turns += turn != self.last_turn
            if self.low is None:
                self.low = self.first_turn = turn
            self.high = self.last_turn = turn

    @property
    def full(self) -> bool:
        return len(self.rows) >= self.limit or self.bytes >= SEGMENT_BYTES

    def counts(self) -> dict:
        names = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "last_turn", "first_turn", "first", "last")
        return {name: getattr(self, name) for name in names}

    def join(self, counts: dict) -> None:
        """Add the counts of the segment that comes next."""
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + counts[name])
        if counts["first"] is not None:
            if self.last is not None and self.last + counts["first"] not in LEGAL:
                self.illegal += 1
            self.last = counts["last"]
        if counts["first_turn"] is not None:
            self.turns -= counts["first_turn"] == self.last_turn
            self.low = counts["low"] if self.low is None else self.low
            self.high, self.last_turn = counts["high"], counts["last_turn"]

    def result(self, cost: int, audit: str) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv_id": self.conv, "gaps": gaps, "cost": cost, "audit": audit, **self.counts()}

    def done(self) -> Iterator[dict]:
        cost, audit = cheapest(walk(self.steps, START, True))
        total = Hash()
        for role, text in applied(self.rows, audit):
            total.add(role, text)
        yield {"kind": "done", "repaired_sha256": total.sum.hexdigest(), **self.result(cost, audit)}

    def open(self, part: int) -> Iterator[dict]:
        """The sums from each state to each, and the rows, for the pass over unfinished conversations."""
        ends = [end for start in STATES for end in walk(self.steps, start, False)]
        at = {"conv_id": self.conv, "part": part, "seq": self.seq}
        yield {"kind": "part", **at, **self.counts(), "costs": [end and end[0] for end in ends], "audits": [end and end[1] for end in ends]}
        for pos, (role, text) in enumerate(self.rows):
            yield {"kind": "turn", **at, "pos": pos, "role": role, "text": text}


def _batched(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("text") or "") + sum(len(audit or "") for audit in row.get("audits") or ())
        if len(held) >= OUT_ROWS or size >= SEGMENT_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _segments(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[dict]:
    """A task's rows as results and segments. Its first and last conversations may go on in other tasks."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    now: Segment | None = None
    whole, before, seq = False, None, 0
    for batch in batches:
        for start in range(0, batch.num_rows, OUT_ROWS):
            columns = [batch.column(name).slice(start, OUT_ROWS).to_pylist() for name in ("conv_id", "turn", "role", "text", "dropped", "blank", "cut", "repeated", "later", "mark")]
            for conv, turn, role, text, dropped, blank, cut, repeated, later, mark in zip(*columns, strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        yield from now.done() if whole else now.open(part)
                    whole = now is not None  # the first may have begun in another task
                    now, before, seq = Segment(conv, 0, limit), None, 0
                elif now.full:
                    yield from now.open(part)
                    whole, seq = False, seq + 1
                    now = Segment(conv, seq, limit)
                if dropped:
                    continue
                now.add(turn, role, text, blank, later or (repeated and before == (turn, mark)), cut)
                before = (turn, mark)
    if now is not None:
        yield from now.open(part)


def _pass(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    return _batched(_segments(batches, limit), _ARROW)


# --- Conversations of several segments --------------------------------------------------------------


class Piece:
    """A segment's audit behind those before it."""

    __slots__ = ("parent", "text", "depth")

    def __init__(self, parent: Piece | None, text: str) -> None:
        self.parent, self.text, self.depth = parent, text, parent.depth + 1 if parent else 0


def _before(a: Piece, b: Piece) -> bool:
    """Whether chain a comes before b of equal length, read from where they part."""
    left, right = [], []
    while a is not b:
        left.append(a.text)
        right.append(b.text)
        a, b = a.parent, b.parent
    return "".join(reversed(left)) < "".join(reversed(right))


def _joined(rows: Iterable[dict]) -> Iterator[dict]:
    """The segments of each conversation joined in order: its counts, cost and audit, a row for each piece."""

    def finish() -> Iterator[dict]:
        cost, best = min((c for c in (reached[state] for state in FINAL) if c), key=lambda c: c[0])
        for state in FINAL:
            if reached[state] and reached[state][0] == cost and reached[state][1] is not best and _before(reached[state][1], best):
                best = reached[state][1]
        pieces = []
        while best is not None:
            pieces.append(best.text)
            best = best.parent
        pieces.reverse()
        total = sums.result(cost, "".join(pieces))
        yield {"kind": "total", "part": -1, "seq": -1, "pos": -1, **total}
        # The inserts before the first row belong to the first segment.
        pieces[0:2] = ["".join(pieces[0:2])]
        for (part, seq), text in zip(at, pieces, strict=True):
            yield {"kind": "piece", "conv_id": sums.conv, "part": part, "seq": seq, "pos": -1, "audit": text}

    sums: Segment | None = None
    for row in rows:
        if sums is None or row["conv_id"] != sums.conv:
            if sums is not None:
                yield from finish()
            sums, at = Segment(row["conv_id"], 0), []
            reached = [end and (end[0], Piece(None, end[1])) for end in walk([], START, True)]
        sums.join(row)
        if sums.first is None:
            sums.first = row["first"]
        at.append((row["part"], row["seq"]))
        new: list[tuple[int, Piece] | None] = [None] * 4
        for state in STATES:
            for end in STATES:
                cost = row["costs"][4 * state + end]
                if reached[state] is None or cost is None:
                    continue
                total, piece = reached[state][0] + cost, Piece(reached[state][1], row["audits"][4 * state + end])
                if new[end] is None or total < new[end][0] or (total == new[end][0] and _before(piece, new[end][1])):
                    new[end] = (total, piece)
        reached = new
    if sums is not None:
        yield from finish()


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for start in range(0, batch.num_rows, OUT_ROWS):
            yield from batch.slice(start, OUT_ROWS).to_pylist()


def _join_pass(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batched(_joined(_rows(batches)), _ARROW)


def _hashed(rows: Iterable[dict], turns: bool) -> Iterator[dict]:
    """Totals, then pieces each with its rows: the hash over the repaired turns, or the turns."""
    total, piece, held = None, None, []

    def feed() -> Iterator[tuple[str, str]]:
        nonlocal state
        if piece is not None:
            yield from applied(held, piece, state)
            state = _after(held, piece, state)

    def flush() -> Iterator[dict]:
        nonlocal count
        for role, text in feed():
            sum_.add(role, text)
            if turns:
                yield {"conv_id": total["conv_id"], "pos": count, "role": role, "text": text}
            count += 1

    for row in rows:
        if row["kind"] == "total":
            if total is not None:
                yield from flush()
                if not turns:
                    yield {**total, "kind": "done", "repaired_sha256": sum_.sum.hexdigest()}
            total, piece, held, state, sum_, count = row, None, [], START, Hash(), 0
        elif row["kind"] == "piece":
            yield from flush()
            piece, held = row["audit"], []
        else:
            held.append((row["role"], row["text"]))
    if total is not None:
        yield from flush()
        if not turns:
            yield {**total, "kind": "done", "repaired_sha256": sum_.sum.hexdigest()}


def _hash_pass(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batched(_hashed(_rows(batches), turns=False), _ARROW)


# --- The operator -----------------------------------------------------------------------------------


def in_order(turns: DataFrame) -> DataFrame:
    """The rows in order of conversation and turn, with their faults; narrow rules only, but for repeats.

    A row repeats an earlier one if it has the role and text of a row at a smaller turn, or
    follows its equal within a turn. Only rows that occur more than once are looked for.
    """
    bare = F.rtrim("text", F.lit(SPACES))
    marked = turns.withColumns(
        {
            "mark": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256),
            "blank": bare == "",
            "cut": ~F.substring(bare, -1, 1).isin(*ENDS),
        }
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    several = (
        marked.filter(~F.col("dropped"))
        .groupBy(F.col("conv_id").alias("_conv"), F.col("mark").alias("_mark"))
        .agg(F.count("*").alias("_n"), F.min(place)["turn"].alias("_first"))
        .filter("_n > 1")
    )
    found = marked.join(several, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("mark") == F.col("_mark")), "left")
    flagged = found.withColumn("repeated", F.col("_n").isNotNull()).withColumn("later", F.col("repeated") & ~F.col("turn").eqNullSafe(F.col("_first")))
    order = ["conv_id", "turn", "role", "_head", "mark"]
    placed = flagged.withColumn("_head", F.substring("text", 1, 64)).repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.select("conv_id", "turn", "role", "text", "dropped", "blank", "cut", "repeated", "later", "mark")


def repair(turns: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row per conversation: RESULT. ``turns`` has conv_id, turn, role, text and ``dropped``.

    Rows marked as dropped count for nothing, but their conversation has its row: zeros, an empty
    audit and the hash of the empty string if it has no other. Other columns are not read. Rows without
    a conversation id are one conversation, null roles and texts one space; equal turns come in order of
    role and text. An empty table gives an empty result. A task holds ``segment_rows`` of a conversation
    at once; the result does not depend on it.
    """
    string = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), string("role").alias("role"), string("text").alias("text"), F.coalesce("dropped", F.lit(False)).alias("dropped")
    )
    passed = stored(in_order(rows).mapInArrow(partial(_pass, limit=segment_rows), _PASS), "repair-pass", "kind")
    of = lambda kind: passed.filter(F.col("kind") == kind)
    sums = of("part").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    pieces = stored(sums.mapInArrow(_join_pass, _PASS), "repair-pieces")
    parts = pieces.unionByName(of("turn")).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq", "pos")
    rest = parts.mapInArrow(_hash_pass, _PASS)
    names = [field.split()[0] for field in RESULT.split(", ")]
    return of("done").select(names).unionByName(rest.select(names))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in, for measuring the repair: by the checksum of ``conv_id:turn`` modulo 20,

    0 drops the row, 1 empties its text, 2 removes its end marks, 3 repeats it, 4 sets role user.
    """
    string = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(string("conv_id"), F.lit(":"), string("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), string("role").alias("role"), string("text").alias("text"), fault.alias("_fault"))

    def when(k: int, value: Column, otherwise: Column) -> Column:
        return F.when(F.col("_fault") == k, value).otherwise(otherwise)

    # A dropped row's place stays, its text does not travel.
    text = when(0, F.lit(""), when(1, F.lit(""), when(2, F.translate("text", ENDS, ""), F.col("text"))))
    changed = rows.select("conv_id", "turn", when(4, F.lit("user"), F.col("role")).alias("role"), text.alias("text"), (F.col("_fault") == 0).alias("dropped"), "_fault")
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_fault") == 3, 2).otherwise(1)))
    return changed.select("conv_id", "turn", "role", "text", "dropped", copies.alias("_copy")).drop("_copy")
