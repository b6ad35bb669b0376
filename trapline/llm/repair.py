"""Repair of conversation structure: the cheapest edits, found by a persistent audit DP.

A conversation's rows, in turn order, pass an automaton of role initials that
takes ``(s?(ua)+)?``. Edits of a row: Keep (cost 0), Rerole to what the place
asks for (1), Delete (2; the only one for blank and duplicate rows); undeleted
truncated rows add 5; Insert puts an empty user or assistant row anywhere (5).
The audit is the edits' initials in order; of equal costs the least audit in
ASCII order wins.

``Audits`` holds audits as linked nodes that share their prefixes. A node knows
its ancestors 1, 2, 4, ... edits up and a rolling hash of its whole audit, so two
audits of equal cost are compared by a search for their longest common prefix
over ancestors; equal hashes are verified by walking both to their common node.
The state of the automaton follows from the audit, so no two ways to one state
spell the same audit, and neither of two audits of equal cost is a prefix of the
other: the least stays least whatever follows. For that reason the way through
rows ``a`` and then ``b`` is the least over states between them of a's audit and
b's, and a conversation of any size is worked on in pieces (``CHUNK`` rows, and
whatever a partition holds), each giving a cost and an audit from state to state.

Rows are placed by range partitions on conversation, turn, role and text. A
conversation within a partition is finished there, in one pass. One that goes on
over partitions (at most one more than there are partitions) gives a piece a
partition; repeated rows are found by a second placing, on role and text; the
pieces, without texts, are joined in order; and the repaired text is hashed as a
stream, as a digest of the whole asks for.

Defined cases: null roles and texts are one space, a null turn comes first and
has no gap; rows of one turn go by role, then text; an empty role fits no place;
other roles count by their initial; repeated rows are duplicates; a conversation
without rows has zeros, an empty audit and the digest of nothing; a null id is a
conversation of its own; an empty table gives no rows; columns beyond ``conv_id``,
``turn``, ``role`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, ordering
from .repeats import stored

#: rows whose audits share one arena
CHUNK = 2048
#: costs of the edits
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: states: nothing yet, after s, after u, after a; the first and the last may end
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: the role that a state asks for, and the state after it
ASKED = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: states after a kept row of an initial
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = ("su", "ua", "au")
#: a row's first fault
SOUND, BLANK, DUPLICATE, CUT = range(4)
_MODULUS, _BASE = (1 << 61) - 1, 1_000_003


class Audits:
    """Edit strings as linked nodes; node 0 is the empty one."""

    def __init__(self):
        self.parent, self.edit, self.depth, self.hash, self.up = [0], [""], [0], [0], [()]

    def add(self, node: int, edit: str) -> int:
        new = len(self.parent)
        up = [node]
        while up[-1] and len(up) <= len(self.up[up[-1]]):  # 2**k above is 2**(k-1) above the one 2**(k-1) above
            up.append(self.up[up[-1]][len(up) - 1])
        self.parent.append(node)
        self.edit.append(edit)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(edit)) % _MODULUS)
        self.up.append(tuple(up))
        return new

    def above(self, node: int, steps: int) -> int:
        k = 0
        while steps:
            if steps & 1:
                node = self.up[node][k]
            steps >>= 1
            k += 1
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two audits of one length are equal, edit by edit to their common node."""
        while a != b:
            if self.edit[a] != self.edit[b]:
                return False
            a, b = self.parent[a], self.parent[b]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether audit ``a`` comes before ``b``; a prefix comes first."""
        least = min(self.depth[a], self.depth[b])
        x, y = self.above(a, self.depth[a] - least), self.above(b, self.depth[b] - least)
        if self.hash[x] == self.hash[y] and self.same(x, y):
            return self.depth[a] < self.depth[b]
        if self.hash[x] == self.hash[y]:
            return self.spelled(x) < self.spelled(y)
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if not self.same(self.parent[x], self.parent[y]):  # a collision
            return self.spelled(a) < self.spelled(b)
        return self.edit[x] < self.edit[y]

    def spelled(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.parent[node]
        return "".join(reversed(out))


def _offer(audits: Audits, best: dict, state: int, cost: int, node: int, edit: str) -> None:
    """Take the way to ``state`` by ``edit`` after ``node`` if it is cheaper, or as cheap and less."""
    old = best.get(state)
    if old is None or cost < old[0]:
        best[state] = (cost, audits.add(node, edit))
    elif cost == old[0]:
        new = audits.add(node, edit)
        if audits.less(new, old[1]):
            best[state] = (cost, new)


def _inserted(audits: Audits, best: dict) -> dict:
    """``best`` and what inserted rows make of it; two in a row lead to any state that inserts lead to."""
    last = best
    for _ in range(2):
        before = dict(best)
        for cost, node, asked in [(*best[state], ASKED[state][1]) for state in last]:
            _offer(audits, best, asked, cost + INSERT, node, "I")
        last = [state for state in best if best[state] != before.get(state)]
    return best


def ways(initials: list[str], faults: list[int], start: int) -> dict[int, tuple[int, str]]:
    """The cheapest cost and least audit from ``start`` to each state, over one chunk."""
    audits = Audits()
    best = _inserted(audits, {start: (0, 0)})
    for initial, fault in zip(initials, faults):
        after: dict = {}
        late = TRUNCATED if fault == CUT else 0
        for state, (cost, node) in best.items():
            _offer(audits, after, state, cost + DELETE, node, "D")
            if fault in (BLANK, DUPLICATE):
                continue
            kept = KEPT.get((state, initial))
            if kept is not None:
                _offer(audits, after, kept, cost + late, node, "K")
            asked = ASKED[state][1]
            if asked != kept:
                _offer(audits, after, asked, cost + REROLE + late, node, "R")
        best = _inserted(audits, after)
    return {state: (cost, audits.spelled(node)) for state, (cost, node) in best.items()}


def joined(first: dict, second: dict) -> dict[int, tuple[int, str]]:
    """The ways to each state over two pieces: ``first`` from one start, ``second`` from every state."""
    out: dict = {}
    for middle, (cost, audit) in first.items():
        for state, (more, rest) in second[middle].items():
            whole = (cost + more, audit + rest)
            if state not in out or whole < out[state]:
                out[state] = whole
    return out


def piece_ways(initials: list[str], faults: list[int], starts: tuple[int, ...]) -> dict[int, dict[int, tuple[int, str]]]:
    """The ways over any number of rows, from each start."""
    found = {s: ways(initials[:CHUNK], faults[:CHUNK], s) for s in starts}
    for lo in range(CHUNK, len(initials), CHUNK):
        after = {s: ways(initials[lo : lo + CHUNK], faults[lo : lo + CHUNK], s) for s in {x for f in found.values() for x in f}}
        found = {s: joined(f, after) for s, f in found.items()}
    return found


def repaired(audit: str, state: int, rows: Iterator[tuple[str, str, str]]) -> Iterator[str]:
    """The lines that an audit makes of ``(role, initial, text)`` rows, from a state on."""
    for edit in audit:
        role, text = ASKED[state][0], ""
        if edit != "I":
            own, initial, text = next(rows)
        if edit == "D":
            continue
        if edit == "K":
            role, state = own, KEPT[state, initial]
        else:
            state = ASKED[state][1]
        yield f"{role}:{text}"


def end_state(audit: str, state: int, initials: Iterator[str]) -> int:
    """The state an audit leads to from ``state``."""
    for edit in audit:
        initial = next(initials) if edit != "I" else ""
        if edit == "K":
            state = KEPT[state, initial]
        elif edit != "D":
            state = ASKED[state][1]
    return state


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that ``crc32(conv_id:turn) % 20`` names."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_kind"))
    kind = F.col("_kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    changed = rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy"))
    return changed.drop("_copy")


def _features(rows: DataFrame) -> DataFrame:
    """Rows with the sort key of their conversation, initial, and the faults that a row shows by itself."""
    bare = F.rtrim("text", F.lit("\t\n\x0b\x0c\r "))
    fault = F.when(bare == "", BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), CUT).otherwise(SOUND)
    role = F.col("role")
    same = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, F.col("text")).cast("binary"), 256)
    return rows.select(
        ordering.group_key("conv_id").alias("conv"), "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text",
        F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), F.unhex(same).alias("same"),
    )


class Tally:
    """The counts of a piece; pieces add up in order."""

    def __init__(self):
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = None
        self.first = self.last = None

    def row(self, turn: int | None, initial: str, fault: int) -> None:
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == CUT
        if self.rows:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.rows, self.last = self.rows + 1, initial
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def add(self, other: Tally) -> None:
        self.blank += other.blank
        self.duplicate += other.duplicate
        self.truncated += other.truncated
        self.illegal += other.illegal + (self.rows > 0 and self.last + other.first not in LEGAL)
        self.first = other.first if not self.rows else self.first
        self.rows, self.last = self.rows + other.rows, other.last
        if other.first_turn is not None:
            self.turns += other.turns - (other.first_turn == self.last_turn)
            self.first_turn = other.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = other.last_turn

    def counts(self) -> dict[str, int]:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_RESULT = "conv string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
_RESULT_ROWS = pa.schema([("conv", pa.string()), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _best_end(found: dict[int, tuple[int, str]]) -> tuple[int, str]:
    return min(found[s] for s in ENDS if s in found)


def _finished(conv: str, rows: list[tuple]) -> dict:
    """The result of a whole conversation: ``(turn, role, text, initial, fault, same)`` rows in order."""
    tally, seen, faults = Tally(), set(), []
    for turn, _, _, initial, fault, same in rows:
        if same in seen and fault != BLANK:
            fault = DUPLICATE
        seen.add(same)
        faults.append(fault)
        tally.row(turn, initial, fault)
    cost, audit = _best_end(piece_ways([r[3] for r in rows], faults, (START,))[START])
    lines = "\n".join(repaired(audit, START, ((r[1], r[3], r[2]) for r in rows)))
    return {"conv": conv, **tally.counts(), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(lines.encode()).hexdigest()}


def _whole_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = ["turn", "role", "text", "initial", "fault", "same"]
    out, conv, rows = [], None, []
    for new, run in ordering.runs(batches, ["conv"]):
        if new:
            if rows:
                out.append(_finished(conv, rows))
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, _RESULT_ROWS)
                out = []
            conv, rows = run.column("conv")[0].as_py(), []
        rows.extend(zip(*(run.column(c).to_pylist() for c in columns)))
    if rows:
        out.append(_finished(conv, rows))
    if out:
        yield pa.RecordBatch.from_pylist(out, _RESULT_ROWS)
    common.give_back()


_PIECE = (
    "conv string, part int, rows long, blank long, duplicate long, truncated long, illegal long, turns long, "
    "first_turn long, last_turn long, first string, last string, ways array<struct<start:int,stop:int,cost:long,audit:string>>"
)
_WAY = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_TALLY = ["rows", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first", "last"]
_PIECE_ROWS = pa.schema(
    [("conv", pa.string()), ("part", pa.int32()), *((c, pa.int64()) for c in _TALLY[:8]), ("first", pa.string()), ("last", pa.string()), ("ways", pa.list_(_WAY))]
)


def _piece(conv: str, part: int, initials: list[str], faults: list[int], tally: Tally) -> pa.RecordBatch:
    starts = (START, SYSTEM, USER, ASSISTANT)
    found = [{"start": s, "stop": t, "cost": c, "audit": a} for s, to in piece_ways(initials, faults, starts).items() for t, (c, a) in to.items()]
    return pa.RecordBatch.from_pylist([{"conv": conv, "part": part, **{c: getattr(tally, c) for c in _TALLY}, "ways": found}], _PIECE_ROWS)


def _piece_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A piece for each conversation and partition; rows come without texts."""
    key, initials, faults, tally = None, [], [], Tally()
    for new, run in ordering.runs(batches, ["conv", ordering.PART]):
        if new:
            if key:
                yield _piece(*key, initials, faults, tally)
            key, initials, faults, tally = (run.column("conv")[0].as_py(), run.column(ordering.PART)[0].as_py()), [], [], Tally()
        for turn, initial, fault in zip(*(run.column(c).to_pylist() for c in ("turn", "initial", "fault"))):
            initials.append(initial)
            faults.append(fault)
            tally.row(turn, initial, fault)
    if key:
        yield _piece(*key, initials, faults, tally)


_JOINED = "conv string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, pieces array<struct<part:int,start:int,audit:string>>"
_JOINED_ROWS = pa.schema(
    [*list(_RESULT_ROWS)[:-1], ("pieces", pa.list_(pa.struct([("part", pa.int32()), ("start", pa.int32()), ("audit", pa.string())])))]
)


def _joined_pieces(table: pa.Table) -> pa.Table:
    """One conversation's pieces, joined in order; and the way taken through each."""
    pieces = sorted(table.to_pylist(), key=lambda p: p["part"])
    tally, best, steps = Tally(), {START: (0, "")}, []
    for p in pieces:
        own = Tally()
        for c in _TALLY:
            setattr(own, c, p[c])
        tally.add(own)
        found: dict = {}
        for w in p["ways"]:
            found.setdefault(w["start"], {})[w["stop"]] = (w["cost"], w["audit"])
        after, back = {}, {}
        for middle, (cost, audit) in best.items():
            for state, (more, rest) in found[middle].items():
                whole = (cost + more, audit + rest)
                if state not in after or whole < after[state]:
                    after[state], back[state] = whole, (middle, rest)
        best = after
        steps.append(back)
    cost, audit = _best_end(best)
    state = next(s for s in ENDS if best.get(s) == (cost, audit))
    taken = []
    for p, back in zip(reversed(pieces), reversed(steps)):
        state, rest = back[state]
        taken.append({"part": p["part"], "start": state, "audit": rest})
    row = {"conv": pieces[0]["conv"], **tally.counts(), "cost": cost, "audit": audit, "pieces": taken}
    return pa.Table.from_pylist([row], _JOINED_ROWS)


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation's lines; a piece's rows follow the audit that is theirs (``tag`` 0)."""
    columns = ["tag", "start", "audit", "role", "initial", "text"]
    schema = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])
    conv, digest, lines, state, audit, at = None, None, 0, START, "", 0

    def put(line: str) -> None:
        nonlocal lines
        digest.update((("\n" if lines else "") + line).encode())
        lines += 1

    def insertions() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            put(f"{ASKED[state][0]}:")
            state, at = ASKED[state][1], at + 1

    for new, run in ordering.runs(batches, ["conv"]):
        if new:
            if digest:
                yield pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": digest.hexdigest()}], schema)
            conv, digest, lines = run.column("conv")[0].as_py(), hashlib.sha256(), 0
        for tag, start, own, role, initial, text in zip(*(run.column(c).to_pylist() for c in columns)):
            if tag == 0:
                state, audit, at = start, own, 0
                insertions()
                continue
            edit, at = audit[at], at + 1
            if edit == "K":
                put(f"{role}:{text}")
                state = KEPT[state, initial]
            elif edit == "R":
                put(f"{ASKED[state][0]}:{text}")
                state = ASKED[state][1]
            insertions()
    if digest:
        yield pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": digest.hexdigest()}], schema)
    common.give_back()


def _over_partitions(rows: DataFrame) -> DataFrame:
    """Results of conversations that go on over partitions."""
    at, part = ordering.AT, ordering.PART
    marks = rows.where(F.col("fault") != BLANK).select(F.concat("conv", F.lit("\0"), F.hex("same")).alias("group"), F.col(at).alias("place"))
    again = ordering.numbered(ordering.placed(marks, "group", [F.col("place")]), "group").where("_pos > 0").select(F.col("place").alias(at), F.lit(True).alias("again"))
    narrow = rows.select("conv", part, at, "turn", "initial", "fault").join(again, at, "left")
    narrow = narrow.withColumn("fault", F.when(F.col("again"), DUPLICATE).otherwise(F.col("fault"))).drop("again")
    pieces = narrow.repartition("conv", part).sortWithinPartitions("conv", part, at).mapInArrow(_piece_batches, _PIECE)
    whole = stored(pieces.groupBy("conv").applyInArrow(_joined_pieces, _JOINED), "repairs")
    heads = whole.select("conv", F.explode("pieces").alias("p")).select("conv", F.col("p.part").alias(part), F.lit(0).alias("tag"), "p.start", "p.audit")
    lines = heads.unionByName(rows.select("conv", part, F.lit(1).alias("tag"), at, "role", "initial", "text"), allowMissingColumns=True)
    lines = lines.repartition("conv").sortWithinPartitions("conv", part, "tag", at)
    digests = lines.mapInArrow(_hash_batches, "conv string, repaired_sha256 string")
    return whole.drop("pieces").join(digests, "conv")


def repair(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``conv_id``, the counts of faults, ``cost``, ``audit`` and the digest of the repaired rows.

    ``rows`` holds the conversations' rows as they are to be repaired; ``ids`` every
    conversation that is to have a result, whether it has rows or not.
    """
    placed = ordering.placed(_features(rows), "conv", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")])
    over = ordering.spanning(placed, "conv").select("conv").distinct()
    over = F.broadcast(rows.sparkSession.createDataFrame([r["conv"] for r in over.collect()], "string").toDF("conv"))  # fewer than partitions
    within = placed.join(over, "conv", "left_anti").mapInArrow(_whole_batches, _RESULT)
    results = within.unionByName(_over_partitions(placed.join(over, "conv", "left_semi")))
    every = ids.select("conv_id").distinct().select(ordering.group_key("conv_id").alias("conv"), "conv_id")
    filled = {c: F.coalesce(c, F.lit(0).cast("long")) for c in _COUNTS}
    filled |= {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))}
    return every.join(results, "conv", "left").withColumns(filled).drop("conv")
