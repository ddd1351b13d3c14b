"""Repair of conversation structure: the cheapest edits, and among them the least audit.

A conversation's rows in order of turn are edited so that the role initials read
``(s?(ua)+)?``: Keep costs 0, Rerole to user or assistant 2, Delete 3 (required
for blank and duplicate rows), Insert of an empty user or assistant row 2; a
truncated row that stays adds 1.  The audit is the edits' initials in order.

The states of the pattern (nothing yet, after s, after u, after a) before every
row are nodes, edits are arcs.  A backward dynamic program gives every node its
cost; it works on cost vectors less their least value, of which there are few,
so a row is one look-up.  Of the arcs on cheapest paths the nodes get ranks by the
audits of length 1, 2, 4, ... that start there (a pair of ranks of length n gives
the rank of length 2n); the ranks choose one arc per node and doubled pointers
read the path off.  Nodes of many conversations are ranked at once, a long one in
blocks of rows: here a letter leads from a node to one other, so what lies beyond
a block's border decides nothing within it.

In Spark, one pass over small rows (role initial, faults, digest of the text) in
order of turn gives audits, holding one byte a row; a second pass over the texts in
the same order streams each repaired text into its hash.  Both follow a sort that
spills.  A conversation is one sequence to its hash, and its audit is one value,
so its rows meet in one task, which streams them; copies of a row are one row
with a count before anything is shuffled, and duplicates are found by a map-side
aggregated first turn, not by a window.

Edge cases: null role, text, turn or conv_id read as one space where they are
written out; a null conv_id is a conversation; null turns come first; rows of
equal turn are ordered by role and by the digest of the text, copies adjacent;
a conversation without rows has zeros, an empty audit and the hash of nothing; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import ArrowStep, run_steps

_ROLES = {2: "user", 3: "assistant"}
_SPACE = " \t\n\x0b\x0c\r"
_LETTERS = "DIKR"  # ASCII order
_KEEP, _REROLE, _DELETE, _INSERT, _CUT = 0, 2, 3, 2, 1
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a; the audit may end in 0 and 3.
_AFTER_ROLE = (2, 2, 3, 2)  # a user or assistant row, whichever the state allows
_AFTER_KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "": (None,) * 4}
_BLOCK = 1 << 16
_OK, _TRUNCATED, _MUST_GO = 0, 1, 2
_INITIALS = "sua"  # code of a row: 3 * place of its initial (3: another) + kind


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults set by crc32(``conv_id:turn``) % 20, and ``copies`` of each (0: dropped)."""
    space = F.lit(" ")
    fault = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                             F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), space)
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), space)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))


def _ends_well(text: Column) -> Column:
    return F.right(F.rtrim(text, F.lit(_SPACE)), F.lit(1)).isin(".", "!", "?")


def _ordered(df: DataFrame, *last: str) -> DataFrame:
    """Partitions of whole conversations, rows by turn (nulls first), role and digest."""
    return df.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), *last, F.col("turn").asc_nulls_first(), "role", "digest")


# ---------------------------------------------------------------- costs and ranks


class _Steps:
    """The backward step of the dynamic program: (row code, costs after it) to costs before it and optimal arcs."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.after: list[tuple[int, tuple]] = []  # (least cost, costs above it) before the row
        self.arcs: list[list[list[int]]] = []  # per state and letter: 4 * (1 if the next layer) + state, or -1

    def end(self) -> int:
        return self._step(None, (0, 0, 0, 0))

    def before(self, code: int, above: tuple) -> int:
        return self._step(code, above)

    def _step(self, code: int | None, above: tuple) -> int:
        key = (code, above)
        if key in self.known:
            return self.known[key]
        moves = [self._moves(code, s) for s in range(4)]
        costs = [min([c + (above[to] if code is not None else 0) for _, to, c in m], default=10 ** 9) for m in moves]
        for _ in range(4):  # inserts lead round u and a; their costs are positive
            costs = [min(c, _INSERT + costs[_AFTER_ROLE[s]]) for s, c in enumerate(costs)]
        arcs = [[-1] * 4 for _ in range(4)]
        for s in range(4):
            for letter, to, c in moves[s]:
                if letter is not None and c + above[to] == costs[s]:
                    arcs[s][_LETTERS.index(letter)] = 4 + to
            if _INSERT + costs[_AFTER_ROLE[s]] == costs[s]:
                arcs[s][1] = _AFTER_ROLE[s]
        least = min(costs)
        self.known[key] = len(self.after)
        self.after.append((least, tuple(c - least for c in costs)))
        self.arcs.append(arcs)
        return self.known[key]

    @staticmethod
    def _moves(code: int | None, state: int) -> list[tuple]:
        if code is None:  # the end of the conversation
            return [(None, state, 0)] if state in (0, 3) else []
        kind, initial = code % 3, "".join(_INITIALS[code // 3:code // 3 + 1])
        moves = [("D", state, _DELETE)]
        if kind != _MUST_GO:
            cut = _CUT if kind == _TRUNCATED else 0
            kept = _AFTER_KEEP[initial][state]
            if kept is not None:
                moves.append(("K", kept, _KEEP + cut))
            moves.append(("R", _AFTER_ROLE[state], _REROLE + cut))
        return moves


def _layers(codes: bytes, steps: _Steps) -> tuple[np.ndarray, int]:
    """The step of every row and of the end, and the cost from the start."""
    found = np.empty(len(codes) + 1, dtype=np.int32)
    found[-1] = step = steps.end()
    cost, above = steps.after[step]
    known, after = steps.known, steps.after
    for i in range(len(codes) - 1, -1, -1):
        step = known.get((codes[i], above), -1)
        if step < 0:
            step = steps.before(codes[i], above)
        found[i] = step
        least, above = after[step]
        cost += least
    return found, cost + above[0]


def _chosen(arcs: np.ndarray, beyond: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Per node the letter and the target of the arc that begins its least audit.

    ``arcs`` (nodes, letters) hold targets; the last ``beyond`` targets are no
    nodes here and end the audit, like a node without arcs.
    """
    n, m = len(arcs), len(arcs) + beyond
    has = np.concatenate([arcs >= 0, np.zeros((beyond, arcs.shape[1]), dtype=bool)])
    arcs = np.concatenate([arcs, np.full((beyond, arcs.shape[1]), -1)])
    ends, own = ~has.any(axis=1), np.arange(m)
    first = np.where(ends, 0, has.argmax(axis=1))
    pointer = np.where(ends, own, arcs[own, first])
    rank, count = np.where(ends, 0, first + 1), 0  # audits of length 1; an audit that has ended comes first
    while True:  # of length 2, 4, ...
        _, rank = np.unique(rank * (int(rank.max()) + 1) + rank[pointer], return_inverse=True)
        now, pointer = int(rank.max()) + 1, pointer[pointer]
        if now == count and ends[pointer].all():
            break
        count = now
    by_arc = np.where(has, np.arange(arcs.shape[1]) * (m + 1) + rank[np.where(has, arcs, 0)], np.iinfo(np.int64).max)
    best = np.where(ends, 0, by_arc.argmin(axis=1))
    return best[:n], np.where(ends, own, arcs[own, best])


def _read_off(start: np.ndarray, target: np.ndarray) -> np.ndarray:
    """(starts, steps) nodes of the paths from ``start``, by pointers of doubled reach, until all have come to rest."""
    nodes, pointer = start.reshape(-1, 1), target
    while (target[nodes[:, -1]] != nodes[:, -1]).any():
        nodes = np.concatenate([nodes, pointer[nodes]], axis=1)
        pointer = pointer[pointer]
    return nodes


def _paths(layers: np.ndarray, starts: np.ndarray, beyond: int = 0) -> tuple[list[str], np.ndarray]:
    """Least audits from the nodes ``starts`` through layers (layers, states, letters) of arcs, and where they end."""
    place = 4 * np.arange(len(layers)).reshape(-1, 1, 1)
    best, target = _chosen(np.where(layers >= 0, layers + place, -1).reshape(-1, len(_LETTERS)), beyond)
    nodes = _read_off(starts, target)
    signs = np.frombuffer(_LETTERS.encode(), dtype=np.uint8)[np.concatenate([best, np.zeros(beyond, dtype=np.int64)])]
    moved = target[nodes] != nodes
    return [signs[of][m].tobytes().decode() for of, m in zip(nodes, moved)], nodes[:, -1]


def audits(conversations: list[bytes], steps: _Steps | None = None) -> list[tuple[int, str]]:
    """(cost, audit) of each conversation, given as one code a row."""
    steps = steps or _Steps()
    layered = [_layers(c, steps) for c in conversations]
    table = np.array(steps.arcs, dtype=np.int64)  # steps, states, letters
    found: list[str] = [""] * len(conversations)
    waiting = sorted((i for i, c in enumerate(conversations) if len(c) < _BLOCK), key=lambda i: len(conversations[i]))
    while waiting:  # conversations of about one length are ranked and read off together
        longest = len(conversations[waiting[-1]]) + 1
        some = waiting[-max(1, _BLOCK // longest):]
        del waiting[-len(some):]
        sizes = [len(layered[i][0]) for i in some]
        texts, _ = _paths(table[np.concatenate([layered[i][0] for i in some])], 4 * (np.cumsum(sizes) - sizes))
        for i, text in zip(some, texts):
            found[i] = text
    for i, c in enumerate(conversations):
        if len(c) >= _BLOCK:
            found[i] = _long_audit(table, layered[i][0])
    return [(cost, text) for (_, cost), text in zip(layered, found)]


def _long_audit(table: np.ndarray, layers: np.ndarray) -> str:
    """Block after block, each from the state in which the one before it ended."""
    parts, state = [], 0
    for lo in range(0, len(layers), _BLOCK):
        block = table[layers[lo:lo + _BLOCK]]
        (text,), last = _paths(block, np.array([state]), 0 if lo + _BLOCK >= len(layers) else 4)
        parts.append(text)
        state = int(last[0]) - 4 * len(block)
    return "".join(parts)


# ---------------------------------------------------------------- operator


_NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_LEGAL = {"su", "ua", "au"}


class _Conversation:
    """What one pass over a conversation's rows in order gathers: counts and a byte a row."""

    def __init__(self):
        self.codes, self.turns, self.first, self.last = bytearray(), 0, None, None
        self.counts, self.before = dict.fromkeys(_NUMBERS, 0), None

    def add(self, turn, initial: str, copies: int, blank: bool, repeated: bool, well: bool) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        place = 3 * _INITIALS.index(initial) if initial and initial in _INITIALS else 9
        for k in range(copies):
            fault = "blank" if blank else "duplicate" if repeated or k else "" if well else "truncated"
            if fault:
                self.counts[fault] += 1
            if self.before is not None and self.before + initial not in _LEGAL:
                self.counts["illegal"] += 1
            self.before = initial
            self.codes.append(place + (_MUST_GO if fault in ("blank", "duplicate") else _TRUNCATED if fault else _OK))

    def numbers(self) -> dict[str, int]:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.counts | {"gaps": min(gaps, (1 << 63) - 1)}


def conversation_audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of ``rows`` (conv_id, turn, role, digest, blank, well, copies)."""
    same = ["conv_id", "turn", "role", "digest"]
    rows = rows.groupBy(*same).agg(F.sum("copies").alias("copies"), F.bool_and("blank").alias("blank"), F.bool_and("well").alias("well"))
    held = rows.where("copies > 0").groupBy("conv_id", "role", "digest").agg(
        F.min("turn").alias("first_turn"), F.bool_or(F.col("turn").isNull()).alias("null_turn"), F.count("*").alias("places"))
    again = held.where("places > 1").select(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "digest")], "first_turn", "null_turn")
    met = (rows["conv_id"].eqNullSafe(again["_conv_id"]) & (rows["role"] == again["_role"]) & (rows["digest"] == again["_digest"]))
    later = F.col("turn").isNotNull() & (F.col("null_turn") | (F.col("turn") > F.col("first_turn")))
    flagged = rows.join(again, met, "left").select(
        *same, F.substring("role", 1, 1).alias("initial"), F.col("copies").cast("long").alias("copies"), "blank",
        F.coalesce(later, F.lit(False)).alias("repeated"), "well")
    id_type = pa.int64() if dict(rows.dtypes)["conv_id"] == "bigint" else pa.string()
    schema = pa.schema([("conv_id", id_type), *[(n, pa.int64()) for n in _NUMBERS], ("audit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, done, held_rows = _Steps(), [], 0

        def out() -> pa.RecordBatch:
            results = audits([bytes(c.codes) for _, c in done], steps)
            numbers = [c.numbers() | {"cost": cost} for (_, c), (cost, _) in zip(done, results)]
            return pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in done], id_type), *[pa.array([r[n] for r in numbers], pa.int64()) for n in _NUMBERS],
                 pa.array([a for _, a in results], pa.string())], schema=schema)

        last, current = None, None
        for b in batches:
            for conv_id, turn, initial, copies, blank, repeated, well in zip(*(b.column(i).to_pylist() for i in (0, 1, 4, 5, 6, 7, 8))):
                if current is None or conv_id != last:
                    if current is not None:
                        done.append((last, current))
                        held_rows += len(current.codes) + 1
                        if held_rows >= _BLOCK:
                            yield out()
                            done, held_rows = [], 0
                    last, current = conv_id, _Conversation()
                if copies:
                    current.add(turn, initial, copies, blank, repeated, well)
        if current is not None:
            done.append((last, current))
            yield out()

    numbers = ", ".join(f"{n} long" for n in _NUMBERS)
    return _ordered(flagged).mapInArrow(run, f"conv_id {'long' if id_type == pa.int64() else 'string'}, {numbers}, audit string")


def _edited(rows: Iterator[tuple], audit: str) -> Iterator[tuple[str, bytes]]:
    """The repaired (role, text) rows of one conversation, from its rows (role, text, copies) in order."""
    state, edits = 0, iter(audit)

    def inserted() -> Iterator[tuple[str, bytes]]:
        nonlocal state
        for e in edits:
            if e != "I":
                return e
            state = _AFTER_ROLE[state]
            yield _ROLES[state], b""
        return None

    for role, text, copies in rows:
        for _ in range(copies):
            edit = yield from inserted()
            if edit == "K":
                state = _AFTER_KEEP[role[:1]][state]
                yield role, text
            elif edit == "R":
                state = _AFTER_ROLE[state]
                yield _ROLES[state], text
    yield from inserted()


def _repair_step(id_type: str) -> ArrowStep:
    """Audits and rows of whole conversations in order to (conv_id, place, role, text); place 0 opens a conversation."""
    arrow_type = pa.int64() if id_type == "bigint" else pa.string()
    schema = pa.schema([("conv_id", arrow_type), ("place", pa.int64()), ("role", pa.string()), ("text", pa.binary())])

    def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            ids, parts, roles, copies = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "part", "role", "copies"))
            texts = b.column(b.schema.get_field_index("text"))
            for i in range(b.num_rows):
                yield ids[i], parts[i], roles[i], texts[i].as_py(), copies[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = rows_in(batches)
        head = next(source, None)

        def own() -> Iterator[tuple]:
            nonlocal head
            head = None
            for row in source:
                if row[1] == 0:
                    head = row
                    return
                yield row[2:]

        held, size = [], 0
        while head is not None:
            conv_id, audit = head[0], head[3].decode()
            held.append((conv_id, 0, None, None))
            for place, (role, text) in enumerate(_edited(own(), audit), start=1):
                held.append((conv_id, place, role, text))
                size += len(text)
                if len(held) >= 4096 or size >= 1 << 22:
                    yield _batch(held, schema)
                    held, size = [], 0
        yield _batch(held, schema)

    return ArrowStep(run, T.StructType([T.StructField("conv_id", T.LongType() if id_type == "bigint" else T.StringType()),
                                        T.StructField("place", T.LongType()), T.StructField("role", T.StringType()),
                                        T.StructField("text", T.BinaryType())]))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def repaired_digest_step(step: ArrowStep) -> ArrowStep:
    """(conv_id, repaired_sha256) of the rows of ``_repair_step``: sha-256 of ``role:text``, newline-joined."""
    id_field = step.schema["conv_id"]
    schema = pa.schema([("conv_id", pa.int64() if isinstance(id_field.dataType, T.LongType) else pa.string()),
                        ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, current, digest = [], None, None
        for b in batches:
            for conv_id, place, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if place == 0:
                    if digest is not None:
                        done.append((current, digest.hexdigest()))
                    current, digest = conv_id, hashlib.sha256()
                else:
                    digest.update((b"" if place == 1 else b"\n") + role.encode() + b":" + text)
            yield _batch(done, schema)
            done = []
        if digest is not None:
            yield _batch([(current, digest.hexdigest())], schema)

    return ArrowStep(run, T.StructType([id_field, T.StructField("repaired_sha256", T.StringType())]))


def judge_conversations(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text, copies): counts of faults, cost and audit.

    ``copies`` is how often a row stands there; rows with 0 only name their conversation.
    """
    return conversation_audits(_with_digest(rows).select(
        "conv_id", "turn", "role", "digest", (F.rtrim("text", F.lit(_SPACE)) == "").alias("blank"),
        _ends_well(F.col("text")).alias("well"), "copies"))


def _with_digest(rows: DataFrame) -> DataFrame:
    if dict(rows.dtypes)["conv_id"] != "bigint":
        rows = rows.withColumn("conv_id", F.col("conv_id").cast("string"))
    return rows.withColumn("digest", F.sha2("text", 256))


def repair_conversations(rows: DataFrame, judged: DataFrame, digest: bool = False) -> DataFrame:
    """The repaired rows (conv_id, place, role, text), or with ``digest`` (conv_id, repaired_sha256) of every conversation."""
    null = F.lit(None)
    rows = _with_digest(rows)
    first = judged.select("conv_id", F.lit(0).alias("part"), null.cast("long").alias("turn"), F.lit("").alias("role"),
                          F.lit("").alias("digest"), F.col("audit").cast("binary").alias("text"), F.lit(0).alias("copies"))
    texts = rows.where("copies > 0").select("conv_id", F.lit(1).alias("part"), "turn", "role", "digest",
                                            F.col("text").cast("binary").alias("text"), "copies")
    step = _repair_step(dict(rows.dtypes)["conv_id"])
    ordered = _ordered(first.unionByName(texts), "part")
    if digest:
        return run_steps(ordered, step, repaired_digest_step(step))
    return run_steps(ordered, step).where("place > 0").withColumn("text", F.col("text").cast("string"))
