"""Conversation structure repair: generalised LR parsing of role sequences with weighted edits.

The roles of a conversation, told by their initials, have to follow the grammar

    S -> s P | P | nothing          P -> u a | P u a

A conversation is parsed left to right by the LR automaton of that grammar. Where rows don't fit, all
edits are tried at once: a graph-structured stack holds the stacks of all readings, and readings whose
stacks have the same top are merged into the one of least (cost, audit). An edit is one of

- K, keep the row: 0
- R, rerole it to user or assistant: 2
- D, delete it: 3, the only edit of a row that is blank or a duplicate
- I, insert an empty user or assistant row: 2, before any row or at the end

and a row that is truncated and not deleted costs 1 more. The audit is the edits' letters in order. Two
readings with one top that have taken the same rows and cost the same never have audits of which one
begins the other (the letters tell the cost), so whatever follows keeps their order, and merging is
exact: what is left at the end is the cheapest repair, ASCII-least in its audit on ties.

A row's first fault counts: blank (no character but white space), duplicate (role and text seen
earlier in the conversation), truncated (its last other character is none of ``.!?``).

How it runs: the first turn of each (conversation, role, text) comes from a partial aggregate and a
join, so that a text repeated by a third of all rows is no hot group. Rows are dealt by
conversation, sorted by turn and numbered. The parser then reads them without their texts, sorted, over
Arrow batches: its state is the tops (six at most) and the edits that they don't share yet, so a
conversation of any length passes in constant memory but for readings that stay apart, at some bytes a row.
Edits are written, then joined to the rows by conversation and number. One conversation is
read by one task at a time, since each edit depends on all rows before.

Defined results: nulls in role and text are one space (blank, and of no known role); null turns come first;
rows of one turn go by role and text; a null conversation id is a conversation; repeated rows are
duplicates; roles count by their first character, in lower case as written, and an empty role fits nowhere;
a conversation all of whose rows are absent has zeros, an empty audit and no rows; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import settle

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
SOLID, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
#: Rows after which edits that all readings share are sent off, and rows of an output batch.
SHARED_AFTER, BATCH = 256, 8192
EDITS = "conv_id {0}, at bigint, inserted string, edit string, role string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"

#: The automaton: shifts of s and u by state; u a and P u a are reduced as soon as a is read.
SHIFTS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (4, "u"): 6, (5, "u"): 6}
GOTO_P = {0: 4, 1: 5}
ACCEPTED = (0, 4, 5)
#: Tops after a user, or an assistant, row; and what it costs at most to follow, from a stack of either kind, the
#: rest of a reading with another top: an assistant or user row more, and a system row less. A reading that is dearer
#: than that can't win any more, and is given up.
AFTER = {"u": (2, 6), "a": (4, 5)}
FOLLOWS = {
    "a": {0: DELETE, 1: 0, 2: INSERT, 6: INSERT, 4: 0, 5: 0},
    "u": {0: DELETE + INSERT, 1: INSERT, 2: 0, 6: 0, 4: INSERT, 5: INSERT},
}


def push(node: tuple, x: str) -> tuple | None:
    """The stack (top state, stack below) after a symbol, or None."""
    state, below = node
    if x == "a" and state == 2:  # P -> u a
        return GOTO_P[below[0]], below
    if x == "a" and state == 6:  # P -> P u a
        return GOTO_P[below[1][0]], below[1]
    to = SHIFTS.get((state, x))
    return None if to is None else (to, node)


@dataclass
class Parse:
    """The graph-structured stack of one conversation: for each top (cost, rank of the audit, letters
    since, stack, path); a path is [path before, edit], an edit (inserted initials, letter, new role)."""

    tops: dict[int, tuple] = field(default_factory=lambda: {0: (0, 0, "", (0, None), [None, None])})

    def _with_inserts(self) -> list[tuple]:
        """The tops and what inserting makes of them, as (cost, rank, letters, stack, path, inserted)."""
        found = {state: (*top, "") for state, top in self.tops.items()}
        todo = list(found.values())
        while todo:
            cost, rank, letters, node, path, inserted = todo.pop()
            for x in ROLES:
                if (to := push(node, x)) is not None:
                    new = (cost + INSERT, rank, letters + "I", to, path, inserted + x)
                    if to[0] not in found or new[:3] < found[to[0]][:3]:
                        found[to[0]] = new
                        todo.append(new)
        return list(found.values())

    def row(self, initial: str, fault: int) -> None:
        best: dict[int, tuple] = {}

        def offer(cost: int, rank: int, letters: str, node: tuple | None, *edit) -> None:
            if node is not None and (node[0] not in best or (cost, rank, letters) < best[node[0]][:3]):
                best[node[0]] = (cost, rank, letters, node, *edit)

        for cost, rank, letters, node, path, inserted in self._with_inserts():
            offer(cost + DELETE, rank, letters + "D", node, path, (inserted, "D", None))
            if fault not in (BLANK, DUPLICATE):
                more = CUT if fault == TRUNCATED else 0
                offer(cost + KEEP + more, rank, letters + "K", push(node, initial), path, (inserted, "K", None))
                for x, role in ROLES.items():
                    offer(cost + REROLE + more, rank, letters + "R", push(node, x), path, (inserted, "R", role))
        least = {kind: min((best[x][0] for x in states if x in best), default=None) for kind, states in AFTER.items()}
        for state in [x for x in best if any(least[kind] is not None and best[x][0] > least[kind] + more[x] for kind, more in FOLLOWS.items())]:
            del best[state]
        ranks = {key: i for i, key in enumerate(sorted({(x[1], x[2]) for x in best.values()}))}
        self.tops = {state: (x[0], ranks[x[1], x[2]], "", x[3], [x[4], x[5]]) for state, x in best.items()}

    def shared(self) -> list[tuple]:
        """The edits that all readings share, in order; they are forgotten here."""
        paths = [top[4] for top in self.tops.values()]
        while any(p is not paths[0] for p in paths):
            paths = [p[0] for p in paths]
        out, at = [], paths[0]
        while at is not None and at[1] is not None:
            out.append(at[1])
            at = at[0]
        paths[0][0], paths[0][1] = None, None
        return out[::-1]

    def end(self) -> tuple[int, list[tuple]]:
        """(cost, edits not sent off yet) of the cheapest reading."""
        cost, _, _, _, path, inserted = min((x for x in self._with_inserts() if x[3][0] in ACCEPTED), key=lambda x: x[:3])
        out = [(inserted, "", None)] if inserted else []
        while path is not None and path[1] is not None:
            out.append(path[1])
            path = path[0]
        return cost, out[::-1]


def _parsed(kind: str):
    """Edits and, with a null `at`, the summary of each conversation, of rows sorted by conversation and number."""
    schema = None
    names = [c.split(" ")[0] for c in EDITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal schema
        out: list[tuple] = []
        now, parse = None, None

        def begin(conv_id):
            nonlocal now, parse, total, turns, before, audit, done
            now, parse = (conv_id,), Parse()
            total, turns, before, audit, done = [0, 0, 0, 0], [None, None, 0], None, [], 0

        total, turns, before, audit, done = [0, 0, 0, 0], [None, None, 0], None, [], 0

        def send(edits: list[tuple]) -> None:
            nonlocal done
            for inserted, letter, role in edits:
                out.append((now[0], done, inserted, letter, role, *[None] * 7))
                audit.append("I" * len(inserted) + letter)
                done += 1
            audit[:] = ["".join(audit)] if len(audit) > BATCH else audit

        def finish() -> None:
            cost, edits = parse.end()
            send(edits)
            gaps = 0 if turns[0] is None else turns[1] - turns[0] + 1 - turns[2]
            out.append((now[0], None, None, None, None, gaps, *total, cost, "".join(audit)))

        def batch() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            found = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema, strict=True)], names=names)
            out.clear()
            return found

        for part in batches:
            schema = [part.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.string()]
            for conv_id, at, turn, initial, fault in zip(*(part.column(c).to_pylist() for c in ("conv_id", "at", "turn", "initial", "fault")), strict=True):
                if now != (conv_id,):
                    if now is not None:
                        finish()
                    begin(conv_id)
                if at is None:
                    continue
                if turn is not None and turn != turns[1]:
                    turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
                if fault:
                    total[fault - 1] += 1
                total[3] += before is not None and before + initial not in ("su", "ua", "au")
                before = initial
                parse.row(initial, fault)
                if at % SHARED_AFTER == SHARED_AFTER - 1:
                    send(parse.shared())
                if len(out) >= BATCH:
                    yield batch()
            if out:
                yield batch()
        if now is not None:
            finish()
            yield batch()

    return run


def ordered(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """conv_id, at (from 0, in order of turn), turn, role, text and fault (0, or the first of 1 blank, 2
    duplicate, 3 truncated) of the rows that are present; a row of nulls names a conversation without any."""
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), there.alias("_there"))
    told = plain.withColumn("_said", F.sha2("text", 256)).withColumn("_turn", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    first = told.where("_there").groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("_said").alias("_s")).agg(F.min("_turn").alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_said") == F.col("_s"))
    known = told.join(first, same, "left").select("conv_id", "turn", "role", "text", "_there", F.coalesce(F.col("_turn") > F.col("_first"), F.lit(False)).alias("_later"))
    order = Window.partitionBy("conv_id").orderBy(F.col("_there").desc(), F.col("turn").asc_nulls_first(), "role", "text")
    again = (F.col("role") == F.lag("role").over(order)) & (F.col("text") == F.lag("text").over(order)) & F.col("turn").eqNullSafe(F.lag("turn").over(order))
    fault = F.when(~F.col("text").rlike(SOLID), BLANK).when(F.col("_later") | F.coalesce(F.col("_again"), F.lit(False)), DUPLICATE).when(~F.col("text").rlike(ENDED), TRUNCATED).otherwise(0)
    numbered = known.withColumns({"_again": again, "_at": F.row_number().over(order).cast("long") - 1})
    # Absent rows come last; one of them is enough, and only where no row is present.
    held = numbered.where(F.col("_there") | (F.col("_at") == 0))
    return held.select("conv_id", *(F.when(F.col("_there"), c).alias(n) for n, c in (("at", F.col("_at")), ("turn", F.col("turn")), ("role", F.col("role")), ("text", F.col("text")), ("fault", fault))))


@dataclass
class Repaired:
    """summary: a row for each conversation (conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit). rows: the repaired conversations (conv_id, place by which they are ordered, role, text, edit: K, R or I)."""

    summary: DataFrame
    rows: DataFrame


def repair(conversations: DataFrame, present: Column | None = None) -> Repaired:
    """Repair conversations (conv_id, turn, role, text). present: a condition; where it isn't true a row is absent."""
    read = settle(ordered(conversations, present), "turns")
    light = read.select("conv_id", "at", "turn", F.substring("role", 1, 1).alias("initial"), "fault")
    dealt = light.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    kind = dict(read.dtypes)["conv_id"]
    edits = settle(dealt.mapInArrow(_parsed(kind), EDITS.format(kind)), "edits")
    summary = edits.where("at IS NULL").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    done = edits.where("at IS NOT NULL").select(F.col("conv_id").alias("_conv"), F.col("at").alias("_at"), "inserted", "edit", F.col("role").alias("_role"))
    met = done.join(read, done["_conv"].eqNullSafe(read["conv_id"]) & (done["_at"] == read["at"]), "left")
    added = F.transform(F.split("inserted", ""), lambda x: F.struct(F.when(x == "u", ROLES["u"]).otherwise(ROLES["a"]).alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))
    own = F.struct(F.coalesce("_role", "role").alias("role"), F.col("text").alias("text"), F.col("edit").alias("edit"))
    none = F.array().cast("array<struct<role: string, text: string, edit: string>>")
    said = F.concat(F.when(F.col("inserted") != "", added).otherwise(none), F.when(F.col("edit").isin("K", "R"), F.array(own)).otherwise(none))
    out = met.select(F.col("_conv").alias("conv_id"), F.col("_at").alias("at"), F.posexplode(said).alias("nth", "_said"))
    return Repaired(summary, out.select("conv_id", F.struct("at", "nth").alias("place"), "_said.*"))


def digests(rows: DataFrame) -> DataFrame:
    """conv_id and sha256 of each conversation's `role:text` lines, joined by newlines, read as a sorted stream."""
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for part in batches:
            ids, found = [], []
            for conv_id, role, text in zip(*(part.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now == (conv_id,):
                    total.update(b"\n")
                else:
                    if now is not None:
                        ids.append(now[0])
                        found.append(total.hexdigest())
                    now, total = (conv_id,), hashlib.sha256()
                total.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, part.schema.field("conv_id").type), pa.array(found, pa.string())], names=["conv_id", "sha256"])
            last = part.schema.field("conv_id").type
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], last), pa.array([total.hexdigest()], pa.string())], names=["conv_id", "sha256"])

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """The rows of conversations with planned faults, by crc32 of `conv_id:turn` modulo 20: 0 absent
    (column `present`), 1 without text, 2 without its ``.!?``, 3 twice, 4 said by the user. Nulls are one space."""
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(show("conv_id"), F.lit(":"), show("turn"))) % 20
    rows = conversations.select("conv_id", "turn", show("role").alias("role"), show("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_kind") != 0).alias("present"), copies.alias("_copy")).drop("_copy")
