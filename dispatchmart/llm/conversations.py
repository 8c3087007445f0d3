"""Repair of conversations: the cheapest edits that bring their roles into order, by rank-convergence parallel Viterbi.

Rows are sorted by conversation and turn over the whole table and cut into ranges. A conversation that lies inside one range and
is of moderate size is repaired where it lies. Any other is cut into slices of bounded length that are worked on side by
side. Each slice runs backward from speculative costs, as if the conversation ended there. In fix-up passes a slice
whose right neighbour begins with other costs than it had assumed runs again from these, until its costs differ from
the earlier ones only by a constant; then all before is right already. Where costs do not converge (rows of one role only), the
next pass hands them on through eight times as many slices as the last, so the number of passes grows with the logarithm of
their number. The stitched costs then drive the trace: each slice tells where each of four states leads,
one scan over these answers gives each slice its entry, and all slices write their edits.

Defined results, for ``repair``: a null role or text is one blank; a null turn comes first and a null conversation is one, too;
rows of one turn are ordered by role, by the first 64 characters of the text, then by its hash, so equal rows lie side by side; a role
without a letter is of no known class; a repeated row is a duplicate of the first; a conversation without rows
(all absent) has zeros, an empty audit and no turns; an empty table gives an empty one; texts may be of any length;
other columns are not read. ``sha256`` of a conversation is a chain over all of its text, so a conversation cut into slices
streams through one task for it, and its audit is one value; nothing else brings a whole conversation together.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchmart.llm import viterbi as V
from dispatchmart.llm.common import saved, ship_package

SLICE_BITS = 12
"""A slice holds at most 2^12 rows."""
HELD_ROWS = 1 << 16
HELD_BYTES = 1 << 25
"""A task holds no more rows and bytes of text of one conversation; larger ones are cut into slices. Bounds memory only."""
GROWTH = 8

_BLANKS = " \t\n\x0b\x0c\r"
_ROWS = "conv_id long, at long, turn long, role string, text string, code int"
_FIRST_PASS = (
    f"{_ROWS}, whole boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, turns array<struct<role:string,text:string>>"
)
_TURN = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_KINDS = {
    "long": pa.int64(),
    "int": pa.int32(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()),
}


@dataclass(frozen=True)
class Repaired:
    """``conversations``: one row each, with faults, cost, audit and the digest of the repaired lines. ``turns``: the repaired rows."""

    conversations: DataFrame
    turns: DataFrame


def _or_blank(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, absent``: rows damaged by a hash of conversation and turn; dropped ones are ``absent``."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        _or_blank("role").alias("_role"),
        _or_blank("text").alias("_text"),
        (F.crc32(F.concat_ws(":", _or_blank("conv_id"), _or_blank("turn")).cast("binary")) % 20).alias("_way"),
    )
    way = F.col("_way")
    text = F.when(way == 1, "").when(way == 2, F.translate("_text", ".!?", "")).otherwise(F.col("_text"))
    rows = rows.select(
        "conv_id",
        "turn",
        F.when(way == 4, "user").otherwise(F.col("_role")).alias("role"),
        text.alias("text"),
        (way == 0).alias("absent"),
        F.when(way == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("_copies"),
    )
    return rows.select("conv_id", "turn", "role", "text", "absent", F.explode("_copies").alias("_copy")).drop("_copy")


def _coded(rows: DataFrame) -> DataFrame:
    """Rows with the code of class and fault, as far as a row by itself tells."""
    absent = F.coalesce(F.col("absent"), F.lit(False)) if "absent" in rows.columns else F.lit(False)
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(absent, "").otherwise(_or_blank("role")).alias("role"),
        F.when(absent, "").otherwise(_or_blank("text")).alias("text"),
        absent.alias("_absent"),
    )
    rows = rows.withColumn("_end", F.rtrim(F.col("text"), F.lit(_BLANKS)))
    fault = (
        F.when(F.col("_end") == "", V.BLANK)
        .when(F.substring("_end", -1, 1).isin(".", "!", "?"), V.NO_FAULT)
        .otherwise(V.TRUNCATED)
    )
    initial = F.substring("role", 1, 1)
    role_class = F.lit(len(V.CLASSES))
    for number, letter in enumerate(V.CLASSES):
        role_class = F.when(initial == letter, number).otherwise(role_class)
    code = F.when(F.col("_absent"), V.ABSENT).otherwise(role_class + 4 * fault)
    return rows.select("conv_id", "turn", "role", "text", code.cast("int").alias("code"))


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows cut into ranges and sorted, with their place ``at`` over all ranges; each range is one run of places."""
    keyed = rows.withColumns(
        {"_head": F.substring("text", 1, 64), "_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()}
    )
    keys = ["conv_id", "turn", "role", "_head", "_hash", "_row"]
    placed = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    return placed.select("conv_id", "at", "turn", "role", "text", "code")


def _record(schema: str, rows: list) -> pa.RecordBatch:
    names, kinds = zip(*(part.split() for part in schema.split(", ")))
    columns = list(zip(*rows)) or [()] * len(names)
    arrays = [pa.array(column, _TURN if kind.startswith("array<struct") else _KINDS[kind]) for column, kind in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, list(names))


def _repaired_whole(conv_id, rows: list) -> tuple:
    """The output row of a conversation whose rows (at, turn, role, text, code) are all here."""
    present = [row for row in rows if row[4] != V.ABSENT]
    codes, seen, counts = bytearray(), set(), [0] * 4
    for _, _, role, text, code in present:
        if (role, text) in seen and code // 4 != V.BLANK:
            code = V.code_of(code % 4, V.DUPLICATE)
        seen.add((role, text))
        codes.append(code)
        counts[code // 4] += 1
    after, costs, total = V.backward(codes, V.FINAL)
    steps = V.trace(codes, after, 0)
    last = V.ending(steps[-1].state if steps else 0)
    turns = []
    for (_, _, role, text, _), done in zip(present, steps):
        turns += [(name, "") for name in done.inserted]
        if done.stays:
            turns.append((done.role or role, text))
    turns += [(name, "") for name in last]
    audit = "".join(done.audit for done in steps) + "I" * len(last)
    numbers = {row[1] for row in present} - {None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = V.bad_neighbours(codes)[0]
    faults = counts[V.BLANK], counts[V.DUPLICATE], counts[V.TRUNCATED]
    turns = [{"role": role, "text": text} for role, text in turns]
    return (conv_id, None, None, None, None, None, True, gaps, *faults, illegal, total + costs[0], audit, turns)


def _first_pass(batches, held_rows: int):
    """Conversations that lie whole inside the range, repaired; the rows of all others, as they are."""
    current, rows, size, passing = object(), [], 0, True  # what comes first may have begun in the range before

    def as_they_are(conv_id, rows):
        return [(conv_id, *row, False, *[None] * 8) for row in rows]

    for batch in batches:
        out = []
        for conv_id, *row in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "at", "turn", "role", "text", "code"))):
            if conv_id != current:
                if rows and not passing:
                    out.append(_repaired_whole(current, rows))
                elif rows:
                    out += as_they_are(current, rows)
                passing = not isinstance(current, (int, type(None)))
                current, rows, size = conv_id, [], 0
            rows.append(row)
            size += len(row[3])
            if passing or len(rows) > held_rows or size > HELD_BYTES:
                passing = True
                out += as_they_are(current, rows)
                rows, size = [], 0
        yield _record(_FIRST_PASS, out)
    yield _record(_FIRST_PASS, as_they_are(current, rows))  # what comes last may go on in the range after


def _with_duplicates(rows: DataFrame) -> DataFrame:
    """Rows whose role and text an earlier row of the conversation has, marked in the code."""
    text_key = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    rows = rows.withColumn("_text", F.when(F.col("code") != V.ABSENT, text_key))
    first = rows.groupBy("conv_id", "_text").agg(F.min("at").alias("_first"))
    first = first.select(F.col("conv_id").alias("_of"), F.col("_text").alias("_same"), "_first")
    joined = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_of")) & F.col("_text").eqNullSafe(F.col("_same")))
    again = (F.col("at") > F.col("_first")) & F.col("_text").isNotNull() & (F.floor(F.col("code") / 4) != V.BLANK)
    code = F.when(again, F.col("code") % 4 + 4 * V.DUPLICATE).otherwise(F.col("code"))
    return joined.select("conv_id", "at", "turn", code.cast("int").alias("code"))


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _slices(rows: DataFrame, slice_bits: int) -> DataFrame:
    """``conv_id, k, n, first_at, codes``: the k-th of n slices of a conversation, one letter a row."""
    letters = F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda r: F.char(r["code"] + 64))
    cut = rows.withColumn("_slice", F.shiftright("at", slice_bits)).groupBy("conv_id", "_slice")
    slices = saved(cut.agg(F.min("at").alias("first_at"), F.array_join(letters, "").alias("codes")))
    numbered = slices.select("conv_id", "first_at").repartition("conv_id").sortWithinPartitions("conv_id", "first_at")

    def number(batches):
        current, k = object(), 0
        for batch in batches:
            out = []
            for conv_id, first_at in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "first_at"))):
                current, k = conv_id, k + 1 if conv_id == current else 1
                out.append((first_at, k))
            yield _record("_at long, k long", out)

    numbers = numbered.mapInArrow(number, "_at long, k long")
    # No place belongs to two conversations, so the first place names the slice.
    return slices.join(numbers, F.col("first_at") == F.col("_at")).drop("_at")


def _codes(text: str) -> bytes:
    return bytes(letter - 64 for letter in text.encode())


_SLICE = "conv_id long, k long, first_at long, codes string"
_COSTED = f"{_SLICE}, end array<int>, start array<int>, off long"


def _speculate(batches):
    """Each slice run backward as if the conversation ended with it."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            _, start, off = V.backward(_codes(row["codes"]), V.FINAL)
            out.append((row["conv_id"], row["k"], row["first_at"], row["codes"], V.FINAL, start, off))
        yield _record(_COSTED, out)


def _fix_up(batches):
    """Slices of a group from the last to the first; each runs again if what follows begins with other costs than assumed."""
    last = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            key = row["conv_id"], row["_group"], row["k"] + 1
            right = last[1] if last and last[0] == key else row["_right"]
            start, end, off = tuple(row["start"]), tuple(row["end"]), row["off"]
            if right is not None and tuple(right) != end:
                fresh, grown = V.rerun(_codes(row["codes"]), end, tuple(right))
                end, start, off = tuple(right), fresh or start, off + grown
            last = (row["conv_id"], row["_group"], row["k"]), start
            out.append((row["conv_id"], row["k"], row["first_at"], row["codes"], end, start, off))
        yield _record(_COSTED, out)


def _converged(slices: DataFrame) -> DataFrame:
    """Slices with the right costs at both ends, up to a constant."""
    costed, span = saved(slices.mapInArrow(_speculate, _COSTED)), 1
    while True:
        follows = costed.select(F.col("conv_id").alias("_of"), (F.col("k") - 1).alias("_k"), F.col("start").alias("_right"))
        joined = costed.join(follows, _same("conv_id", "_of") & (F.col("k") == F.col("_k")), "left").drop("_of", "_k")
        if joined.where("_right <> end").isEmpty():
            return costed
        groups = joined.withColumn("_group", F.floor(F.col("k") / span)).repartition("conv_id", "_group")
        ordered = groups.sortWithinPartitions("conv_id", "_group", F.desc("k"))
        costed, span = saved(ordered.mapInArrow(_fix_up, _COSTED)), span * GROWTH


_ENTRY = "entry_at long, entry int, bad long"


def _entries(costed: DataFrame) -> DataFrame:
    """The state in which each slice is entered, and its bad neighbours, by the first place of the slice."""
    outcome = "conv_id long, k long, first_at long, exits array<int>, heads array<int>, bad long"

    def leads_to(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                codes = _codes(row["codes"])
                after, _, _ = V.backward(codes, tuple(row["end"]))
                exits = [V.trace(codes, after, state)[-1].state for state in range(4)]
                bad, last = V.bad_neighbours(codes)
                head = next((code % 4 for code in codes if code != V.ABSENT), None)
                out.append((row["conv_id"], row["k"], row["first_at"], exits, [head, last], bad))
            yield _record(outcome, out)

    def enter(batches):
        current, state, last = object(), 0, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv_id"] != current:
                    current, state, last = row["conv_id"], 0, None
                head, tail = row["heads"]
                joint = V.bad_neighbours([] if head is None else [head], last)[0]
                out.append((row["first_at"], state, row["bad"] + joint))
                state, last = row["exits"][state], last if tail is None else tail
            yield _record(_ENTRY, out)

    led = costed.mapInArrow(leads_to, outcome)
    return led.repartition("conv_id").sortWithinPartitions("conv_id", "k").mapInArrow(enter, _ENTRY)


_EDIT = "edit_at long, edits string, inserted array<string>, stays boolean, new_role string, appended array<string>"


def _edits(entered: DataFrame) -> DataFrame:
    """What becomes of each row, by its place."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes = _codes(row["codes"])
                after, _, _ = V.backward(codes, tuple(row["end"]))
                steps = V.trace(codes, after, row["entry"])
                out = [
                    (row["first_at"] + i, done.audit, list(done.inserted), done.stays, done.role, [])
                    for i, done in enumerate(steps)
                ]
                if row["k"] == row["n"]:
                    last = V.ending(steps[-1].state)
                    out[-1] = (out[-1][0], out[-1][1] + "I" * len(last), *out[-1][2:5], last)
                yield _record(_EDIT, out)

    return entered.select("first_at", "codes", "end", "entry", "k", "n").mapInArrow(run, _EDIT)


def _digests(edited: DataFrame) -> DataFrame:
    """Audit and digest of each conversation; its rows stream through a task in their order."""
    schema = "digest_of long, audit string, repaired_sha256 string"

    def run(batches):
        current, audit, digest, lines = object(), [], hashlib.sha256(), 0

        def output():
            return (current, "".join(audit), digest.hexdigest())

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv_id"] != current:
                    if isinstance(current, (int, type(None))):
                        out.append(output())
                    current, audit, digest, lines = row["conv_id"], [], hashlib.sha256(), 0
                audit.append(row["edits"])
                for turn in row["turns"]:
                    digest.update(f"{chr(10) if lines else ''}{turn['role']}:{turn['text']}".encode("utf-8", "replace"))
                    lines += 1
            yield _record(schema, out)
        if isinstance(current, (int, type(None))):
            yield _record(schema, [output()])

    ordered = edited.select("conv_id", "at", "edits", "turns").repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return ordered.mapInArrow(run, schema)


def _in_slices(rows: DataFrame, slice_bits: int) -> Repaired:
    """Conversations of any length, slice by slice."""
    marked = saved(_with_duplicates(rows))
    costed = _converged(_slices(marked, slice_bits))
    entered = costed.join(saved(_entries(costed)), F.col("first_at") == F.col("entry_at"))
    totals = entered.groupBy(F.col("conv_id").alias("_of")).agg(
        F.sum("bad").alias("illegal"),
        (F.sum("off") + F.max(F.when(F.col("k") == 1, F.col("start")[0]))).alias("cost"),
        F.max("k").alias("_n"),
    )
    totals = saved(totals)
    numbered = entered.join(totals.select("_of", F.col("_n").alias("n")), _same("conv_id", "_of"))
    empty_text = lambda role: F.struct(role.alias("role"), F.lit("").alias("text"))
    own = F.array(F.struct(F.coalesce("new_role", "role").alias("role"), "text"))
    none = F.array().cast("array<struct<role:string,text:string>>")
    turns = F.concat(
        F.transform("inserted", empty_text), F.when(F.col("stays"), own).otherwise(none), F.transform("appended", empty_text)
    )
    edited = saved(rows.join(_edits(numbered), F.col("at") == F.col("edit_at")).select("conv_id", "at", "edits", turns.alias("turns")))
    here = F.col("code") != V.ABSENT
    fault = F.floor(F.col("code") / 4)
    turn = F.when(here, F.col("turn"))
    gaps = F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn)
    faults = marked.groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).alias("gaps"),
        F.count_if(fault == V.BLANK).alias("blank"),
        F.count_if(fault == V.DUPLICATE).alias("duplicate"),
        F.count_if(fault == V.TRUNCATED).alias("truncated"),
    )
    whole = faults.join(totals, _same("conv_id", "_of")).join(_digests(edited), _same("conv_id", "digest_of"))
    return Repaired(whole.drop("_of", "_n", "digest_of"), edited.select("conv_id", "at", "turns"))


def repair(rows: DataFrame, held_rows: int = HELD_ROWS, slice_bits: int = SLICE_BITS) -> Repaired:
    """Faults, cheapest edits and repaired turns of conversations given as ``conv_id, turn, role, text``.

    A row with a true ``absent`` column only names its conversation.
    """
    ship_package(rows.sparkSession)
    first = saved(_in_order(_coded(rows)).mapInArrow(lambda batches: _first_pass(batches, held_rows), _FIRST_PASS))
    whole = first.where("whole")
    sliced = _in_slices(first.where("not whole").select("conv_id", "at", "turn", "role", "text", "code"), slice_bits)
    lines = F.transform("turns", lambda turn: F.concat(turn["role"], F.lit(":"), turn["text"]))
    digest = F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256")
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    together = whole.select(*columns, digest).unionByName(sliced.conversations.select(*columns, "repaired_sha256"))
    turns = whole.select("conv_id", F.lit(0).cast("long").alias("at"), "turns").unionByName(sliced.turns)
    placed = turns.select("conv_id", "at", F.posexplode("turns").alias("i", "_turn"))
    return Repaired(together, placed.select("conv_id", "at", "i", "_turn.*"))
