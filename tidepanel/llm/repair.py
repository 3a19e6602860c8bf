"""Repair of conversations: faults of their rows, and the cheapest edits to a legal order of roles, by weighted CYK parsing.

The legal orders are (s?(ua)+)? in initials of roles. The grammar is in Chomsky normal form: a nonterminal is a pair of
states of that expression (nothing yet, after s, after u, after a), and stands for all that leads from the one to the
other; its rules are (p, q) -> (p, r) (r, q). A cell holds the least (cost, audit) of a nonterminal over a span of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import ASCII_SPACE, durable, in_order, session

#: Rows of a chart; spans of this many charts or spans are combined in one step.
BLOCK = 16
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. What each initial does.
STEPS = {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}
INITIALS = "sua"
FAULTS = ("none", "blank", "duplicate", "truncated")
FINAL = (0, 3)
#: Nonterminals, those that some rows can be; and the rules, by number.
PAIRS = [(p, q) for p in range(4) for q in range(4) if p == q or q > 1 or (p, q) == (0, 1)]
RULES = [(PAIRS.index((p, r)), PAIRS.index((r, q)), PAIRS.index((p, q))) for p, r in PAIRS for s, q in PAIRS if s == r and (p, q) in PAIRS]
LEGAL = {"su", "ua", "au"}

Cell = tuple[int, str] | None


def _closed(paths: dict[tuple[int, int], Cell]) -> dict[tuple[int, int], Cell]:
    """The least cost of inserted rows from state to state: the closure of single insertions."""
    for r in range(4):
        for p in range(4):
            for q in range(4):
                a, b = paths.get((p, r)), paths.get((r, q))
                if a and b:
                    paths[p, q] = min(paths.get((p, q)) or (a[0] + b[0], a[1] + b[1]), (a[0] + b[0], a[1] + b[1]))
    return paths


INSERTED = _closed({(p, p): (0, "") for p in range(4)} | {step: (INSERT, "I") for i in "ua" for step in STEPS[i]})


@lru_cache(maxsize=None)
def row_cells(code: str) -> tuple[Cell, ...]:
    """The cells of one row (see coded) with what may be inserted before and after it."""
    initial, fault = (*INITIALS, "")[(ord(code) - 65) // 4], FAULTS[(ord(code) - 65) % 4]
    edits = [((p, p), DELETE, "D") for p in range(4)]
    if fault in ("none", "truncated"):
        more = TRUNCATED if fault == "truncated" else 0
        edits += [(step, KEEP + more, "K") for step in STEPS.get(initial, [])]
        edits += [(step, REROLE + more, "R") for i in "ua" for step in STEPS[i]]
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for (p, q), cost, letter in edits:
        for (a, b), before in INSERTED.items():
            for (c, d), after in INSERTED.items():
                if b == p and c == q:
                    cell = (before[0] + cost + after[0], before[1] + letter + after[1])
                    best[a, d] = min(best.get((a, d), cell), cell)
    return tuple(best.get(x) for x in PAIRS)


def combined(best: list[Cell], left: tuple[Cell, ...], right: tuple[Cell, ...]) -> list[Cell]:
    """best, or what the rules make of two neighbouring spans where that is less.

    Audits of equal cost over the same rows are never beginnings of one another (one more insertion costs more), so the
    least audits of the parts make the least of the whole.
    """
    for a, b, x in RULES:
        if left[a] and right[b]:
            cost, old = left[a][0] + right[b][0], best[x]
            if old is None or cost < old[0] or cost == old[0] and left[a][1] + right[b][1] < old[1]:
                best[x] = (cost, left[a][1] + right[b][1])
    return best


@lru_cache(maxsize=100_000)
def chart(codes: str) -> tuple[Cell, ...]:
    """The cells of a block of rows, bottom-up by the length of spans, over all splits of each."""
    n = len(codes)
    cells = {(i, i + 1): row_cells(c) for i, c in enumerate(codes)}
    for width in range(2, n + 1):
        for i in range(n - width + 1):
            best: list[Cell] = [None] * len(PAIRS)
            for k in range(i + 1, i + width):
                best = combined(best, cells[i, k], cells[k, i + width])
            cells[i, i + width] = tuple(best)
    return cells[0, n]


def illegal(initials: str) -> int:
    """Neighbours in a legal order of roles that aren't su, ua or au."""
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) as a faulty recorder would leave them, by crc32 of conv_id:turn modulo 20.

    0 drops a row, 1 empties its text, 2 takes .!? out of it, 3 repeats the row, 4 makes it the user's. Nulls count as one
    space in what is hashed and as role or text; conv_id and turn stay null.
    """
    kind = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(k).cast("string"), F.lit(" ")) for k in ("conv_id", "turn")))) % 20
    role, text = (F.coalesce(k, F.lit(" ")) for k in ("role", "text"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(text, ".!?", "")).otherwise(text)
    left = rows.select("conv_id", "turn", "role", "text", kind.alias("_kind")).filter("_kind > 0")
    return left.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def ordered(rows: DataFrame) -> DataFrame:
    """rows with _place: by conversation, turn (nulls first), role, text; and what their faults need. Written once.

    A conversation of any length is spread over ranges of its rows; a range ends by a text's first 64 characters.
    """
    session(rows.sparkSession)
    stripped = F.rtrim("text", F.lit(ASCII_SPACE))
    initial = F.substring("role", 1, 1)
    of = reduce(lambda out, k: F.when(initial == INITIALS[k], k).otherwise(out), range(len(INITIALS)), F.lit(len(INITIALS)))
    out = rows.select("conv_id", "turn", *(F.coalesce(k, F.lit(" ")).alias(k) for k in ("role", "text")))
    out = out.withColumns({"_blank": stripped == "", "_cut": ~F.right(stripped, F.lit(1)).isin(".", "!", "?"), "_initial": of, "_same": F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))})
    return in_order(out, [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.substring("text", 1, 64)], [F.col("text")])


def coded(rows: DataFrame) -> DataFrame:
    """Of each row of ordered(): conv_id, turn, _place, fault (its first, or none) and code, a letter for initial and fault."""
    own = rows.select("conv_id", "turn", "_place", "_blank", "_cut", "_initial", "_same")
    again = own.filter("not _blank").groupBy(F.col("conv_id").alias("_conv"), F.col("_same").alias("_key")).agg(F.min("_place").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    both = own.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_same") == F.col("_key")), "left")
    fault = F.when(F.col("_blank"), 1).when(F.col("_place") > F.col("_first"), 2).when(F.col("_cut"), 3).otherwise(0)
    letter = F.substring(F.lit("".join(chr(65 + k) for k in range(16))), 4 * F.col("_initial") + F.col("_fault") + 1, F.lit(1))
    return durable(both.withColumn("_fault", fault).select("conv_id", "turn", "_place", F.element_at(F.array(*map(F.lit, FAULTS)), F.col("_fault") + 1).alias("fault"), letter.alias("code")))


_CELLS = "first string, last string, illegal long, cells array<struct<cost: long, audit: string>>"


def _spans(kind: str, parse):
    """A mapInArrow function: rows (conv_id, place, parts) to rows (conv_id, place, first, last, illegal, cells)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(x) for x in batch.column(2).to_pylist()]
            cells = [[c and {"cost": c[0], "audit": c[1]} for c in r[3]] for r in rows]
            columns = [pa.array([r[k] for r in rows], t) for k, t in ((0, pa.string()), (1, pa.string()), (2, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array(cells, pa.list_(pa.struct({"cost": pa.int64(), "audit": pa.string()})))], names=["conv_id", "place", "first", "last", "illegal", "cells"])

    return lambda df: df.mapInArrow(run, f"conv_id {kind}, place long, {_CELLS}")


def _of_codes(codes: str):
    initials = "".join((*INITIALS, "-")[(ord(c) - 65) // 4] for c in codes)
    return initials[0], initials[-1], illegal(initials), chart(codes)


def _of_spans(spans: list[dict]):
    """Neighbouring spans as one."""
    cells = reduce(lambda a, b: tuple(combined([None] * len(PAIRS), a, b)), ([c and (c["cost"], c["audit"]) for c in s["cells"]] for s in spans))
    between = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(spans, spans[1:], strict=False))
    return spans[0]["first"], spans[-1]["last"], between + sum(s["illegal"] for s in spans), cells


def parsed(codes: DataFrame) -> DataFrame:
    """conv_id, cost, audit, illegal of each conversation of coded().

    Charts of BLOCK rows, then spans of BLOCK charts and so on, until a conversation has no more than BLOCK spans, which
    become one: whatever its length, no task holds more than BLOCK spans of it, and their audits.
    """
    kind = codes.schema["conv_id"].dataType.simpleString()
    in_turn = lambda what: F.array_sort(F.collect_list(F.struct(F.col("place").alias("_at"), what)))
    blocks = codes.withColumn("place", F.col("_place")).groupBy("conv_id", F.floor(F.col("_place") / BLOCK).alias("_block")).agg(in_turn(F.col("code").alias("code")).alias("rows"))
    spans = durable(_spans(kind, _of_codes)(blocks.select("conv_id", "_block", F.concat_ws("", F.col("rows.code")).alias("codes"))))

    def up(spans: DataFrame, place: Column) -> DataFrame:
        groups = spans.groupBy("conv_id", place.alias("_block")).agg(in_turn(F.struct("first", "last", "illegal", "cells").alias("span")).alias("rows"))
        return _spans(kind, _of_spans)(groups.select("conv_id", "_block", F.col("rows.span").alias("spans")))

    while (spans.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0) > BLOCK:
        spans = durable(up(spans, F.floor(F.col("place") / BLOCK)))
    whole = up(spans, F.lit(0).cast("long"))
    ends = [F.element_at("cells", PAIRS.index((0, q)) + 1) for q in FINAL]
    best = F.array_min(F.filter(F.array(*ends), lambda x: x.isNotNull()))
    return whole.select("conv_id", best["cost"].alias("cost"), best["audit"].alias("audit"), "illegal")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(number of the conversation, its id, edit, turn, role, text) of each row that stays or is inserted, and once for each
    conversation with edit None. Batches: for each conversation its audit (place -1), then its rows in order."""
    which, conv, audit, at, last, state = -1, None, "", 0, 0, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while audit[at : at + 1] == "I":
            role, state = ("assistant", 3) if state == 2 else ("user", 2)
            at += 1
            yield which, conv, "I", None, role, ""

    for batch in batches:
        for c, place, turn, role, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if place < 0:
                which, conv, audit, at, last, state = which + 1, c, text, 0, len(text.rstrip("I")), 0
                yield which, conv, None, None, None, None
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "R":
                role, state = ("assistant", 3) if state == 2 else ("user", 2)
            elif edit == "K":
                state = dict(STEPS[role[0]])[state]
            if edit != "D":
                yield which, conv, edit, turn, role, text
            if at == last:
                yield from inserted()


def _typed(batches: Iterator[pa.RecordBatch]) -> tuple[list[pa.DataType], Iterator[pa.RecordBatch]]:
    """The types of the columns, and the batches."""
    batches = iter(batches)
    first = next(batches, None)
    return (first.schema.types, chain([first], batches)) if first else ([pa.null()] * 5, iter(()))


def _in_turn(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The rows of each conversation in one partition, in order, after its audit."""
    audit = audits.select("conv_id", F.lit(-1).cast("long").alias("_place"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    return audit.unionByName(rows.select("conv_id", "_place", "turn", "role", "text")).repartition("conv_id").sortWithinPartitions("conv_id", "_place")


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), turn, role, text of the rows of each conversation after its audit's edits.

    rows: ordered(); audits: parsed(). Inserted rows have a null turn.
    """
    conv, turn = (rows.schema[k].dataType.simpleString() for k in ("conv_id", "turn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, batches = _typed(batches)
        kinds = [types[0], pa.int64(), pa.string(), types[2], pa.string(), pa.string()]
        names, out, last, place = ["conv_id", "place", "edit", "turn", "role", "text"], [], None, 0
        make = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        for which, c, edit, t, role, text in _edited(batches):
            place = 0 if which != last else place
            last = which
            if edit is not None:
                out.append((c, place, edit, t, role, text))
                place += 1
            if len(out) >= 256:
                yield make()
                out = []
        if out:
            yield make()

    return _in_turn(rows, audits).mapInArrow(run, f"conv_id {conv}, place long, edit string, turn {turn}, role string, text string")


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, of role:text of the repaired rows, joined by newlines.

    A hash runs over the lines one after another, so those of one conversation go through one task, as a sorted stream:
    one batch of them is held.
    """
    conv = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (kind, *_), batches = _typed(batches)
        ids, sums, own, glue = [], [], None, ""
        make = lambda: pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(sums, pa.string())], names=["conv_id", "repaired_sha256"])
        for _, c, edit, _, role, text in _edited(batches):
            if edit is None:
                sums += [own.hexdigest()] if own else []
                if len(sums) >= 1024:
                    yield make()
                    ids, sums = [], []
                ids.append(c)
                own, glue = hashlib.sha256(), ""
            else:
                own.update(f"{glue}{role}:{text}".encode())
                glue = "\n"
        if own:
            sums.append(own.hexdigest())
            yield make()

    return _in_turn(rows, audits).mapInArrow(run, f"conv_id {conv}, repaired_sha256 string")


def report(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of rows.

    rows: conv_id, turn, role, text. Rows are taken by turn (nulls first), then role, then text; a null role or text is one
    space; a null conv_id is a conversation. A fault is a row's first of blank, duplicate, truncated. ids (conv_id): what to
    report besides, with zeros, an empty audit and the hash of an empty string where it has no rows. Equal rows of a turn
    are copies, the later ones duplicates. Empty tables give empty ones.
    """
    placed = ordered(rows)
    codes = coded(placed)
    audits = durable(parsed(codes))
    count = lambda k: F.count_if(F.col("fault") == k).alias(k)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    faults = codes.groupBy("conv_id").agg(gaps, *map(count, FAULTS[1:]))
    every = faults.select("conv_id") if ids is None else faults.select("conv_id").unionByName(ids.select("conv_id")).distinct()
    out = every.withColumnRenamed("conv_id", "_id")
    for part in (faults, audits, digests(placed, audits)):
        out = out.join(part, F.col("_id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    zero = lambda k: F.coalesce(k, F.lit(0)).cast("long").alias(k)
    return out.select(F.col("_id").alias("conv_id"), *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
