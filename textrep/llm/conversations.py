"""Faults of conversations and their cheapest repair.

A conversation's turns are put in order by range, so a long one lies in several parts
and is cut into blocks; first copies come from counts of each (role, text). A block's
turns become symbols (``grammar``). Conversations inside one block are repaired there; of
those on its borders the block gives the matrix, and the matrices of one conversation
are multiplied in order. Texts are shuffled once, at the end, to follow the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrep.llm import grammar
from textrep.llm.grammar import Rope
from textrep.session import cut_lineage

BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: Rows of a block, as a power of two, and symbols that share a grammar.
BLOCK_BITS = 12
GRAMMAR_SYMBOLS = 1 << 16
NAMES = {"s": "system", "u": "user", "a": "assistant"}

STATS = "blank long, duplicate long, truncated long, illegal long, gaps long"


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turn, role, text, copies)`` with faults by crc32 of ``conv:turn`` modulo 20; a null is one blank.

    0 drops the row (no copies), 1 empties its text, 2 removes the signs that end
    a sentence, 3 repeats the row, 4 makes it the user's.
    """
    blank = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))) % 20
    said = F.coalesce(F.col(text), blank)
    return rows.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col(role), blank)).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(said, ENDS, "")).otherwise(said).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def as_they_are(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turn, role, text, copies)`` without any fault put in."""
    blank = F.lit(" ")
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), blank).alias("role"), F.coalesce(F.col(text), blank).alias("text"), F.lit(1).alias("copies")
    )


def _symbols(rows: DataFrame) -> DataFrame:
    """``rows`` with the hash of the text, the role's number and the symbol a first copy has."""
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(grammar.OTHER)
    symbol = F.when(last == "", grammar.DELETED).otherwise(1 + 2 * number + F.when(last.isin(*ENDS), 0).otherwise(1))
    return rows.withColumns({"hash": F.sha2("text", 256), "number": number, "symbol": symbol})


def _order() -> list[Column]:
    return [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("hash")]


def _segments(group: pa.Table) -> pa.Table:
    """The turns of each conversation in a block as symbols, with what can be counted in the block."""
    group = group.combine_chunks()
    firsts = group.filter(group.column("first")).column("place").to_numpy()
    rows = group.filter(pa.compute.invert(group.column("first"))).sort_by("place").combine_chunks()
    conv, block = rows.column("conv"), rows.column("block")
    code = conv.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) if rows.num_rows else np.zeros(0, np.int64)
    symbol, number, copies = (rows.column(c).to_numpy().astype(np.int64) for c in ("symbol", "number", "copies"))
    later = ~np.isin(rows.column("place").to_numpy(), firsts) & (symbol > 0)
    blank, short = symbol == 0, (symbol > 0) & (symbol % 2 == 0) & ~later
    symbol[later] = grammar.DELETED
    known = rows.column("turn").is_valid().to_numpy()
    turn = rows.column("turn").fill_null(0).to_numpy()
    # Second copies stand behind the first ones.
    every = np.repeat(symbol, copies).astype(np.uint8)
    every[np.cumsum(copies)[copies > 1] - 1] = grammar.DELETED
    wanted = np.isin(number[:-1] * 4 + number[1:], [1, 6, 9])  # su, ua, au
    ends = np.flatnonzero(code[1:] != code[:-1]) + 1
    starts, stops = np.concatenate([[0], ends]), np.concatenate([ends, [len(code)]])
    place = np.concatenate([[0], np.cumsum(copies)])
    found = []
    for low, high in zip(starts, stops) if rows.num_rows else ():
        turns = turn[low:high][known[low:high]]
        twice = copies[low:high] > 1
        inner = int((~wanted[low : high - 1]).sum()) + int(twice.sum())  # a role and its copy never follow each other
        found.append({
            "block": block[low].as_py(), "conv": conv[low].as_py(), "edge": bool(low == 0 or high == len(code)), "symbols": every[place[low] : place[high]].tobytes(),
            "blank": int((blank[low:high] * copies[low:high]).sum()),
            "duplicate": int(later[low:high].sum()) + int((twice & ~blank[low:high]).sum()),
            "truncated": int(short[low:high].sum()), "illegal": inner,
            "head": int(number[low]), "tail": int(number[high - 1]),
            "least": int(turns[0]) if len(turns) else None, "most": int(turns[-1]) if len(turns) else None,
            "turns": int((turns[1:] != turns[:-1]).sum()) + 1 if len(turns) else 0,
        })
    return pa.Table.from_pylist(found, group_schema(conv.type))


def group_schema(kind: pa.DataType) -> pa.Schema:
    long = [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "head", "tail", "least", "most", "turns")]
    return pa.schema([("block", pa.int64()), ("conv", kind), ("edge", pa.bool_()), ("symbols", pa.binary()), *long])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs and audits of each segment: one if it is whole, else those of its matrix."""
    for batch in batches:
        symbols, edges = batch.column("symbols").to_pylist(), batch.column("edge").to_pylist()
        known, fresh, size = {}, {}, 0
        for key in dict.fromkeys(zip(symbols, edges)):
            fresh[key] = None
            size += len(key[0])
            if size >= GRAMMAR_SYMBOLS:
                known.update(_solved(list(fresh)))
                fresh, size = {}, 0
        known.update(_solved(list(fresh)))
        found = [known[key] for key in zip(symbols, edges)]
        columns = [pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.string()))]
        kept = [c for c in batch.schema.names if c != "symbols"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, "costs", "audits"])


def _solved(keys: list[tuple[bytes, bool]]) -> dict:
    cells = grammar.solve([s for s, _ in keys], [not edge for _, edge in keys])
    return {key: ([c and c[0] for c in row], [c and str(c[1]) for c in row]) for key, row in zip(keys, cells)}


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation whose segments follow each other; the running audits are ropes."""
    names = ["blank", "duplicate", "truncated", "illegal"]
    state = None

    def finished() -> pa.RecordBatch:
        cost, audit = grammar.finish(state["way"])
        gaps = state["most"] - state["least"] + 1 - state["turns"] if state["turns"] else 0
        row = {"conv": state["conv"], **{n: state[n] for n in names}, "gaps": gaps, "cost": cost, "audit": str(audit)}
        return pa.RecordBatch.from_pylist([row], pa.schema([("conv", kind), *((n, pa.int64()) for n in (*names, "gaps", "cost")), ("audit", pa.string())]))

    for batch in batches:
        kind = batch.schema.field("conv").type
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            cells = [None if cost is None else (cost, Rope(audit)) for cost, audit in zip(row["costs"], row["audits"])]
            if state is None or state["conv"] != row["conv"]:
                if state is not None:
                    yield finished()
                state = row | {"way": grammar.START[0]}
            else:
                for n in names:
                    state[n] += row[n]
                state["illegal"] += (state["tail"], row["head"]) not in ((0, 1), (1, 2), (2, 1))
                if row["turns"]:
                    state["turns"] += row["turns"] - (state["most"] == row["least"] if state["turns"] else 0)
                    state["least"] = state["least"] if state["least"] is not None else row["least"]
                    state["most"] = row["most"]
                state["tail"] = row["tail"]
            matrix = [cells[at : at + grammar.STATES] for at in range(0, len(cells), grammar.STATES)]
            state["way"] = grammar.times([state["way"]], matrix)[0]
    if state is not None:
        yield finished()


def audits(rows: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``(conv, blank, duplicate, truncated, illegal, gaps, cost, audit)`` of each conversation with a copy in ``rows``."""
    narrow = _symbols(rows.where("copies > 0")).select("conv", "turn", "role", "hash", "number", "symbol", "copies", F.monotonically_increasing_id().alias("row"))
    kind = rows.schema["conv"].dataType.simpleString()
    # The row number spreads equal rows over several parts; which of them comes first makes no difference.
    order = [*_order(), F.col("row")]
    placed = narrow.repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("place", F.monotonically_increasing_id())
    placed = cut_lineage(placed, "turns").withColumn("block", F.shiftright("place", block_bits))
    firsts = placed.where(F.col("symbol") > 0).groupBy("conv", "role", "hash").agg(F.min("place").alias("place"))
    marks = firsts.select(F.shiftright("place", block_bits).alias("block"), "place", F.lit(True).alias("first"))
    marked = placed.select("block", "place", F.lit(False).alias("first"), "conv", "turn", "number", "symbol", "copies").unionByName(marks, allowMissingColumns=True)
    counted = "blank long, duplicate long, truncated long, illegal long, head long, tail long, least long, most long, turns long"
    segments = marked.groupBy("block").applyInArrow(_segments, f"block long, conv {kind}, edge boolean, symbols binary, {counted}")
    solved = cut_lineage(segments.mapInArrow(_solve, f"block long, conv {kind}, edge boolean, {counted}, costs array<long>, audits array<string>"), "segments")
    final = f"conv {kind}, {STATS.replace('gaps long', 'gaps long, cost long, audit string')}"
    edges = solved.where("edge").repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_joined, final)
    gaps = F.when(F.col("turns") > 0, F.col("most") - F.col("least") + 1 - F.col("turns")).otherwise(0)
    whole = solved.where("NOT edge").select("conv", "blank", "duplicate", "truncated", "illegal", gaps.cast("long").alias("gaps"), F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))
    return whole.unionByName(edges)


class _Repair:
    """Lines of one conversation, as its audit tells."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0

    def _new(self) -> str:
        role = 2 if self.state == 2 else 1
        self.state = grammar.NEXT[self.state, role]
        return NAMES[grammar.ROLES[role]]

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._new(), ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = grammar.NEXT[self.state, grammar.ROLES.index(role[0])]
            yield role, text
        elif edit == "R":
            yield self._new(), text


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[tuple[str, str]], bool]]:
    """``(conversation, lines, last)`` of sorted rows, whose conversations begin with their audit unless they have no turn left."""
    now, repair = None, None
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        for i in range(batch.num_rows):
            if now is None or now["conv"] != columns["conv"][i]:
                if now is not None:
                    yield now, list(repair.inserted()), True
                audit = columns["audit"][i]
                now = {c: columns[c][i] for c in ("conv", "blank", "duplicate", "truncated", "illegal", "gaps", "cost", "audit")}
                repair = _Repair(audit or "")
            for _ in range(columns["copies"][i]):
                yield now, list(repair.turn(columns["role"][i], columns["text"][i])), False
    if now is not None:
        yield now, list(repair.inserted()), True


def _in_order(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Audits and turns of each conversation behind each other; its texts pass through one task as a stream."""
    said = rows.withColumn("hash", F.sha2("text", 256)).withColumn("text", F.when(F.col("copies") > 0, F.col("text")))
    heads = found.withColumn("copies", F.lit(0)).withColumn("kind", F.lit(0))
    both = heads.unionByName(said.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    conv, *rest = _order()
    return both.repartition("conv").sortWithinPartitions(conv, "kind", *rest)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``(conv, place, role, text)``: the turns of each conversation after its repair."""
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, size, schema = 0, [], 0, None

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for batch in batches:
                schema = pa.schema([("conv", batch.schema.field("conv").type), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
                yield batch

        for now, lines, last in _lines(listed(batches)):
            for role, text in lines:
                held.append({"conv": now["conv"], "place": place, "role": role, "text": text})
                place, size = place + 1, size + len(text) + 64
            place = 0 if last else place
            if size > 1 << 22:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return _in_order(rows, found).mapInArrow(run, f"conv {kind}, place long, role string, text string")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The audits of all conversations in ``rows`` with the SHA-256 of their repaired ``role:text`` lines.

    A digest runs through all lines of a conversation in order, so one task reads them as
    a stream; it holds an Arrow batch and the audit.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    fields = [*(f.split()[0] for f in STATS.split(", ")), "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, first, held = hashlib.sha256(), True, []

        def finished() -> pa.RecordBatch:
            names, columns = ["conv", *fields, "audit", "sha256"], list(zip(*held))
            types = [kinds[0], *[pa.int64()] * len(fields), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        kinds = []

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds[:] = [batch.schema.field("conv").type]
                yield batch

        for now, lines, last in _lines(listed(batches)):
            for role, text in lines:
                hashed.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
            if last:
                held.append((now["conv"], *(now[f] or 0 for f in fields), now["audit"] or "", hashed.hexdigest()))
                hashed, first = hashlib.sha256(), True
                if len(held) >= 4096:
                    yield finished()
                    held = []
        if held:
            yield finished()

    return _in_order(rows, found).mapInArrow(run, f"conv {kind}, {', '.join(f'{f} long' for f in fields)}, audit string, sha256 string")


def repair(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """``(key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of each conversation.

    ``rows`` are ``(conv, turn, role, text, copies)`` as ``damaged`` or
    ``as_they_are`` give them. Turns follow ``turn``, nulls first; equal turns follow
    the role and the hash of the text, copies side by side. Each turn's first
    fault counts: blank, duplicate (role and text seen earlier), truncated. A null key
    is a conversation of its own; one without copies has zeros, an
    empty audit and the digest of nothing. Roles count by their first character, and one that is none of
    s, u, a can only be changed or deleted. A conversation of any length is cut into
    blocks; its audit, one character a turn, is held whole by one task, its texts never.
    """
    found = cut_lineage(audits(rows), "audits")
    return digests(rows, found).select(F.col("conv").alias(key), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha256").alias("repaired_sha256"))
