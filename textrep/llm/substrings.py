"""Duplicate passages by relative Lempel-Ziv parsing against the first occurrences of word blocks.

The reference are the places where a block of 13 words occurs first, by key, text
and position. A document is parsed greedily: a factor starts at the next block that
has a place in a smaller document and goes on while the places of the blocks follow
each other there; the next factor starts behind it. A factor is a block at least, so
each becomes a duplicate span, and at its end the blocks that lie across the border
are looked at, since no factor holds them.

Most blocks occur once and are never indexed. Each block has an anchor, the run of
five words with the least hash among its nine, so equal blocks have equal anchors, and
only anchors that occur in two documents go on. The blocks of one anchor are one
segment of 13 to 21 words, which is looked up as a whole; block by block are looked up
only segments that have no place in a smaller document but share their anchor with
another segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textrep.llm.frames import annotate, sent, struct_of
from textrep.llm.words import BLANKS, Words, mix, split_words, window_hashes, window_starts
from textrep.session import cut_lineage

BLOCK = 13
#: Words of the runs whose least hash is the anchor of a block.
RUN = 5
MOST_ID_BYTES = MOST_MARK_BYTES = MOST_SPAN_BYTES = 32 << 20
#: A segment with more than one in this many of all anchors is sent to the tasks; there are fewer than this many.
HOT = 1000

_SEGMENT = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xC2B2AE3D27D4EB4F))


def _fields(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_LONG, _INT = T.LongType(), T.IntegerType()
WHOLE = _fields(n_words=_LONG, f1=_LONG, f2=_LONG, sha=T.StringType())
MARKS = _fields(marks=T.ArrayType(_LONG))
ANCHORS = _fields(anchors=T.ArrayType(_fields(at=_INT, n=_INT, mark=_LONG, seg=_LONG)))
BLOCKS = _fields(blocks=T.ArrayType(_fields(at=_INT, off=_INT, mark=_LONG, seg=_LONG, hash=_LONG)))
FACTOR = _fields(start=_LONG, length=_LONG, source=_LONG, source_start=_LONG)
PARSED = _fields(id=_LONG, body=_LONG, starts=T.ArrayType(_LONG), stops=T.ArrayType(_LONG), factors=T.ArrayType(FACTOR))
CUT = _fields(n_removed=_LONG, kept=T.StringType())


def least_runs(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least one of ``width`` values from each place on."""
    least, at, done = values, np.arange(len(values)), 1
    while done < width:
        step = min(done, width - done)
        left = least[:-step] <= least[step:]
        least, at = np.where(left, least[:-step], least[step:]), np.where(left, at[:-step], at[step:])
        done += step
    return at


def segments_of(words: Words, block: int, run: int) -> tuple[np.ndarray, ...]:
    """``(first word, blocks, mark, hash of the segment, hashes of all blocks)``; the last by first word."""
    hashes = words.hashes()
    starts = window_starts(words.first, block)
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return starts, starts, none, none, none
    runs = window_hashes(hashes, run)
    place = least_runs(runs, block - run + 1)[starts]
    owner = np.searchsorted(words.first, starts, "right") - 1
    heads = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]))
    count = np.diff(np.append(heads, len(starts)))
    blocks = window_hashes(hashes, block)
    low = starts[heads]
    seg = mix(blocks[low] + mix(blocks[low + count - 1] * _SEGMENT[0] + count.astype(np.uint64) * _SEGMENT[1]))
    return low, count, runs[place[heads]], seg, blocks


def _lists(owner: np.ndarray, rows: int, values: pa.Array) -> pa.ListArray:
    """One list of ``values`` for each row, in the order of their owners."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)), pa.int32()), values)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _sequence_prints(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over place and word of each text."""
    place = (np.arange(len(hashes)) - np.repeat(words.first[:-1], words.counts)).astype(np.uint64)
    out = np.zeros((2, len(words.counts)), np.uint64)
    filled = np.flatnonzero(words.counts)
    for i, salt in enumerate((0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)):
        if len(filled):
            out[i, filled] = np.add.reduceat(mix(hashes + mix(place + np.uint64(salt))), words.first[filled])
    return out


def _wholes(texts: pa.Array) -> pa.StructArray:
    words = split_words(texts, BLANKS, lower=False)
    prints = _sequence_prints(words, words.hashes())
    shas = [hashlib.sha256(b" ".join(t.as_py().encode().split()) if t.is_valid else b"").hexdigest() for t in texts]
    return struct_of(n_words=pa.array(words.counts, pa.int64()), f1=_signed(prints[0]), f2=_signed(prints[1]), sha=pa.array(shas, pa.string()))


def _marks(texts: pa.Array, block: int, run: int) -> pa.StructArray:
    words = split_words(texts, BLANKS, lower=False)
    low, _, marks, *_ = segments_of(words, block, run)
    owner = np.searchsorted(words.first, low, "right") - 1
    new = np.ones(len(marks), bool)
    new[1:] = (marks[1:] != marks[:-1]) | (owner[1:] != owner[:-1])
    return struct_of(marks=_lists(owner[new], len(texts), _signed(marks[new])))


def _anchors(texts: pa.Array, block: int, run: int) -> pa.StructArray:
    words = split_words(texts, BLANKS, lower=False)
    low, count, marks, seg, _ = segments_of(words, block, run)
    owner = np.searchsorted(words.first, low, "right") - 1
    at = pa.array((low - words.first[owner]).astype(np.int32))
    return struct_of(anchors=_lists(owner, len(texts), struct_of(at=at, n=pa.array(count.astype(np.int32)), mark=_signed(marks), seg=_signed(seg))))


def _blocks(part: pa.RecordBatch, block: int, run: int) -> pa.StructArray:
    words = split_words(part.column("text"), BLANKS, lower=False)
    low, count, marks, seg, blocks = segments_of(words, block, run)
    wanted = part.column("wanted")
    rows = np.repeat(np.arange(part.num_rows), wanted.value_lengths().to_numpy())
    chosen = np.flatnonzero(np.isin(low, words.first[rows] + wanted.flatten().to_numpy()))
    each = np.repeat(chosen, count[chosen])
    off = np.arange(len(each)) - np.repeat(np.cumsum(count[chosen]) - count[chosen], count[chosen])
    owner = np.searchsorted(words.first, low[each], "right") - 1
    found = struct_of(
        at=pa.array((low[each] + off - words.first[owner]).astype(np.int32)),
        off=pa.array(off.astype(np.int32)),
        mark=_signed(marks[each]),
        seg=_signed(seg[each]),
        hash=_signed(blocks[low[each] + off]),
    )
    return struct_of(blocks=_lists(owner, part.num_rows, found))


def parse(at: np.ndarray, source: np.ndarray, place: np.ndarray, block: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors ``(start, stop, first hit, end of its span)``.

    ``at`` are the ascending first words of blocks with a place in the reference,
    ``source`` tells the reference texts apart, ``place`` is the word there. The
    span ends behind the last block that starts within the factor.
    """
    breaks = np.flatnonzero((np.diff(at) != 1) | (source[1:] != source[:-1]) | (np.diff(place) != 1))
    last = np.append(breaks, len(at) - 1)
    out, i = [], 0
    while i < len(at):
        stop = int(at[last[np.searchsorted(last, i)]]) + block
        after = int(np.searchsorted(at, stop))
        out.append((int(at[i]), stop, i, max(stop, int(at[after - 1]) + block)))
        i = after
    return out


def _parse(batch: pa.RecordBatch, block: int) -> pa.RecordBatch:
    """Spans and factors of each row's hits ``(at, n, id, body, place)``."""
    lists = batch.column("hits")
    lengths = lists.value_lengths().to_numpy()
    cells = {f: v.to_numpy(zero_copy_only=False) for f, v in zip(("at", "n", "id", "body", "place"), lists.flatten().flatten())}
    bounds = np.append(0, np.cumsum(lengths))
    starts, stops, factors = [], [], []
    for low, high in zip(bounds[:-1], bounds[1:]):
        n = cells["n"][low:high]
        each = np.repeat(np.arange(low, high), n)
        off = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        order = np.argsort(cells["at"][each] + off, kind="stable")
        each, off = each[order], off[order]
        at, place, ids = cells["at"][each] + off, cells["place"][each] + off, cells["id"][each]
        _, source = np.unique(np.stack([ids, cells["body"][each]]), axis=1, return_inverse=True)
        found = parse(at, source.reshape(-1), place, block)
        starts.append([f[0] for f in found])
        stops.append([f[3] for f in found])
        factors.append([{"start": s, "length": e - s, "source": int(ids[i]), "source_start": int(place[i])} for s, e, i, _ in found])
    longs = pa.list_(pa.int64())
    kind = pa.list_(pa.struct([(f.name, pa.int64()) for f in FACTOR]))
    columns = [batch.column("id"), batch.column("body"), pa.array(starts, longs), pa.array(stops, longs), pa.array(factors, kind)]
    return pa.RecordBatch.from_arrays(columns, names=[f.name for f in PARSED])


def _cut(part: pa.RecordBatch) -> pa.StructArray:
    removed, kept = [], []
    for text, starts, stops in zip(part.column("text"), part.column("starts"), part.column("stops")):
        words = text.as_py().encode().split()
        stays, end = [], 0
        for start, stop in zip(starts.values.to_numpy(), stops.values.to_numpy()):
            stays += words[end:start]
            end = max(end, stop)
        stays += words[end:]
        removed.append(len(words) - len(stays))
        kept.append(b" ".join(stays).decode())
    return struct_of(n_removed=pa.array(removed, pa.int64()), kept=pa.array(kept, pa.string()))


def _few(rows: DataFrame, key_bytes: int, limit: int) -> DataFrame:
    """``rows``, to be sent to all tasks if they stay below the limit."""
    marked = sent(rows, key_bytes, limit)
    return rows if marked is None else marked


def _of_text(lists: DataFrame, column: str, cell_bytes: int, limit: int) -> DataFrame:
    """Lists by text, to be sent to all tasks if they stay below the limit."""
    used = lists.agg(F.sum(F.size(column) * cell_bytes + 32)).first()[0] or 0
    return F.broadcast(lists) if used <= limit else lists


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, run: int = RUN) -> DataFrame:
    """Each row without the words of blocks that also start in a document with a smaller key.

    Returns ``(key, n_words, n_removed, kept_sha256, copy_of, kept, factors)``.
    ``copy_of`` is the smallest key with the same words where that is another
    one; such a text of a block or more is one factor and is removed whole.
    ``kept`` and ``factors`` (first word, length, source, first word there) are
    given where some words were removed, and are null where the text stays or goes
    whole. Factors do not overlap; a block across the end of one is removed too.
    Null texts have no words. A row without key is never a source and stays
    whole. Rows are told apart by key and text: rows that share a key are no
    smaller documents of one another, and each is parsed and is a source. The
    work on a very long text grows with its words.
    """
    base = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))
    row = ["id", "body"]
    sketch = annotate(base, "text", "s", WHOLE, lambda: lambda part: _wholes(part.column("text")), row)
    sketch = cut_lineage(sketch.select(*row, "s.*"), "texts")
    long = sketch.where(F.col("id").isNotNull() & (F.col("n_words") >= block))
    classes = long.groupBy("f1", "f2").agg(F.min("id").alias("lowest"))
    copies = cut_lineage(long.join(classes, ["f1", "f2"]).where("lowest < id").select(row).distinct(), "copies")
    firsts = base.where("id IS NOT NULL").join(_few(copies, 16, MOST_ID_BYTES), row, "left_anti")
    repeated = cut_lineage(long.groupBy(row).agg(F.count("*").alias("rows")).where("rows > 1").select(row), "repeated")
    if not repeated.isEmpty():
        few = _few(repeated, 16, MOST_ID_BYTES)
        firsts = firsts.join(few, row, "left_anti").union(firsts.join(few, row, "left_semi").dropDuplicates(row))

    marks = annotate(firsts, "text", "m", MARKS, lambda: lambda part: _marks(part.column("text"), block, run), ["id"])
    marks = marks.select("id", F.explode("m.marks").alias("mark")).groupBy("mark").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    common = cut_lineage(marks.where("low < high").select("mark"), "common-marks")
    anchors = annotate(firsts, "text", "a", ANCHORS, lambda: lambda part: _anchors(part.column("text"), block, run), row)
    anchors = anchors.select(*row, F.explode("a.anchors").alias("a")).select(*row, "a.*").join(_few(common, 8, MOST_MARK_BYTES), "mark", "left_semi")
    anchors = cut_lineage(anchors, "anchors")

    segment = ["mark", "seg"]
    first = F.struct("id", "body", F.col("at").alias("place"))
    segments = cut_lineage(anchors.groupBy(segment).agg(F.min(first).alias("low"), F.max("id").alias("last"), F.count("*").alias("rows")), "segments")
    several = segments.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark")
    wanted = segments.join(several, "mark", "left_semi").groupBy("low.id", "low.body").agg(F.collect_list("low.place").alias("wanted"))
    chosen = firsts.join(_of_text(cut_lineage(wanted, "segments-of-texts"), "wanted", 4, MOST_MARK_BYTES), row)
    blocks = annotate(chosen, "text", "b", BLOCKS, lambda: lambda part: _blocks(part, block, run), row)
    blocks = blocks.select(*row, F.explode("b.blocks").alias("b")).select(*row, "b.*")
    index = blocks.groupBy("mark", "hash").agg(F.min(first).alias("low"), F.max("id").alias("last")).where("low.id < last").drop("last")
    parts = blocks.join(cut_lineage(index, "index"), ["mark", "hash"]).where("low.id < id")
    parts = cut_lineage(parts.groupBy(segment).agg(F.collect_list(F.struct("off", "low")).alias("parts")), "parts")

    def hit(at, n, low):
        return F.struct(at.alias("at"), n.alias("n"), low["id"].alias("id"), low["body"].alias("body"), low["place"].alias("place"))

    known = segments.join(parts, segment, "left").where("low.id < last OR parts IS NOT NULL").drop("last")
    known = cut_lineage(known, "known-segments")
    many = F.col("rows") * HOT > anchors.count()
    hot = F.broadcast(known.where(many))
    met = anchors.join(hot, segment).unionByName(anchors.join(hot.select(segment), segment, "left_anti").join(known.where(~many), segment))
    single = F.transform("parts", lambda x: hit(F.col("at") + x["off"], F.lit(1), x["low"]))
    hits = F.when(F.col("low.id") < F.col("id"), F.array(hit(F.col("at"), F.col("n"), F.col("low")))).otherwise(single)
    hits = met.select(*row, hits.alias("hits")).where("hits IS NOT NULL")
    hits = hits.groupBy(row).agg(F.flatten(F.collect_list("hits")).alias("hits"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _parse(batch, block)

    spans = cut_lineage(hits.mapInArrow(parsed, PARSED), "factors")
    texts = firsts.join(_of_text(spans, "factors", 48, MOST_SPAN_BYTES), row)
    cut = annotate(texts, "text", "c", CUT, lambda: _cut, [*row, "factors"]).select(*row, "factors", "c.*")
    named = sketch.join(classes, ["f1", "f2"], "left").join(cut, row, "left")
    copied = F.coalesce(F.col("n_words") >= block, F.lit(False)) & F.coalesce(F.col("lowest") < F.col("id"), F.lit(False))
    return named.select(
        F.col("id").alias(key),
        "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.sha2(F.lit(""), 256)).when(F.col("kept").isNotNull(), F.sha2("kept", 256)).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(copied, F.col("lowest")).alias("copy_of"),
        F.when(~copied, F.col("kept")).alias("kept"),
        F.when(~copied, F.col("factors")).alias("factors"),
    )
