"""Language-model scores of whole documents.

Word counts over all training documents give the vocabulary and the plain base
score. A gated recurrent model predicts the ``TOKENS`` most frequent words, the end
and "any other word"; the other words keep their share of the counts. Tasks train on their own documents from the
same weights; the weighted mean of their weights starts the next round.
"""

from __future__ import annotations

import copy
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrep.llm import gru
from textrep.llm.frames import ship, shipped
from textrep.llm.words import BLANKS, slices, split_words
from textrep.session import cut_lineage

#: The counts of this many words at most are sent to the tasks; the counts of all others are joined.
MOST_SENT = 1 << 20
#: Rounds of training; each training document belongs to one of them.
ROUNDS = 2
#: Tokens that a task holds at once.
HELD_TOKENS = 6_000_000
#: Tokens that the model knows one by one, at most; the same for tables of any size.
TOKENS = 1 << 15
#: Tokens that a task trains on in a round, about; each task sends its weights once.
PART_TOKENS = 3_000_000
#: The weights are added up in pieces of this many numbers, spread over this many tasks.
PIECE, GROUPS = 1 << 20, 16
END = np.uint64(0x0123456789ABCDEF)
OTHER, STOP = 0, 1


def _signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """``(word, c)``: hashed words and ends of all rows; each slice is summed before the shuffle."""

    def run(batches):
        held, ends, size = [], 0, 0
        for batch in batches:
            for part in slices(batch, text):
                ends += part.num_rows
                held.append(np.unique(split_words(part.column(text), BLANKS, lower=True).hashes(), return_counts=True))
                size += len(held[-1][0])
                if size > 1 << 20:
                    yield _summed(held)
                    held, size = [], 0
        yield _summed([*held, (np.array([END]), np.array([ends]))])

    return docs.select(text).mapInArrow(run, "word long, c long").where("c > 0").groupBy("word").agg(F.sum("c").alias("c"))


def _summed(held: list) -> pa.RecordBatch:
    words, place = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
    sums = np.bincount(place.reshape(-1), np.concatenate([c for _, c in held])).astype(np.int64)
    return pa.RecordBatch.from_arrays([_signed(words), pa.array(sums)], names=["word", "c"])


def vocabulary_size(words: int) -> int:
    """Tokens of a model of a table with so many distinct words."""
    return max(min(words + 2, TOKENS), gru.SIZE)


class Lexicon:
    """Counts of the frequent words, sorted by hash, and the token of each."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, size: int = gru.SIZE) -> None:
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.token = np.full(len(words), OTHER, np.int32)
        frequent = [i for i in np.lexsort((self.words, -self.counts))[: size - 1] if self.words[i] != END][: size - 2]
        self.token[frequent] = np.arange(2, 2 + len(frequent))
        self.token[self.words == END] = STOP
        self.token_counts = np.bincount(self.token, self.counts, size)
        self.logs = np.log10(self.counts + 1.0)
        self._index()

    def _index(self) -> None:
        """Where the words of each head of a hash begin; about one word has it."""
        bits = max(len(self.words).bit_length(), 1)
        self.shift = np.uint64(64 - bits)
        heads = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.first = np.minimum(np.searchsorted(self.words, heads), max(len(self.words) - 1, 0)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word and whether it is there."""
        at = self.first[hashes >> self.shift]
        if not len(self.words):
            return at, np.zeros(len(hashes), bool)
        behind = np.flatnonzero(self.words[at] < hashes)
        while len(behind):
            behind = behind[at[behind] < len(self.words) - 1]
            at[behind] += 1
            behind = behind[self.words[at[behind]] < hashes[behind]]
        return at, self.words[at] == hashes

    def tokens_only(self) -> Lexicon:
        """The words that the model knows one by one."""
        known = self.token != OTHER
        some = copy.copy(self)
        some.words, some.counts, some.token, some.logs = self.words[known], self.counts[known], self.token[known], self.logs[known]
        some._index()
        return some


def _texts(part: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and ends in order, and the border and number of tokens of each text."""
    words = split_words(part.column(text), BLANKS, lower=True)
    return np.insert(words.hashes(), words.first[1:], END), words.first + np.arange(len(words.first)), words.counts + 1


def learn(docs: DataFrame, lexicon: Lexicon, text: str, key: str, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Weights after one pass over all documents, in ``rounds`` parts."""
    spark = docs.sparkSession
    shared = ship(docs, lexicon.tokens_only())
    size = len(lexicon.token_counts)
    parts = max(int(lexicon.counts.sum()) // (rounds * PART_TOKENS), 1)
    model = gru.initial(lexicon.token_counts)
    for turn in range(rounds):
        part = docs.where(F.pmod(F.xxhash64(F.col(key), F.lit(9)), F.lit(rounds)) == turn)
        sent = spark.sparkContext.broadcast(gru.pack(model))

        def run(batches):
            known, before = shipped(shared), sent.value
            weights, held, n, total = gru.unpack(before.copy(), size), [], 0, 0
            for batch in batches:
                for small in slices(batch, text):
                    hashes, first, _ = _texts(small, text)
                    at, there = known.find(hashes)
                    held += np.split(np.where(there, known.token[at] if len(known.token) else 0, OTHER).astype(np.int32), first[1:-1])
                    n += len(hashes)
                    if n >= HELD_TOKENS:
                        weights, total, held, n = gru.train(weights, held), total + n, [], 0
            if held:
                weights, total = gru.train(weights, held), total + n
            if total:
                moved = (gru.pack(weights) - before).astype(np.float16)
                for i in range(0, len(moved), PIECE):
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([total]), pa.array([moved[i : i + PIECE].tobytes()], pa.binary())], names=["at", "n", "moved"])

        def merge(batches):
            sums = {}
            for batch in batches:
                for at, count, raw in zip(*(c.to_pylist() for c in batch.columns)):
                    n, total = sums.get(at, (0, np.float64(0)))
                    sums[at] = n + count, total + count * np.frombuffer(raw, np.float16).astype(np.float64)
            for at, (n, total) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["at", "moved"])

        made = part.select(text).coalesce(parts).mapInArrow(run, "at long, n long, moved binary").repartition(GROUPS, "at").mapInArrow(merge, "at long, moved binary").toArrow()
        flat = gru.pack(model)
        for at, raw in zip(*(c.to_pylist() for c in made.columns)):
            moved = np.frombuffer(raw, np.float32)
            flat[at : at + len(moved)] += moved
        model = gru.unpack(flat, size)
        sent.destroy()
    shared.destroy()
    return model


def score_documents(docs: DataFrame, train: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``(key, n_tokens, n_known, train_tokens, base_score, score)`` of each row of ``docs``, learned from ``train``.

    Scores are log10 probabilities of the lower-cased words and one end; a null
    text is empty and has the end alone. ``base_score`` is the plain smoothed
    count model. Repeated rows and null keys are scored row by row. Without
    training rows every word is unknown. Which documents a task trains on
    depends on the files' partitions, so ``score`` varies slightly with them;
    all other columns do not.
    """
    spark = docs.sparkSession
    counts = cut_lineage(count_words(train.select(key, text), text), "word-counts")
    size, tokens = (x or 0 for x in counts.agg(F.count("*"), F.sum("c")).first())
    steps = counts.groupBy(F.floor(F.log2("c")).alias("p")).agg(F.count("*").alias("n")).collect()
    least = 1
    for p, n in sorted(((r["p"], r["n"]) for r in steps)):
        if sum(r["n"] for r in steps if r["p"] >= p) > MOST_SENT:
            least = 2 ** (p + 1)
    frequent = counts.where((F.col("c") >= least) | (F.col("word") == int(END))).toArrow()
    sent = frequent.column("c").to_numpy()
    lexicon = Lexicon(frequent.column("word").to_numpy().view(np.uint64), sent, vocabulary_size(size))
    model = learn(train, lexicon, text, key, rounds)
    shared, flat_model = ship(docs, lexicon), spark.sparkContext.broadcast(gru.pack(model))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("key", "text"))

    def run(batches):
        known = shipped(shared)
        weights = gru.unpack(flat_model.value, len(known.token_counts))
        held, ready, size = [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, first, n = _texts(part, "text")
                at, there = known.find(hashes)
                token = np.where(there, known.token[at] if len(known.token) else 0, OTHER).astype(np.int32)
                logs = np.where(there, known.logs[at] if len(known.logs) else 0.0, 0.0)
                token[hashes == END] = STOP
                sums = [np.add.reduceat(x, first[:-1]) for x in (there.astype(np.int64), (token == OTHER).astype(np.int64), logs, np.where(token == OTHER, logs, 0.0))]
                rare = np.flatnonzero(~there)
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, first), pa.int32()), _signed(hashes[rare]))
                ready.append([part.column("key"), part.column("row"), pa.array(n), *map(pa.array, sums), rare])
                held += np.split(token, first[1:-1])
                size += len(token)
                if size >= HELD_TOKENS:
                    yield finished(weights, ready, held)
                    held, ready, size = [], [], 0
        if held:
            yield finished(weights, ready, held)

    names = ["key", "row", "n_tokens", "known", "others", "logs", "other_logs", "rare", "model"]

    def finished(weights, ready, held):
        columns = [pa.concat_arrays([r[i] for r in ready]) for i in range(len(ready[0]))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(gru.score(weights, held) / math.log(10))], names=names)

    kind = rows.schema["key"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"key {kind}, row long, n_tokens long, known long, others long, logs double, other_logs double, rare array<long>, model double")

    out = scored.withColumns({"more_known": F.lit(0), "more_logs": F.lit(0.0)})
    if least > 1:  # some counts were not sent
        scored = cut_lineage(scored, "scored")
        tail = scored.select("row", F.explode("rare").alias("word")).join(counts.where(F.col("c") < least), "word")
        tail = tail.groupBy("row").agg(F.count("*").alias("more_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("more_logs"))
        copies = scored.groupBy("row").agg(F.count("*").alias("copies"))
        tail = tail.join(copies, "row").select("row", (F.col("more_known") / F.col("copies")).cast("long").alias("more_known"), (F.col("more_logs") / F.col("copies")).alias("more_logs"))
        out = scored.join(tail, "row", "left").fillna({"more_known": 0, "more_logs": 0.0})
    # Words outside the model's vocabulary share its "other" token by their counts.
    other = tokens - float(lexicon.token_counts[1:].sum()) + size - int((lexicon.token > 0).sum()) + 1
    return out.select(
        F.col("key").alias(key),
        "n_tokens",
        (F.col("known") + F.col("more_known")).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("more_logs") - F.col("n_tokens") * math.log10(tokens + size + 1)).alias("base_score"),
        (F.col("model") + F.col("other_logs") + F.col("more_logs") - F.col("others") * math.log10(other)).alias("score"),
    )
