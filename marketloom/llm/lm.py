"""Language-model scoring of whole texts, with a word-frequency base.

Two scores of each document: `score`, the log10 probability under the causal
self-attention model of attention.py, and `base_score`, that of a smoothed word
unigram over all training documents.  Words are lower-cased (A-Z) and followed
by one end token.

Word counts cover the whole corpus: every block of text sends its distinct
words with their counts in training documents, the counts of a word are summed
before they meet, and each block gets the corpus counts of its own words.  What
is exchanged grows with the corpus; no machine holds a table of all words.

The attention model is trained on every window of all training texts.  One task
fits a start on about `sample` hash-chosen documents; from there, shards of a
few megabytes of text, dealt by a hash, are passed over in parallel, and their
parameters are averaged by windows after each round.  Shards grow with the
corpus, and neither they nor the result depend on how rows are partitioned.

A null or empty text is the end token alone.  Without any training document
the counts are zero and the model is its seeded start.  Words are identified by
64-bit hashes.  Repeated rows get equal results.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_groups, reuse, trimmed, written
from .attention import Attention, Subwords, score, windows
from .blocks import Block, Blocks, replies
from .substrings import _parts
from .words import Words, slices


def fold_of(key: int, parts: int) -> int:
    return zlib.crc32(str(key).encode()) % parts


def _distinct(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct word hashes, index of each word's hash in them, document of each word)."""
    hashes, documents = [], []
    for i, _, words in _parts(block):
        hashes.append(words.hashes(fold_case=True))
        documents.append(words.documents() + i)
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    values, where = np.unique(np.concatenate(hashes), return_inverse=True)
    return values, where, np.concatenate(documents)


def training_counts(block: Block, values: np.ndarray, where: np.ndarray, document: np.ndarray, held: Callable[[int], bool]) -> np.ndarray:
    """Counts of a block's distinct words in its training documents."""
    training = np.array([not held(int(i)) for i in block.ids])
    return np.bincount(where, training[document], len(values)).astype(np.int64) if len(values) else np.empty(0, dtype=np.int64)


def send_words(held: Callable[[int], bool]) -> Callable[[Block], tuple[np.ndarray, np.ndarray]]:
    """Distinct words of a block with their counts in training documents."""

    def work(block: Block) -> tuple[np.ndarray, np.ndarray]:
        found = _distinct(block)
        return found[0], training_counts(block, *found, held)

    return work


def fit(docs: DataFrame, ranks: list[bytes], key: str, text: str, sample: int, pieces: int, stretch: int, seed: int) -> Attention:
    """The model: started on stretches of a hash-chosen sample of `docs`, then trained on all of their text."""
    rows = docs.where(F.length(text) > 0)
    count, chars = rows.agg(F.count(F.lit(1)), F.sum(F.length(text))).first()
    near = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, sample / max(count, 1)) * (1 << 30))
    size = F.length(text)
    cut = [F.when((F.lit(i) == 0) | (size > i * stretch), F.substring(F.col(text), (F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(i)), F.greatest(size - stretch, F.lit(1))) + 1).cast("int"), F.lit(stretch))) for i in range(pieces)]
    chosen = rows.where(near).select(F.col(key).cast("string").alias("k"), F.explode(F.array(*cut)).alias("x")).where("x IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse()
        found = [(k, x) for batch in batches for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        texts = pa.array([x for _, x in sorted(found)], pa.string())
        subwords, model = Subwords(ranks), Attention()
        parts = [windows(*subwords.encode(Words(data, bounds)))[:2] for _, _, data, bounds in slices(texts)]
        if parts:
            model.fit(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # one task with the bounded sample: a worker has one numerics thread, and a lost one is run again
    started = chosen.repartition(1).mapInArrow(trimmed(run), "model binary").first()
    model = pickle.loads(started[0]) if started else Attention()  # adaptive plans drop an empty sample's task
    shards = -(-(chars or 0) // SHARD_CHARS)
    rounds = min(shards, ROUNDS)
    digest = F.xxhash64(F.col(key), F.col(text), F.lit(seed))
    dealt = rows.select(F.pmod(digest, F.lit(max(shards, 1))).alias("shard"), digest.alias("h"), F.col(key).cast("string").alias("k"), F.col(text).alias("x"))
    for i in range(rounds):
        own = dealt.where(F.col("shard") % rounds == i).withColumn("place", F.call_function("div", "shard", F.lit(rounds)))
        model = _averaged(own, model, ranks, len(range(i, shards, rounds)), 0.003 * (1 - 0.9 * i / rounds))
    return model


#: Characters of training text in a shard on average, and the most rounds of averaging.
SHARD_CHARS, ROUNDS = 4 << 20, 8


def _averaged(dealt: DataFrame, model: Attention, ranks: list[bytes], shards: int, rate: float) -> Attention:
    """The mean, weighted by windows, of models that each pass once over one shard, each in a task of its own (`place`); added in two levels."""
    shared = dealt.sparkSession.sparkContext.broadcast((model, ranks))
    mark, groups = zlib.crc32(b" ".join(ranks)), math.isqrt(shards - 1) + 1

    def learn(key: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        reuse()
        start, subwords = shared.value[0], pieces_of(shared.value[1], mark)
        own = start.with_flat(start.flat())
        parts = [windows(*subwords.encode(Words(data, bounds)))[:2] for _, _, data, bounds in slices(rows["x"])]
        inputs, targets = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        own.pass_over(inputs, targets, rate=rate, seed=key[0])
        yield pa.RecordBatch.from_arrays([pa.array([key[0] % groups]), pa.array([key[0]]), pa.array([len(inputs)]), pa.array([(len(inputs) * own.flat().astype("<f8")).tobytes()])], names=["group", "shard", "n", "total"])

    def add(key: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(x.as_buffer(), "<f8") for chunk in rows["total"].chunks for x in chunk)
        yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([sum(rows["n"].to_pylist())]), pa.array([total.tobytes()])], names=["group", "n", "total"])

    learnt = map_groups(dealt, ["shard"], lambda: learn, "group bigint, shard bigint, n bigint, total binary", order=["h", "k", "x"], partitions=shards, place=F.col("place"))
    sums = map_groups(learnt, ["group"], lambda: add, "group bigint, n bigint, total binary", order=["shard"], partitions=groups).collect()
    shared.destroy()
    sums.sort()
    return model.with_flat(sum(np.frombuffer(r.total, "<f8") for r in sums) / sum(r.n for r in sums)) if sums else model


_PIECES: dict[int, Subwords] = {}


def pieces_of(ranks: list[bytes], mark: int) -> Subwords:
    """The worker's piece table for a vocabulary (told apart by `mark`), built once."""
    if mark not in _PIECES:
        _PIECES.clear()
        _PIECES[mark] = Subwords(ranks)
    return _PIECES[mark]


#: Columns that scoring adds.
SCORED = "held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_documents(
    docs: DataFrame, ranks: list[bytes], key: str = "doc_id", text: str = "text", folds: int = 10, sample: int = 4000, pieces: int = 4, stretch: int = 600, seed: int = 13
) -> DataFrame:
    """key, held_out and the scores of each document; documents of fold 0 are held out."""
    spark = docs.sparkSession
    training = docs.where(F.crc32(F.col(key).cast("string").cast("binary")) % folds != 0)
    model = fit(training, ranks, key, text, sample, pieces, stretch, seed)
    shared = spark.sparkContext.broadcast((model, ranks))
    mark = zlib.crc32(b" ".join(ranks))
    held = lambda i: fold_of(i, folds) == 0
    blocks = Blocks(docs, key, text, [key])
    sent = written(blocks.send(send_words(held)), {"compression": "uncompressed"})
    kinds, words = sent.groupBy("hash").agg(F.sum("value").alias("n")).where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    ends = training.count()
    total, distinct = (words or 0) + ends, (kinds or 0) + (ends > 0)
    floor = total + 0.1 * (distinct + 1)

    def finish(block: Block, own: np.ndarray, found: np.ndarray) -> Iterator[pa.RecordBatch]:
        reuse()
        values, where, document = _distinct(block)
        n = len(block.ids)
        counts = training_counts(block, values, where, document, held)  # of words that no other block has
        counts[np.searchsorted(values, own)] = found
        logs = np.log10((counts + 0.1) / floor)
        base = np.bincount(document, logs[where], n) + np.log10((ends + 0.1) / floor)
        known = np.bincount(document, (counts > 0)[where], n).astype(np.int64) + (ends > 0)
        subwords = pieces_of(shared.value[1], mark)
        scores = np.concatenate([score(shared.value[0], subwords, words) for _, _, words in _parts(block)]) if n else np.empty(0)
        yield pa.RecordBatch.from_arrays(
            [*block.rest.columns, pa.array([held(int(i)) for i in block.ids], pa.bool_()), pa.array(np.bincount(document, minlength=n) + 1), pa.array(known), pa.array(np.full(n, total)), pa.array(base), pa.array(scores)],
            names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return blocks.receive(replies(sent, F.sum("value"), F.col("total") > F.col("value")), finish, f"`{key}` {blocks.kept[0][1]}, {SCORED}")
