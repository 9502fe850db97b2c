"""Substring dedup with difference-cover anchors.

A window is `width` consecutive words of one document.  Words covered by a
window whose words also start in a document with a smaller id go.

Anchors are shorter runs of words, hashed only at positions that a difference
cover modulo a period contains.  Of any two equal windows some offset below the
period puts both on cover positions, so every repeated window holds an anchor
that both documents share.  Pass one finds the anchors that several blocks of text have;
pass two extends shared anchors to all windows around them and exchanges those
windows' hashes with their smallest document; pass three removes what a smaller
document holds.  Each pass sends one row for each distinct value of a block,
so a passage in every document costs one row a block.

Windows are compared by 64-bit hashes.  A null or empty
text has no words and stays empty; documents shorter than a window stay whole;
rows with equal ids do not remove each other's words; other columns are kept
where named.  The kept words are joined by single spaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import discard, written
from .blocks import Block, Blocks, replies
from .words import CHUNK_BYTES, Words, runs

_U = np.uint64


def difference_cover(period: int) -> list[int]:
    """A smallest set (first in order) whose pairwise differences give every residue."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            own = (0, *rest)
            if len({(a - b) % period for a in own for b in own}) == period:
                return list(own)
    raise ValueError(period)


def period_for(width: int) -> int:
    """The period with the sparsest cover that leaves anchors of half a window at least."""
    best = max(range(1, min(width // 2 + 2, 22)), key=lambda v: (v / len(difference_cover(v)), -v))
    return best


class Shape:
    """Window width, period, cover and anchor length."""

    def __init__(self, width: int) -> None:
        self.width, self.period = width, period_for(width)
        self.cover = np.array(difference_cover(self.period))
        self.anchor = width - self.period + 1


def _parts(block: Block) -> Iterator[tuple[int, int, Words]]:
    """Runs of documents whose bytes fit a numpy pass."""
    i, n = 0, len(block.ids)
    while i < n:
        j = int(np.searchsorted(block.bounds, block.bounds[i] + CHUNK_BYTES, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, Words(block.data[block.bounds[i] : block.bounds[j]], block.bounds[i : j + 1] - block.bounds[i])
        i = j


class Text:
    """Word hashes of a block, with each word's document and place in it."""

    def __init__(self, block: Block) -> None:
        hashes, documents, counts = [], [], []
        for i, _, words in _parts(block):
            hashes.append(words.hashes())
            documents.append(words.documents() + i)
            counts.append(words.counts())
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
        self.document = np.concatenate(documents) if documents else np.empty(0, dtype=np.int64)
        self.counts = np.concatenate(counts) if counts else np.empty(0, dtype=np.int64)
        first = np.cumsum(self.counts) - self.counts
        self.place = np.arange(len(self.hashes)) - first[self.document]

    def starts(self, length: int) -> np.ndarray:
        """Whether a run of `length` words of one document starts at each word."""
        return self.place + length <= self.counts[self.document]

    def anchors(self, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
        """(word index, hash) of each anchor."""
        at = np.flatnonzero(self.starts(shape.anchor) & np.isin(self.place % shape.period, shape.cover))
        return at, runs(self.hashes, shape.anchor)[at]

    def windows(self, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
        """(word index, hash) of each window."""
        at = np.flatnonzero(self.starts(shape.width))
        return at, runs(self.hashes, shape.width, seed=1)[at]


def _smallest(hashes: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and the smallest document of each."""
    order = np.lexsort((documents, hashes))
    hashes, documents = hashes[order], documents[order]
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = hashes[1:] != hashes[:-1]
    return hashes[first], documents[first]


def send_anchors(shape: Shape) -> Callable[[Block], tuple[np.ndarray, np.ndarray]]:
    """Distinct anchors of a block."""

    def work(block: Block) -> tuple[np.ndarray, np.ndarray]:
        own = np.unique(Text(block).anchors(shape)[1])
        return own, np.ones(len(own), dtype=np.int64)

    return work


def send_windows(shape: Shape) -> Callable[[Block, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Windows around anchors that other blocks have, with the block's smallest document of each.

    Repeats inside the block need no exchange: `covered` sees them."""

    def work(block: Block, shared: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(shared):
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        shared = np.sort(shared)
        text = Text(block)
        at, hashes = text.anchors(shape)
        near = np.searchsorted(shared, hashes)
        at = at[shared[np.minimum(near, len(shared) - 1)] == hashes]
        wanted = np.zeros(len(text.hashes) + shape.period, dtype=bool)
        for back in range(shape.period):
            ok = text.place[at] >= back
            wanted[at[ok] - back] = True
        places, windows = text.windows(shape)
        own = wanted[places]
        return _smallest(windows[own], block.ids[text.document[places[own]]])

    return work


def covered(block: Block, far: np.ndarray, least: np.ndarray, shape: Shape) -> tuple[Text, np.ndarray]:
    """The block's text and which of its words go: `far` are its windows that a smaller document, `least`, has."""
    text = Text(block)
    places, windows = text.windows(shape)
    ids = block.ids[text.document[places]]
    low, smallest = _smallest(windows, ids)
    at = np.searchsorted(low, far)
    smallest[at] = np.minimum(smallest[at], least)
    hit = places[smallest[np.searchsorted(low, windows)] < ids]
    edge = np.zeros(len(text.hashes) + 1, dtype=np.int64)
    edge[hit] += 1
    edge[hit + shape.width] -= 1
    return text, np.cumsum(edge[:-1]) > 0


def kept_texts(block: Block, gone: np.ndarray) -> Iterator[bytes]:
    """Each document's kept words, joined by single spaces."""
    at = 0
    for i, j, words in _parts(block):
        stay = ~gone[at : at + len(words)]
        at += len(words)
        starts, sizes = words.starts[stay], (words.ends - words.starts)[stay] + 1
        ends = np.cumsum(sizes)
        index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
        padded = np.append(words.data, np.uint8(32))
        out = padded[index]
        out[ends - 1] = 32
        bounds = np.concatenate(([0], ends))[np.searchsorted(np.flatnonzero(stay), words.first)]
        data = out.tobytes()
        for k in range(j - i):
            a, b = int(bounds[k]), int(bounds[k + 1])
            yield data[a : b - 1] if b > a else b""


def texts_of(block: Block, gone: np.ndarray, counts: np.ndarray) -> dict[str, pa.Array]:
    return {"kept_text": pa.array([t.decode() for t in kept_texts(block, gone)], pa.string())}


def spliced_of(block: Block, gone: np.ndarray, counts: np.ndarray) -> dict[str, pa.Array]:
    """Each text without the words that go and the white space after them, else unchanged."""
    drop = np.zeros(len(block.data) + 1, dtype=np.int8)
    changed = np.zeros(len(block.ids), dtype=bool)
    at = 0
    for i, j, words in _parts(block):
        own = gone[at : at + len(words)]
        at += len(words)
        document = words.documents()
        until = np.append(words.starts[1:], 0)
        last = words.first[1:][words.counts() > 0] - 1
        until[last] = words.bounds[document[last] + 1]
        base = block.bounds[i]
        np.add.at(drop, base + words.starts[own], 1)
        np.add.at(drop, base + until[own], -1)
        changed[i:j] = np.bincount(document, own, j - i) > 0
    keep = np.cumsum(drop[:-1], dtype=np.int32) == 0
    out = []
    for k in range(len(block.ids)):
        a, b = int(block.bounds[k]), int(block.bounds[k + 1])
        data = block.data[a:b]
        out.append((data[keep[a:b]] if changed[k] else data).tobytes().decode())
    return {"kept_text": pa.array(out, pa.string())}


def digests_of(block: Block, gone: np.ndarray, counts: np.ndarray) -> dict[str, pa.Array]:
    return {"kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in kept_texts(block, gone)], pa.string())}


def remove_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 50,
    keep: list[str] | None = None,
    derive: Callable[[Block, np.ndarray, np.ndarray], dict[str, pa.Array]] = texts_of,
    schema: str = "kept_text string",
) -> DataFrame:
    """key, other kept columns, n_words, n_removed and what `derive` makes of the kept words."""
    shape = Shape(width)
    names = [f.strip().split()[0] for f in schema.split(",")]
    kept = [c for c in dict.fromkeys([key, *(keep or [])]) if c not in (*names, "n_words", "n_removed")]
    blocks = Blocks(docs, key, text, kept)
    plain = {"compression": "uncompressed"}
    shared = replies(written(blocks.send(send_anchors(shape)), plain), F.sum("value"), F.lit(True))
    windows = written(blocks.receive_and_send(shared, send_windows(shape)), plain)
    discard(docs.sparkSession, shared)

    def finish(block: Block, far: np.ndarray, least: np.ndarray) -> Iterator[pa.RecordBatch]:
        own, gone = covered(block, far, least, shape)
        removed = np.bincount(own.document, gone, len(block.ids)).astype(np.int64)
        made = derive(block, gone, own.counts)
        yield pa.RecordBatch.from_arrays([*block.rest.columns, pa.array(own.counts), pa.array(removed), *(made[n] for n in names)], names=[*kept, "n_words", "n_removed", *names])

    out = ", ".join([f"`{n}` {kind}" for n, kind in blocks.kept] + ["n_words bigint", "n_removed bigint", schema])
    return blocks.receive(replies(windows, F.min("value"), F.col("total") < F.col("value")), finish, out)
