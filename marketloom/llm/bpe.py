"""Byte-level BPE encoding and decoding by two-tier lookup.

Tier one: a minimal perfect hash (hash, displace) over the vocabulary resolves
every pre-token that is itself a vocabulary entry, for a whole batch with numpy.
Tier two: the others are merged with a heap over linked bytes, lowest rank and
leftmost pair first.  Distinct pre-tokens are resolved once per worker, in a
memo of bounded size.

Empty and null texts have no tokens; very long texts are encoded whole; equal
rows give equal results; other columns of the input are kept unless they clash
with an output name, in which case the output replaces them.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import trimmed
from .words import mix

_U = np.uint64


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank of a rank file (base64 token, space, rank on each line)."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    tokens = [b""] * len(ranks)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def _key_hashes(tokens: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each byte string, as an array of shape (2, n)."""
    sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
    ends = np.cumsum(sizes)
    out = np.zeros((2, len(tokens)), dtype=np.uint64)
    step = np.arange(len(data), dtype=np.int64) - np.repeat(ends - sizes, sizes)
    filled = sizes > 0
    for lane, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        part = mix((data.astype(np.uint64) + _U(1)) * _U(odd) + step.astype(np.uint64) * _U(0x165667B19E3779F9))
        if len(data):
            out[lane, filled] = np.add.reduceat(part, (ends - sizes)[filled])
        out[lane] = mix(out[lane] + sizes.astype(np.uint64))
    return out


class PerfectHash:
    """Minimal perfect hash over distinct byte strings: n slots for n keys.

    Keys fall into buckets of about four; buckets, largest first, take the
    first displacement that puts all their keys on free slots.
    """

    def __init__(self, keys: list[bytes]) -> None:
        n = len(keys)
        one, two = _key_hashes(keys)
        self.size, self.buckets = n, max(1, (n + 3) // 4)
        bucket = (one % _U(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        first = np.concatenate(([0], np.cumsum(counts)))
        self.displace = np.zeros(self.buckets, dtype=np.int64)
        self.slots = np.full(max(n, 1), -1, dtype=np.int64)
        free = np.ones(max(n, 1), dtype=bool)
        block = np.arange(256, dtype=np.uint64)
        for b in np.argsort(-counts, kind="stable"):
            if not counts[b]:
                break
            own = order[first[b] : first[b + 1]]
            base, tries = two[own], 0
            while True:
                at = self._slot(base[None, :], (block + _U(tries))[:, None])
                good = free[at].all(axis=1)
                if len(own) > 1:
                    ordered = np.sort(at, axis=1)
                    good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if good.any():
                    pick = int(np.argmax(good))
                    break
                tries += 256
            self.displace[b] = tries + pick
            self.slots[at[pick]] = own
            free[at[pick]] = False

    def _slot(self, two: np.ndarray, displacement: np.ndarray) -> np.ndarray:
        return (mix(two + displacement * _U(0x9E3779B97F4A7C15)) % _U(self.size)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The only index each key can have; the caller compares the key itself."""
        if not self.size:
            return np.full(len(keys), -1, dtype=np.int64)
        one, two = _key_hashes(keys)
        moved = self.displace[(one % _U(self.buckets)).astype(np.int64)].astype(np.uint64)
        return self.slots[self._slot(two, moved)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: a heap of mergeable pairs over linked pieces."""
    n = len(piece)
    size = [1] * n  # bytes of the piece that begins here; 0 once it is merged away
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            heap.append((rank, i, 2))
    heapq.heapify(heap)
    while heap:
        rank, i, span = heapq.heappop(heap)
        own = size[i]
        j = i + own
        if not own or j >= n or own + size[j] != span:
            continue  # one of the two has changed since
        size[i], size[j] = span, 0
        after = i + span
        if after < n:
            before[after] = i
            end = after + size[after]
            found = ranks.get(piece[i:end])
            if found is not None:
                heapq.heappush(heap, (found, i, end - i))
        left = before[i]
        if left >= 0:
            found = ranks.get(piece[left:after])
            if found is not None:
                heapq.heappush(heap, (found, left, after - left))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : i + size[i]]])
        i += size[i]
    return out


class Codec:
    """Encoder and decoder of one worker; `memo` bounds the pre-tokens it keeps."""

    def __init__(self, tokens: list[bytes], pattern: str, table: PerfectHash, memo: int = 400_000) -> None:
        import regex

        self.tokens, self.table, self.memo = tokens, table, memo
        self.find = regex.compile(pattern).findall
        self.ranks = {t: i for i, t in enumerate(tokens)}
        sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        self.sizes, self.ends = sizes, np.cumsum(sizes)
        self.pool = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.length = np.zeros(1 << 16, dtype=np.int64)
        self.offset = np.zeros(1 << 16, dtype=np.int64)
        self.ids = np.zeros(1 << 18, dtype=np.uint32)
        self.used = 0

    def _learn(self, fresh: list[str]) -> None:
        keys = [t.encode() for t in fresh]
        at = self.table.find(keys).tolist()
        tokens, ranks, ids, sizes = self.tokens, self.ranks, [], []
        for key, i in zip(keys, at, strict=True):
            if i >= 0 and tokens[i] == key:
                ids.append(i)
                sizes.append(1)
            else:
                got = merge(key, ranks)
                ids += got
                sizes.append(len(got))
        known, n = len(self.codes), len(fresh)
        while known + n > len(self.length):
            self.length, self.offset = (np.concatenate((x, np.zeros_like(x))) for x in (self.length, self.offset))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        own = np.asarray(sizes, dtype=np.int64)
        self.length[known : known + n] = own
        self.offset[known : known + n] = self.used + np.cumsum(own) - own
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.codes.update(zip(fresh, range(known, known + n), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, end of each text's ids)."""
        pieces: list[str] = []
        stops = []
        for text in texts:
            pieces += self.find(text)
            stops.append(len(pieces))
        if len(self.codes) > self.memo:
            self._clear()
        fresh = list(set(pieces).difference(self.codes))
        if fresh:
            self._learn(fresh)
        codes = np.fromiter(map(self.codes.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        sizes = self.length[codes]
        ends = np.cumsum(sizes)
        index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.offset[codes] - (ends - sizes), sizes)
        bounds = np.concatenate(([0], ends))[np.asarray(stops, dtype=np.int64)] if stops else np.empty(0, dtype=np.int64)
        return self.ids[index], bounds

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a run of ids."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.ends[ids] - ends, sizes)
        return self.pool[index].tobytes()


#: Characters of text per encoding step.
STEP = 1 << 20


def _steps(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    run: list[str] = []
    held = first = 0
    for i, text in enumerate(texts):
        run.append(text or "")
        held += len(run[-1])
        if held >= STEP:
            yield first, run
            run, held, first = [], 0, i + 1
    if run:
        yield first, run


def token_ids(codec: Codec, texts: list[str | None]) -> dict[str, pa.Array]:
    """Default output: the ids."""
    parts, ends, base = [], [0], 0
    for _, run in _steps(texts):
        ids, stops = codec.encode(run)
        parts.append(ids)
        ends += (stops + base).tolist()
        base += len(ids)
    flat = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32)
    return {"token_ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))}


def digests(codec: Codec, texts: list[str | None]) -> dict[str, pa.Array]:
    """Token count and digests of the ids and of the bytes decoded from them."""
    return ids_and_digests(codec, texts)


def ids_and_digests(codec: Codec, texts: list[str | None]) -> dict[str, pa.Array]:
    """The ids with their digests."""
    parts, ends = [], [0]
    made: dict[str, list[pa.Array]] = {}
    for _, run in _steps(texts):
        ids, stops = codec.encode(run)
        parts.append(ids)
        before, cuts = ends[-1], [0, *stops.tolist()]
        ends += [before + s for s in cuts[1:]]
        own = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        made.setdefault("n_tokens", []).append(pa.array([len(x) for x in own], pa.int64()))
        made.setdefault("ids_sha256", []).append(pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own], pa.string()))
        made.setdefault("decoded_sha256", []).append(pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in own], pa.string()))
    flat = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32)
    return {k: pa.concat_arrays(v) for k, v in made.items()} | {"token_ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))}


def encode(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    text: str = "text",
    derive: Callable[[Codec, list[str | None]], dict[str, pa.Array]] = token_ids,
    schema: str = "token_ids array<int>",
    keep: list[str] | None = None,
) -> DataFrame:
    """df's columns (or `keep`) and what `derive` makes of the encoded texts.

    The rank file is read on the driver and broadcast with its perfect hash:
    its size is that of the vocabulary, whatever the corpus.
    """
    spark = df.sparkSession
    tokens = read_ranks(ranks_path)
    shared = spark.sparkContext.broadcast((tokens, PerfectHash(tokens)))
    names = [f.strip().split()[0] for f in schema.split(",")]
    kept = [c for c in (keep if keep is not None else df.columns) if c not in names]
    source = df.select(*dict.fromkeys([*kept, text]))
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema] + [schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value[0], pattern, shared.value[1])
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                made = derive(codec, part.column(part.schema.get_field_index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in kept] + [made[c] for c in names], names=[*kept, *names])

    return source.mapInArrow(trimmed(run), out)


def decode(df: DataFrame, ranks_path: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """Adds the bytes that a column of ids stands for (null ids: null)."""
    spark = df.sparkSession
    tokens = spark.sparkContext.broadcast(read_ranks(ranks_path))
    kept = [c for c in df.columns if c != to]
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema] + [f"`{to}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokens.value
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            made = pa.array([None if r is None else b"".join(map(table.__getitem__, r)) for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + [made], names=[*kept, to])

    return df.mapInArrow(trimmed(run), out)
