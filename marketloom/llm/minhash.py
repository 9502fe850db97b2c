"""MinHash near-duplicate detection with min-max signatures.

Each text becomes its set of word shingles.  Under each permutation both the
minimum and the maximum of the set are kept, so 64 permutations give a
signature of 128 values at half the hash evaluations.  32 bands of 4 values
make pairs at a similarity of 0.8 candidates with probability 1 - 5e-8.

From candidates to exact classes, without emitting the pairs of a group:

1. equal sets collapse to one representative (a combined minimum);
2. inside each band bucket (large ones in block pairs of at most BLOCK
   members) signatures are compared and a spanning forest of the pairs whose
   estimate is at least the threshold less five standard errors is emitted;
3. the forests' components are families; each family's full sets are fetched
   once and compared exactly (again in block pairs), and the links that join
   what is not yet joined are emitted;
4. the components of those links are the classes.

A null or empty text, or one without words, has an empty set and links with
nothing; with fewer words than a shingle, the whole sequence is one shingle.
Rows are told apart by their sets, never by id alone: rows that repeat an id
with other texts have links and classes of their own, and rows that repeat both
share one result.  A row with a null id takes part like any other; a class is
called by its smallest id that is not null, and only rows with a null id are
kept in a class without one.  Extra columns are ignored unless named in `keep`.
Shingles are compared by 64-bit hashes, sets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_groups, trimmed, written
from .graph import components, named, numbered
from .words import Words, _stream, mix, runs, slices

PERMUTATIONS = 64
BANDS, ROWS = 32, 4
#: Members of a bucket or family block that one task compares at once, and shingles of a family block.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
_U = np.uint64
_A = (_stream("permutation a", PERMUTATIONS) >> _U(32)).astype(np.uint32) | np.uint32(1)
_B = (_stream("permutation b", PERMUTATIONS) >> _U(32)).astype(np.uint32)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for i, j, data, bounds in slices(texts):
        words = Words(data, bounds)
        hashes = words.hashes(0, fold_case=True)
        windows = runs(hashes, width)
        for k in range(j - i):
            a, b = int(words.first[k]), int(words.first[k + 1])
            if b - a >= width:
                yield np.unique(windows[a : b - width + 1])
            elif b > a:
                yield runs(hashes[a:b], b - a, seed=b - a)
            else:
                yield np.empty(0, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation; interleaved, as uint32."""
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, dtype=np.uint32)
    high = np.zeros(PERMUTATIONS, dtype=np.uint32)
    short = (shingles >> _U(32)).astype(np.uint32)
    for at in range(0, len(short), 4096):
        y = _A[:, None] * short[None, at : at + 4096] + _B[:, None]
        np.minimum(low, y.min(axis=1), out=low)
        np.maximum(high, y.max(axis=1), out=high)
    return np.concatenate((low, high))


def bands(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each signature (n, 128): two minima and two maxima a band."""
    n = len(signatures)
    low = signatures[:, :PERMUTATIONS].reshape(n, BANDS, 2)
    high = signatures[:, PERMUTATIONS:].reshape(n, BANDS, 2)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * _U(0x9E3779B97F4A7C15)
    for part in (low[..., 0], low[..., 1], high[..., 0], high[..., 1]):
        key = mix(key + part.astype(np.uint64))
    return key.view(np.int64)


def _print(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    if not len(s):
        return 0, 0
    weights = s * _U(0xD6E8FEB86659FD93)
    return int(mix(np.add.reduce(mix(s), keepdims=True))[0]) ^ len(s), int(mix(np.add.reduce(mix(weights), keepdims=True))[0])


def _prints(prints: list[tuple[int, int]]) -> tuple[pa.Array, pa.Array]:
    one, two = np.array(prints, dtype=np.uint64).reshape(-1, 2).T.copy().view(np.int64)
    return pa.array(one), pa.array(two)


def _table(texts: pa.Array, width: int) -> dict[str, pa.Array]:
    sizes, prints, sketches = [], [], []
    for s in shingle_sets(texts, width):
        sizes.append(len(s))
        prints.append(_print(s))
        sketches.append(signature(s) if len(s) else np.zeros(2 * PERMUTATIONS, dtype=np.uint32))
    full = np.array(sketches, dtype=np.uint32).reshape(len(sizes), 2 * PERMUTATIONS)
    one, two = _prints(prints)
    small = (full * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
    return {
        "n": pa.array(sizes, pa.int64()),
        "print1": one,
        "print2": two,
        "sketch": pa.array([r.tobytes() for r in small], pa.binary()),
        "keys": pa.array(list(bands(full)), pa.list_(pa.int64())),
    }


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _forest(pairs: Iterator[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    parent, out = np.arange(n), []
    for i, j in pairs:
        a, b = _root(parent, i), _root(parent, j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _edges(ids: np.ndarray, forest: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if forest:
        at = np.array(forest)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], names=["a", "b"])


def _similar(least: float):  # noqa: ANN202
    def make():  # noqa: ANN202
        def work(_: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
            ids = rows["node"].to_numpy()
            if len(ids) < 2:
                return
            sketches = np.frombuffer(b"".join(rows["sketch"].to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
            # a byte agrees by chance once in 256, which only adds candidates
            def pairs() -> Iterator[tuple[int, int]]:
                done = np.zeros(len(ids), dtype=bool)
                while not done.all():  # breadth first: a joined member is compared with the unjoined ones only
                    queue = [int(np.argmin(done))]
                    done[queue[0]] = True
                    while queue:
                        i = queue.pop()
                        rest = np.flatnonzero(~done)
                        hit = rest[(sketches[rest] == sketches[i]).mean(axis=1) >= least] if len(rest) else rest
                        done[hit] = True
                        queue += hit.tolist()
                        yield from ((i, int(j)) for j in hit)

            yield from _edges(ids, _forest(pairs(), len(ids)))

        return work

    return make


def _links(percent: int):  # noqa: ANN202
    def make():  # noqa: ANN202
        def work(_: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
            ids = rows["node"].to_numpy()
            if len(ids) < 2:
                return
            sizes = rows["n"].to_numpy()
            flat = np.frombuffer(b"".join(rows["shingles"].to_pylist()), dtype=np.uint64)
            owner = np.repeat(np.arange(len(ids)), sizes)
            if len(ids) == 2:
                shared = np.array([[0, len(np.intersect1d(flat[: sizes[0]], flat[sizes[0] :], assume_unique=True))], [0, 0]])
            else:
                _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
                useful = count[code] > 1
                column = np.cumsum(count > 1)[code[useful]] - 1
                owner = owner[useful]
                order = np.argsort(column, kind="stable")
                column, owner = column[order], owner[order]
                shared = np.zeros((len(ids), len(ids)), dtype=np.float32)
                wide = max(64, (1 << 22) // len(ids))
                for at in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
                    a, b = np.searchsorted(column, (at, at + wide))
                    part = np.zeros((len(ids), wide), dtype=np.float32)
                    part[owner[a:b], column[a:b] - at] = 1
                    shared += part @ part.T
            i, j = np.nonzero(np.triu(100 * shared.astype(np.int64) >= percent * (sizes[:, None] + sizes[None, :] - shared.astype(np.int64)), 1))
            yield from _edges(ids, _forest(zip(i.tolist(), j.tolist(), strict=True), len(ids)))

        return work

    return make


def _paired(rows: DataFrame, key: str, blocks: str, id_: str) -> DataFrame:
    """Rows once for each pair of blocks that their own block is in: columns i, j added.

    A group of one block has the pair (0, 0) only; in a larger one every two
    rows meet in the pair of their blocks.
    """
    own = rows.withColumn("_own", F.pmod(F.xxhash64(id_, F.lit(5)), F.col(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1))
    return own.withColumn("_other", other).withColumn("i", F.least("_own", "_other")).withColumn("j", F.greatest("_own", "_other")).where((F.col("i") < F.col("j")) | (F.col(blocks) == 1)).drop("_own", "_other", blocks)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, columns to keep, n_shingles, component_id and kept of each document (see the module)."""
    texts = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    carried = [f"k{i}" for i in range(len(keep))]
    out = ", ".join(["doc bigint, n bigint, print1 bigint, print2 bigint, sketch binary, keys array<bigint>", *(f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in zip(carried, keep, strict=True))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                made = _table(part.column(1), width)
                yield pa.RecordBatch.from_arrays([part.column(0), *made.values(), *part.columns[2:]], names=["doc", *made, *carried])

    prints = ["print1", "print2"]
    table = written(texts.mapInArrow(trimmed(sketch), out))
    reps = written(numbered(table.where("n > 0").groupBy(*prints).agg(F.min("doc").alias("doc")), ["doc", *prints]))
    same = [table[c] == reps[c] for c in prints] + [table["doc"].eqNullSafe(reps["doc"])]
    lone = written(table.join(reps, same).select("node", reps["doc"], *[reps[c] for c in prints], "n", "sketch", "keys").dropDuplicates(["node"]))
    keyed = lone.select("node", F.explode("keys").alias("key"))
    full = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key", F.ceil(F.col("members") / BLOCK).alias("blocks")))
    least = max(0.0, percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / (2 * PERMUTATIONS)) ** 0.5)
    members = _paired(keyed.join(full, "key"), "key", "blocks", "node").join(lone.select("node", "sketch"), "node")
    alike = map_groups(members.select("key", "i", "j", "node", "sketch"), ["key", "i", "j"], _similar(least), "a bigint, b bigint", order=["node"])
    family = written(components(alike))
    sized = written(lone.select("node", "doc", *prints, "n").join(family, "node"))
    blocks = written(sized.groupBy("component").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK)).alias("blocks")))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                sets = list(shingle_sets(batch.column(0).slice(at, 1000), width))
                yield pa.RecordBatch.from_arrays([*_prints([_print(s) for s in sets]), pa.array([s.tobytes() for s in sets], pa.binary())], names=[*prints, "shingles"])

    wanted = sized.select(F.col("doc").alias("own")).distinct()
    sets = texts.join(wanted, F.col("doc").eqNullSafe(F.col("own")), "left_semi").select("text").mapInArrow(trimmed(fetch), "print1 bigint, print2 bigint, shingles binary")
    # rows that repeat an id and a text come once
    placed = _paired(sized.join(blocks, "component"), "component", "blocks", "node").join(sets.dropDuplicates(prints), prints)
    links = map_groups(placed.select("component", "i", "j", "node", "n", "shingles"), ["component", "i", "j"], _links(percent), "a bigint, b bigint", order=["node"])
    classes = named(reps, components(links), "doc")
    result = written(reps.join(classes, "node", "left").select(*prints, F.coalesce("class", "doc").alias("class")))
    joined = table.select("doc", "n", *prints, *carried).join(result, prints, "left")
    component = F.coalesce("class", "doc")
    return joined.select(F.col("doc").alias(key), *[F.col(k).alias(c) for k, c in zip(carried, keep, strict=True)], F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc")).alias("kept"))
