"""Embedding near-dedup with randomised-rotation binary codes.

Each unit vector is rotated at random; its code is the signs of the rotated
coordinates, and its stored correction factor f is the inner product of the
rotated vector with its own code.  For another rotated vector y and
a = <code, y>, a / f estimates the inner product without bias, with an error of
about sqrt((1 - f^2) / f^2 / (d - 1)) times a normal variable.  Pairs whose
estimate plus EPSILON of those errors stays below the threshold are dropped; so
are pairs that the spherical bound f a + sqrt(1 - f^2) sqrt(1 - a^2), which
always holds, keeps below it.  All others are recomputed exactly in double
precision.

Vectors are compared only with equal, non-null labels.  Equal vectors collapse
to one with a multiplicity first, so a very common vector costs one row.  Each
label's distinct vectors form blocks of at most about BLOCK rows, and every two
blocks meet in one task, which emits link counts and a spanning forest: what
comes out grows with the vectors, not with the pairs.  What goes in does not: a
label of n distinct vectors is read n / BLOCK times.

Null vectors, empty ones, all-zero ones and those with null or non-finite
components link with nothing, as do vectors of different lengths.  Rows are told
apart by label and vector, never by id alone: rows that repeat an id with other
vectors have links and classes of their own.  A row with a null id takes part
like any other; a class is called by its smallest id that is not null, and only
rows with a null id are kept in a class without one.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_groups, trimmed, written
from .graph import components, named, numbered
from .words import mix

BLOCK = 4096
#: Rows of a block that are compared with another block at once; bounds the mask.
STRIP = 512
EPSILON = 6.0
_U = np.uint64


@lru_cache(maxsize=8)
def rotation(d: int, seed: int = 29) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def code(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed signs, correction factor) of unit vectors (n, d)."""
    y = unit @ rotation(unit.shape[1]).T
    return np.packbits(y >= 0, axis=1), np.abs(y).sum(axis=1) / np.sqrt(unit.shape[1])


def turned(unit: np.ndarray) -> np.ndarray:
    """Rotated unit vectors, as `candidates` takes them."""
    return (unit @ rotation(unit.shape[1]).T).astype(np.float32)


def candidates(codes: np.ndarray, factors: np.ndarray, others: np.ndarray, least: float) -> np.ndarray:
    """Mask (n, m) of the pairs that the codes cannot rule out: n coded rows against m rotated unit vectors."""
    d = others.shape[1]
    signs = (np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(d))
    a = np.clip(signs @ others.T, -1, 1)
    f = np.minimum(factors, 1).astype(np.float32)[:, None]
    spread = np.sqrt(np.maximum(1 - f * f, 0)) / f / np.sqrt(max(d - 1, 1))
    likely = a / f + EPSILON * spread >= least
    possible = f * a + np.sqrt(np.maximum(1 - f * f, 0)) * np.sqrt(np.maximum(1 - a * a, 0)) >= least - 1e-4
    return likely & possible


def _prints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's bytes."""
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
    place = mix(np.arange(1, x.shape[1] + 1, dtype=np.uint64))
    one = mix(bits * _U(0x9E3779B97F4A7C15) + place)
    two = mix(bits * _U(0xC2B2AE3D27D4EB4F) + place * _U(3))
    return mix(one.sum(axis=1, dtype=np.uint64)).view(np.int64), mix(two.sum(axis=1, dtype=np.uint64)).view(np.int64)


CODED = ["vec", "label", "d", "print1", "print2", "unit", "code", "factor"]


def _coded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """All rows, those with a usable vector and a label coded; one batch for each vector length and one for the rest."""
    column = batch.column(2)
    rest = np.ones(batch.num_rows, dtype=bool)
    sizes = np.diff(np.asarray(column.offsets)) if len(column) else np.empty(0, dtype=np.int64)
    sizes = np.where(np.asarray(column.is_null()) | np.asarray(batch.column(1).is_null()), 0, sizes)
    for d in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == d)
        flat = column.take(pa.array(own)).flatten()
        x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(own), d)
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        own, x = own[good], x[good]
        if not len(own):
            continue
        rest[own] = False
        scale = np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
        scaled = x / scale
        unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
        codes, factors = code(unit)
        one, two = _prints(x)
        pick = pa.array(own)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(np.full(len(own), d)), pa.array(one), pa.array(two)]
            + [pa.array([r.tobytes() for r in m], pa.binary()) for m in (unit, codes)]
            + [pa.array(factors)],
            names=CODED,
        )
    if rest.any():
        own = pa.array(np.flatnonzero(rest))
        ids, labels = batch.column(0).take(own), batch.column(1).take(own)
        yield pa.RecordBatch.from_arrays([ids, labels] + [pa.nulls(len(own), kind) for kind in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float64())], names=CODED)


def _compare(least: float):  # noqa: ANN202
    def make():  # noqa: ANN202
        def work(key: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
            d, i, j = int(key[1]), int(key[2]), int(key[3])
            ids, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
            own = rows["own"].to_numpy()
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            if not len(left) or not len(right):
                return
            x = np.frombuffer(b"".join(rows["unit"].to_pylist()), dtype=np.float64).reshape(len(ids), d)
            codes = np.frombuffer(b"".join(rows["code"].to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
            factors = rows["factor"].to_numpy()
            others, found = turned(x[right]), []
            for at in range(0, len(left), STRIP):
                strip = left[at : at + STRIP]
                mask = candidates(codes[strip], factors[strip], others, least)
                if i == j:
                    mask &= strip[:, None] < right[None, :]
                a, b = np.nonzero(mask)
                a, b = strip[a], right[b]
                hit = np.zeros(len(a), dtype=bool)
                for k in range(0, len(a), 1 << 15):
                    part = slice(k, k + (1 << 15))
                    hit[part] = np.einsum("nd,nd->n", x[a[part]], x[b[part]]) >= least
                found.append((a[hit], b[hit]))
            a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            if not len(a):
                return
            links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
            parent = np.arange(len(ids))

            def root(k: int) -> int:
                while parent[k] != k:
                    parent[k] = parent[parent[k]]
                    k = parent[k]
                return k

            for p, q in zip(a.tolist(), b.tolist(), strict=True):
                p, q = root(p), root(q)
                if p != q:
                    parent[max(p, q)] = min(p, q)
            linked = np.flatnonzero(links)
            roots = np.array([root(k) for k in linked.tolist()])
            yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[roots]), pa.array(links[linked].astype(np.int64))], names=["a", "b", "links"])

        return work

    return make


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93) -> DataFrame:
    """key, n_links, component_id and kept of each vector (see the module)."""
    rows = df.select(F.col(key).cast("bigint").alias("vec"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                yield from _coded(batch.slice(at, 2000))

    coded = written(rows.mapInArrow(trimmed(run), "vec bigint, label string, d bigint, print1 bigint, print2 bigint, unit binary, code binary, factor double"))
    usable, same = coded.where("d IS NOT NULL"), ["label", "d", "print1", "print2"]
    reps = written(numbered(usable.groupBy(*same).agg(F.min("vec").alias("vec"), F.count(F.lit(1)).alias("copies")), ["vec", *same]))
    own = [usable[c] == reps[c] for c in same] + [usable["vec"].eqNullSafe(reps["vec"])]
    single = usable.join(reps, own).select(usable["label"], usable["d"], "node", "copies", "unit", "code", "factor").dropDuplicates(["node"])
    blocks = reps.groupBy("label", "d").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = single.join(written(blocks), ["label", "d"]).withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    found = written(map_groups(placed.select("label", "d", "i", "j", "own", "node", "copies", "unit", "code", "factor"), ["label", "d", "i", "j"], _compare(least), "a bigint, b bigint, links bigint", order=["node"]))
    classes = named(reps, components(found.select("a", "b")), "vec")
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    result = reps.join(links, "node", "left").join(classes, "node", "left")
    result = written(result.select(*same, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("class", "vec").alias("component_id")))
    linked = usable.select("vec", *same).join(result, same).select("vec", "n_links", "component_id")
    alone = coded.where("d IS NULL").select("vec", F.lit(0).cast("bigint").alias("n_links"), F.col("vec").alias("component_id"))
    return linked.unionByName(alone).select(F.col("vec").alias(key), "n_links", "component_id", F.col("component_id").eqNullSafe(F.col("vec")).alias("kept"))
