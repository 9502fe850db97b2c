"""Language identification by a byte convolutional network.

Windows of a fixed number of bytes (A-Z folded) pass filters of several widths;
each filter's largest response over the window (max pooling) feeds a softmax.
A text is cut into consecutive windows over its whole length; its prediction is
the softmax of the windows' mean logits, weighted by their bytes.  As a filter
over one-hot bytes is a sum of table rows, inference looks up byte pairs.

Training runs in numpy on the driver over a bounded sample of labelled rows:
about `per_language` distinct texts of each language, chosen by a hash of the
text, and of all windows of their whole texts the `windows` ones a language with
the smallest hashes, which is a strict bound.  More than `most` languages raise
an error.

A null text, or one without a letter, gets `und` and score 0.  Ties go to the
first language in order.  With no labelled row at all every text is `und`.
Extra columns are ignored; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import trimmed
from .words import slices

WINDOW = 256
WIDTHS = (2, 4, 6)
FILTERS = 16
UNKNOWN = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class ByteCnn:
    """tables: for each tap of each width a (256, FILTERS) table; dense: (features + 1, languages)."""

    def __init__(self, languages: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [[rng.normal(0, 0.3, (256, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS]
        self.dense = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS + 1, len(languages))).astype(np.float32)

    def _responses(self, x: np.ndarray, width: int, taps: list[np.ndarray]) -> np.ndarray:
        n = x.shape[1] - width + 1
        out = taps[0][x[:, :n]]
        for j in range(1, width):
            out = out + taps[j][x[:, j : j + n]]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.01, seed: int = 11) -> ByteCnn:
        """Adam on cross-entropy; half of the windows are shortened at random."""
        rng = np.random.default_rng(seed)
        params = [t for taps in self.tables for t in taps] + [self.dense]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        total = epochs * max(1, (len(x) + batch - 1) // batch)
        for _ in range(epochs):
            for own in np.array_split(rng.permutation(len(x)), max(1, (len(x) + batch - 1) // batch)):
                b = x[own].copy()
                cut = np.where(rng.random(len(own)) < 0.5, WINDOW, rng.integers(6, WINDOW, len(own)))
                b[np.arange(WINDOW)[None, :] >= cut[:, None]] = 0
                grads = self._gradients(b, y[own])
                step += 1
                now = rate * (1 - 0.9 * step / total)
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n = len(x)
        pooled, places = [], []
        for width, taps in zip(WIDTHS, self.tables, strict=True):
            r = self._responses(x, width, taps)
            at = r.argmax(axis=1)
            places.append(at)
            pooled.append(np.take_along_axis(r, at[:, None, :], axis=1)[:, 0, :])
        z = np.concatenate(pooled, axis=1)
        h = np.concatenate([np.maximum(z, 0), np.ones((n, 1), np.float32)], axis=1)
        logits = h @ self.dense
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        dense = h.T @ p + 1e-4 * self.dense
        back = (p @ self.dense[:-1].T) * (z > 0)
        grads = []
        rows, columns = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
        for k, width in enumerate(WIDTHS):
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(width):
                g = np.zeros((256, FILTERS), np.float32)
                np.add.at(g, (x[rows, places[k] + j], columns), own)
                grads.append(g)
        return [*grads, dense]

    def compiled(self) -> list[list[np.ndarray]]:
        """Tables over byte pairs (65,536 rows) for inference."""
        return [[(taps[j][:, None, :] + taps[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, len(taps), 2)] for taps in self.tables]

    def logits(self, x: np.ndarray, pairs: list[list[np.ndarray]]) -> np.ndarray:
        """Logits of windows (n, WINDOW) of folded bytes."""
        codes = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        pooled = []
        for width, tables in zip(WIDTHS, pairs, strict=True):
            n = x.shape[1] - width + 1
            r = tables[0][codes[:, :n]]
            for j, table in enumerate(tables[1:], 1):
                r += table[codes[:, 2 * j : 2 * j + n]]
            pooled.append(r.max(axis=1))
        h = np.maximum(np.concatenate(pooled, axis=1), 0)
        return h @ self.dense[:-1] + self.dense[-1]


def windows_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows of folded bytes, document of each, bytes in each); an empty document has none."""
    sizes = np.diff(bounds)
    per = (sizes + WINDOW - 1) // WINDOW
    document = np.repeat(np.arange(len(sizes)), per)
    start = bounds[:-1][document] + WINDOW * (np.arange(len(document)) - np.repeat(np.cumsum(per) - per, per))
    length = np.minimum(bounds[1:][document] - start, WINDOW)
    at = start[:, None] + np.arange(WINDOW)[None, :]
    x = _FOLD[data[np.minimum(at, max(len(data) - 1, 0))]]
    x[np.arange(WINDOW)[None, :] >= length[:, None]] = 0
    return x, document, length


def train(df: DataFrame, text: str = "text", label: str = "lang", per_language: int = 1000, windows: int = 3000, most: int = 1000, seed: int = 7) -> ByteCnn:
    """Fits the network on a bounded, hash-chosen sample of labelled rows (see the module)."""
    digest = F.xxhash64(F.col(text), F.lit(seed))
    rows = df.where(F.col(label).isNotNull() & (F.length(text) > 0)).select(F.col(label).alias("y"), F.col(text).alias("t"), digest.alias("h"))
    counts = rows.groupBy("y").agg(F.approx_count_distinct("h").alias("n")).limit(most + 1).collect()
    if not counts:
        return ByteCnn([UNKNOWN])
    if len(counts) > most:
        raise ValueError(f"more than {most} languages")
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["y"], min(1.0, per_language / max(r["n"], 1)))])
    near = F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) < F.element_at(share, F.col("y"))
    texts = rows.where(near).groupBy("y", "h").agg(F.min("t").alias("t"))
    at = texts.select("y", "h", "t", F.explode(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / WINDOW).cast("int"))).alias("i"))
    order = Window.partitionBy("y").orderBy(F.xxhash64("h", "i"), "h", "i")
    ranked = at.select("y", F.expr(f"substring(t, i * {WINDOW} + 1, {WINDOW})").alias("x"), F.row_number().over(order).alias("r"))
    sample = ranked.where(F.col("r") <= windows).select("y", "r", "x").collect()
    sample.sort(key=lambda r: (r["y"], r["r"]))
    languages = sorted(r["y"] for r in counts)
    index = {name: i for i, name in enumerate(languages)}
    x = np.zeros((len(sample), WINDOW), dtype=np.uint8)
    for i, r in enumerate(sample):
        w = r["x"].encode()[:WINDOW]
        x[i, : len(w)] = _FOLD[np.frombuffer(w, dtype=np.uint8)]
    return ByteCnn(languages, seed).fit(x, np.array([index[r["y"]] for r in sample]))


def has_letter(text: str | Column) -> Column:
    """Whether a text has a letter of any script (null: null)."""
    return F.col(text).rlike(r"\p{L}") if isinstance(text, str) else text.rlike(r"\p{L}")


#: Windows in one pass; bounds temporaries.
PASS = 256


def identify(df: DataFrame, model: ByteCnn, keep: list[str], text: str = "text") -> DataFrame:
    """keep, lang_pred and score of each row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in keep if c not in ("lang_pred", "score")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema] + ["lang_pred string", "score double"])
    source = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)], *([] if text in kept else [F.col(text).alias("t")]), F.coalesce(has_letter(text), F.lit(False)).alias("letters"))
    at_text = kept.index(text) if text in kept else len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cnn = shared.value
        pairs, names = cnn.compiled(), np.array([*cnn.languages, UNKNOWN], dtype=object)
        for batch in batches:
            if not batch.num_rows:
                continue
            best = np.full(batch.num_rows, len(cnn.languages))
            score = np.zeros(batch.num_rows)
            letters = np.asarray(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False), dtype=bool)
            for i, j, data, bounds in slices(batch.column(at_text), 1 << 18):
                x, document, length = windows_of(data, bounds)
                total = np.zeros((j - i, len(cnn.languages)))
                for at in range(0, len(x), PASS):
                    part = slice(at, at + PASS)
                    np.add.at(total, document[part], cnn.logits(x[part], pairs) * length[part, None])
                total /= np.maximum(np.diff(bounds), 1)[:, None]
                p = np.exp(total - total.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best[i:j], score[i:j] = p.argmax(axis=1), p.max(axis=1)
            best[~letters], score[~letters] = len(cnn.languages), 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in range(len(kept))] + [pa.array(names[best], pa.string()), pa.array(score, pa.float64())],
                names=[*kept, "lang_pred", "score"],
            )

    return source.mapInArrow(trimmed(run), schema)
