"""URL filters: host and path rules first, gradient-boosted trees for the rest.

Rules name a host and a path prefix; a rule fits its host and all subdomains
where the URL's path starts with the rule's path, and the longest fitting rule
decides.  URLs that no rule fits are judged by boosted trees over lexical
features: lengths, depth, digit ratio, entropy, parameter counts and statistics
of the host's suffix.  Those statistics count all URLs that a rule labels; there
are as many suffixes at most as rules, as a rule's host ends with its suffix.
The trees are trained on the distinct URLs that a rule labels: the `sample` ones
of the smallest hashes (documented bound).

Null URLs and those without "://" have empty host and path, and are judged by
the trees like any other.  If no rule labels any URL, or all labels agree, the
verdict is that label (allow when there is none).  Repeated rows get equal
results.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import trimmed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path columns of a URL column; empty without "://"."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


class Rules:
    """Longest fitting rule of (rule, verdict) pairs, as `host/path` strings."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
            host, _, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((f"/{path}", rule, verdict))

    def judge(self, host: str, path: str) -> tuple[str, str] | None:
        best: tuple[str, str] | None = None
        at = 0
        while True:
            for prefix, rule, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(prefix):
                    if best is None or len(rule) > len(best[0]):
                        best = (rule, verdict)
                    break
            at = host.find(".", at) + 1
            if not at:
                return best


#: Names of the lexical features, in the order of `features`.
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "entropy", "host_entropy", "parameters", "query_length", "fragment", "hyphens", "longest_token", "tail_length", "secure", "suffix_count", "suffix_rate")


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def features(url: str, host: str, path: str, suffixes: dict[str, tuple[float, float]]) -> list[float]:
    after = url.partition("?")[2].partition("#")[0]
    n = max(len(url), 1)
    count, rate = suffixes.get(host.rpartition(".")[2], (0.0, 0.5))
    tokens = path.replace("-", "/").replace("_", "/").split("/")
    return [
        len(url), len(host), len(path), sum(map(bool, path.split("/"))), host.count(".") + 1, sum(map(str.isdigit, url)) / n, sum(map(str.isdigit, host)),
        _entropy(url), _entropy(host), len(after.split("&")) if after else 0, len(after), "#" in url, host.count("-"), max(map(len, tokens)), len(path.rpartition("/")[2]),
        url.startswith("https"), math.log1p(count), rate,
    ]


class BoostedTrees:
    """Complete binary trees of one depth on binned features, logistic loss."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 5.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.prior, self.feature, self.cut, self.value = 0.0, [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        if not len(y):
            self.prior = -1.0
            return self
        mean = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
        self.prior = math.log(mean / (1 - mean))
        if y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        score = np.full(len(y), self.prior)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            feature, cut = [], []
            for level in range(self.depth):
                width = 1 << level
                best = np.zeros(width)
                chosen, place = np.zeros(width, dtype=np.int64), np.full(width, self.bins, dtype=np.int64)
                for f in range(x.shape[1]):
                    at = node * self.bins + binned[:, f]
                    g = np.bincount(at, gradient, width * self.bins).reshape(width, self.bins).cumsum(axis=1)
                    h = np.bincount(at, weight, width * self.bins).reshape(width, self.bins).cumsum(axis=1)
                    gr, hr = g[:, -1:] - g, h[:, -1:] - h
                    gain = g * g / (h + 1) + gr * gr / (hr + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                    gain[(h < self.least * 0.05) | (hr < self.least * 0.05)] = 0
                    top = gain.argmax(axis=1)
                    better = gain[np.arange(width), top] > best + 1e-9
                    best[better], chosen[better], place[better] = gain[np.arange(width), top][better], f, top[better]
                feature.append(chosen)
                cut.append(np.array([cuts[f][b] if b < len(cuts[f]) else np.inf for f, b in zip(chosen, place, strict=True)]))
                node = 2 * node + (x[np.arange(len(y)), chosen[node]] > cut[-1][node])
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, gradient, leaves) / (np.bincount(node, weight, leaves) + 1)
            score += value[node]
            self.feature.append(feature)
            self.cut.append(cut)
            self.value.append(value)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.prior), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for f, c in zip(feature, cut, strict=True):
                node = 2 * node + (x[rows, f[node]] > c[node])
            score += value[node]
        return 1 / (1 + np.exp(-score))


#: Columns that judging adds.
JUDGED = "host string, path string, rule string, verdict string, block_score double"


def judge(df: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url", sample: int = 20_000, seed: int = 3) -> DataFrame:
    """key, host, path, rule, verdict and block_score of each URL.

    block_score is 1 or 0 where a rule decides, else the trees' probability;
    0.5 or more blocks.  The rules are held by every worker.
    """
    spark = df.sparkSession
    host, path = host_and_path(url)
    parsed = df.select(F.col(key), F.coalesce(F.col(url), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    verdict = F.lit(None).cast("string")
    for rule, said in sorted(rules, key=lambda r: len(r[0])):  # longer rules overrule shorter ones
        of, _, prefix = rule.partition("/")
        verdict = F.when(((F.col("host") == of) | F.col("host").endswith(f".{of}")) & F.col("path").startswith(f"/{prefix}"), said).otherwise(verdict)
    labelled = parsed.withColumn("said", verdict).where("said IS NOT NULL")
    counted = labelled.groupBy(F.substring_index("host", ".", -1).alias("suffix")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("said") == "block").alias("blocked")).collect()
    suffixes = {r.suffix: (r.n, (r.blocked + 1) / (r.n + 2)) for r in counted}
    kinds = labelled.agg(F.approx_count_distinct("url").alias("n")).first().n
    near = F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, 2 * sample / max(kinds, 1)) * (1 << 30))  # few more than needed reach the driver
    chosen = labelled.where(near).select("url", "host", "path", "said").distinct().orderBy(F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(1 << 30)), "url").limit(sample).collect()
    rows = [(r.url, r.host, r.path) for r in chosen]
    y = np.array([r.said == "block" for r in chosen], dtype=np.float64)
    x = np.array([features(*r, suffixes) for r in rows], dtype=np.float64).reshape(len(rows), len(FEATURES))
    shared = spark.sparkContext.broadcast((Rules(rules), suffixes, BoostedTrees().fit(x, y)))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, stats, model = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            urls, hosts, paths = (batch.column(i).to_pylist() for i in (1, 2, 3))
            found = [held.judge(h, p) for h, p in zip(hosts, paths, strict=True)]
            score = np.array([float(f is not None and f[1] == "block") for f in found])
            rest = [i for i, f in enumerate(found) if f is None]
            if rest:
                score[rest] = model.predict(np.array([features(urls[i], hosts[i], paths[i], stats) for i in rest], dtype=np.float64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array([f and f[0] for f in found], pa.string()), pa.array(["block" if s >= 0.5 else "allow" for s in score], pa.string()), pa.array(score, pa.float64())],
                names=[key, "host", "path", "rule", "verdict", "block_score"],
            )

    return parsed.mapInArrow(trimmed(run), f"`{key}` {kind}, {JUDGED}")
