"""Duplicates, passages, vectors, language model, mixing and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import attention, bpe, graph, langid, lm, minhash, mixing, op1, substrings, vectors
from marketloom.llm.words import Words

from . import data

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def classes(ids, texts, width, percent):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").encode().translate(FOLD))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()})
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = defaultdict(lambda: math.inf)
    for i, k in enumerate(ids):
        least[root(i)] = min(least[root(i)], k)
    return {k: (len(sets[i]), least[root(i)]) for i, k in enumerate(ids)}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_are_exact(spark, width, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)  # so that small groups are compared in block pairs too
    docs = data.frame(spark, 150, seed=width, repeat=True)
    rows = {r.doc_id: r.text for r in docs.collect()}
    want = classes(list(rows), list(rows.values()), width, 80)
    got = minhash.near_duplicates(docs, width=width).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    assert minhash.near_duplicates(data.empty(spark), width=width).count() == 0


def row_classes(rows, alike):
    """(id, smallest id reachable that is not null) of each row, by all pairs."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if alike(rows[a], rows[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[root(i)] += [r[0]] if r[0] is not None else []
    return [(r[0], min(least[root(i)], default=None)) for i, r in enumerate(rows)]


def jaccard(x, y, width=4):
    sets = []
    for t in (x[1], y[1]):
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)})
    return bool(sets[0] and sets[1]) and 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1])


def test_near_duplicates_with_repeated_and_null_ids(spark):
    rng = random.Random(9)
    a, b, c, d = (" ".join(f"{x}{rng.randrange(900)}" for _ in range(60)) for x in "abcd")
    rows = [(5, a), (5, b), (7, a + " q"), (9, b + " q"), (5, a), (None, c), (None, c + " q"), (12, c + " r"), (None, d), (None, d), (None, None), (3, None), (3, ""), (11, b)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs, width=4).collect())
    assert got == Counter((i, c, i == c) for i, c in row_classes(rows, jaccard))
    # the extra columns named in `keep` stay with their row
    kept = minhash.near_duplicates(docs.selectExpr("doc_id", "text", "length(text) AS size"), width=4, keep=("size",)).collect()
    assert Counter((r.doc_id, r["size"]) for r in kept) == Counter((i, None if t is None else len(t)) for i, t in rows)


def test_near_duplicate_recall_at_the_threshold(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(60):  # pairs of two sets of 180 shingles, similar by exactly 0.8
        own = [f"w{rng.randrange(10**6)}" for _ in range(183)]
        texts += [" ".join(own), " ".join(own[:163] + [f"n{rng.randrange(10**6)}" for _ in range(20)])]
    rows = list(enumerate(texts))
    linked = {i for i, c in row_classes(rows, jaccard) if c != i}
    got = {r.doc_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=4).collect() if not r.kept}
    print(f"recall at 0.8: {len(got & linked)} of {len(linked)}")
    assert len(linked) == 60 and got == linked


def test_one_large_family(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    texts = []
    for _ in range(90):
        own = base.copy()
        for _ in range(rng.randrange(1, 9)):
            own[rng.randrange(120)] = f"n{rng.randrange(10_000)}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = classes(list(range(90)), texts, 4, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, width=4).collect()} == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 10), (5, 5), (3, 9), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 10: 10, 11: 10} | dict.fromkeys(range(20, 26), 20)
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def repeats(ids, texts, width):
    words = [WORD.findall((t or "").encode()) for t in texts]
    first = {}
    for i, w in zip(ids, words):
        for k in range(len(w) - width + 1):
            first[tuple(w[k : k + width])] = min(first.get(tuple(w[k : k + width]), i), i)
    out = {}
    for i, w in zip(ids, words):
        gone = {j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for j in range(k, k + width)}
        out[i] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("width", [13, 50, 3])
def test_substring_dedup_is_exact(spark, width):
    docs = data.frame(spark, 120, seed=width, repeat=True)
    rows = {r.doc_id: r.text for r in docs.collect()}
    want = repeats(list(rows), list(rows.values()), width)
    got = substrings.remove_repeats(docs, width=width, keep=["lang", "n_words"]).collect()
    assert len(got) == docs.count() and any(r.n_removed for r in got)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_text.encode()) == want[r.doc_id]
    digests = substrings.remove_repeats(docs, width=width, derive=substrings.digests_of, schema="kept_sha256 string").collect()
    assert all(r.kept_sha256 == hashlib.sha256(want[r.doc_id][2]).hexdigest() for r in digests)
    spliced = {r.doc_id: r for r in substrings.remove_repeats(docs, width=width, derive=substrings.spliced_of).collect()}
    for i, text in rows.items():
        assert spliced[i].kept_text.encode() == (text or "").encode() if not want[i][1] else WORD.findall(spliced[i].kept_text.encode()) == want[i][2].split()
    assert substrings.remove_repeats(data.empty(spark), width=width).count() == 0


def test_difference_covers():
    for v in range(1, 22):
        cover = substrings.difference_cover(v)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rng = np.random.default_rng(3)
    rows = []
    centres = rng.normal(size=(8, 24))
    for i in range(160):
        v = (centres[i % 8] + rng.normal(scale=0.25, size=24)).tolist()
        rows.append((i * 2, v, i % 3 if i % 17 else None))
    rows += [(1001, rows[4][1], rows[4][2]), (1003, rows[4][1], rows[4][2]), (1005, [0.0] * 24, 1), (1007, None, 1), (1009, [], 1), (1011, [float("nan")] * 24, 1), (1013, [1.0, 2.0], 1), (1015, [None] + [1.0] * 23, 1), (1017, [1e200] * 24, 1), (1019, [1e-200] * 24, 1)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id bigint, embedding array<double>, label int, copies int")

    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v) / max(map(abs, v))
        return v / np.linalg.norm(v)

    units = [unit(r[1]) for r in rows]
    links, parent = Counter(), {r[0]: r[0] for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            x, y = units[a], units[b]
            if rows[a][2] is not None and rows[a][2] == rows[b][2] and x is not None and y is not None and len(x) == len(y) and x @ y >= 0.93:
                links[rows[a][0]] += 1
                links[rows[b][0]] += 1
                p, q = root(rows[a][0]), root(rows[b][0])
                parent[max(p, q)] = min(p, q)
    got = vectors.near_duplicates(df).collect()
    assert len(got) == len(rows) and sum(links.values()) > 100
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], root(r.vec_id), root(r.vec_id) == r.vec_id)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_codes_never_lose_a_pair():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 64))
    x[150:] = x[:150] + rng.normal(scale=0.35, size=(150, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, factors = vectors.code(x)
    mask = vectors.candidates(codes, factors, vectors.turned(x), 0.93)
    assert mask[(x @ x.T) >= 0.93].all() and mask.mean() < 0.05


def test_scores_against_counts(spark):
    tokens = bpe.read_ranks(pytest.importorskip("public_tokenizers").path("byte_bpe_multi_50k.tiktoken"))
    docs = data.frame(spark, 80, seed=9)
    rows = {r.doc_id: r.text for r in docs.collect()}
    words = {i: WORD.findall((t or "").encode().translate(FOLD)) for i, t in rows.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in rows}
    counts = Counter(w for i in rows if not held[i] for w in [*words[i], None])
    n, v = sum(counts.values()), len(counts)
    got = lm.score_documents(docs, tokens, sample=40).collect()
    assert len(got) == len(rows)
    for r in got:
        own = [*words[r.doc_id], None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)) and r.score < 0
    assert lm.score_documents(data.empty(spark), tokens).count() == 0


def test_model_learns_from_all_training_texts(spark, monkeypatch):
    tokens = bpe.read_ranks(pytest.importorskip("public_tokenizers").path("byte_bpe_multi_50k.tiktoken"))
    monkeypatch.setattr(lm, "SHARD_CHARS", 200_000)
    docs = spark.createDataFrame([(i, "a quiet river runs below the old stone mill " * 300) for i in range(60)], "doc_id long, text string")
    score = lambda df: {r.doc_id: r.score for r in lm.score_documents(df, tokens, sample=0).collect()}
    got = score(docs)  # no start: only what lies outside the sample can teach
    raw = np.frombuffer(docs.first().text.encode(), dtype=np.uint8)
    blank = attention.score(attention.Attention(), attention.Subwords(tokens), Words(raw, np.array([0, len(raw)])))[0]
    assert len(got) == 60 and min(got.values()) > blank / 2
    assert score(docs.repartition(7)) == pytest.approx(got, rel=1e-6)


def test_every_shard_has_its_own_task(spark, monkeypatch):
    import json

    monkeypatch.setattr(lm, "SHARD_CHARS", 2_000)
    tasks, plain = [], lm.map_groups

    def counted(df, keys, *rest, **options):
        if keys == ["shard"]:
            own = plain(df, keys, lambda: _seat, "shard bigint, task int", partitions=options["partitions"], place=options.get("place"))
            tasks.append([tuple(r) for r in own.distinct().collect()])
        return plain(df, keys, *rest, **options)

    monkeypatch.setattr(lm, "map_groups", counted)
    docs = spark.createDataFrame([(i, json.dumps([i] * 30)) for i in range(400)], "doc_id long, text string")
    lm.fit(docs, [], "doc_id", "text", 0, 1, 60, 13)
    assert len(tasks) == lm.ROUNDS and all(len(t) > 2 and len({task for _, task in t}) == len({shard for shard, _ in t}) == len(t) for t in tasks)


def _seat(key, rows):
    import pyarrow as pa
    from pyspark import TaskContext

    yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([TaskContext.get().partitionId()], pa.int32())], names=["shard", "task"])


def test_scoring_by_tables_is_the_layers_output():
    model, rng = attention.Attention(seed=3), np.random.default_rng(4)
    inputs = rng.integers(0, attention.IDS + 1, (9, attention.SPAN))
    assert np.allclose(model._scored(inputs, model.tables()), model._hidden(inputs)[-1], atol=1e-4)


def test_attention_is_causal_and_normalised():
    tokens = bpe.read_ranks(pytest.importorskip("public_tokenizers").path("byte_bpe_multi_50k.tiktoken"))
    model = attention.Attention(seed=2)
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 256, 120).astype(np.int16)
    bounds = np.array([0, 50, 120])
    inputs, targets, document = attention.windows(ids, bounds)
    assert (targets >= 0).sum() == 120 and np.bincount(document).tolist() == [2, 3]
    one = model.log_probability(inputs[:1], targets[:1])
    later = inputs.copy()
    later[0, -1] = 7
    assert np.allclose(one[0, :-1], model.log_probability(later[:1], targets[:1])[0, :-1], atol=1e-5)
    every = np.stack([model.log_probability(inputs[:1], np.full_like(targets[:1], i))[0, 5] for i in range(attention.IDS)])
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-3)
    sub = attention.Subwords(tokens)
    raw = "The thing, über\x00 " + "y" * 200
    ids, bounds = sub.encode(Words(np.frombuffer(raw.encode(), dtype=np.uint8), np.array([0, len(raw.encode()), len(raw.encode())])))
    assert ids[bounds[1] - 1] == attention.END and bounds[2] - bounds[1] == 1


def test_attention_gradients_match_differences():
    model = attention.Attention(width=8, hidden=8, seed=4)
    for k, w in model.p.items():
        model.p[k] = w.astype(np.float64)
    model.mask = model.mask.astype(np.float64)
    rng = np.random.default_rng(1)
    inputs, targets = rng.integers(0, 40, (2, attention.SPAN)), rng.integers(0, 40, (2, attention.STRIDE))
    targets[0, -3:] = -1
    grads = model._gradients(inputs, targets)
    loss = lambda: -model.log_probability(inputs, targets).sum() / (targets >= 0).sum()
    for name in ("e", "pos", "q", "k", "v", "o", "w1", "w2", "c", "m"):
        at = np.unravel_index(np.argmax(np.abs(grads[name])), grads[name].shape)
        keep, step = model.p[name][at], 1e-5
        model.p[name][at] = keep + step
        up = loss()
        model.p[name][at] = keep - step
        down = loss()
        model.p[name][at] = keep
        assert grads[name][at] == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=1e-5), name


def test_vectors_with_repeated_and_null_ids(spark):
    rng = np.random.default_rng(6)
    u, v, w = rng.normal(size=(3, 16))
    rows = [(1, v, 1), (1, None, 1), (2, v * 2, 1), (3, u, 1), (3, w, 1), (None, u, 1), (8, w + 0.01, 1), (None, w, 2), (None, w, 2), (4, u, None), (1, v, 1)]
    df = spark.createDataFrame([(i, None if x is None else x.tolist(), c) for i, x, c in rows], "vec_id bigint, embedding array<double>, label int").repartition(3)
    alike = lambda x, y: x[1] is not None and y[1] is not None and x[2] is not None and x[2] == y[2] and x[1] @ y[1] / np.linalg.norm(x[1]) / np.linalg.norm(y[1]) >= 0.93
    links = [sum(alike(x, y) for j, y in enumerate(rows) if j != i) for i, x in enumerate(rows)]
    want = Counter((i, n, c, i == c) for (i, c), n in zip(row_classes(rows, alike), links))
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()) == want


def test_vector_recall_at_the_threshold(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(300):  # pairs at cosines around 0.93
        x, y = rng.normal(size=(2, 64))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        c = 0.93 + 0.002 * (i % 5 - 2) + 1e-9  # no rounding decides
        rows += [(2 * i, x.tolist()), (2 * i + 1, (c * x + math.sqrt(1 - c * c) * y / np.linalg.norm(y)).tolist())]
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = set(np.flatnonzero(((unit @ unit.T) - np.eye(len(unit)) >= 0.93).any(axis=1)).tolist())
    got = {r.vec_id for r in vectors.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, label int")).collect() if r.n_links}
    print(f"recall around 0.93: {len(got & linked)} of {len(linked)}")
    assert len(linked) > 300 and got == linked


def test_mixing_as_sql(spark, tmp_path):
    docs = data.frame(spark, 200, seed=3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in op1.query(spark, str(tmp_path)).select("doc_id", "domain", "language", "source_name", "n_tokens", "copies", "cut_tokens").collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(c.execute(f"SELECT doc_id, domain, language, source_name, n_tokens, copies, cut_tokens FROM ({op1.ORACLE})").fetchall())


def test_shortages_go_to_siblings_first(spark):
    from pyspark.sql import functions as F

    leaves = spark.createDataFrame([("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("a", "fr", "s3", 1000), ("b", "en", "s4", 1000)], "domain string, language string, source_name string, supply bigint")
    plan = {r.source_name: r.budget for r in mixing.leaf_budgets(leaves, mixing.Target(share_percent=40, max_epochs=1)).collect()}
    assert plan["s1"] == 10 and plan["s2"] == 291 and plan["s3"] == 301 and plan["s4"] == 602
    assert sum(plan.values()) == 3010 * 40 // 100
    docs = data.frame(spark, 60, repeat=True)
    rows = mixing.mix(docs, mixing.Target(share_percent=130, max_epochs=2), F.lit("d"))
    assert rows.count() == docs.count()
    total = rows.agg(F.sum(F.col("copies") * F.col("n_tokens") + F.col("cut_tokens")), F.sum("n_tokens")).first()
    assert total[0] == total[1] * 130 // 100
    assert mixing.mix(data.empty(spark), mixing.Target(), F.lit("d")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = data.frame(spark, 150, seed=6)  # with extra columns that clash with outputs
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "language_id":
            model = langid.train(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
            named = langid.identify(docs.select("doc_id", "text"), model, ["doc_id"]).collect()
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in named if r.lang_pred != "und" and r.score >= pipeline.LEAST_SCORE}
        if name == "mixing":
            names = {c: f"x_{c}" for c in ("score", "n_words", "label")}
            rows = mixing.mix(docs.withColumnsRenamed(names), pipeline.MIX, F.expr(op1.DOMAIN)).collect()
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in rows if r.copies or r.cut_tokens}
        if name == "near_duplicates":
            rows = {r.doc_id: r.text for r in docs.collect()}
            want = classes(list(rows), list(rows.values()), 5, 80)
            assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in want.items() if c == i}
        if name == "substring_dedup":
            rows = {r.doc_id: r.text for r in docs.collect()}
            want = repeats(list(rows), list(rows.values()), 50)
            assert all(WORD.findall(r.text.encode()) == want[r.doc_id][2].split() and (want[r.doc_id][1] or r.text == rows[r.doc_id]) for r in out.collect())
        if name != "byte_bpe":
            assert out.columns == docs.columns and 0 < out.count() <= docs.count()
            assert {(r.score, r.n_words, r.label) for r in out.collect()} == {(0.5, "clash", None)}
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
        else:
            rows = {r.doc_id: r.text for r in docs.collect()}
            got = {r.doc_id: r for r in out.collect()}
            assert out.count() == docs.count() and all(got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in rows.items())
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_keeps_rows_apart_that_share_an_id(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(pipeline.STAGES)
    rng = random.Random(2)
    a, b, c = (" ".join(f"{x}{rng.randrange(900)}" for _ in range(40)) for x in "abc")
    rows = [(3, a), (5, a + " q"), (5, b), (None, c), (None, b + " q"), (8, c + " q"), (9, a)]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = [(r.doc_id, r.text) for r in stages["near_duplicates"](spark, docs, str(tmp_path)).collect()]
    assert Counter(kept) == Counter([(3, a), (5, b), (8, c + " q")])
    alone = docs.where("doc_id IS NULL")
    assert stages["near_duplicates"](spark, alone, str(tmp_path)).count() == 2
    mixed = stages["mixing"](spark, docs, str(tmp_path))
    assert 0 < mixed.count() <= docs.count() and mixed.columns == docs.columns
    assert stages["mixing"](spark, alone, str(tmp_path)).count() >= 1
