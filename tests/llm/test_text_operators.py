"""Tokens, media, languages, URLs and licences against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import bpe, langid, licenses, media, op10, urls
from marketloom.llm.words import Words, slices

from . import data

try:
    import public_tokenizers as P
except ImportError:
    P = None
RANKS = P and P.path("byte_bpe_multi_50k.tiktoken")
needs_tokenizers = pytest.mark.skipif(P is None, reason="no public tokenizers")


def test_perfect_hash_is_minimal_and_exact():
    keys = [f"k{i}".encode() for i in range(1000)] + [b""]
    table = bpe.PerfectHash(keys)
    assert sorted(table.slots.tolist()) == list(range(len(keys)))
    assert table.find(keys).tolist() == list(range(len(keys)))
    assert bpe.PerfectHash([]).find([b"a"]).tolist() == [-1]


@needs_tokenizers
def test_encode_is_as_tiktoken_and_round_trips(spark):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(RANKS))}, special_tokens={})
    docs = data.frame(spark, repeat=True)
    made = bpe.encode(docs, RANKS, P.PATTERN, derive=bpe.ids_and_digests, schema="token_ids array<int>, n_tokens bigint, ids_sha256 string, decoded_sha256 string", keep=["doc_id", "text", "score"])
    back = bpe.decode(made, RANKS).collect()
    assert len(back) == docs.count()
    for r in back:
        want = own.encode_ordinary(r.text or "")
        assert r.token_ids == want and r.n_tokens == len(want) and r.score == 0.5
        assert bytes(r.decoded) == (r.text or "").encode()
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


@needs_tokenizers
def test_encode_memo_is_bounded_without_changing_ids():
    tokens = bpe.read_ranks(RANKS)
    table = bpe.PerfectHash(tokens)
    texts = [f"word{i} other{i * 7}" for i in range(400)]
    small, large = bpe.Codec(tokens, P.PATTERN, table, memo=10), bpe.Codec(tokens, P.PATTERN, table)
    for a in range(0, 400, 50):
        assert small.encode(texts[a : a + 50])[0].tolist() == large.encode(texts[a : a + 50])[0].tolist()
    assert len(small.codes) < 400


@needs_tokenizers
def test_encode_of_no_rows(spark):
    assert bpe.encode(data.empty(spark), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 16_384, 16_385, 200_000])
def test_media_round_trip(size):
    rng = random.Random(size)
    raw = bytes(rng.choice(b"abc\n") if rng.random() < 0.02 else 120 for _ in range(size))
    file = media.pack(raw)
    assert media.payload(file) == raw
    track = media.inspect(file)[0]
    frames = [raw[i : i + media.FRAME] for i in range(0, size, media.FRAME)]
    assert track.count == len(frames) and track.codec == "raw " and track.duration == len(frames) / media.RATE
    own = [i for i in range(len(frames)) if i % media.GROUP == 0 or b"\n" in frames[i - 1]]
    assert track.sync.tolist() == own
    assert b"".join(file[a:b] for a, b in track.keyframes()) == b"".join(frames[i] for i in own)
    paths = [p for p, _, _ in media.walk(file)]
    assert "/moov/trak/mdia/minf/stbl/stss" in paths and paths[0] == "/ftyp" and paths[-1] == "/mdat"


def test_media_of_other_writers_and_broken_files():
    """A track of one-byte samples in two chunks, sync samples 2 and 5, and one without a sync table."""
    box, full, word = media._box, media._full, lambda *n: b"".join(x.to_bytes(4, "big") for x in n)

    def movie(*extra):
        head = box(b"ftyp", b"isom")
        for at in (0, 1):
            stbl = box(b"stbl", full(b"stsd", 0, word(1), box(b"sowt", bytes(28))), full(b"stts", 0, word(1, 6, 2)), full(b"stsc", 0, word(1, 1, 3, 1)), full(b"stsz", 0, word(1, 6)), full(b"stco", 0, word(2, at and body, at and body + 5)), *extra)
            moov = box(b"moov", box(b"trak", box(b"mdia", full(b"mdhd", 0, word(0, 0, 6, 12, 0)), box(b"minf", stbl))))
            body = len(head) + len(moov) + 8
        return head + moov + box(b"mdat", b"abc--def")

    file = movie(full(b"stss", 0, word(2, 2, 5)))
    track = media.inspect(file)[0]
    assert media.payload(file) == b"abcdef" and (track.codec, track.duration) == ("sowt", 2.0)
    assert [file[a:b] for a, b in track.keyframes()] == [b"b", b"e"]
    plain = movie()
    assert [plain[a:b] for a, b in media.inspect(plain)[0].keyframes()] == [b"abc", b"def"]
    assert media.features_of(None) is None and media.features_of(b"") is None and media.features_of(file[:-10]) is None
    with pytest.raises(ValueError):
        media.inspect(b"")


def test_media_columns(spark):
    rows = {(r.doc_id, r.text): r for r in media.describe(data.frame(spark, repeat=True).withColumnRenamed("label", "feature")).join(data.frame(spark).select("doc_id", "text"), "doc_id").collect()}
    for (_, text), r in rows.items():
        raw = (text or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-64:]) and r.media_sha256 == hashlib.sha256(media.pack(padded)).hexdigest()
    assert media.describe(data.empty(spark)).count() == 0
    stored = media.store(data.frame(spark)).first()
    assert media.payload(bytes(stored.media)).startswith((stored.text or "").encode())


def test_languages(spark):
    rng = random.Random(2)
    words = {"en": ["the", "thing", "other", "wheel", "shore"], "de": ["über", "straße", "nicht", "zwölf", "ganz"], "fr": ["été", "où", "garçon", "élève", "quelque"]}
    own = [(i, " ".join(rng.choice(words[c]) for _ in range(rng.randrange(3, 300))), c) for i in range(240) for c in [("en", "de", "fr")[i % 3]]]
    docs = spark.createDataFrame([*own, (900, None, "en"), (901, "", "en"), (902, "12 34 !!", "en"), (903, "über " * 40_000, None), (0, own[0][1], own[0][2])], "doc_id bigint, text string, lang string")
    model = langid.train(docs.where("doc_id < 160"), per_language=80)
    got = {r.doc_id: r for r in langid.identify(docs, model, ["doc_id", "lang", "text"]).collect()}
    held = [r for r in got.values() if 160 <= r.doc_id < 240]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred == "de" and all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(docs.limit(0), model, ["doc_id"]).count() == 0
    nothing = langid.train(docs.where("doc_id < 0"))
    assert {r.lang_pred for r in langid.identify(docs, nothing, ["doc_id"]).collect()} == {"und"}


def test_languages_from_whole_texts_within_their_bound(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid.ByteCnn, "fit", lambda self, x, y: seen.append((x, y)) or self)
    common = [(7, "one constant row " * 40, "en")] * 3000
    rows = [*common, *[(i, f"nur {i} " * 500 + "ende", "de") for i in range(300)]]
    langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("windows", F.lit(1)), per_language=50, windows=400)
    x, y = seen[0]
    assert len(x) <= 800 and (y == 1).sum() == 3 and (y == 0).sum() == 400  # one distinct text in English: all its windows
    assert any(bytes(w).rstrip(b"\0").endswith(b"ende") for w in x)
    with pytest.raises(ValueError):
        langid.train(spark.createDataFrame([(i, "x", f"l{i}") for i in range(4)], "doc_id bigint, text string, lang string"), most=3)


def test_convolution_pooling_and_gradients():
    rng = np.random.default_rng(1)
    net = langid.ByteCnn(["a", "b", "c"])
    net.tables = [[t.astype(np.float64) for t in taps] for taps in net.tables]
    net.dense = net.dense.astype(np.float64)
    x = rng.integers(0, 256, (4, langid.WINDOW)).astype(np.uint8)
    features = np.array([[max(sum(taps[j][w[i + j], f] for j in range(width)) for i in range(langid.WINDOW - width + 1)) for width, taps in zip(langid.WIDTHS, net.tables) for f in range(langid.FILTERS)] for w in x])
    plain = np.maximum(features, 0) @ net.dense[:-1] + net.dense[-1]
    assert np.allclose(net.logits(x, net.compiled()), plain, atol=1e-5)
    y = np.array([0, 2, 1, 1])

    def loss():
        z = net.logits(x, net.compiled())
        return -(z[np.arange(4), y] - np.log(np.exp(z).sum(axis=1))).mean() + 0.5e-4 * (net.dense**2).sum()

    grads = net._gradients(x, y)
    for g, p in zip(grads, [t for taps in net.tables for t in taps] + [net.dense]):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        keep = p[at]
        p[at] = keep + 1e-6
        up = loss()
        p[at] = keep - 1e-6
        down = loss()
        p[at] = keep
        assert g[at] == pytest.approx((up - down) / 2e-6, rel=2e-2, abs=1e-6)


def test_urls(spark):
    rules = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/", "allow")]
    own = ["http://A.Example.com/en/71?x", "https://example.com/en/8#f", "http://xexample.com/en/7", "http://net", "http://a.net?x=/en", "no scheme", None, "", "x://com/en", "http://user@com/en/ é/"] + [f"http://s{i}.example.com/en/{i}" for i in range(80)] + [f"http://s{i}.example.net/de/{i}" for i in range(80)]
    pages = spark.createDataFrame([(i, u, "allow") for i, u in enumerate([*own, own[0]])], "page_id bigint, url string, verdict string")
    got = {r.page_id: r for r in urls.judge(pages, rules).collect()}

    def split(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]

    for i, url in enumerate([*own, own[0]]):
        host, path = split(url)
        fits = [(r, v) for r, v in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        best = max(fits, key=lambda f: len(f[0]), default=None)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, best and best[0])
        if best:
            assert r.verdict == best[1]
        assert r.verdict in ("allow", "block")
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge(pages, []).collect()} == {"allow"}


def test_url_verdicts_by_plain_trees(spark, monkeypatch):
    fits = []
    monkeypatch.setattr(urls.BoostedTrees, "fit", lambda self, x, y, own=urls.BoostedTrees.fit: fits.append((self, x, y)) or own(self, x, y))
    rules = [("com/en/", "block"), ("net/", "allow"), ("org/", "block")]
    own = [f"http://h{i}.{('com', 'net', 'org')[i % 3]}/{('en', 'de')[i % 2]}/{'x' * (i % 9)}?a={i}" for i in range(400)] + ["http://h.net/same"] * 1000
    pages = spark.createDataFrame([(1 if u.endswith("same") else i, u) for i, u in enumerate(own)], "page_id bigint, url string").repartition(3)
    got = urls.judge(pages, rules, sample=120).collect()
    model, x, y = fits[0]
    assert len(x) == 120 and 0 < y.mean() < 1  # a strict bound on distinct URLs, one key on most rows or not
    stats = Counter()
    for u in own:
        host, path = u.split("/")[2], "/" + u.split("/", 3)[3].split("?")[0]
        for r, v in rules:
            h, _, p = r.partition("/")
            if host.endswith("." + h) and path.startswith("/" + p):
                stats[h, v] += 1
    suffixes = {h: (n := stats[h, "block"] + stats[h, "allow"], (stats[h, "block"] + 1) / (n + 2)) for h in ("com", "net", "org")}
    assert sum(n for n, _ in suffixes.values()) > 1200

    def plain(row):
        total = model.prior
        for feature, cut, value in zip(model.feature, model.cut, model.value):
            node = 0
            for f, c in zip(feature, cut):
                node = 2 * node + (row[f[node]] > c[node])
            total += value[node]
        return 1 / (1 + np.exp(-total))

    judged = [(r, plain(urls.features(u, r.host, r.path, suffixes))) for r in got if r.rule is None for u in [next(v for v in own if v.startswith(f"http://{r.host}{r.path}"))]]
    assert judged and all(r.verdict == ("block" if p >= 0.5 else "allow") and r.block_score == pytest.approx(p) for r, p in judged)


def test_boosted_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = urls.BoostedTrees().fit(x[:1500], y[:1500])
    assert ((model.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.93


def test_licences_against_words(spark, tmp_path):
    data.frame(spark, 120, repeat=True).write.parquet(str(tmp_path / "documents.parquet"))
    texts = {r.doc_id: r.text for r in data.frame(spark, 120).collect()}
    fold = str.maketrans(licenses.UPPER, licenses.LOWER)
    for r in op10.query(spark, str(tmp_path)).collect():
        words = re.findall(licenses.WORD, (texts[r.doc_id] or "").translate(fold))
        found = [(i, label) for phrase, label in licenses.BASE for k in [phrase.split()] for i in range(len(words)) if words[i : i + len(k)] == k]
        starts = [i for i, _ in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(found), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def plain_scan(text):
    """Detections by a plain loop over all rules, without gates: (label, kind, first, last, percent) in order."""
    line = f" {' '.join(re.findall(licenses.WORD, text.translate(str.maketrans(licenses.UPPER, licenses.LOWER))))} "
    found = []
    for rank, r in enumerate(licenses.rules()):
        for m in re.finditer(rf" (?:{r.pattern})(?= )", line, re.ASCII):
            first = line[: m.start()].count(" ")
            found.append((first, -(first + m[0].count(" ") - 1), -r.priority, rank, r))
    kept = []
    for i, (first, down, up, rank, r) in enumerate(sorted(found, key=lambda f: f[:4])):
        if not any(-d >= -down and q.priority >= r.priority for _, d, _, _, q in sorted(found, key=lambda f: f[:4])[:i]):
            kept.append((r.label, r.kind, first, -down, r.percent))
    return kept


def test_licence_detections_are_those_of_a_plain_loop(spark, tmp_path):
    rng = random.Random(12)
    rules = licenses.rules()
    texts = [r.text or "" for r in data.frame(spark, 60).collect() if len(r.text or "") < 3000]
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 7)):
            parts.append(_example(re._parser.parse(rng.choice(rules).pattern), rng.randrange(9)))
            parts.append(" ".join(rng.choice(["the", "see", "under", "licensed under", "license", "a copy of", "public", "\u00e9\u00e9", "terms of"]) for _ in range(rng.randrange(4))))
        texts.append(" ".join(parts).title() if rng.random() < 0.5 else ", ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    want = {i: plain_scan(t) for i, t in enumerate(texts)}
    got = {r.doc_id: [(d.label, d.kind, d.first, d.last, d.percent) for d in (r.scan.detections if r.scan else [])] for r in licenses.scan(docs, ["doc_id"]).collect()}
    assert got == want and sum(map(len, want.values())) > 300
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for r in op10.query(spark, str(tmp_path)).collect():
        base = set(filter(None, r.base_labels.split(",")))
        assert r.labels == ",".join(sorted(base | {d[0] for d in want[r.doc_id]}))
        assert r.score == max([d[4] for d in want[r.doc_id]] + [50] * bool(base), default=0) / 100


def test_licence_suppression(spark):
    texts = ["Released under the Apache License, Version 2.0.", "GNU Lesser General Public License v3.0", "All rights reserved. MIT-License mit license", "(c) nothing here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: [(d.label, d.kind, d.first, d.last) for d in (r.scan.detections if r.scan else [])] for r in licenses.scan(docs, ["doc_id"]).collect()}
    assert got[0] == [("apache-2.0", "grant", 0, 7)]
    assert ("lgpl-3.0", "name", 0, 6) in got[1] and all(label != "gpl" for label, *_ in got[1])
    assert [d[:1] + d[2:] for d in got[2]] == [("proprietary", 0, 2), ("mit", 3, 4), ("mit", 5, 6)]
    assert got[3] == []
    assert len(licenses.TEXTS) + len(licenses.NAMES) >= 250 and licenses.scan(docs.limit(0), ["doc_id"]).count() == 0


def _example(tree, turn):
    """A text that an expression matches; `turn` chooses among alternatives."""
    out = ""
    for op, value in tree:
        match str(op):
            case "LITERAL":
                out += chr(value)
            case "IN":
                kind, first = value[turn % len(value)]
                out += "w" if str(kind) == "CATEGORY" else chr(first if str(kind) == "LITERAL" else first[0])
            case "MAX_REPEAT":
                least, most, inner = value  # an odd turn takes what is optional
                out += _example(inner, turn) * (least or (turn % 2 and most > 0))
            case "SUBPATTERN":
                out += _example(value[3], turn)
            case "BRANCH":
                out += _example(value[1][turn % len(value[1])], turn)
            case other:
                raise ValueError(other)
    return out


def test_every_licence_rule_fires_on_its_own_phrase(spark):
    rules = licenses.rules()
    texts = sorted({(i, _example(re._parser.parse(r.pattern), turn).title().replace(" ", ",\n")) for i, r in enumerate(rules) for turn in range(9)})
    rows = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id int, text string").repartition(8)
    got = {r.doc_id: (r.n_words, r.scan) for r in licenses.scan(rows, ["doc_id"]).collect()}
    for k, (i, t) in enumerate(texts):
        n, found = got[k]
        assert found and any(d.first == 0 and d.last == n - 1 and d.priority >= rules[i].priority for d in found.detections), (rules[i], t)


def test_base_phrases_need_no_rule_keyword(spark):
    docs = spark.createDataFrame([(1, "Under the Foo Bar terms")], "doc_id int, text string")
    assert licenses.scan(docs, ["doc_id"], base=(("foo bar", "foo"),)).first().scan.base_labels == ["foo"]


def test_words_follow_the_contract():
    import pyarrow as pa

    texts = [None, "", " a\tb\x0b\x0cc ", "a\u00a0b", "\x00x \x1fy", "é è"]
    counts = []
    for _, _, bytes_, bounds in slices(pa.array(texts), 4):
        counts += Words(bytes_, bounds).counts().tolist()
    assert counts == [len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for t in texts]


@needs_tokenizers
def test_heap_merges_as_a_plain_loop():
    tokens = bpe.read_ranks(RANKS)
    ranks = {t: i for i, t in enumerate(tokens)}
    rng = random.Random(8)
    for _ in range(300):
        piece = bytes(rng.choice(b"aeinrst \xc3\xa9\x00z") for _ in range(rng.randrange(1, 40)))
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert bpe.merge(piece, ranks) == [ranks[p] for p in parts]
