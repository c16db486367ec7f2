"""The corpus operators on awkward rows, against brute force and round trips."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from urlmill.llm import bpe, common, forest, language, lengths, licenses, matroska, mixing, queries, sharding, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, n_tokens long, p array<double>"
LONG = "wort " * 60_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
    (2, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
    (3, None, "en", None, None),
    (4, "", None, "b", 0),
    (5, " \t\n ", "de", "b", 3),
    (None, "Der schnelle braune Fuchs springt über den faulen Hund", "de", "b", 5),
    (6, "Der schnelle braune Fuchs springt über den faulen Hund", "de", "b", 5),
    (7, LONG, "de", "b", 5),
    (8, "MIT License\nmit  license apache-license GENERAL public license", "en", "c", 5),
    (8, "MIT License\nmit  license apache-license GENERAL public license", "en", "c", 5),
    (9, "12345 !!! K İ <|endoftext|> \x00", "en", "c", 5),
]


def pad(r):
    return (*r, 0.5, 7, 9, [1.0])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([pad(r) for r in ROWS], SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def spec():
    return bpe.load(queries.tokenizer_path())


# Sharding


def test_sharding(docs, none):
    got = sharding.assign(docs, sharding.balanced()).collect()
    assert len(got) == len(ROWS)
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
        assert 0 <= r.shard < 24 and (r.grown_shard in (r.shard, 24))
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert sharding.assign(none, sharding.balanced()).collect() == []


def test_sharding_against_plain_descent(spark):
    tree = sharding.Tree((((2.0, 1.0), (1.0,)), ((3.0, 0.0, 1.0),)))

    def draw(key, level, weights):
        u = lambda i: (int(hashlib.md5(f"{key}|{level}/{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return min((-np.log(u(i)) / w, i) for i, w in enumerate(weights) if w > 0)[1]

    def place(key):
        r = draw(key, "", [sum(map(sum, x)) for x in tree.regions])
        k = draw(key, f"{r}", [sum(x) for x in tree.regions[r]]) if len(tree.regions[r]) > 1 else 0
        s = draw(key, f"{r}/{k}", tree.regions[r][k])
        return sum(len(x) for q in tree.regions[:r] for x in q) + sum(len(x) for x in tree.regions[r][:k]) + s

    ids = spark.range(3000)
    got = {r[0]: r[1] for r in ids.select("id", sharding.shard_of(F.col("id"), tree)).collect()}
    assert got == {i: place(i) for i in range(3000)}
    share = Counter(got.values())
    assert share[4] == 0 and abs(share[3] / 3000 - 3 / 8) < 0.04


# Language


def _learned(spark):
    rng = random.Random(1)
    words = {"en": "the of and house water green".split(), "de": "der und ein haus wasser grün".split(), "ru": "дом вода и зелёный".split()}
    rows = [(i, " ".join(rng.choices(words[k], k=30)), k) for i, k in enumerate(list(words) * 40)]
    return language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_language(spark, docs, none):
    model = _learned(spark)
    labeller = language.Labeller(model)
    assert labeller.label("the house and the water")[0] == "en"
    assert labeller.label("ДОМ вода")[0] == "ru"
    pred, score, spans = labeller.label("the house and the green water of the house " * 3 + "der und ein haus wasser und der wasser " * 3)
    assert [s["lang"] for s in spans] == ["en", "de"] and sum(s["words"] for s in spans) == 51
    got = language.predict(docs, model).collect()
    assert len(got) == len(ROWS)
    for r in got:
        has_letter = bool(re.search(r"[^\W\d_]", r.text or ""))
        assert (r.lang_pred == "und") == (not has_letter) and 0 <= r.score <= 1
    assert language.predict(none, model).count() == 0
    empty = language.fit(none)
    assert empty.languages == () and language.Labeller(empty).label("word")[0] == "und"


def test_viterbi_is_best_path(spark):
    from itertools import product

    labeller = language.Labeller(_learned(spark), switch=2.0)
    rng = np.random.default_rng(3)
    for _ in range(60):
        scores = -rng.random((6, 3)) * 4
        worth = lambda p: sum(scores[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        assert abs(worth(labeller.path(scores)) - max(map(worth, product(range(3), repeat=6)))) < 1e-9


# Toxicity


def test_toxicity(spark, docs, none):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad, junk = i % 5 == 0, i % 7 == 0
        words = rng.choices(["alpha", "beta", "gamma", "delta"], k=20) + ["vileness"] * 2 * bad + ["%%%"] * 3 * junk
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(junk), int(bad)))
    own, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 1), (9999, 1, None)], "doc_id long, junk int, toxic int")
    chain = toxicity.fit(own, known, ("junk", "toxic"))
    assert {r.doc_id for r in toxicity.predict(own, chain).where("is_toxic").collect()} == {i for i in range(600) if i % 5 == 0}
    got = toxicity.predict(docs.withColumn("is_toxic", F.lit("clash")), chain).collect()
    assert len(got) == len(ROWS) and all(0 <= r.p_toxic <= 1 and r.is_toxic in (True, False) for r in got)
    assert toxicity.predict(none, chain).count() == 0
    bare = toxicity.fit(own, known.where("false"), ("junk", "toxic"))
    assert not toxicity.predict(own, bare).where("is_toxic").count()


def test_chain_uses_earlier_probability():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (400, 2)).astype(np.float32)
    labels = np.stack([x[:, 0], x[:, 0]], axis=1).astype(int)
    chain = toxicity.fit_matrix(("a", "b"), ("f0", "f1"), x, labels)
    assert chain.weights[1, 2] > 0 and ((chain.probabilities(x)[:, 1] > 0.5) == (labels[:, 1] == 1)).all()


# SimHash


def _naive(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints(docs):
    for text in [r[1] for r in ROWS] + ["a", "a b", "Ä Á x\u0085y", "A\x1cB c d"]:
        if text != LONG:
            assert simhash.fingerprint(text) == _naive(text)


def _brute(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_components_by_blocks(spark):
    rng = random.Random(5)
    prints = []
    for _ in range(6):  # families that drift by up to three bits a step, and strangers
        x = rng.getrandbits(64)
        for _ in range(40):
            prints.append(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])):
                x ^= 1 << b
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    for chunk in (2048, 4):  # with tiny chunks every key is cut
        got = {r.node: r.root for r in common.components(simhash.links(df, len(prints), chunk=chunk)).collect()}
        want = _brute(prints)
        classes = {}
        for i, w in enumerate(want):
            classes.setdefault(w, set()).add(signed[i])
        for members in classes.values():
            assert {got.get(m, m) for m in members} == {min(members)}


def test_near_duplicates(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    of = lambda i: {r.component_id for r in got if r.doc_id == i}
    assert of(1) == of(2) == {1} and of(None) == of(6) == {6} and of(3) == of(4) == of(5) == {3}
    kept = [r.doc_id for r in simhash.keep_first(docs).select("doc_id").collect()]
    assert sorted(kept) == [1, 3, 6, 7, 8, 9]
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_first(none).count() == 0


# BPE


def test_bpe_equals_library(spec):
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    own, rng = bpe.Tokenizer(spec), random.Random(7)
    marks = ["a", "Zb", "'s", "'LL", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "​", "1", "²", "é", "é", "漢", "😀", "<|endoftext|>", "<|end", "...", "\0", "﻿"]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 14))) for _ in range(3000)] + [r[1] or "" for r in ROWS] + ["ab" * 20_000]
    for t in texts:
        ids = own.encode(t)
        assert ids == theirs.encode(t, add_special_tokens=False).ids
        assert own.decode(ids) == theirs.decode(ids, skip_special_tokens=False) == t


def test_bpe_columns(docs, none, spec):
    got = bpe.with_tokens(docs, spec, digests=True).collect()
    own = bpe.Tokenizer(spec)
    for r in got:
        ids = own.encode(r.text)
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == bpe.digest_ids(ids) and r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert len(got) == len(ROWS) and bpe.with_tokens(none, spec).count() == 0


# Lengths


def test_lengths(spark, none):
    rng = random.Random(3)
    sizes = [0, 0, 5000] + [rng.randint(0, 3000) for _ in range(300)]
    sums = lengths.suffix_sums(lengths.histogram(spark.createDataFrame([(x,) for x in sizes], "n_tokens long"), "n_tokens"), block=64).cache()
    rows = {r.n_tokens: r for r in sums.collect()}
    assert set(rows) == set(sizes)
    for x, r in rows.items():
        assert (r.docs, r.docs_from, r.tokens_from, r.docs_to, r.tokens_to, r.truncated_total) == (sizes.count(x), sum(s >= x for s in sizes), sum(s for s in sizes if s >= x), sum(s <= x for s in sizes), sum(s for s in sizes if s <= x), sum(min(s, x) for s in sizes))
    asked = [0, 1, 512, 2999, 10_000]
    got = {r.context: r for r in lengths.answers(sums, spark.createDataFrame([(x,) for x in asked], "context long")).collect()}
    assert {x: got[x].truncated_total for x in asked} == {x: sum(min(s, x) for s in sizes) for x in asked}
    assert lengths.quantile(sums, 0.5).first()[0] == sorted(sizes)[(len(sizes) + 1) // 2 - 1]
    assert lengths.suffix_sums(lengths.histogram(none)).count() == 0


# Matroska


def test_matroska_round_trip(docs, none):
    for r in matroska.with_digest(docs).collect():
        payload, n = matroska.payload_of(r.text)
        assert (r.n_bytes, r.payload_bytes) == (n, len(payload)) and len(payload) % 64 == 0 and payload
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(matroska.write(payload)).hexdigest()
    assert matroska.with_digest(none).count() == 0
    table = matroska.packets(matroska.with_media(docs.select("doc_id", "text")), "doc_id")
    total = {r.doc_id: r.n for r in table.groupBy("doc_id").agg(F.sum("bytes").alias("n")).collect()}
    assert total[7] == len(matroska.payload_of(LONG)[0]) and not table.where("fault IS NOT NULL").count()


@pytest.mark.parametrize("lacing", [1, 2, 3])
def test_lacing(lacing):
    sizes = [300, 300, 300] if lacing == 2 else [255, 700, 3, 0, 300]
    frames = [bytes([i]) * n for i, n in enumerate(sizes)]
    track = matroska.element(matroska.TRACKS, matroska.element(matroska.TRACK, matroska.element(matroska.NUMBER, b"\x02") + matroska.element(matroska.CODEC, b"X")))
    block = matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, matroska.laced(frames, 2, -5, lacing)))
    unknown = b"\x1f\x43\xb6\x75\xff" + matroska.element(matroska.TIME, b"\x64") + block  # a cluster of unknown size
    data = matroska.element(matroska.EBML, b"") + b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + track + unknown + matroska.element(matroska.CLUSTER, matroska.element(matroska.TIME, b"\xc8"))
    media = matroska.parse(data)
    assert media.fault is None and len(media.clusters) == 2
    assert [data[p.at : p.at + p.size] for p in media.packets] == frames
    assert {(p.track, p.time, p.lacing) for p in media.packets} == {(2, 95_000_000, lacing)}


def test_matroska_cues_and_faults(spark):
    data = matroska.write(bytes(range(256)) * 1200)
    media = matroska.parse(data)
    assert [at for _, _, at in media.cues] == media.clusters
    cut = matroska.parse(data[:-100_000])
    assert cut.fault and cut.packets == media.packets[: len(cut.packets)]
    rows = spark.createDataFrame([(1, data[:50]), (2, None), (3, b"\x00junk")], "id long, media binary")
    assert {r.id for r in matroska.packets(rows, "id").where("fault IS NOT NULL").collect()} == {1, 3}


# Forest


def test_forest_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 24))
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)] + [(2000 + i, [float(v) for v in x[40]]) for i in range(40)]
    rows += [(3000, None), (3001, [0.0] * 24), (3002, [float("nan")] * 24), (3003, [None] + [1.0] * 23), (3004, []), (None, [1.0] * 24), (3005, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0.1) for i, v in rows], "vec_id long, embedding array<double>, score double")
    got = forest.search(df, df.where("vec_id % 20 = 0"), shard_rows=400).collect()
    usable = [(i, np.array(v)) for i, v in rows if i is not None and i < 3000]
    ids, points = np.array([i for i, _ in usable]), np.stack([v for _, v in usable])
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    asked = [i for i in ids if i % 20 == 0]
    assert sorted(found) == sorted(int(i) for i in asked)
    hits = 0
    for q, rs in found.items():
        score = points @ points[ids == q][0]
        best = [i for i in np.lexsort((ids, -np.round(score, 9))) if ids[i] != q][:20]
        rs.sort(key=lambda r: r.rank)
        assert [r.rank for r in rs] == list(range(1, 21)) and all(abs(r.score - score[ids == r.vec_id][0]) < 1e-9 for r in rs)
        assert all((a.score, -a.vec_id) >= (b.score, -b.vec_id) for a, b in zip(rs, rs[1:]))
        hits += len({int(ids[i]) for i in best} & {r.vec_id for r in rs})
    assert hits / (20 * len(asked)) >= 0.9
    assert forest.search(df.where("false"), df.where("false")).count() == 0


# Licenses


def test_licenses(docs, none):
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.scan(docs).collect()}
    assert (8, 9, 4, 0, 6, "apache,gpl,mit", "apache,gpl,mit") in got
    assert (3, 0, 0, None, None, "", "") in got and (4, 0, 0, None, None, "", "") in got
    assert licenses.scan(none).count() == 0


def test_license_join_is_exact(spark):
    rng = random.Random(4)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in t.split()})
    texts = []
    for _, t in licenses.TEMPLATES:
        for _ in range(25):
            words = [w for w in t.split() if rng.random() < 0.85] + rng.choices(vocabulary + ["filler", "words"], k=rng.randint(0, 6))
            rng.shuffle(words)
            texts.append("some line\n" + " ".join(words).upper() + "\n")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set()
    for i, t in enumerate(texts):
        for line in t.split("\n"):
            own = set(re.findall("[a-z0-9]+", line.lower()))
            for k, (_, template) in enumerate(licenses.TEMPLATES):
                full = set(template.split())
                if len(own & full) >= licenses.needed(len(full)):
                    want.add((hashlib.md5(t.encode()).hexdigest(), k))
    got = {(r.text_id, r.template) for r in licenses.containment_join(rows).collect()}
    assert got == want and want
    labels = {r.doc_id: r.labels for r in licenses.scan(rows).collect()}
    assert len(labels) == len(texts) and any("bsd" in x for x in labels.values())


# Mixing


def test_mixing(spark, docs, none):
    rng = random.Random(6)
    words = {"x": "alpha beta gamma".split(), "y": "delta epsilon zeta".split()}
    rows = [(i, " ".join(rng.choices(words["x" if i % 4 else "y"], k=rng.randint(5, 40))), "x" if i % 4 else "y") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rated, weights, facts = mixing.mix(df, targets={"x": 1.0, "y": 1.0})
    got = rated.collect()
    total = sum(r.tokens for r in got)
    assert weights.domains == ("x", "y") and total == sum(len(r[1].split()) for r in rows)
    for k in range(2):
        assert abs(sum(r.rate * r.tokens * r.p[k] for r in got) - total / 2) < 1e-4 * total
    assert all(r.rate >= 0 and abs(sum(r.p) - 1) < 1e-9 and r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    rated, _, _ = mixing.mix(df, targets={"x": 1.0, "y": 0.0})
    assert sum(r.rate * r.tokens for r in rated.collect() if r.p[1] > 0.9) < 0.01 * total
    with pytest.raises(ValueError):
        mixing.mix(df, targets={"z": 1.0})
    awkward = mixing.mix(docs)[0].collect()
    assert len(awkward) == len(ROWS) and all(r.rate == 1.0 for r in awkward if not r.tokens)
    assert mixing.mix(none)[0].count() == 0


# Queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, name):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    assert queries.queries()[name](spark, folder).count() > 0


def test_pipeline(spark, docs, none, tmp_path, spec):
    import corpus_pipeline

    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = common.cut(stage(spark, now, folder))
        if name == "language":
            assert sorted(r.doc_id or 0 for r in now.collect()) == [0, 1, 2, 6, 7, 8, 8, 9]
        if name == "near_copies":
            assert sorted(r.doc_id for r in now.collect()) == [1, 6, 7, 8, 9]
        if name != "tokens":
            assert now.columns == docs.columns
    own = bpe.Tokenizer(spec)
    text = {r[0]: r[1] for r in ROWS}
    assert now.count() and all(r.ids == own.encode(text[r.doc_id]) for r in now.collect())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
