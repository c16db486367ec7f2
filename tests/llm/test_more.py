"""Corpus operators against plain versions, and on rows that are awkward for one of them."""

import hashlib
import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlmill.llm import bpe, common, forest, language, lengths, matroska, mixing, queries, sharding, simhash, toxicity

# Language


def _model():
    words = {"de": ["haus", "wasser", "und"], "en": ["house", "water", "and"], "ja": ["日本", "東京", "水"], "ru": ["дом", "вода"]}
    return language.build({k: dict.fromkeys(v, 20) for k, v in words.items()})


@pytest.mark.parametrize("text", ["½ ²", "Ⅷ ①", "123 !!! ³", "", None, "a", "ª", "٣ ۴", "日", "x²", "é"])
def test_und_is_for_texts_without_a_letter(text):
    has_letter = any(unicodedata.category(c)[0] == "L" for c in text or "")
    assert (language.Labeller(_model()).label(text)[0] != "und") == has_letter


def test_words_are_cut_by_script():
    assert language.words_of("Haus² ½Wasser") == ["haus", "wasser"]
    assert language.words_of("домhouse 日本東京水 x") == ["дом", "house", "日本", "東京", "水", "x"]
    assert language.words_of("ไทยไทย") == ["ไท", "ยไ", "ทย"]


def test_scripts_rule_languages_out():
    labeller = language.Labeller(_model())
    spans = labeller.label("house and water " * 5 + "дом " + "house and water " * 5)[2]
    assert [s["lang"] for s in spans] == ["en", "ru", "en"]  # one word that no path may give to another language
    assert labeller.label("house 日本東京水日本東京")[0] == "ja"


def test_scores_against_a_plain_version():
    """Trigram and word likelihoods by the definition, without the labeller's tables."""
    model = _model()
    grams = [Counter(), Counter(), Counter(), Counter()]
    for word, n in model.words.items():
        for k in range(4):
            for i in range(len(word)):
                grams[k][f"^{word}$"[i : i + 3]] += n[k]
    kinds = len({g for c in grams for g in c})
    for word in ("haus", "hand", "house", "zzz"):
        like = [sum(math.log((grams[k][f"^{word}$"[i : i + 3]] + 0.5) / (sum(grams[k].values()) + kinds + 1)) for i in range(len(word))) for k in (0, 1)]
        if word in model.words:
            own = [math.log((model.words[word][k] + 0.1) / (sum(n[k] for n in model.words.values()) + 1)) for k in (0, 1)]
            like = [a / 2 + b for a, b in zip(like, own)]
        got = language.Labeller(model).score(word)
        assert np.allclose(got[:2], [max(x - max(like), -language.CLIP) for x in like]) and got[2] == got[3] == language.RULED_OUT


def test_fit_on_awkward_rows(spark):
    rows = [(1, "haus und wasser", "de")] * 500 + [(None, "water and house", "en")] * 300 + [(2, None, "en"), (3, "", "de"), (4, "x y z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, max_rows=100)
    assert model.languages == ("de", "en") and model.words["haus"] == (1, 0) and model.words["water"] == (0, 1)
    many = spark.createDataFrame([(i, "common " + chr(192 + i) * 5, "de") for i in range(23)], "doc_id long, text string, lang string")
    assert set(language.fit(many, max_words=10).words) == {"common"} and len(language.fit(many, max_words=None).words) == 24
    assert common.labelled_texts(df, "doc_id", "text", "lang", 1).count() == 1


# Toxicity


def _labelled(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        junk, bad = i % 7 == 0, i % 5 == 0
        words = rng.choices(["alpha", "beta", "gamma"], k=12) + ["vile"] * bad + ["%%"] * junk
        rows.append((i, " ".join(words)))
        labels.append((i, int(junk), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, junk int, toxic int"), rows


def test_toxicity_against_a_plain_chain(spark):
    docs, labels, rows = _labelled(spark)
    chain = toxicity.fit(docs, labels, ("junk", "toxic"))
    got = {r.doc_id: r for r in toxicity.predict(docs, chain).collect()}
    for i, text in rows[::7]:
        counts = Counter(re.findall(r"[^\W\d_]+|[^\w\s]+", text))
        x = [min(sum(n for w, n in counts.items() if f in (f"={w}", *[w[:k] for k in range(3, 7) if len(w) >= k])), toxicity.COUNT_CAP) for f in chain.features]
        earlier: list[float] = []
        for c, name in enumerate(chain.categories):
            z = sum(a * w for a, w in zip(x + earlier, chain.weights[c])) + chain.bias[c]
            earlier.append(1 / (1 + math.exp(-z)))
            assert abs(got[i][f"p_{name}"] - earlier[-1]) < 1e-5 and got[i][f"is_{name}"] == (earlier[-1] >= chain.thresholds[c])


def test_out_of_fold_probabilities_feed_the_next_model():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (300, 4)).astype(np.float32)
    y = np.stack([x[:, 0] > 1, x[:, 1] + x[:, 0] > 2], axis=1).astype(int)
    fold = np.array([toxicity.fold_of(f"text {i % 90}") for i in range(len(x))])
    assert len(set(fold)) == toxicity.FOLDS and (fold[:90] == fold[90:180]).all() and toxicity.fold_of(None) == toxicity.fold_of("")
    chain = toxicity.fit_matrix(("a", "b"), ("f0", "f1", "f2", "f3"), x, y, fold)
    before = np.zeros(len(x))
    for f in range(toxicity.FOLDS):
        w, b = toxicity._logistic(x[fold != f], y[fold != f, 0].astype(float))
        before[fold == f] = 1 / (1 + np.exp(-(x[fold == f] @ w + b)))
    w, b = toxicity._logistic(np.hstack([x, before[:, None]]), y[:, 1].astype(float))
    assert np.allclose(chain.weights[1, :5], w) and abs(chain.bias[1] - b) < 1e-9


def test_toxicity_bounds(spark):
    docs, labels, _ = _labelled(spark)
    again = docs.unionByName(spark.createDataFrame([(5, "vile alpha")] * 3000, "doc_id long, text string"))
    few = toxicity.fit(again, labels, ("junk", "toxic"), max_rows=60)
    assert set(few.categories) == {"junk", "toxic"}
    every = toxicity.fit(docs, labels, ("junk", "toxic"), max_features=None, min_rows=0, min_z=0.0, count_cap=None)
    assert len(every.features) > len(toxicity.fit(docs, labels, ("junk", "toxic"), max_features=2).features) and every.count_cap is None
    tie = toxicity.Chain(("a",), ("=x",), np.zeros((1, 2)), np.zeros(1), (0.5,))
    assert toxicity.predict(docs, tie).where("is_a").count() == docs.count()  # ties at the threshold are flagged


# Mixing


def test_mixing_against_a_plain_version(spark):
    rng = random.Random(9)
    words = {"x": "alpha beta gamma rho".split(), "y": "delta eps zeta rho".split(), "z": "eta theta iota rho".split()}
    rows = [(i, " ".join(rng.choices(words["xyz"[i % 3]], k=rng.randint(1, 30))) + (" delta" if i % 7 == 0 else "") + "\n", "xyz"[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rated, weights, facts = mixing.mix(df, targets={"x": 2.0, "y": 1.0, "z": 1.0})
    assert facts["converged"]
    place = {r.w: r.at for r in spark.createDataFrame([(w,) for w in {w for v in words.values() for w in v}], "w string").select("w", mixing.place_of(F.col("w")).alias("at")).collect()}
    p, t = np.zeros((300, 3)), np.zeros(300)
    for i, text, _ in rows:
        own = [[weights.table[k][place[w]] / 1000 for w in text.split()] for k in range(3)]
        z = np.array([mixing.SHARPNESS * np.mean(o) for o in own]) + np.log(weights.prior)
        p[i], t[i] = np.exp(z - z.max()) / np.exp(z - z.max()).sum(), len(text.split())
    rate, goal = np.ones(300), t.sum() * np.array([0.5, 0.25, 0.25])
    gram = (p.T * t) @ p
    curve = np.diag(gram)
    size = 1 / np.abs(gram / np.sqrt(np.outer(curve, curve))).sum(axis=1).max()
    for _ in range(facts["rounds"]):
        rate = np.maximum(0, rate - size * (p @ (((rate * t) @ p - goal) / curve)))
    for r in rated.collect():
        assert r.tokens == t[r.doc_id] and np.allclose(r.p, p[r.doc_id], atol=1e-9) and abs(r.rate - rate[r.doc_id]) < 1e-6
    assert np.allclose((rate * t) @ p, goal, rtol=1e-4)


def test_mixing_says_what_it_cannot_reach(spark):
    df = spark.createDataFrame([(i, "alpha beta", "x") for i in range(5)] + [(9, "delta", "y")], "doc_id long, text string, lang string")
    rated, weights, facts = mixing.mix(df, targets={"x": 1.0, "y": 1.0})
    steps, none = mixing.fit_rates(rated.select("tokens", "p"), 2, [0.5, 0.5], rounds=0)
    assert steps == [] and not none["converged"] and none["residual"] > 0
    assert all(r.rate >= 0 for r in rated.collect())


def test_mixing_keeps_clashing_columns(spark):
    names = ("tokens", "rate", "copies", "known", "p", "mix", "word")
    df = spark.createDataFrame([(i, f"alpha w{i}", "x", *[f"{n}{i}" for n in names]) for i in range(6)], "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names))
    rated, _, _ = mixing.with_rates(df, to="__mix")
    assert rated.columns == [*df.columns, "__mix"]
    assert all(r[n] == f"{n}{r.doc_id}" for r in rated.collect() for n in names)


# Matroska


def test_block_groups():
    E, M = matroska.element, matroska
    track = lambda n, *more: E(M.TRACK, E(M.NUMBER, bytes([n])) + b"".join(more))
    strip = E(M.ENCODINGS, E(M.ENCODING, E(M.COMPRESSION, E(M.ALGORITHM, b"\x03") + E(M.SETTINGS, b"\x01\x02"))))
    tracks = E(M.TRACKS, track(1) + track(2, strip) + track(3, E(M.DEFAULT_DURATION, M.number(5_000_000))))
    block = lambda n, frames, *more: E(M.BLOCK_GROUP, E(M.BLOCK, M.laced(frames, n, 0)) + b"".join(more))
    groups = [
        block(1, [b"ab", b"cd"], E(M.BLOCK_DURATION, b"\x08")), block(1, [b"e"], E(M.REFERENCE, b"\xff")), block(2, [b"xyz"]),
        E(M.BLOCK_GROUP, E(M.REFERENCE, b"\x01") + E(M.BLOCK_DURATION, b"\x04") + E(M.BLOCK, M.laced([b"q"], 1, 3))), block(3, [b"a", b"b"], E(M.BLOCK_DURATION, b"\x14")),
        E(M.SIMPLE_BLOCK, M.laced([b"s"], 3, 7)),
    ]
    media = M.parse(E(M.EBML, b"") + E(M.SEGMENT, tracks + E(M.CLUSTER, E(M.TIME, b"\x64") + b"".join(groups))))
    assert media.fault is None and media.tracks[2]["settings"] == b"\x01\x02" and media.tracks[2]["compression"] == M.STRIPPED
    ms = 1_000_000
    assert [(p.track, p.time // ms, p.duration and p.duration // ms, p.keyframe) for p in media.packets] == [
        (1, 100, 4, True), (1, 104, 4, True), (1, 100, None, False), (2, 100, None, True), (1, 103, 4, False), (3, 100, 10, True), (3, 105, 10, True), (3, 107, 5, True),
    ]


def test_packets_of_awkward_tables(spark):
    data = matroska.write(bytes(64))
    df = spark.createDataFrame([(1, data, "x"), (1, data, "y"), (2, None, "z")], "track long, media binary, bytes string")
    got = matroska.packets(df, "track")
    assert got.columns[0] == "track" and "packet_track" in got.columns and got.count() == 2 and {r.packet_track for r in got.collect()} == {1}
    assert matroska.packets(df.where("false"), "track").count() == 0
    texts = spark.createDataFrame([(1, "abc", "old")], "doc_id long, text string, media string")
    assert bytes(matroska.with_media(texts).first().media)[:4] == b"\x1a\x45\xdf\xa3"


@pytest.mark.parametrize("n", [0, 1, 64, 511, 512, 4096, 4097, 65_536, 70_001, 140_000])
def test_feature_by_arithmetic(n):
    """Numbers of packets, clusters and cues, the end's time and the file's length, from the payload's length only."""
    text = "".join(chr(97 + i % 23) for i in range(n))
    payload, _ = matroska.payload_of(text)
    got = matroska.digest(text)
    size = len(payload)
    frames, clusters = -(-size // 512), -(-size // 65_536)
    feature = f"A_PCM/INT/LIT 8000Hz 8bit packets={frames} clusters={clusters} cues={clusters} ms={size // 8} sum={sum(payload)} distinct={len(set(payload))}"
    assert got[6] == feature
    media = matroska.parse(matroska.write(payload))
    assert [t for t, _, _ in media.cues] == [65_536 * i // 8 for i in range(clusters)] and all(p.keyframe for p in media.packets)
    assert [p.time // 10**6 for p in media.packets] == [512 * i // 8 for i in range(frames)]


# Forest


@pytest.mark.parametrize("scale", [1e25, 1e160, 1e-30, 1e-170, 1.0])
def test_forest_at_any_magnitude(spark, scale):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 8)) * scale
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(60)], "vec_id long, embedding array<double>")
    got = forest.search(df, df.where("vec_id % 20 = 0"), candidate_share=1.0).collect()
    assert len(got) == 60
    with np.errstate(over="ignore", invalid="ignore"):
        for q in (0, 20, 40):
            score = np.array([(x[i] * x[q]).sum() for i in range(60)])
            best = [i for i in np.lexsort((np.arange(60), -np.where(np.isnan(score), -np.inf, score))) if i != q][:20]
            assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == best


def test_forest_on_other_arrays(spark):
    whole = spark.createDataFrame([(i, [i, 1, 2 * i + 1]) for i in range(30)] + [(20, [20, 1, 41])] * 2 + [(7, [9, 9, 9])], "vec_id int, embedding array<int>")
    got = forest.search(whole, whole.where("vec_id % 20 = 0"), k=5, candidate_share=1.0).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: (r.query_id, r.rank)) if r.query_id == 20] == [(1, 29), (2, 28), (3, 27), (4, 26), (5, 25)]
    single = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in forest.search(single, single.where("vec_id = 1")).collect()] == [(1, 2, 4.0)]


def test_exact_forest_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((500, 12)).round(1)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(500)], "vec_id long, embedding array<double>")
    got = forest.search(df, df.where("vec_id % 20 = 0"), candidate_share=1.0, shard_rows=100, query_rows=10).collect()
    for q in range(0, 500, 20):
        score = (x * x[q]).sum(axis=1)
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [i for i in np.lexsort((np.arange(500), -score)) if i != q][:20]


# SimHash, sharding, lengths, components


@pytest.mark.parametrize("rows", [10, 2**30, 2**40, 2**60])
def test_every_number_of_blocks_is_exact(spark, rows):
    rng = random.Random(rows)
    prints = []
    for _ in range(5):
        x = rng.getrandbits(64)
        for _ in range(12):
            prints.append(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                x ^= 1 << b
    signed = [p - (1 << 64) if p >> 63 else p for p in dict.fromkeys(prints)]
    got = {r.node: r.root for r in common.components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), rows)).collect()}
    groups = {}
    for a in signed:
        groups[a] = a
    changed = True
    while changed:
        changed = False
        for a in signed:
            for b in signed:
                if bin((a ^ b) & (2**64 - 1)).count("1") <= 3 and groups[a] != groups[b]:
                    groups[a] = groups[b] = min(groups[a], groups[b])
                    changed = True
    assert {s: got.get(s, s) for s in signed} == groups


def test_lookup_spreads_hot_keys(spark):
    rows = spark.createDataFrame([(1, i) for i in range(4000)] + [(i, i) for i in range(2, 900)] + [(None, 0), (5000, 1)], "k long, x long")
    values = rows.where("k < 5000").groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("most"))
    got = common.lookup(rows, values, "k").collect()
    assert len(got) == rows.count()
    assert all(r.most == (3999 if r.k == 1 else None if r.k is None or r.k == 5000 else r.k) for r in got)


def test_bounded_sample(spark):
    df = spark.range(5000).selectExpr("id % 700 AS k")
    got = [r.k for r in common.bounded_sample(df, 50).collect()]
    assert len(got) == len(set(got)) == 50 and got == [r.k for r in common.bounded_sample(df.repartition(7), 50).collect()]
    assert common.bounded_sample(df, 5).count() == 5 and common.bounded_sample(df.where("false"), 5).count() == 0


def test_one_key_in_many_rows(spark):
    df = spark.createDataFrame([(7, f"text {i}") for i in range(900)] + [(None, "x")] * 100, "doc_id long, text string")
    got = sharding.assign(df, sharding.balanced()).collect()
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_growth_moves_rows_into_the_new_shard_only(spark):
    got = sharding.assign(spark.range(4000).selectExpr("id AS doc_id", "string(id) AS text"), sharding.balanced()).collect()
    moved = [r for r in got if r.grown_shard != r.shard]
    assert moved and {r.grown_shard for r in moved} == {24}


def test_null_lengths(spark):
    df = spark.createDataFrame([(None,), (0,), (3,), (3,)], "n_tokens long")
    got = {r.n_tokens: (r.docs, r.truncated_total) for r in lengths.suffix_sums(lengths.histogram(df)).collect()}
    assert got == {0: (2, 0), 3: (2, 6)}
    asked = lengths.answers(lengths.suffix_sums(lengths.histogram(df)), spark.createDataFrame([(None,), (2,)], "context long")).collect()
    assert [(r.context, r.truncated_total) for r in asked] == [(2, 4)]


def test_no_folder_of_one_machine(spark):
    class Without:
        conf = {}

        class sparkContext:
            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(ValueError):
        common.shared_folder(Without)


# BPE


def test_pieces_forgotten_and_met_again(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    spec = bpe.load(queries.tokenizer_path())
    tokenizers = pytest.importorskip("tokenizers")
    own, theirs, rng = bpe.Tokenizer(spec), tokenizers.Tokenizer.from_file(queries.tokenizer_path()), random.Random(1)
    for _ in range(200):
        text = " ".join(rng.choices(["one", "two", "three", "vier", "fünf", "x" * 60, "  ", "\n"], k=12))
        parts = own.parts(text)
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert bpe.ids_of(parts).tolist() == own.encode(text) == ids and own.decode(ids) == text
        assert hashlib.sha256(",".join(p[1] for p in parts).encode()).hexdigest() == bpe.digest_ids(ids) and b"".join(p[2] for p in parts).decode() == text


# Pipeline


def test_stages_keep_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    names = ("score", "spans", "lang_pred", "is_toxic", "p_toxic", "tokens", "rate", "copies", "fp", "text_hash", "sid", "bands", "component_id", "p", "key", "label")
    rows = [(i, f"text number {i} of the house " * 3 + " ".join(f"w{i}{k}" for k in range(20)), "en", "a", *[f"{n}{i}" for n in names]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.cut(stage(spark, now, str(tmp_path)))
        assert now.columns == docs.columns, name
        got = now.collect()
        assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names), name


def test_pipeline_against_plain_stages(spark, tmp_path):
    """What each stage keeps, by the rule it states, on texts where that is plain."""
    import corpus_pipeline

    rng = random.Random(12)
    word = lambda: rng.choice("house water green the of and river stone".split()) + rng.choice(["", "s", "ly"])
    rows, toxic = [], set()
    for i in range(240):
        words = [word() for _ in range(rng.randint(30, 60))]
        if i % 6 == 0:
            toxic.add(i)
            words[3:3] = ["vileness", "vileness"]
        rows.append([i, " ".join(words), "en", "a"])
    rows += [[1000, "12 34 !!", "en", "a"], [1001, None, "en", "a"], [1002, rows[1][1], "en", "a"], [1003, rows[2][1] + " river", "en", "a"]]
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = {i for i in range(240)} - toxic  # one domain only: every rate is 1, and every document stays once
    assert sorted(r.doc_id for r in got) == sorted(want)
    own, text = bpe.Tokenizer(bpe.load(queries.tokenizer_path())), {r[0]: r[1] for r in rows}
    assert all(list(r.ids) == own.encode(text[r.doc_id]) and r.n_tokens == len(r.ids) for r in got)
