"""Near copies of the pipeline against brute force on planted edited copies."""

import random

import numpy as np
import pytest

from urlmill.llm import copies, simhash


def _words(text):
    own = (text or "").lower().split()
    return {tuple(own[i : i + 5]) for i in range(max(len(own) - 4, 1))} if own else set()


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def _planted():
    """Families of texts, each with copies that have single words changed, far beyond three bits."""
    rng, rows = random.Random(11), []
    for _ in range(12):
        words = [f"w{rng.randrange(10_000)}" for _ in range(rng.choice([60, 130, 250]))]
        rows.append(" ".join(words))
        for edits in (1, 2, 3, 4, 6, 9):
            own = list(words)
            for at in rng.sample(range(len(own)), edits):
                own[at] = "edited"
            rows.append(" ".join(own))
    chain = [f"c{i}" for i in range(140)]  # neighbours are similar, the ends are not
    rows += [" ".join(chain[i * 3 : i * 3 + 60]) for i in range(20)]
    rows += ["one two", "ONE  two", "one two three", "", " \n", None]
    return rows


def _brute(rows):
    sets, root = [_words(t) for t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if _jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("chunk", [2048, 3])  # with tiny chunks every key is dealt
def test_near_copies_against_brute_force(spark, chunk):
    rows = _planted()
    want = _brute(rows)
    got = copies.near_copies(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), chunk=chunk).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want)) and len(got) == len(rows)


def test_a_false_sure_pair_loses_nothing(spark, monkeypatch):
    rows = _planted()
    monkeypatch.setattr(copies, "SURE", 0.6)  # now sure pairs are often false
    monkeypatch.setattr(copies, "MAYBE", 0.5)
    got = copies.near_copies(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(_brute(rows)))


def test_a_group_gives_few_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 16, 192).astype(np.uint8)
    sketches = np.stack([np.where(rng.random(192) < 0.02, rng.integers(0, 16, 192), base).astype(np.uint8) for _ in range(300)])
    sids, sizes = np.arange(300), np.full(300, 100)
    pairs, more = copies.pairs_of(sids, sids, sizes, sketches, 0.8, 0)
    assert len(pairs) == 299 and not more
    assert copies.pairs_of(sids, np.zeros(300, int), sizes, sketches, 0.8, 4) == ([], False)
    assert copies.pairs_of(sids, sids, np.where(sids % 2, 100, 70), sketches, 0.8, 0)[0][0] == (0, 2)
    apart = np.where(sids < 290, 0, sids)  # ten sets outside of the large group
    pairs, more = copies.pairs_of(sids, apart, sizes, sketches, 0.8, 4)
    assert more and len(pairs) <= 40
    assert len(set(copies.pairs_of(sids, apart, sizes, sketches, 0.8, None)[0])) == 290 * 10 + 45


def test_pipeline_drops_edited_copies(spark):
    import corpus_pipeline

    rows = _planted()[:-3]
    bits = [bin(simhash.fingerprint(rows[0]) ^ simhash.fingerprint(t)).count("1") for t in rows[1:7] if _jaccard(_words(rows[0]), _words(t)) >= 0.8]
    assert max(bits) > 3  # beyond the contract of op6
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, lang string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(_brute(rows)))


@pytest.mark.parametrize("chunk", [2048, 40])
def test_a_large_group_on_both_sides_of_the_limit_writes_each_set_a_few_times(spark, tmp_path, monkeypatch, chunk):
    rng, base = random.Random(3), [f"w{i}" for i in range(100)]
    rows = []
    for _ in range(300):  # one to six edits of one text: pairs between 0.45 and 0.9
        own = list(base)
        for at in rng.sample(range(100), rng.choice([1, 2, 3, 6])):
            own[at] = f"e{rng.randrange(10**6)}"
        rows.append(" ".join(own))
    cells, old = [], copies.in_cells
    monkeypatch.setattr(copies, "in_cells", lambda rows, key, *carried: cells.append((key, old(rows, key, *carried))) or cells[-1][1])
    got = copies.near_copies(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), chunk=chunk).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(_brute(rows)))
    written = dict(cells)["root"].groupBy("sid").count().agg({"count": "max"}).first()[0]
    assert written <= max(-(-300 // chunk) - 1, 1)


def test_links_of_sets_against_all_pairs():
    rng = np.random.default_rng(5)
    pool = np.sort(rng.integers(0, 1 << 63, 60).astype(np.uint64))
    sets = [np.sort(rng.choice(pool, n, replace=False)) for n in rng.integers(1, 12, 400)] + [np.array([], np.uint64)]
    root = list(range(len(sets)))
    for i, j in copies.similar(sets, 0.5):
        a, b = sorted((root[i], root[j]))
        assert a != b and len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))
        root = [a if r == b else r for r in root]
    own = [set(s.tolist()) for s in sets]
    for i, a in enumerate(own):
        for j, b in enumerate(own[:i]):
            assert root[i] == root[j] or len(a & b) < 0.5 * len(a | b)


@pytest.mark.parametrize("shared, own, other", [(4, 1, 0), (8, 2, 0), (16, 2, 2), (100, 12, 13), (400, 100, 0)])
def test_simhash_blocks_meet_at_the_similarity(shared, own, other):
    rng = np.random.default_rng(shared)
    blocks, bits = copies.blocks_for(250_000)
    for _ in range(200):
        hashes = rng.permutation(np.unique(rng.integers(0, 1 << 63, shared + own + other).astype(np.uint64)))
        sets = np.sort(hashes[: shared + own]), np.sort(np.r_[hashes[:shared], hashes[shared + own :]])
        a, b = (copies.fingerprint_bits(s, copies.CHECKED + blocks * bits) for s in sets)
        assert (a == b)[: copies.CHECKED].mean() >= copies.may_be()
        assert (a == b)[copies.CHECKED :].reshape(blocks, bits).all(axis=1).any()
        words = np.stack([np.packbits(x[: copies.CHECKED], bitorder="little").view(np.uint64) for x in (a, b, 1 - a)])
        assert copies.meeting(words, int((a != b)[: copies.CHECKED].sum())).tolist() == [True, True, False]


def test_simhash_blocks_grow_with_the_rows():
    assert copies.blocks_for(0) == copies.blocks_for(1_000)
    assert [copies.blocks_for(n)[1] for n in (10**5, 10**6, 10**7)] == [10, 13, 17]
    for n in (10**3, 10**5, 10**7):
        blocks, bits = copies.blocks_for(n)
        assert (1 - (1 - copies.angle(0.8)) ** bits) ** blocks <= copies.MISS and blocks << bits < 1 << 31
    assert copies.blocks_for(10**6, 1.0)[0] == 1 and copies.may_be(0.5) < copies.may_be(0.8) <= copies.MAYBE
    assert not copies.fingerprint_bits(np.array([], np.uint64), 300).any()


def test_candidates_of_near_copies_come_from_simhash(spark, monkeypatch):
    rows, met = _planted(), []
    old = copies.candidates
    monkeypatch.setattr(copies, "candidates", lambda sets, *how: met.append(sets) or old(sets, *how))
    copies.near_copies(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    found = {r.sid: r for r in met[0].collect()}
    blocks, bits = copies.blocks_for(len(rows))
    for text in rows:
        own = copies.shingles(text)
        row = found[int(np.uint64(copies.xxhash.xxh64_intdigest(own.tobytes(), simhash.SEED)).view(np.int64))]
        want = copies.fingerprint_bits(own, copies.CHECKED + blocks * bits)
        words = np.array([row[w] for w in copies.WORDS], np.int64).view(np.uint8)
        assert np.unpackbits(words, bitorder="little").tolist() == want[: copies.CHECKED].tolist()
        keys = want[copies.CHECKED :].reshape(blocks, bits)
        assert row.bands == [(i << bits) + sum(int(x) << j for j, x in enumerate(k)) for i, k in enumerate(keys)]


def test_small_tables_are_cut_into_few_files(spark, monkeypatch):
    from urlmill.llm import common

    sizes = []
    monkeypatch.setattr(common, "cut", lambda df, parts=None, real=common.cut: sizes.append((parts, (out := real(df, parts)).rdd.getNumPartitions())) or out)
    edges = spark.range(50).selectExpr("id as u", "id + 1 as v").repartition(16)
    assert {r.root for r in common.components(edges, parts=2).collect()} == {0}
    assert sizes and all(parts == 2 and n <= 2 for parts, n in sizes)
