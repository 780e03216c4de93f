import random

import numpy as np
import xxhash

from plumbline.llm import simhash


def plain_fingerprint(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    n = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(docs):
    fps = [(d, plain_fingerprint(t)) for d, t in docs]
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 2:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, f"{fp:016x}", least.get(root(i))) for i, (d, fp) in enumerate(fps)), key=repr)


def rows(spark, docs, tmp_path):
    path = str(tmp_path / "sf")
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op7_simhash(spark, path).collect()), key=repr)


def test_against_all_pairs(spark, tmp_path):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    docs = [(None, "lost and found"), (900, None), (901, ""), (902, " \t\n"), (903, "É one"), (904, "é one"), (904, "é one"), (905, "a b c"), (906, "A b\tC")]
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([40, 300]))]
        for c in range(6):
            t = base[:]
            for _ in range(c % 3):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            docs.append((g * 10 + c, " ".join(t)))
    assert rows(spark, docs, tmp_path) == plain_components(docs)


def test_slices_of_hot_anchors_lose_no_link(spark):
    rng = np.random.default_rng(5)
    center = rng.integers(0, 2**63)
    fps = sorted({int(center ^ sum(1 << int(b) for b in rng.choice(10, rng.integers(0, 6), replace=False))) for _ in range(150)})
    nodes = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "node bigint, fp bigint")
    whole = {tuple(r) for r in simhash.components(simhash.links(nodes)).collect()}
    sliced = {tuple(r) for r in simhash.components(simhash.links(nodes, home_limit=7)).collect()}
    assert whole and whole == sliced


def test_every_near_pair_meets_at_its_home_anchor():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 200, dtype=np.uint64)
    i, anchor, home = simhash.anchors(x.view(np.int64))
    for k, v in enumerate(x):
        own = anchor[(i == k) & home]
        assert len(own) == 1
        y = v
        for b in rng.choice(64, 2, replace=False):
            y ^= np.uint64(1 << int(b))
        assert own[0] in set(simhash.anchors(np.array([y]).view(np.int64))[1])


def test_chains_contract_to_one_component(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101)]
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(1, 61)} == {0} and got[101] == 100


def test_empty_table(spark, tmp_path):
    assert rows(spark, [], tmp_path) == []


def test_stage_keeps_one_of_each_group(spark):
    docs = spark.createDataFrame([(1, "a b c d", 7), (2, "a b c d", 8), (2, "a b c d", 8), (3, "x y z q w", 9), (None, "a b c d", 1)], "doc_id bigint, text string, fp int")
    kept = simhash.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.fp) for r in kept.collect()) == [(0, 1), (1, 7), (3, 9)]


def test_stage_catches_edited_copies_and_leaves_others(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    docs, base_of = [], {}
    for g in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([60, 200, 500]))]
        for c in range(5):
            t = base[:]
            for _ in range(len(t) * c // 250):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            docs.append((g * 10 + c, " ".join(t)))
            base_of[g * 10 + c] = g * 10
    kept = {r.doc_id for r in simhash.stage(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), "").collect()}
    texts = dict(docs)
    sets = {i: set(simhash.shingle_hashes(t).tolist()) for i, t in docs}
    for i, b in base_of.items():
        similarity = len(sets[i] & sets[b]) / len(sets[i] | sets[b])
        if i == b:
            assert i in kept
        elif similarity >= 0.9:
            assert i not in kept, (i, similarity, len(texts[i].split()))


def plain_groups(docs):
    """Component of each document by all pairs of similarity 0.8 or more."""
    sets = {i: set(simhash.shingle_hashes(t).tolist()) for i, t in docs}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def passage_docs(n=60, share=0.8, size=100):
    """Documents that share a passage; every third is an edited copy of the one before it."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(int(share * size))]
    docs, last = [], None
    for i in range(n):
        if i % 3 == 2:
            own = last[:]
            own[rng.randrange(5, len(own) - 5)] = word()
        else:
            own = [word() for _ in range(size - len(passage))]
        last = own
        docs.append((i, " ".join(passage + own)))
    return docs


def groups(spark, docs, **limits):
    found = simhash.similar_groups(spark.createDataFrame(docs, "doc_id bigint, text string"), **limits)
    return {r.doc: r.component for r in found.collect()}


def test_stage_links_simhashes_of_all_shingles_at_their_anchors(spark, monkeypatch):
    """Without the exact search that follows: the pairs of 2 or fewer differing bits that verify, and no others."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    docs = []
    for i in range(120):
        own = [word() for _ in range(rng.choice([60, 300, 900]))]
        other = own[:]
        for _ in range(1 + i % 3):
            other[rng.randrange(len(other))] = word()
        docs += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(other))]
    prints = {i: simhash.fingerprint(t, simhash.STAGE_SHINGLE) for i, t in docs}
    alike = plain_groups(docs)
    apart = {i: (prints[i] ^ prints[i + 1]).bit_count() for i in range(0, len(docs), 2) if alike[i + 1] == i}
    assert any(n == 0 for n in apart.values()) and any(0 < n <= 2 for n in apart.values()) and any(n > 2 for n in apart.values())
    empty = spark.createDataFrame([], "a bigint, b bigint")
    monkeypatch.setattr(simhash, "_rest", lambda *_, **__: empty)
    assert groups(spark, docs) == {i: i - 1 if i % 2 and apart.get(i - 1, 64) <= 2 else i for i, _ in docs}
    monkeypatch.undo()
    assert groups(spark, docs) == alike


def test_stage_finds_pairs_whose_leader_is_another(spark):
    docs = passage_docs()
    want = plain_groups(docs)
    assert len(set(want.values())) < len(docs)
    assert groups(spark, docs) == want
    assert groups(spark, docs, cold=3, slice_=7) == want


def edited_pairs(n, lead=""):
    """Pairs of documents of a similarity from 0.8 to 0.85, unlike all others."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**7)}"
    docs = []
    for i in range(n):
        own = [word() for _ in range(49)]
        other = own[:20] + [word()] + own[21:]
        docs += [(2 * i, f"{lead}{' '.join(own)}"), (2 * i + 1, f"{lead}{' '.join(other)}")]
    return docs


def test_stage_misses_no_pair_at_the_threshold(spark):
    docs = edited_pairs(400)
    assert groups(spark, docs) == {i: i - i % 2 for i, _ in docs}


def test_stage_keeps_links_among_equal_fingerprints(spark):
    docs = edited_pairs(400, "one two three four five " * 60)
    assert len({simhash.fingerprint(t) for _, t in docs}) < 40
    assert groups(spark, docs) == {i: i - i % 2 for i, _ in docs}


def test_stage_loses_no_pair_behind_a_crowd_of_smaller_ids(spark):
    """Per group: forty variants of a text, alike to it at 0.71 at most, ahead of a pair of 0.87 or more."""
    rng = random.Random(33)
    word = lambda: f"w{rng.randrange(10**7)}"
    docs, pairs = [], []
    for g in range(12):
        base = [word() for _ in range(300)]
        for v in range(40):
            own = base[:]
            for at in range(4, 300, 18):
                own[at + rng.randrange(8)] = word()
            docs.append((1000 * g + v, " ".join(own)))
        near = base[:]
        for at in (50, 150, 250):
            near[at] = word()
        docs += [(1000 * g + 900, " ".join(base)), (1000 * g + 901, " ".join(near))]
        pairs.append((1000 * g + 900, 1000 * g + 901))
    want = plain_groups(docs)
    assert all(want[b] == a for a, b in pairs)
    assert groups(spark, docs) == want
    assert groups(spark, docs, cold=3, slice_=2000) == want


def test_filters_by_ids(spark):
    from plumbline.llm.common import only_ids, without_ids

    df = spark.createDataFrame([(i, f"t{i}") for i in [*range(3000), -5, 2**63 - 1, -(2**63)]] + [(None, "none")], "x bigint, t string")
    ids = spark.createDataFrame([(i,) for i in [*range(0, 3000, 7), -5, -(2**63), None]], "doc bigint")
    wanted = {*range(0, 3000, 7), -5, -(2**63)}
    assert {r.x for r in only_ids(df, "x", ids).collect()} == wanted
    assert sorted((r.x is None, r.x or 0) for r in without_ids(df, "x", ids).collect()) == sorted((x is None, x or 0) for x in [*range(3000), 2**63 - 1, None] if x is None or x not in wanted)


def test_stage_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", 7, 1, "p"), (2, "a b c d", 8, 2, "q"), (2, "a b c e", 8, 3, "r"), (3, "x y z q w", 9, 4, "s")], "doc_id bigint, text string, doc int, node int, __may string")
    kept = simhash.stage(spark, docs, "")
    assert kept.columns == docs.columns and len(kept.collect()) in (2, 3)
    assert {tuple(r) for r in kept.collect()} >= {(1, "a b c d", 7, 1, "p"), (3, "x y z q w", 9, 4, "s")}


def test_parities_never_rule_a_similar_pair_out():
    rng = np.random.default_rng(7)
    ruled = 0
    for _ in range(300):
        x = np.unique(rng.integers(0, 2**64, rng.integers(1, 700), dtype=np.uint64))
        keep = x[rng.random(len(x)) < rng.choice([0.5, 0.85, 0.95])]
        y = np.unique(np.r_[keep, rng.integers(0, 2**64, rng.integers(0, 40), dtype=np.uint64)])
        bound = simhash.least_difference(simhash.parity(x), simhash.parity(y))
        assert bound <= len(np.setxor1d(x, y))
        ruled += 9 * bound > len(x) + len(y)
    assert ruled > 100
