import hashlib
import random

import numpy as np

from plumbline.llm.linededup import CuckooFilter, LineIndex, op5_line_dedup

LOWER = {i: i + 32 for i in range(65, 91)}
SPACE = " \t\n\x0b\x0c\r"


def plain(docs, min_docs=3):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holders = {}
    for doc, text in docs:
        if doc is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= 20:
                    holders.setdefault(key(line), set()).add(doc)
    keeper = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or keeper.get(key(x), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def made():
    rng = random.Random(3)
    pool = [f"Shared line number {i} with Ünïcode — {'x' * i}" for i in range(12)] + ["short", "", "é" * 19, "é" * 20, "  Tabs\tand trailing space  \t", "CASE folds only in ASCII É here", "case folds only in ascii É here", "\x85 next line is no ASCII space \xa0"]
    docs = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own line {i} {rng.random()} tail" for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    return [*docs, (None, pool[3]), (100, None), (101, ""), (102, "\n\n"), (3, docs[3][1]), (103, pool[0] + "\r\n" + pool[0]), (104, "a" * 200_000 + "\n" + pool[1])]


def digests(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_query_against_plain(spark, tmp_path):
    docs = made()
    path = str(tmp_path / "sf")
    spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, doc int").drop("doc").write.parquet(f"{path}/documents.parquet")
    assert digests(op5_line_dedup(spark, path).collect()) == plain(docs)


def view(spark, index, rows):
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    return digests(index.digests(d).select("doc_id", "__n_lines", "__n_dropped", "__kept").collect())


def test_deletion_takes_insertion_back(spark):
    docs = [d for d in made() if d[0] is not None and d[0] != 3]
    first, second = docs[:40], docs[40:]
    d = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    one = LineIndex(spark, shards=3).insert(d(first))
    both = one.insert(d(second))
    assert view(spark, both, docs) == plain(docs)
    assert view(spark, both.delete(d(second)), first) == view(spark, both.delete(d(second), text_col="text"), first) == view(spark, one, first) == plain(first)


def test_one_document_changes_its_shards_alone(spark):
    docs = [d for d in made() if d[0] is not None and d[0] != 3]
    d = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    index = LineIndex(spark, shards=64).insert(d(docs))
    more = [(500, "an entirely new line, never seen before\n" + docs[0][1].split("\n")[0])]
    hi = [r.hi for r in index._keys(d(more), "doc_id", "text").collect()]
    touched = {((h % 2**64) >> 40) % 64 for h in hi}
    after = index.insert(d(more))
    assert {s for s, folder in after.parts.items() if folder != index.parts.get(s)} == touched and len(touched) <= 2
    assert view(spark, after, docs + more) == plain(docs + more)
    # the stored filters took the change: none was built anew where there was one
    changed = {r.shard: r.built for r in after.filters.collect() if r.shard in touched}
    had = {r.shard for r in index.filters.collect()}
    assert not any(built for s, built in changed.items() if s in had)
    back = after.delete(d(more), text_col="text")
    assert sorted(map(tuple, back.refs.collect())) == sorted(map(tuple, index.refs.collect()))
    assert {s for s, folder in back.parts.items() if folder != after.parts.get(s)} <= touched


def test_filters_beyond_the_broadcast_and_more_shards(spark):
    docs = [d for d in made() if d[0] != 3]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    index = LineIndex(spark, max_filter_bytes=0, keys_per_shard=1, shards=1).insert(df)
    assert index.shards > 1 and index.filters.agg({"keys": "sum"}).first()[0] <= 4 * index.shards
    assert view(spark, index, docs) == plain(docs)
    passed = index.drops(df).selectExpr("doc", "explode(__drop) AS k").count()
    assert passed == LineIndex(spark).insert(df).drops(df).selectExpr("doc", "explode(__drop) AS k").count() > 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "a line that is long enough to count", i, i) for i in range(4)], "doc_id bigint, text string, doc int, __kept int")
    out = LineIndex(spark).insert(docs).apply(docs)
    assert out.columns == ["doc_id", "text", "doc", "__n_lines", "__n_dropped", "__kept"]
    assert sorted((r.doc_id, r.doc, r["__kept"]) for r in out.collect()) == [(0, 0, ""), (1, 1, ""), (2, 2, ""), (3, 3, "a line that is long enough to count")]


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    hi, lo = (rng.integers(0, 2**64, 5000, dtype=np.uint64) for _ in range(2))
    f = CuckooFilter.of(hi, lo)
    assert f.contains(hi, lo).all()
    other = rng.integers(0, 2**64, (2, 20_000), dtype=np.uint64)
    assert f.contains(*other).mean() < 0.01
    for a, b in zip(hi[:2000], lo[:2000], strict=True):
        assert f.delete(int(a), int(b))
    assert f.contains(hi[2000:], lo[2000:]).all() and f.contains(hi[:2000], lo[:2000]).mean() < 0.01
    for a, b in zip(hi[:2000], lo[:2000], strict=True):
        assert f.insert(int(a), int(b))
    assert f.contains(hi, lo).all()


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "sf")
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    assert op5_line_dedup(spark, path).count() == 0
