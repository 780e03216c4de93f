import hashlib
import random
import re

from plumbline.llm import decontaminate as dc


def plain(docs, items, window=13):
    words = lambda t: re.findall(dc.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, it in items:
            b = words(it)
            m = min(window, len(b))
            windows = {tuple(b[i : i + m]) for i in range(len(b) - m + 1)} if m else set()
            for i in range(len(w) - m + 1):
                if m and tuple(w[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
                    found |= {str(item)} if item is not None else set()
        ids = sorted(found)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def sets(spark, path, docs, items):
    spark.createDataFrame(docs, "doc_id bigint, text string, n_words int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def made():
    rng = random.Random(6)
    vocab = ["a", "b", "c", "Über", "über", "日本", "x1", "don't"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "."]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 13, 14, 40]))) for i in range(8, 20)] + [(1, "lonely"), (2, None), (3, ""), (4, "?!"), (None, "zz yy xx"), (5, "zz yy xx"), (5, "zz yy xx")]
    docs = [(i, text(rng.randrange(60))) for i in range(30)] + [(100, None), (101, ""), (102, "LONELY"), (102, "LONELY"), (None, "zz yy xx ww"), (103, " ".join(["pad"] * 5000 + [items[3][1]]))]
    docs += [(200 + i, f"start {it[1]} end") for i, it in enumerate(items)]
    return docs, items


def test_query_against_plain(spark, tmp_path):
    docs, items = made()
    path = sets(spark, str(tmp_path / "sf"), [(i, t, 0) for i, t in docs], items)
    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in dc.op2_decontamination(spark, path).collect()), key=repr)
    assert got == plain(docs, items)


def test_blocks_of_items_find_the_same(spark):
    docs, items = made()
    docs = [d for d in docs if d[0] is not None and d[0] != 102]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    rows = [sorted(tuple(map(str, r)) for r in dc.contamination(d, b, block_windows=size).select("doc_id", "__n_words", "__n_hit", "__items", "__contaminated").collect()) for size in (1 << 20, 5)]
    assert rows[0] == rows[1]


def test_empty_tables_and_stage(spark, tmp_path):
    path = sets(spark, str(tmp_path / "a"), [], [(1, "a b")])
    assert dc.op2_decontamination(spark, path).count() == 0
    path = sets(spark, str(tmp_path / "b"), [(1, "a b", 5), (2, "c", 6)], [])
    assert [r.contaminated for r in dc.op2_decontamination(spark, path).collect()] == [False, False]
    path = sets(spark, str(tmp_path / "c"), [(1, "a b", 5), (2, "c", 6), (3, None, 7)], [(1, "A B")])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = dc.stage(spark, docs, path)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_blocks_of_items_tell_rows_of_one_id_and_of_none_apart(spark):
    docs, items = made()
    docs += [(None, "clean as can be"), (None, None), (102, "clean too"), (102, "zz yy xx")]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    rows = [sorted(tuple(map(str, r)) for r in dc.contamination(d, b, block_windows=size).select("doc_id", "text", "__n_words", "__n_hit", "__items", "__contaminated").collect()) for size in (1 << 20, 5)]
    assert rows[0] == rows[1]


def test_stage_drops_a_short_passage_in_a_long_text(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(16))
    pad = " ".join(f"pad{i}" for i in range(16 * 25))
    path = sets(spark, str(tmp_path / "sf"), [(1, f"{pad} {item} {pad}", 0), (2, pad, 0)], [(9, item)])
    assert [r.contaminated for r in dc.op2_decontamination(spark, path).orderBy("doc_id").collect()] == [False, False]
    assert [r.doc_id for r in dc.stage(spark, spark.read.parquet(f"{path}/documents.parquet"), path).collect()] == [2]


def test_rows_of_one_id_and_of_none_in_many_blocks(spark):
    docs = [(5, "a b c"), (5, "d e f g h"), (None, "a b c"), (None, "clean")]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, "a b c"), (2, "e f g")], "item_id bigint, text string")
    for size in (1, 1000):
        got = sorted((str(r.doc_id), r.text, r["__n_hit"], r["__items"]) for r in dc.contamination(d, b, block_windows=size).collect())
        assert got == [("5", "a b c", 3, ["1"]), ("5", "d e f g h", 3, ["2"]), ("None", "a b c", 3, ["1"]), ("None", "clean", 0, [])]


def test_clashing_columns(spark, tmp_path):
    path = sets(spark, str(tmp_path / "sf"), [], [(1, "a b")])
    docs = spark.createDataFrame([("x", "A b c", 7, 8, 9), ("y", "c", 1, 2, 3)], "doc_id string, text string, __n_words int, __N_hit int, __spans int")
    kept = dc.stage(spark, docs, path)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [("y", "c", 1, 2, 3)]
    made = dc.contamination(docs, spark.read.parquet(f"{path}/benchmark.parquet")).orderBy("doc_id").collect()
    assert [(r.doc_id, r["__n_words"], r["__n_hit"], r["__spans"]) for r in made] == [("x", 3, 2, 9), ("y", 1, 0, 3)]
