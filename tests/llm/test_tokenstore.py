import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import tokenstore as ts
from plumbline.llm.common import scratch


def plain(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(ts.default_tokenizer())
    rows = []
    for doc, text in docs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        rows.append((doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return rows


def test_store_round_trip(spark, tmp_path):
    rng = random.Random(4)
    vocab = ["the", "Ünïcode", "don't", "x" * 40, "42", "…", "!?", "日本", "tab\tin", "a b"]
    shared = " ".join(rng.choice(vocab) for _ in range(3000))
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(400)))) for i in range(60)]
    docs += [(100 + i, shared + f" end {i}") for i in range(5)]
    docs += [(200, None), (201, ""), (202, "   \n\n  b  \r\n"), (203, "<|endoftext|> inside"), (204, "  x　 y \x1c z"), (205, "a \n b"), (None, "no id")]
    path = str(tmp_path / "sf")
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    got = {r.doc_id: r for r in ts.op10_token_store(spark, path).collect()}
    start = 0
    for doc, n, crc in sorted(plain(docs), key=lambda r: (r[0] is not None, r[0] or 0)):
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (start, n, crc), doc
        start += n
    assert len(got) == len(docs)


def test_copies_and_shared_passages_are_stored_once(spark):
    rng = random.Random(7)
    text = " ".join(f"word{rng.randrange(5000)}" for _ in range(4000))
    folder = scratch(spark, "store")
    ts.write_store(spark.createDataFrame([(i, text + (f" tail{i}" if i % 2 else "")) for i in range(8)], "doc_id bigint, text string"), folder)
    index = spark.read.parquet(f"{folder}/packed").where("address is not null")
    assert index.count() == index.select("address").distinct().count()
    per_doc = [len(r.addresses) // 16 for r in ts.recipes(spark, folder).collect()]
    assert index.count() < min(per_doc) + 8
    assert [tuple(r)[1] for r in ts.manifest(spark, folder).orderBy("part").collect()] and sum(r.documents for r in ts.manifest(spark, folder).collect()) == 8


def test_repeated_rows_and_empty_table(spark, tmp_path):
    for k, docs in enumerate([[(1, "a b"), (1, "a b"), (1, "c")], []]):
        path = str(tmp_path / f"sf{k}")
        spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
        rows = sorted(ts.op10_token_store(spark, path).collect(), key=lambda r: r.start)
        assert [r.start for r in rows] == list(np.cumsum([0, *[r.n_tokens for r in rows]])[: len(rows)])
        assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == sorted(plain(docs))


def test_crc_combine():
    rng = random.Random(2)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(300)), rng.randbytes(rng.randrange(300))
        assert ts.crc_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_chunks_bound_and_cover():
    ids = np.random.default_rng(0).integers(0, 50_000, 60_000).astype(np.uint32)
    ends = ts.chunk_ends(ts.cut_points(ids), 0, len(ids))
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= ts.MAX_CHUNK and sizes[:-1].min() >= ts.MIN_CHUNK


def test_pieces_encode_like_whole_texts():
    rng = random.Random(11)
    parts = ["a", "Ab", "é", "ÿ", "×", "—", "…", "日", "'", "'s", "'t", "’", "1", "23", ".", ",", "!!", "##", " ", "  ", "\n", "\t", "\r\n", "\x0b", "_", "\x00", "\x7f", "\u0301", "🙂", "½", "ª", "ſ", "\x01", "\u00a0", "<|endoftext|>", "hello", ", "]
    enc = ts.Encoder(ts.default_tokenizer())
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(6000)]
    for text, ids in zip(texts, enc.batch(texts)):
        assert np.frombuffer(ids, enc.kind).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_merkle_of_a_stream_is_that_of_a_list():
    leaves = [bytes([i]) * 16 for i in range(40)]
    for n in range(40):
        tree = ts.Merkle()
        for leaf in leaves[:n]:
            tree.add(leaf)
        assert tree.root() == (ts.merkle(leaves[:n]) if n else b"")


def test_a_lost_or_changed_recipe_is_noticed(spark):
    folder, wide = scratch(spark, "store"), ts.encoder(ts.default_tokenizer()).wide
    ts.write_store(spark.createDataFrame([(i, f"text number {i}") for i in range(20)], "doc_id bigint, text string"), folder)
    assert ts.verify(spark, folder) and ts.read_store(spark, folder, wide).count() == 20
    rows = spark.read.parquet(f"{folder}/sorted")
    other = scratch(spark, "store")
    for name, df in (("packed", spark.read.parquet(f"{folder}/packed")), ("manifest", spark.read.parquet(f"{folder}/manifest")), ("sorted", rows.where("doc_id <> 7"))):
        df.write.parquet(f"{other}/{name}")
    assert not ts.verify(spark, other)
    with pytest.raises(Exception, match="manifest doesn't hold"):
        ts.recipes(spark, other).collect()


def test_kept_pieces_take_few_bytes():
    enc = ts.Encoder(ts.default_tokenizer())
    tracemalloc.start()
    arrow = pa.total_allocated_bytes()
    for at in range(0, 150_000, 30_000):
        enc.batch([" ".join(f"w{i * 7919 % 10**6:x}q" for i in range(at, at + 30_000))])
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert held < 12e6


def test_pieces_encode_alike_after_others_are_forgotten(monkeypatch):
    monkeypatch.setattr(ts, "CACHE_PIECES", 40)
    rng = random.Random(6)
    enc = ts.Encoder(ts.default_tokenizer())
    for _ in range(60):
        texts = [" ".join(rng.choice(["the", "é1", "don't", "日本", f"n{rng.randrange(90)}", ""]) for _ in range(30)) for _ in range(4)]
        for text, ids in zip(texts, enc.batch(texts), strict=True):
            assert np.frombuffer(ids, enc.kind).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_cut_points_in_parts(monkeypatch):
    ids = np.random.default_rng(3).integers(0, 50_000, 1_500_000).astype(np.uint16)
    gear = ts._gear()
    tracemalloc.start()
    cuts = ts.cut_points(ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6
    monkeypatch.setattr(ts, "HASHED", len(ids))
    assert len(cuts) and (ts.cut_points(ids) == cuts).all()
    assert all(sum(int(gear[x]) << k for k, x in enumerate(ids[c - ts.WINDOW : c][::-1].tolist())) >> (63 - ts.MASK_BITS) & ((1 << ts.MASK_BITS) - 1) == 0 for c in cuts[10:200].tolist())
