"""Token files against the tokenizer itself and wavelet matrices against plain arrays."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from rankloom.llm import bytetokens, queries, wavelet
from rankloom.llm.textcodes import slices

PATH = queries.tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def texts(seed=4):
    rng = random.Random(seed)
    letters = ["a", "B", " ", "  ", "\n", "\t", " \n ", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", " ", "é", "ß", "Ж", "中", "한", "ひ", "😀", "'s", "'Re", "don't", "12", "!", "--", "\x00", "\x7f", "<|endoftext|>", "<|endof", "﻿", "á"]
    out = [None, "", " ", "\n", "plain words, and more words.", "x" * 5000, "word " * 3000]
    return out + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(800)]


def test_byte_ids(tokenizer, monkeypatch):
    rows = texts()
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in rows]
    for most, chunk in ((10**6, None), (5, 64)):
        if chunk:
            monkeypatch.setattr(bytetokens, "_CHUNK", chunk)
        encoder = bytetokens.ByteIds(PATH, most)
        for _ in range(2):
            got = []
            for part in slices(pa.array(rows, pa.string()), 2000):
                ids, bounds = encoder.encode(part)
                got += [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(part.hi - part.lo)]
            assert got == want


def test_matrix():
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (1, 50000), (511, 3), (512, 60), (513, 70000), (5000, 50257), (3000, 1)):
        ids = (rng.integers(0, top, n) ** 2 // max(top, 1)).astype(np.uint32)
        m = wavelet.WaveletMatrix(wavelet.WaveletMatrix.build(ids))
        assert (m.all() == ids).all() and m.n == n
        at = rng.integers(0, n, 200) if n else np.zeros(0, np.int64)
        assert (m.access(at) == ids[at]).all()
        for token in [*np.unique(ids)[:20].tolist(), 0, top, 99999, -1]:
            assert m.occurrences(token).tolist() == np.flatnonzero(ids == token).tolist()
            lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
            assert m.count(token) == (ids == token).sum() and m.count(token, lo, hi) == (ids[lo:hi] == token).sum()
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix(b"XXXX" + bytes(5))


def test_moved_checksums():
    rng = random.Random(2)
    for _ in range(50):
        parts = [rng.randbytes(rng.randint(0, 30)) for _ in range(4)]
        total = 0
        for k, p in enumerate(parts):
            total ^= wavelet.moved(zlib.crc32(p), sum(map(len, parts[k + 1 :])))
        assert total == zlib.crc32(b"".join(parts))


def expected(rows, tokenizer):
    at, out, stream = 0, [], []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
        stream += ids
    return out, stream


def test_files(spark, tmp_path, tokenizer):
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts(9)[:400])] + [(None, "no id")]
    docs = spark.createDataFrame([(d, 1, t, "x") for d, t in rows], "doc_id long, start int, text string, shard string").repartition(5)
    want, stream = expected(rows, tokenizer)
    for block in (1 << 19, 100):
        wavelet.write(docs, path := f"{tmp_path}/{block}", PATH, block=block, files=3)
        assert [tuple(r) for r in wavelet.read(spark, path).orderBy("start").collect()] == want
        assert len(wavelet.shards(spark, path)) == 3
        tokens = [2, 64, 220, 123456]
        assert {tuple(r) for r in wavelet.count(spark, path, tokens).collect()} == {(t, stream.count(t)) for t in tokens}
        assert sorted(tuple(r) for r in wavelet.occurrences(spark, path, tokens).collect()) == sorted((t, i) for i, t in enumerate(stream) if t in tokens)
        positions = spark.range(0, len(stream) + 50, 3).withColumnRenamed("id", "position").union(spark.range(5))
        got = {tuple(r) for r in wavelet.access(spark, path, positions, block=block).collect()}
        assert got == {(i, stream[i]) for i in {*range(0, len(stream), 3), *range(5)}}


def test_rows_of_one_id_and_empty_tables(spark, tmp_path, tokenizer):
    rows = [(5, "same words")] * 30 + [(5, None), (4, "a b")]
    wavelet.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), f"{tmp_path}/t", PATH, block=16)
    got = wavelet.read(spark, f"{tmp_path}/t").orderBy("start").collect()
    lengths = sorted((d, len(tokenizer.encode(t or "").ids) + 1) for d, t in rows)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == lengths
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got[:-1], got[1:])) and got[0]["doc_id"] == 4
    wavelet.write(spark.createDataFrame([], "doc_id string, text string"), f"{tmp_path}/e", PATH)
    assert wavelet.read(spark, f"{tmp_path}/e").count() == 0 and wavelet.count(spark, f"{tmp_path}/e", [2]).count() == 0


def test_query(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_wavelet_matrix(spark, sf).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(rows, tokenizer)[0]
