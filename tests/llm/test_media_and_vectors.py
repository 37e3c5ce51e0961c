"""Bit-sliced search and AVI motion-JPEG: brute force, round trips, odd rows; the pipeline and its registration."""

import hashlib
import os
import struct
import zlib

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from tenfold.llm import avi, bitsliced, catalogue, jpeg, toxicity, weighted_minhash
from tests.llm.fixtures import SCHEMA, SF, clashing, docs, rows
from tests.oracle import check

VECTORS = "vec_id long, embedding array<float>, label int"


# ---- bit-sliced search


def vectors(spark, n=300, dims=12, seed=0):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, dims)) / 4).astype(np.float32)
    x[7] = x[8] = x[9] = x[50]  # ties
    rows_ = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows_ += [(1000, [float("nan")] * dims, 0), (1001, None, 0), (1002, [None] * dims, 0), (1003, [float("inf")] * dims, 0), (None, x[0].tolist(), 0), (1004, [1e30] * dims, 0), (1005, [0.5] * 3, 0), (1006, [], 0)]
    return spark.createDataFrame(rows_, VECTORS)


def brute(frame, k=5):
    v = {r.vec_id: np.floor(256 * np.array(r.embedding, np.float64)) for r in frame.collect() if r.vec_id is not None and r.embedding is not None and all(e is not None and abs(e) < 1e5 for e in r.embedding)}
    out = []
    for q in v:
        if q % 50 == 0:
            score = lambda i: int(sum(a * b for a, b in zip(v[q], v[i])))  # noqa: E731, B023
            best = sorted(((-score(i), i) for i in v if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [(32768, 2048), (50, 2)])
def test_search(spark, blocks):
    frame = vectors(spark)
    got = bitsliced.top_k(clashing(frame), rows=blocks[0], queries_at_once=blocks[1])
    assert rows(got, "query_id", "rank", "vec_id", "score") == brute(frame)


def test_search_of_little(spark):
    assert bitsliced.top_k(spark.createDataFrame([], VECTORS)).count() == 0
    assert bitsliced.top_k(spark.createDataFrame([(0, [0.5], 0)], VECTORS)).count() == 0
    two = spark.createDataFrame([(0, [0.5, -0.25], 0), (3, [0.0, 0.0], 0)], VECTORS)
    assert rows(bitsliced.top_k(two), "query_id", "rank", "vec_id", "score") == [(0, 1, 3, 0)]


def test_search_extremes():
    rng = np.random.default_rng(3)
    v = rng.integers(-(1 << 24) + 1, 1 << 24, (70, 3))
    index = bitsliced.BitSlicedBlock(np.arange(70), v)
    for q in v[:5]:
        ids, score = index.top(q, -1, 7)
        assert sorted(score.tolist()) == sorted((v @ q).tolist())[-7:]


def test_search_of_large_components(spark):
    x = [[0.5, -0.25], [70_000.0, 1.0], [-3e9, 2e9], [1e13, 0.0], [0.5, 0.5], [65_536.0, -65_536.0]]
    v = [[int(np.floor(256 * c)) for c in e] for e in x]
    frame = spark.createDataFrame([(i, e, 0) for i, e in enumerate(x)], "vec_id long, embedding array<double>, label int")
    want = sorted((-sum(a * b for a, b in zip(v[0], v[i])), i) for i in range(1, 6))
    assert rows(bitsliced.top_k(frame), "query_id", "rank", "vec_id", "score") == [(0, n + 1, i, -s) for n, (s, i) in enumerate(want)]
    below = spark.createDataFrame([(0, [-1e13], 0), (1, [1e13], 0), (2, [0.5], 0), (3, [-1.0], 0)], "vec_id long, embedding array<double>, label int")
    assert [r[2] for r in rows(bitsliced.top_k(below, k=2), "query_id", "rank", "vec_id", "score")] == [3, 2]
    with pytest.raises(Exception, match="no long"):
        bitsliced.top_k(below, k=3).collect()


def test_search_is_exact_at_any_width():
    rng = np.random.default_rng(4)
    v = rng.integers(-(1 << 62), 1 << 62, (70, 3))
    index = bitsliced.BitSlicedBlock(np.arange(70), v)
    for q in v[:5]:
        _, score = index.top(q, -1, 7)
        assert sorted(score.tolist()) == sorted(sum(int(a) * int(b) for a, b in zip(row, q)) for row in v)[-7:]


@pytest.mark.parametrize("name", list(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    check(spark, SF, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


# ---- motion JPEG


@pytest.mark.parametrize("n", [0, 1, 64, 128, 1024, 1088, 64 * 5000])
def test_bytes_come_back(n):
    data = os.urandom(n)
    media = avi.stored(data)
    assert avi.payload_of(media)[0] == data
    assert len(avi.read(media).frames) == max(1, -(-n // 1024))


def test_fixed_frames_decode_as_any_frame():
    frame = avi.read(avi.stored(os.urandom(1024))).frames[0]
    fast = jpeg.decode(frame)
    head = jpeg.parse(frame)
    assert head.fixed and fast.shape == (128, 512)
    # the same code read symbol by symbol
    slow = jpeg.decode(frame.replace(bytes([0, 8, *[1] * 63]), bytes([0, 16, *[1] * 63])))
    assert np.array_equal(np.clip((fast.astype(int) - 128) * 2 + 128, 0, 255), slow)


def test_waves_and_colour():
    """A colour frame with subsampled chroma, restarts and AC terms, coded by hand."""
    dc, ac = {0: "00", 4: "01", 5: "10"}, {(0, 0): "0", (0, 3): "10"}
    table = lambda kind, codes: jpeg._segment(0xC4, bytes([kind]) + bytes(sum(len(c) == n for c in codes.values()) for n in range(1, 17)) + bytes(k if isinstance(k, int) else k[0] << 4 | k[1] for k in codes))
    y = dc[4] + "1010" + ac[0, 3] + "101" + ac[0, 0]  # DC +10, first AC +5
    unit = y + (dc[0] + ac[0, 0]) * 5
    size = struct.pack(">BHHB", 8, 16, 32, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    scan = jpeg._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    body = int((unit + "1" * (-len(unit) % 8)), 2).to_bytes(-(-len(unit) // 8)).replace(b"\xff", b"\xff\x00")
    frame = b"\xff\xd8" + jpeg._segment(0xDB, bytes([0, *[4] * 64])) + jpeg._segment(0xC0, size) + table(0, dc) + table(0x10, ac) + jpeg._segment(0xDD, b"\0\1") + scan + body + b"\xff\xd0" + body + b"\xff\xd9"
    got = jpeg.decode(frame)
    x = np.arange(8)
    want = 128 + 10 * 4 / 8 + 5 * 4 / 8 * np.sqrt(2) * np.cos((2 * x + 1) * np.pi / 16)
    assert got.shape == (16, 32) and np.abs(got[0, :8] - want).max() <= 1 and np.array_equal(got[:, :16], got[:, 16:])
    assert (got[:, 8:16] == round(128 + 5)).all()


def test_shots():
    rng = np.random.default_rng(0)
    scenes = [rng.integers(a, a + 40, (n, 16, 64)) for a, n in ((0, 30), (120, 20), (200, 25))]
    media = avi.stored(np.concatenate(scenes).astype(np.uint8).tobytes())
    assert [(c.start_frame, c.end_frame) for c in avi.payload_of(media)[1]] == [(0, 29), (30, 49), (50, 74)]


def test_index_and_other_streams():
    media = avi.stored(os.urandom(3000))
    want = avi.read(media)
    at = media.rindex(b"idx1")
    no_index = media[:at] + b"JUNK" + media[at + 4 :]
    assert avi.read(no_index).frames == want.frames
    n = len(want.frames)
    index = np.frombuffer(media[at + 8 : at + 8 + 16 * n], "<u4").reshape(-1, 4).copy()
    index[:, 2] += media.index(b"movi")  # offsets from the file's start
    assert avi.read(media[: at + 8] + index.tobytes()).frames == want.frames
    sound = index.copy()
    sound[:, 0] = int.from_bytes(b"01wb", "little")
    both = np.concatenate([sound, index]).tobytes()
    assert avi.read(media[:at] + b"idx1" + struct.pack("<I", len(both)) + both).frames == want.frames


def test_clip_rows(spark):
    good = avi.stored(bytes([0] * 4096 + [255] * 4096))
    media = spark.createDataFrame([(1, good), (2, b"broken"), (3, None), (4, b""), (5, good[:900]), (6, b"RIFF....AVI ")], "media_id long, media binary")
    got = avi.clips(clashing(media)).collect()
    assert [(r.clip, r.start_frame, r.end_frame, r.start_s) for r in got if r.media_id == 1] == [(0, 0, 3, 0.0), (1, 4, 7, 0.16)]
    assert {r.media_id for r in got} <= {1, 5}
    assert avi.clips(media.limit(0)).count() == 0


def test_stored_texts(spark):
    table = docs(spark)
    got = {}
    for r in avi.digests(avi.store(clashing(table))).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == table.count()
    for r in table.collect():
        raw = (r.text or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        want = (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert want in [(x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) for x in got[r.doc_id]]
    assert avi.digests(avi.store(spark.createDataFrame([], SCHEMA))).count() == 0


# ---- pipeline


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "minhash_near_dedup", "substring_dedup", "best_fit_packing"]
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    table, kept = documents, [documents]
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, SF).cache()
        kept.append(table)
    for t in kept[:-1]:
        assert t.columns == documents.columns and t.filter("n_chars <> length(text)").count() == 0 or t is documents
    model = toxicity.fit(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    rejected = toxicity.score(documents, model).filter("predicted = 1").count()
    assert kept[1].count() == documents.count() - rejected
    assert kept[2].count() == kept[1].count() and kept[4].count() == kept[3].count()
    assert kept[3].count() == weighted_minhash.classes(kept[2]).select("class_id").distinct().count()
    assert kept[5].select("doc_id").distinct().count() == kept[4].count()
    assert rows(corpus_pipeline.run(spark, SF), "doc_id", "piece", "length") == rows(kept[5], "doc_id", "piece", "length")


def test_pipeline_of_odd_rows(spark):
    table = clashing(docs(spark))
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, SF)
        if name != "best_fit_packing":
            assert table.columns == clashing(docs(spark)).columns
    assert table.count() > 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
