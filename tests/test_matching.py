import random
import statistics
from collections import defaultdict

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tenfold.functions.arrays import longest_uniform
from tenfold.operators import calibrate, geometry, matching, report
from tenfold.plans import catalogue
from tenfold.sources import frames
from tests.conftest import SF


def test_nearest_equals_numpy(spark):
    rng = np.random.default_rng(0)
    bank = [(i, "ABC"[i % 3], rng.random(8).round(3).tolist()) for i in range(9)]
    glyphs = [(i, rng.random(8).round(3).tolist()) for i in range(20)]
    got = {r.glyph_id: r for r in matching.nearest(spark.createDataFrame(glyphs, "glyph_id int, vec array<float>"), spark.createDataFrame(bank, "template_id int, label string, vec array<float>"), None).collect()}
    for i, v in glyphs:
        d = np.array([np.abs(np.float32(v) - np.float32(b)).mean(dtype=np.float64) for _, _, b in bank])
        best = int(d.argmin())
        other = min(x for x, (_, label, _) in zip(d, bank) if label != bank[best][1])
        assert got[i].label == bank[best][1]
        assert got[i].distance == pytest.approx(d[best], abs=1e-6)
        assert got[i].confidence == pytest.approx((other - d[best]) / (other + d[best] + 1e-6), abs=1e-5)


def test_far_glyph_is_unknown(spark):
    bank = spark.createDataFrame([(0, "A", [0.0, 0.0])], "template_id int, label string, vec array<float>")
    near = spark.createDataFrame([(0, [0.1, 0.1]), (1, [0.9, 0.9])], "glyph_id int, vec array<float>")
    got = {r.glyph_id: (r.label, round(r.confidence, 3)) for r in matching.nearest(near, bank).collect()}
    assert got == {0: ("A", 0.818), 1: ("?", 0.0)}


def test_cells(spark):
    p = spark.createDataFrame([("a", 5.0, 0, "7", 0.9), ("a", 1.0, 1, "X", 0.2), ("a", 9.0, 2, "1", 0.7)], "key string, cx double, ix int, label string, confidence double")
    c = matching.cells(p, ["key"])
    assert c.first().text == "?71" and c.first().confidence == pytest.approx(1.6 / 3)
    all_ = matching.with_blanks(c, spark.createDataFrame([("a",), ("b",)], "key string"), ["key"])
    assert {r.key: (r.text, round(r.confidence, 3)) for r in all_.collect()} == {"a": ("?71", 0.533), "b": ("", 1.0)}


def test_leaders_and_bank(spark):
    rows = [(i, [float(i % 3)] * 4, "score" if i % 2 else "throws") for i in range(15)] + [(99, [9.0] * 4, "x")]
    found = calibrate.clusters(spark.createDataFrame(rows, "pos int, vec array<float>, role string"))
    got = found.orderBy("cluster_id").collect()
    assert [(r["count"], r.exemplar[0], r.roles) for r in got] == [(5, float(k), ["score", "throws"]) for k in range(3)]
    typed = spark.createDataFrame([(0, "A"), (1, " "), (7, "B")], "cluster_id int, label string")
    assert [(r.template_id, r.label) for r in calibrate.bank(found, typed).collect()] == [(0, "A")]
    with pytest.raises(PySparkException, match="outside the alphabet"):
        calibrate.bank(found, spark.createDataFrame([(0, "ß")], "cluster_id int, label string")).collect()
    assert {r.cluster_id: r.label for r in calibrate.carried_labels(found, typed).collect()} == {0: "A", 1: " ", 2: ""}


def test_cluster_bound_drops_new_shapes(spark):
    rows = [(i, [float(i)] * 2, "") for i in range(5)] * 4
    found = calibrate.clusters(spark.createDataFrame(rows, "pos int, vec array<float>, role string"), most=3)
    assert found.count() == 3


def test_parsed_labels(spark):
    raw = spark.createDataFrame([('{"0": "A", "x": "B"}',), ("not json",), (None,)], "value string")
    assert [(r.cluster_id, r.label) for r in calibrate.parsed_labels(raw).collect()] == [(0, "A")]


def brute_leaders(vectors, radius, most):
    """Members of each cluster around its first one, in order of arrival."""
    found = []
    for v in vectors:
        d = [float(np.abs(own[0] - v).mean()) for own in found]
        if d and min(d) <= radius:
            found[d.index(min(d))].append(v)
        elif len(found) < most:
            found.append([v])
    return found


def test_leader_queries_against_brute_force(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    vectors = [np.array(r.embedding, np.float32) for r in e]
    sizes = sorted((len(own) for own in brute_leaders(vectors, 0.13, 96) if len(own) >= 4), reverse=True)
    got = catalogue.leader_clusters(spark, SF).orderBy("cluster_id").collect()
    assert [r["count"] for r in got] == sizes and len(sizes) > 10
    bank = defaultdict(list)
    for r in catalogue.reduced_bank(spark, SF).orderBy("label", "rank").collect():
        bank[r.label].append(r.vec)
    for label in {r.label for r in e}:
        own = brute_leaders([v for v, r in zip(vectors, e) if r.label == label], 0.13, len(e))
        want = [np.mean(own[i], axis=0) for i in sorted(range(len(own)), key=lambda i: -len(own[i]))[:8]]
        assert np.allclose(bank[str(label)], want, atol=1e-5)


def test_labelled_by_position(spark):
    g = spark.createDataFrame([("a", 2.0, 0, [1.0]), ("a", 1.0, 1, [2.0]), ("b", 1.0, 0, [3.0])], "key string, cx double, ix int, vec array<float>")
    pairs, wrong = calibrate.labelled(g, spark.createDataFrame([("a", "8o1"), ("b", "12")], "key string, text string"), ["key"])
    assert [(r.label, r.vec) for r in pairs.orderBy("ix").collect()] == [("8o", [2.0]), ("1", [1.0])]
    assert [(r.key, r.n_glyphs, r.n_tokens) for r in wrong.collect()] == [("b", 1, 2)]


@pytest.mark.parametrize("x,want", [([0, 10, 20, 30, 95], [0, 10, 20, 30]), ([1, 2], []), ([], []), ([0, 10, 30, 40, 50], [30, 40, 50]), ([5, 5, 5], [])])
def test_uniform_run(x, want):
    assert longest_uniform(x) == want


def spans(x, tolerance=0.25):
    """All spans of three or more, the longest and first of those that are even."""
    for k in range(len(x), 2, -1):
        for i in range(len(x) - k + 1):
            g = [b - a for a, b in zip(x[i : i + k], x[i + 1 : i + k])]
            m = statistics.median(g)
            if m > 0 and all(abs(v - m) <= tolerance * m for v in g):
                return x[i : i + k]
    return []


def test_longest_uniform():
    rnd = random.Random(5)
    for n in (0, 1, 2, 3, 5, 12, 40):
        for wide in (1, 4, 9):
            for _ in range(20):
                x = sorted(rnd.randrange(1, 1 + wide * max(1, n)) + 5 * i for i in range(n))
                assert longest_uniform(x) == spans(x)
    assert len(longest_uniform(list(range(0, 50_000, 5)))) == 10_000


def test_uniform_runs_of_all_orders(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey", "o_orderkey").collect()
    keys = defaultdict(list)
    for r in orders:
        keys[r.o_custkey].append(r.o_orderkey)
    assert max(map(len, keys.values())) > 10
    got = {r.o_custkey: r.run for r in catalogue.uniform_runs(spark, SF).collect()}
    assert got == {c: ",".join(map(str, spans(sorted(x)))) for c, x in keys.items()}


def test_anti_join(spark):
    box = "box struct<x:int,y:int,w:int,h:int>"
    cells = spark.createDataFrame([(1, (0, 0, 10, 10)), (1, (100, 0, 10, 10)), (2, (0, 0, 10, 10)), (1, (0, 0, 0, 0))], f"frame_index int, {box}")
    over = spark.createDataFrame([(1, (0, 0, 10, 4))], f"frame_index int, {box}")
    assert geometry.visible(cells, over, ["frame_index"]).count() == 3


def test_sources(spark, tmp_path):
    t = spark.range(20).withColumnRenamed("id", "i")
    assert [r.i for r in frames.sampled(t, "i", 3, 4, 3).collect()] == [4, 7, 10]
    assert frames.sampled(t, "i", limit=0).count() == 0
    assert frames.one(t, "i", 5).count() == 1
    with pytest.raises(IndexError):
        frames.one(t, "i", 50)
    clip = frames.clip(spark, [("board", 30), ("pins", 10), ("board_late", 20), ("inset_late", 15), ("board_late", 25)])
    assert clip.count() == 100 and clip.filter("has_board").count() == 90 and clip.filter("occluded").count() == 15
    bank = frames.bank_from(spark, [("A", [0.0, 1.0])])
    frames.write_bank(bank, str(tmp_path / "bank"))
    assert frames.read_bank(spark, str(tmp_path / "bank")).collect() == bank.collect()
    with pytest.raises(FileNotFoundError):
        frames.read_bank(spark, str(tmp_path / "none"))


def test_centred_like_python(spark):
    for s in ("", "1", "12", "123", "300"):
        assert spark.range(1).select(report.centred(F.lit(s)).alias("c")).first().c == s.center(7)
