import random
from collections import defaultdict

import pytest

from tenfold.operators import fusion

SCHEMA = "key string, frame_index int, text string, confidence double, pos int"


def observations(seed, n=400):
    rnd = random.Random(seed)
    return [(rnd.choice("abcde"), i // 3, rnd.choice(["", "X", "7", "8", "9"]), rnd.random(), i) for i in range(n)]


def voted(rows, cutoff, least):
    out = {}
    cells = defaultdict(list)
    for r in rows:
        cells[r[0]].append(r)
    for key, obs in cells.items():
        window = [o for o in obs if o[1] >= cutoff] or obs
        weights = {}
        for o in window:
            weights[o[2]] = weights.get(o[2], 0) + 0.1 + o[3]
        text = max(weights, key=weights.get)
        if weights[text] / sum(weights.values()) < least and len(weights) > 1:
            text = window[-1][2]
        own = [o[3] for o in window if o[2] == text]
        out[key] = (text, round(sum(own) / len(own), 6), len(obs), next(o[1] for o in obs if o[2] == text))
    return out


@pytest.mark.parametrize("tail,least", [(12, 0.3), (3, 0.3), (1, 0.6), (50, 0.0)])
def test_vote_equals_a_loop(spark, tail, least):
    rows = observations(tail)
    o = spark.createDataFrame(rows, SCHEMA)
    cutoff = fusion.tail_cutoff(o, tail).first().cutoff
    assert cutoff == sorted({r[1] for r in rows})[-tail:][0]
    got = {r.key: (r.text, round(r.confidence, 6), r.n_observations, r.first_seen) for r in fusion.vote(o, fusion.tail_cutoff(o, tail), least).collect()}
    assert got == voted(rows, cutoff, least)


def test_vote_tie_goes_to_the_first_text(spark):
    o = spark.createDataFrame([("a", 1, "8", 0.5, 0), ("a", 2, "3", 0.5, 1)], SCHEMA)
    assert fusion.vote(o, fusion.tail_cutoff(o)).first().text == "8"


@pytest.mark.parametrize("tail", [5000, 1])
def test_weights_add_up_in_order_of_arrival(spark, tail):
    """Both texts of a cell weigh the same but for the order in which their readings came; rows lie in any order."""
    rnd, rows, want = random.Random(7), [], {}
    for key in range(60):
        shares = [rnd.randrange(100) / 100 for _ in range(40)]
        own = [(t, c) for t in "XY" for c in rnd.sample(shares, len(shares))]
        rnd.shuffle(own)
        weights, sums = {}, {}
        for t, c in own:
            weights[t], sums[t] = weights.get(t, 0.0) + (c + 0.1), sums.get(t, 0.0) + c
            rows.append((str(key), len(rows), t, c, len(rows)))
        text = max(weights, key=weights.get)
        want[str(key)] = (text, sums[text] / len(shares), weights[text] / sum(sorted(weights.values(), reverse=True)))
    rows.append(("last", len(rows), "7", 0.5, len(rows)))  # in a tail of one frame alone: the others vote with all
    want["last"] = ("7", 0.5, 1.0)
    rnd.shuffle(rows)
    o = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {r.key: (r.text, r.confidence, r.share) for r in fusion.vote(o, fusion.tail_cutoff(o, tail)).collect()}
    assert got == want


def test_empty_votes(spark):
    o = spark.createDataFrame([], SCHEMA)
    assert fusion.tail_cutoff(o).first().cutoff == 0
    assert fusion.vote(o, fusion.tail_cutoff(o)).count() == 0


@pytest.mark.parametrize("persist", [2, 3])
def test_transitions_equal_a_loop(spark, persist):
    rows = [(k, f, t, c, p) for k, f, t, c, p in observations(5, 600)]
    rows = [(k, f, t if f % 5 else "X", c, p) for k, f, t, c, p in rows]
    want, cells = set(), defaultdict(lambda: ["", None, 0])
    for key, f, text, _, _ in rows:
        s = cells[key]
        s[1:] = [text, s[2] + 1] if text == s[1] else [text, 1]
        if s[2] == persist and text != s[0]:
            want.add((key, f, s[0], text))
            s[0] = text
    got = fusion.transitions(spark.createDataFrame(rows, SCHEMA), persist).collect()
    assert {(r.key, r.frame_index, r.old, r.new) for r in got} == want and len(got) == len(want)


def test_published_transition(spark):
    rows = [("p3.total", i, t, 1.0, i) for i, t in enumerate(["33"] * 40 + ["36"] * 8)]
    got = fusion.transitions(spark.createDataFrame(rows, SCHEMA)).orderBy("frame_index").collect()
    assert [(r.old, r.new, r.onset, r.frame_index) for r in got] == [("", "33", 0, 1), ("33", "36", 40, 41)]


def test_runs(spark):
    flags = [False, True, True, False, True]
    r = fusion.runs(spark.createDataFrame([("a", i, f) for i, f in enumerate(flags)], "k string, i int, f boolean"), ["k"], "i", "f")
    assert sorted((x.start, x.end) for x in r.collect()) == [(1, 3), (4, 5)]


def test_quality_of_nothing(spark):
    counts = fusion.counters(spark.createDataFrame([], "frame_index int, ok boolean, occluded boolean"))
    q = fusion.quality(counts, spark.createDataFrame([], "key string, text string, confidence double"), spark.createDataFrame([], "checked boolean, mismatched boolean")).first()
    assert (q.detection_rate, q.rules_agreement, q.mean_glyph_confidence, q.last_board_frame) == (0.0, 1.0, 0.0, None)
