import numpy as np
import pytest

from tenfold.functions import pixels as P
from tenfold.operators import fusion, matching, vision
from tenfold.sources import frames

FONT = {
    "0": "01110 10001 10011 10101 11001 10001 01110", "1": "00100 01100 00100 00100 00100 00100 01110", "2": "01110 10001 00001 00110 01000 10000 11111",
    "3": "11110 00001 00001 01110 00001 00001 11110", "4": "00010 00110 01010 10010 11111 00010 00010", "5": "11111 10000 11110 00001 00001 10001 01110",
    "6": "00110 01000 10000 11110 10001 10001 01110", "7": "11111 00001 00010 00100 01000 01000 01000", "8": "01110 10001 10001 01110 10001 10001 01110",
    "9": "01110 10001 10001 01111 00001 00010 01100", "X": "10001 10001 01010 00100 01010 10001 10001", "H": "10001 10001 10001 11111 10001 10001 10001",
}
TEXTS = {"p0.initial": "X", "p1.initial": "0", "p2.initial": "8", "p3.initial": "H", "p0.f1.throws": "X", "p0.f2.throws": "54", "p0.f1.score": "19", "p1.f1.throws": "81", "p1.f1.score": "9", "p3.f10.throws": "72", "p3.total": "136"}


def drawn(image, text, box, scale=4):
    x, y, w, h = box
    x0 = x + (w - len(text) * 6 * scale) // 2
    y0 = y + (h - 7 * scale) // 2
    for k, c in enumerate(text):
        m = np.array([[b == "1" for b in r] for r in FONT[c].split()]).repeat(scale, 0).repeat(scale, 1)
        image[y0 : y0 + 7 * scale, x0 + k * 6 * scale :][:, : 5 * scale][m] = 240


def board(texts=TEXTS, inset=False):
    """A frame of 1280 x 720 with a ruled board."""
    image = np.full((720, 1280, 3), (90, 40, 20), np.uint8)
    x0, y0, w, h = 60, 120, 1160, 520
    cols = [x0, *np.linspace(x0 + 0.125 * w, x0 + (1 - 0.135) * w, 11).round().astype(int).tolist(), x0 + w]
    top = y0 + 0.075 * h
    rows = [round(top + k * (h - 0.075 * h) / 8) for k in range(9)]
    for x in cols:
        image[y0 : y0 + h, x - 1 : x + 2] = 235
    for y in (y0, *rows):
        image[y - 1 : y + 2, x0 : x0 + w] = 235
    for key, _, _, _, box in vision.cells(cols, rows):
        if texts.get(key):
            drawn(image, texts[key], box)
    if inset:
        image[300:560, 700:1100] = (60, 60, 60)
    return image


def as_rows(spark, images):
    s = "frame_index int, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    return spark.createDataFrame([(i, ("", *x.shape[:2], 3, 16, bytearray(x.tobytes()))) for i, x in enumerate(images)], s)


@pytest.fixture(scope="module")
def found(spark):
    return vision.read_boards(as_rows(spark, [board(), board(), board(inset=True)])).cache()


def test_board_is_found(found):
    r = found.orderBy("frame_index").collect()
    assert [x.ok for x in r] == [True] * 3
    assert len(r[0].cells) == 88 and not r[0].occluders and len(r[2].occluders) == 1
    got = {c.key: len(c.glyphs) for c in r[0].cells if c.glyphs}
    assert got == {k: len(t) for k, t in TEXTS.items()}


def test_read_back(spark, found):
    first = {c.key: c for c in found.filter("frame_index = 0").first().cells}
    pairs = [(c, g.bitmap) for key, text in TEXTS.items() for g, c in zip(first[key].glyphs, text)]
    bank = frames.bank_from(spark, pairs)
    o = vision.observations(found, bank)
    hidden = {r.key for r in o.filter("frame_index = 2").collect()}
    assert 40 < len(hidden) < 88
    v = {r.key: r.text for r in fusion.vote(o, fusion.tail_cutoff(o)).collect()}
    assert {k: t for k, t in v.items() if t} == TEXTS and len(v) == 88


@pytest.mark.parametrize("image", [np.zeros((360, 640, 3), np.uint8), np.full((360, 640, 3), 127, np.uint8), np.random.default_rng(0).integers(0, 255, (360, 640, 3), dtype=np.uint8), np.zeros((1, 1, 3), np.uint8)])
def test_no_board(image):
    assert not vision.detect(image)["ok"]


def test_null_image(spark):
    d = spark.createDataFrame([(0, None)], "frame_index int, image struct<height:int,width:int,nChannels:int,data:binary>")
    assert not vision.read_boards(d).first().ok


def test_regions_and_runs():
    m = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 1]], bool)
    assert [(r["box"], r["area"]) for r in P.regions(m)] == [((0, 0, 2, 2), 2), ((3, 0, 1, 3), 3)]
    assert P.runs([0, 1, 1, 0, 1]) == [(1, 3), (4, 5)]


def test_geometry():
    q = np.array([[10, 0], [0, 0], [0, 5], [10, 5]], float)
    assert P.ordered(q).tolist() == [[0, 0], [10, 0], [10, 5], [0, 5]]
    assert P.area(P.ordered(q)) == 50 and P.skew(P.ordered(q)) == 0
    m = P.perspective(q, q * 2 + 3)
    assert np.allclose(m @ [10, 5, 1], [23, 13, 1])
    x = np.random.default_rng(1).integers(0, 255, (20, 30)).astype(np.uint8)
    assert (P.warped(x, np.eye(3), 30, 20) == x).all()
    assert P.resized(np.array([[0, 2], [4, 6]]), 1, 1)[0, 0] == 3


def test_merge_and_split():
    assert vision.merged([(0, 0, 20, 20), (5, 5, 8, 8), (30, 0, 5, 20)]) == [(0, 0, 20, 20), (30, 0, 5, 20)]
    m = np.zeros((20, 41), bool)
    m[:, :18] = m[:, 23:] = True
    m[10, :] = True
    assert vision.parts(m, (0, 0, 41, 20)) != [(0, 0, 41, 20)]
    assert vision.even_run([0, 10, 20, 30, 95], 0.25) == [0, 10, 20, 30]


def test_titles_from_glyphs(spark):
    p = spark.createDataFrame([(0, 10.0, 0, "6", 0.9), (0, 500.0, 1, "T", 0.9), (0, 600.0, 2, "A", 0.1)], "frame_index int, cx double, ix int, label string, confidence double")
    t = matching.titles(p, ["frame_index"], 1440).first()
    assert (t.lane, t.bowler) == ("6", "T")
