import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadgrid import config as C
from roadgrid.functions import geometry as G
from roadgrid.functions import scaling as S
from roadgrid.functions import text as X
from roadgrid.operators import match, recognise


def values(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


def test_blacklist_has_all_words():
    assert len(C.WORD_BLACKLIST) == len(set(C.WORD_BLACKLIST)) == 43


@pytest.mark.parametrize(
    ("plate", "probs", "text", "conf", "reason"),
    [
        ("abc-1234", [0.9, 0.9], "ABC1234", 0.9, None),
        ("abc", [0.9], "", 0.0, "length"),
        ("the", [0.9], "", 0.0, "length"),
        ("state", [0.9], "", 0.0, "blacklist"),
        ("STATE1", [0.9], "STATE1", 0.9, None),
        ("AB12", [0.25, 0.125], "", 0.0, "confidence"),
        ("AB12", [0.2], "AB12", 0.2, None),
        ("AB12", None, "AB12", 1.0, None),
        ("AB12", [], "AB12", 1.0, None),
        (None, [0.9], "", 0.0, "empty"),
        ("--..", [0.9], "", 0.0, "empty"),
        ("straße", [0.9], "STRASSE", 0.9, None),
    ],
)
def test_cascade(spark, plate, probs, text, conf, reason):
    r = values(spark, "p string, c array<double>", [(plate, probs)], recognise.read_plate(F.col("p"), F.col("c")))[0][0]
    assert (r["text"], r["confidence"], r["reason"]) == (text, conf, reason)


def test_cascade_failure_and_nan(spark):
    rows = values(spark, "p string, c array<double>, f boolean", [("AB12", [0.9], True), ("AB12", [float("nan")], False)], recognise.read_plate(F.col("p"), F.col("c"), F.col("f")))
    assert rows[0][0]["reason"] == "inference"
    assert rows[1][0]["text"] == "AB12"


def test_watchlist_text(spark):
    rows = [(" abc-1234 ",), ("abc 1234",), ("a.b-1",), ("  - ",), ("\tx y ",)]
    assert [r[0] for r in values(spark, "v string", rows, X.normalise_watch(F.col("v")))] == ["ABC1234", "ABC1234", "A.B1", "", "XY"]


def test_paths(spark):
    rows = [("/a/Foo.bar.JPG",), (".jpg",), ("x",), ("a.b/c.webp",)]
    name = X.basename(F.col("p"))
    got = values(spark, "p string", rows, X.stem(name), X.suffix(name), X.is_image(name))
    assert got == [("Foo.bar", ".JPG", True), (".jpg", "", False), ("x", "", False), ("c", ".webp", True)]


@pytest.mark.parametrize(
    ("box", "size", "want"),
    [
        ((10, 20, 110, 60), (200, 100), (2, 17, 118, 63)),
        ((0, 0, 12, 12), (100, 100), (0, 0, 12, 12)),
        ((0, 0, 100, 50), (100, 50), (0, 0, 100, 50)),
        ((50, 50, 75, 75), (100, 100), (48, 48, 77, 77)),
    ],
)
def test_expand(spark, box, size, want):
    b = G.expand(G.box(*map(F.col, ("x1", "y1", "x2", "y2"))), F.col("w"), F.col("h"))
    assert tuple(values(spark, "x1 int, y1 int, x2 int, y2 int, w int, h int", [(*box, *size)], b)[0][0]) == want


BOXES = [
    ([(0.5, 0, 0, 10, 10), (0.5, 20, 20, 30, 30)], 0),
    ([(0.9, 5, 5, 5, 9), (0.4, 1, 1, 9, 9)], 1),
    ([(0.3, 0, 0, 9, 9), (0.8, 1, 1, 9, 9)], 1),
    ([(0.9, 120, 10, 150, 20), (0.2, 0, 0, 9, 9)], 1),
    ([(float("nan"), 0, 0, 9, 9), (0.1, 0, 0, 9, 9)], 1),
    ([(-1.0, 0, 0, 9, 9)], None),
    ([], None),
    (None, None),
]


def test_best_box(spark):
    rows = [(None if b is None else [tuple(map(float, x)) for x in b],) for b, _ in BOXES]
    got = values(spark, f"b {C.BOXES}", rows, G.best_box(F.col("b"), F.lit(100), F.lit(100)))
    assert [r[0] and r[0]["pos"] for r in got] == [want for _, want in BOXES]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=20))
def test_reading_properties(spark, texts):
    once = X.normalise_reading(F.col("t"))
    for a, b in values(spark, "t string", [(t.replace("\x00", ""),) for t in texts], once, X.normalise_reading(once)):
        assert a == b and a == "".join(c for c in a if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def test_scaling(spark):
    got = values(spark, "p int", [(1,), (2,), (4,), (8,), (12,)], F.round(S.amdahl(F.lit(0.68), F.col("p")), 4))
    assert [r[0] for r in got] == [1.0, 1.1905, 1.3158, 1.3889, 1.4151]
    got = values(spark, "c int, g double", [(4, 8.0), (4, 0.3), (4, 0.0)], S.recommended_workers(F.col("c"), F.col("g")))
    assert [r[0] for r in got] == [4, 2, 1]
    got = values(spark, "d int, t int", [(0, 4), (1, 4), (4, 4), (0, 0)], S.progress_state(F.col("d"), F.col("t")), S.progress_bar(F.col("d"), F.col("t")), S.eta(F.lit(3.0), F.col("d"), F.col("t")))
    assert got[1] == ("remaining", "█" * 5 + "░" * 15, 9.0) and got[2][0] == "finished" and got[0][0] == "calculating"


def test_watchlist_sets(spark):
    old = spark.createDataFrame([("A",), ("B",)], "plate string")
    new = spark.createDataFrame([("B",), ("C",), ("",)], "plate string")
    plates = lambda df: sorted(r[0] for r in df.collect())
    assert plates(match.add_plates(old, new)) == ["A", "B", "C"]
    assert plates(match.new_plates(old, new)) == ["C"]
    assert plates(match.remove_plates(match.add_plates(old, new), new)) == ["A"]
    assert plates(match.removed_plates(old, new)) == ["B"]
    assert plates(match.clear(old)) == []
    assert match.sampled(old, 5, "s").count() == 2
    with pytest.raises(ValueError):
        match.sampled(old, -1, "s")


def test_status_keeps_rows(spark):
    rows = spark.createDataFrame([("ABC1234",), ("XYZ9999",), ("",), (None,), ("ABC1234",)], "plate_text string")
    listed = spark.createDataFrame([("ABC1234",), ("ABC1234",)], "plate string")
    got = sorted((r["plate_text"] or "", r["status"]) for r in match.assign_status(rows, listed).collect())
    assert got == [("", C.UNIDENTIFIED), ("", C.UNIDENTIFIED), ("ABC1234", C.STOLEN), ("ABC1234", C.STOLEN), ("XYZ9999", C.OK)]
