"""Adapters of ONNX files, with small models written here byte by byte."""

import numpy as np
import pytest

from roadgrid import cli
from roadgrid.operators import onnx_models as om
from roadgrid.sources import images, results

pytest.importorskip("onnxruntime")
FLOAT, UINT8 = 1, 2


def number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(k, value):
    """A field of a protocol buffer: a number, or bytes."""
    return number(k << 3) + number(value) if isinstance(value, int) else number(k << 3 | 2) + number(len(value)) + value


def tensor(name, x):
    kind = {"float32": FLOAT, "uint8": UINT8, "int64": 7}[x.dtype.name]
    return b"".join(field(1, d) for d in x.shape) + field(2, kind) + field(8, name.encode()) + field(9, x.tobytes())


def value(name, kind, shape):
    dims = b"".join(field(1, field(1, d) if isinstance(d, int) else field(2, d.encode())) for d in shape)
    return field(1, name.encode()) + field(2, field(1, field(1, kind) + field(2, dims)))


def node(op, inputs, output, *attributes):
    return b"".join(field(1, i.encode()) for i in inputs) + field(2, output.encode()) + field(4, op.encode()) + b"".join(field(5, a) for a in attributes)


def integer(name, n):
    return field(1, name.encode()) + field(3, n) + field(20, 2)


def model(path, nodes, constants, given, made, said=()):
    graph = b"".join(field(1, n) for n in nodes) + field(2, b"g") + b"".join(field(5, tensor(k, v)) for k, v in constants.items()) + field(11, value(*given)) + field(12, value(*made))
    meta = b"".join(field(14, field(1, k.encode()) + field(2, v.encode())) for k, v in said)
    with open(path, "wb") as f:
        f.write(field(1, 8) + field(7, graph) + field(8, field(1, b"") + field(2, 13)) + meta)
    return str(path)


def detector(path, found, batch="n", size=64):
    """A model whose places are given; it only adds the mean of what it sees, times 0, so that it runs on its input."""
    x = np.array(found, np.float32).T[None]
    nodes = [node("Mul", ["images", "zero"], "nothing"), node("ReduceSum", ["nothing", "axes"], "sum", integer("keepdims", 1)), node("Squeeze", ["sum", "last"], "flat"), node("Add", ["flat", "boxes"], "out")]
    constants = {"zero": np.zeros(1, np.float32), "axes": np.array([1, 2, 3], np.int64), "last": np.array([3], np.int64), "boxes": x}
    return model(path, nodes, constants, ("images", FLOAT, [batch, 3, size, size]), ("out", FLOAT, [batch, *x.shape[1:]]))


def reader(path, text, said=(), alphabet=om.ALPHABET):
    x = np.full((1, len(text), len(alphabet)), 0.01, np.float32)
    for k, c in enumerate(text):
        x[0, k, alphabet.index(c)] = 0.5 + k / 20
    nodes = [node("Cast", ["input"], "float", integer("to", FLOAT)), node("Mul", ["float", "zero"], "nothing"), node("ReduceSum", ["nothing", "axes"], "sum", integer("keepdims", 1)), node("Squeeze", ["sum", "last"], "flat"), node("Add", ["flat", "chances"], "out")]
    constants = {"zero": np.zeros(1, np.float32), "axes": np.array([1, 2, 3], np.int64), "last": np.array([3], np.int64), "chances": x}
    return model(path, nodes, constants, ("input", UINT8, ["n", 16, 32, 3]), ("out", FLOAT, ["n", *x.shape[1:]]), said)


def test_boxes_in_the_pixels_of_the_image(tmp_path):
    found = [[32, 32, 20, 10, 0.9, 0.1], [33, 32, 20, 10, 0.3, 0.8], [10, 20, 4, 4, 0.2, 0.3], [50, 50, 4, 4, 0.1, 0.2]]
    for batch in ("n", 1):
        d = om.OnnxDetector(detector(tmp_path / f"{batch}.onnx", found, batch))
        wide, tall, same = np.zeros((32, 128, 3), np.uint8), np.zeros((128, 64, 3), np.uint8), np.zeros((64, 64, 3), np.uint8)
        got = d.detect([wide, tall, same])
        assert np.allclose(got[2], [(0.9, 22, 27, 42, 37), (0.3, 8, 18, 12, 22)], atol=1e-4)
        assert np.allclose(got[0][0], (0.9, 44, 6, 84, 26), atol=1e-4)  # half as large, 24 rows down
        assert np.allclose(got[1][0], (0.9, 12, 54, 52, 74), atol=1e-4)
        assert d.detect([]) == []


def test_letterbox_and_resize():
    x = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    assert (om.resized(x, 4, 4) == x).all() and om.resized(x, 1, 1).shape == (1, 1, 3)
    assert np.allclose(om.resized(x, 2, 2)[0, 0], x[:2, :2].reshape(4, 3).mean(0))
    out, scale, left, top = om.letterbox(x, 8, 16)
    assert (scale, left, top) == (2.0, 4, 0) and (out[:, :4] == om.GROUND).all() and (out[:, 12:] == om.GROUND).all()


def test_text_and_chances(tmp_path):
    r = om.OnnxReader(reader(tmp_path / "r.onnx", "AB12__"))
    text, chances = r.read(np.zeros((9, 30, 3), np.uint8))
    assert text == "AB12" and np.allclose(chances, [0.5, 0.55, 0.6, 0.65, 0.7, 0.75])
    assert r.read(np.zeros((0, 5, 3), np.uint8)) == (None, None)
    other = om.OnnxReader(reader(tmp_path / "o.onnx", "ba#", [("alphabet", "ab#"), ("pad_char", "#")], "ab#"))
    assert other.read(np.zeros((9, 30, 3), np.uint8))[0] == "ba"


def test_run_with_onnx_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.png").write_bytes(images.png(np.full((64, 64, 3), 60 + k, np.uint8)))
    d, r = detector(tmp_path / "d.onnx", [[32, 32, 20, 10, 0.9]]), reader(tmp_path / "r.onnx", "QRS4567_")
    args = ["run", "--input", f"{tmp_path}/in", "--output", f"{tmp_path}/out", "--watchlist", f"{tmp_path}/list", "--detector", "roadgrid.operators.onnx_models:OnnxDetector", "--recogniser", "roadgrid.operators.onnx_models:OnnxReader", "--detector-model", d, "--recogniser-model", r, "--quiet"]
    assert cli.run(spark, cli.parser().parse_args(args)) == 0
    got = results.load(spark, f"{tmp_path}/out/results.csv").collect()
    assert len(got) == 3 and {(x["plate_text"], x["status"], x["plate_detected"], x["error"]) for x in got} == {("QRS4567", "OK", True, "")}
