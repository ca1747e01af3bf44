import numpy as np

from roadgrid import cli
from roadgrid.sources import images, results, watchlist

MODELS = """
class Boxes:
    def detect(self, arrays):
        return [[(0.9, 0, 0, a.shape[1], a.shape[0])] for a in arrays]


class Widths:
    def read(self, crop):
        return f"abc-{crop.shape[1]}00", [0.9]
"""


def test_run_and_watchlist(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "stub_models.py").write_text(MODELS)
    monkeypatch.syspath_prepend(str(tmp_path))
    import stub_models
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(stub_models)
    (tmp_path / "in").mkdir()
    for w in (6, 7):
        (tmp_path / "in" / f"{w}.png").write_bytes(images.png(np.full((5, w, 3), 90, np.uint8)))
    plates = str(tmp_path / "plates")
    keep = lambda *a: cli.keep_list(spark, cli.parser().parse_args(["watchlist", *a, "--file", plates, "--results", str(tmp_path / "out/results.csv")]))
    keep("add", "abc-600", "ABC 600", "x1")
    assert capsys.readouterr().out.split() == ["ABC600", "X1"]
    args = ["run", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--watchlist", plates, "--detector", "stub_models:Boxes", "--recogniser", "stub_models:Widths"]
    assert cli.run(spark, cli.parser().parse_args(args)) == 0
    assert sorted((r["plate_text"], r["status"]) for r in results.load(spark, str(tmp_path / "out/results.csv")).collect()) == [("ABC600", "ROUBADO"), ("ABC700", "OK")]
    assert (tmp_path / "out/report.html").exists() and "ABC700" in (tmp_path / "out/pages/page-000000000.js").read_text() and len(list((tmp_path / "out/crops").iterdir())) == 2
    assert results.load_runs(spark, str(tmp_path / "out/runs")).count() == 1
    keep("demo", "2")
    keep("remove", "abc700", "nothing")
    assert sorted(r[0] for r in watchlist.load(spark, plates).collect()) == ["ABC600", "X1"]
    keep("clear")
    assert watchlist.load(spark, plates).count() == 0
    args[2] = str(tmp_path / "none")
    assert cli.run(spark, cli.parser().parse_args(args)) == 1
