from __future__ import annotations

import gzip
import json

import pytest

from gradus import cli

P = "msmarco_passage_00_"


@pytest.mark.parametrize("more", [["--reasoning-effort", "low"], ["--rpm", "5"], ["--method", "structured", "--tpm", "0"], ["--one-rate"], ["--concurrency", "0"], ["--threads", "0"], ["--local-runs", "--download-only"], ["--method", "other"]])
def test_options_that_do_not_go_together(more):
    with pytest.raises(SystemExit):
        cli.parse(["judge", "--collection", "c", "--data-dir", "d", *more])


def test_signature_leaves_out_limits():
    one, two = (cli.parse(["judge", "--collection", "c", "--data-dir", "d", "--method", "structured", *x]) for x in ([], ["--rpm", "9", "--concurrency", "2"]))
    assert cli.configuration(one) == cli.configuration(two)
    assert cli.factory(two)()("q", "passage")["predicted_relevance"] in range(4) and cli.pace(two)().rates[0] == 9 / 60 / 2
    shared = cli.parse(["judge", "--collection", "c", "--data-dir", "d", "--method", "structured", "--rpm", "9", "--one-rate"])
    assert cli.pace(shared)().rates == (9 / 60, 3000) and isinstance(cli.pace(shared)(), cli.judging.SharedPace)
    with pytest.raises(SystemExit):
        cli.parse(["build", "q", "r", "s", "--collection", "c", "--fetch-from", "f"])


def test_all_commands(spark, tmp_path, capsys):
    (tmp_path / "q.tsv").write_text("1\twhat is it\n2\twho\n")
    (tmp_path / "r.txt").write_text(f"1 0 {P}1 3\n1 0 {P}2 0\n2 0 {P}1 1\n")
    with gzip.open(tmp_path / "s.gz", "wt") as out:
        out.writelines(json.dumps({"pid": f"{P}{i}", "passage": "x" * i, "docid": "D", "spans": ""}) + "\n" for i in (1, 2, 3))
    made, data = str(tmp_path / "made"), str(tmp_path / "data")
    cli.main(["build", str(tmp_path / "q.tsv"), str(tmp_path / "r.txt"), str(tmp_path / "s.gz"), "--collection", made])
    cli.main(["build", "/elsewhere/q.tsv", "/elsewhere/r.txt", str(tmp_path / "s.gz"), "--collection", made, "--revision", "r1", "--cache-dir", str(tmp_path / "cache"), "--fetch-from", str(tmp_path)])
    assert (tmp_path / "cache/q.tsv").exists() and cli.tables.read_collection(spark, made, "r1")["qrels"].count() == 3
    cli.main(["summarize", "--collection", made])
    assert "Number of judgments: 3" in capsys.readouterr().out
    (tmp_path / "data/runs").mkdir(parents=True)
    for n in ("a", "b"):
        (tmp_path / f"data/runs/{n}.run").write_text(f"1 Q0 {P}1 0 {ord(n)} t\n2 Q0 {P}2 0 1 t\n")
    cli.main(["judge", "--collection", made, "--data-dir", data, "--concurrency", "2"])
    cli.main(["report", "--collection", made, "--data-dir", data, "--local-runs"])
    assert "system_rank_correlations" in capsys.readouterr().out
    cli.main(["report", "--collection", made, "--data-dir", data, "--runs", str(tmp_path / "copied"), "--fetch-from", f"{data}/runs", "--download-only"])
    assert "2 run files" in capsys.readouterr().out and (tmp_path / "copied/manifest.json").exists()
