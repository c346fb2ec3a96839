import json
import os

import pytest

from textloom import cli, config


def test_layers(tmp_path):
    (tmp_path / "c.yaml").write_text("root: /data # here\nexcludes:\n  - '**/x/**'\n  - y\nmax_file_bytes: 5\nfollow_symlinks: yes\nallowed_origins: [a, b]\n")
    (tmp_path / "e").write_text("export TEXTLOOM_K=7\nTEXTLOOM_ALLOWED_ORIGINS='b,c'\n# TEXTLOOM_K=9\n")
    got = config.load(str(tmp_path / "c.yaml"), str(tmp_path / "e"), {"TEXTLOOM_K": "8", "TEXTLOOM_API_KEY": "s"})
    assert (got.root, got.excludes, got.max_file_bytes, got.follow_symlinks, got.k, got.allowed_origins) == ("/data", ("**/x/**", "y"), 5, True, 8, ("a", "b", "c"))
    assert json.loads(config.snapshot(got))["api_key"] == "set"
    where = lambda env: json.loads(config.snapshot(got, config.sources(str(tmp_path / "c.yaml"), str(tmp_path / "e"), env)))["api_key"]
    assert where({"TEXTLOOM_API_KEY": "s"}) == "env:TEXTLOOM_API_KEY" and where({}) == "unset"
    with open(tmp_path / "c.yaml", "a") as f:
        f.write("api_key: abc\n")
    assert where({}) == "file"
    with open(tmp_path / "e", "a") as f:
        f.write("TEXTLOOM_API_KEY=d\n")
    assert where({"TEXTLOOM_API_KEY": ""}) == "dotenv"
    path = config.save_snapshot(got, {"api_key": "dotenv"}, str(tmp_path / "state"))
    assert oct(os.stat(path).st_mode)[-3:] == "600" and "'s'" not in open(path).read()
    assert config.load(env={}) == config.Config()


@pytest.mark.parametrize("raw", ["- x", " a: 1", "nothing"])
def test_bad_yaml(raw):
    with pytest.raises(ValueError, match="line 1"):
        config.parse_yaml(raw)


def test_commands(spark, tmp_path, capsys):
    root = tmp_path / "root"
    root.mkdir()
    (root / "a.md").write_text("boats leave from the pier")
    (tmp_path / "c.yaml").write_text(f"root: {root}\nstate: file://{tmp_path}/state\n")
    run = lambda *a: (cli.main(["--config", f"{tmp_path}/c.yaml", *a]), capsys.readouterr().out.strip())
    assert run("version")[0] == 0
    assert json.loads(run("up")[1])["embedded_ok"] == 1
    code, out = run("ask", "pier boats", "--k", "1")
    assert code == 0 and out.splitlines()[-1].startswith("[1] a.md (lines:1-1) score=")
    assert json.loads(run("reindex")[1])["chunks_total"] == 1
    assert run("config", "init")[0] == 1 and json.loads(run("config", "print")[1])["root"] == str(root)
