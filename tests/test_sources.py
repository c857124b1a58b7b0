"""Ignore rules, layer files, repositories, version control and hooks."""

import json
import os
import subprocess

import pytest
from codeloom.model import InvalidConfig
from codeloom.sources import git
from codeloom.sources.hooks import touched
from codeloom.sources.ignore import ignored, is_ignored, rules
from codeloom.sources.layers import load_layers, parse_layers
from codeloom.sources.repo import list_files, read_repo, to_repo_relative

CASES = [
    ([("", "*.log\n!keep.log\n")], ["a.log", "x/b.log"], ["keep.log", "x/keep.log", "a.py"]),
    ([("", "build/\n")], ["build/a.py", "x/build/b.py"], ["build", "builder/a.py"]),
    ([("", "/top.py\n")], ["top.py"], ["x/top.py"]),
    ([("", "a/b\n")], ["a/b", "a/b/c.py"], ["x/a/b"]),
    ([("", "**/gen/*.py\n")], ["gen/a.py", "x/y/gen/a.py"], ["gen/x/a.py"]),
    ([("", "docs/**\n")], ["docs/a", "docs/b/c"], ["docs"]),
    ([("", "# note\n\n\\#odd\n")], ["#odd"], ["note"]),
    ([("", "*.py\n"), ("sub", "!ok.py\n")], ["a.py", "sub/b.py"], ["sub/ok.py", "sub/x/ok.py"]),
    ([("sub", "x.py\n")], ["sub/x.py", "sub/y/x.py"], ["x.py", "subway/x.py"]),
    ([("", "[ab]?.py\n")], ["a1.py"], ["c1.py", "a12.py"]),
]


@pytest.mark.parametrize(("files", "yes", "no"), CASES)
def test_ignore_rules(spark, files, yes, no):
    chosen = rules(files)
    for p in yes + no:
        assert is_ignored(p, chosen) == (p in yes), p
    df = spark.createDataFrame([(p,) for p in yes + no], "p string")
    assert [r[0] for r in df.select(ignored("p", chosen)).collect()] == [True] * len(yes) + [False] * len(no)
    assert is_ignored(".git/config", []) and is_ignored(".git", [])


def test_repository(spark, tmp_path):
    for path, text in {"a.py": "x", "pkg/__init__.py": "", "_hidden.py": "y", ".venv/b.py": "z", "out/c.py": "", "pkg/d.txt": "", ".gitignore": "out/\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    assert list_files(str(tmp_path)) == ["_hidden.py", "a.py", "bad.py", "pkg/__init__.py"]
    assert {r["path"]: r["source"] for r in read_repo(spark, str(tmp_path)).collect()} == {"_hidden.py": "y", "a.py": "x", "pkg/__init__.py": ""}
    assert [r["path"] for r in read_repo(spark, str(tmp_path), "pkg/*").collect()] == ["pkg/__init__.py"]
    assert [r["path"] for r in read_repo(spark, str(tmp_path), paths=["a.py", "out/c.py", "../x.py"]).collect()] == ["a.py"]
    assert to_repo_relative("/r", "/r/a/../b.py") == "b.py" and to_repo_relative("/r", "../x") is None


@pytest.mark.parametrize("text", ["", "[]", "{}", '{"layers": []}', '{"layers": {"a": "x"}}', '{"layers": {"a": [1]}}', '{"layers": {"a": ["x"]}, "allowed_dependencies": {"b": []}}', '{"layers": {"a": ["x"]}, "allowed_dependencies": {"a": ["b"]}}'])
def test_bad_layer_files(text):
    with pytest.raises(InvalidConfig):
        parse_layers(text)


def test_layer_files(tmp_path):
    assert load_layers(str(tmp_path)) is None
    (tmp_path / ".layers.json").write_text('{"layers": {"a": ["x/*"], "b": []}, "allowed_dependencies": {"a": ["b"]}}')
    got = load_layers(str(tmp_path))
    assert got.layers == {"a": ["x/*"], "b": []} and got.allowed == {"a": ["b"]}


def test_version_control(tmp_path):
    assert git.head_sha(str(tmp_path)) is None and git.fingerprint(str(tmp_path)) is None and git.changed_paths(str(tmp_path), "HEAD") is None
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("1")
    run("add", "-A")
    run("commit", "-qm", "one")
    first, mark = git.head_sha(str(tmp_path)), git.fingerprint(str(tmp_path))
    (tmp_path / "b.py").write_text("2")
    run("add", "-A")
    run("commit", "-qm", "two")
    (tmp_path / "a.py").write_text("3")
    (tmp_path / "c.py").write_text("4")
    assert git.changed_paths(str(tmp_path), first, ["gone.py", "a.py"]) == ["a.py", "b.py", "c.py", "gone.py"]
    assert git.fingerprint(str(tmp_path)) not in (mark, None)
    repo, tree = git.worktree_ids(str(tmp_path))
    assert repo == tree and len(repo) == 16
    run("worktree", "add", "-q", str(tmp_path / "wt"), "-b", "other")
    assert git.worktree_ids(str(tmp_path / "wt"))[0] == repo and git.worktree_ids(str(tmp_path / "wt"))[1].startswith(repo + "-")
    assert os.path.isabs(git.common_dir(str(tmp_path)))


def test_hook_payloads(spark):
    diff = "--- a/x.py\n+++ b/x.py\n@@\n--- /dev/null\n+++ b/new.py\n--- a/../out.py\n+++ b/y.txt"
    rows = [
        ("claude-code", json.dumps({"tool_input": {"file_path": "pkg/a.py"}})), ("claude-code", "not json"), ("claude-code", "{}"), ("unknown", json.dumps({"tool_input": {"file_path": "b.py"}})),
        ("codex", json.dumps({"tool_input": {"command": diff}})), ("omp", json.dumps({"tool_input": {"file_path": "/etc/c.py"}})), ("codex", None),
    ]
    got = touched(spark.createDataFrame(rows, "agent string, payload string"))
    assert sorted(r["path"] for r in got.collect()) == ["new.py", "pkg/a.py", "x.py"]
