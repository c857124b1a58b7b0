"""Freshness, seeding, catch-up, hooks and the command line."""

import json
import os
import subprocess

import pytest
from codeloom.__main__ import main
from codeloom.plans.index import scan
from codeloom.plans.store import Store
from codeloom.plans.upkeep import catch_up, enrich_if_changed, freshness_target, notify, refresh, remember_head, seed_worktree


def ids(store):
    return {r["id"] for r in store.read("symbols").collect()}


@pytest.fixture
def repo(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    (root / "a.py").write_text("def f(): pass\n")
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "one")
    store = Store(spark, f"file://{tmp_path}/index")
    scan(store, str(root), "t0")
    remember_head(store, str(root))
    return root, store, run


def test_targets():
    assert freshness_target("list_imports", {"file": "a.py"}) == "a.py" and freshness_target("find_symbol", {"name": "x"}) is None
    assert freshness_target("get_definition", {"position": {"file": "b.py"}}) == "b.py" and freshness_target("get_definition", {"symbol_id": "x"}) is None


def test_refresh_only_what_changed(repo):
    root, store, _ = repo
    assert refresh(store, str(root), ["a.py"], "t1") == 0
    (root / "a.py").write_text("def g(): pass\n")
    assert refresh(store, str(root), ["a.py"], "t2") == 1 and ids(store) == {"a.py:#module", "a.py:g#function"}
    os.remove(root / "a.py")
    assert refresh(store, str(root), ["a.py", "never.py"], "t3") == 1 and ids(store) == set()


def test_hooks(repo):
    root, store, run = repo
    (root / "a.py").write_text("def h(): pass\n")
    assert notify(store, str(root), "claude-code", json.dumps({"tool_input": {"file_path": "a.py"}}), "t1") == 1 and "a.py:h#function" in ids(store)
    assert notify(store, str(root), "nobody", "{}", "t1") == 0
    (root / "b.py").write_text("def k(): pass\n")
    run("add", "-A")
    run("commit", "-qm", "two")
    before = store.meta()["head_sha"]
    assert notify(store, str(root), "git", "", "t2") >= 1 and "b.py:k#function" in ids(store) and store.meta()["head_sha"] != before


def test_seeded_worktree(repo, tmp_path):
    root, store, run = repo
    run("worktree", "add", "-q", str(tmp_path / "wt"), "-b", "other")
    (tmp_path / "wt" / "c.py").write_text("def c(): pass\n")
    os.remove(tmp_path / "wt" / "a.py")
    other = seed_worktree(store, str(root), f"file://{tmp_path}/index2", str(tmp_path / "wt"), "t1")
    assert ids(other) == {"c.py:#module", "c.py:c#function"} and ids(store) == {"a.py:#module", "a.py:f#function"}


def test_catch_up_and_enrichment_once(repo):
    root, store, _ = repo
    assert not catch_up(store, str(root), "t1")
    store.commit({}, {}, bump=False, cross_file_pass_version=1)
    assert catch_up(store, str(root), "t1") and not store.needs_resolution()
    assert enrich_if_changed(store, str(root), "t2") and not enrich_if_changed(store, str(root), "t3")


def test_command_line(repo, tmp_path, capsys):
    root, _, _ = repo
    index = f"file://{tmp_path}/cli"
    assert main(["scan", str(root), "--index", index, "--json"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["files_indexed"] == 1
    (root / "a.py").write_text("import late\n")
    main(["query", str(root), "--index", index, "list_imports", '{"file": "a.py"}'])
    got = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert got["ok"] and [r["target"] for r in got["result"]["results"]] == ["late"]
