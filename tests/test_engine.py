import io
import json

import pytest

from siftwell import cli, config, workspace
from siftwell.plans import service
from siftwell.plans.search import SearchEngine, SyncStatus
from siftwell.sources.tree import read_tree


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "small.py").write_text("def func_1():\n    return 'alpha token'\n")
    (root / "large.py").write_text("\n".join(f"def big_{i}(value):\n    return value + {i}\n" for i in range(200)))
    (root / "main.go").write_text("package main\n\nfunc Daemon() {}\n")
    (root / "__init__.py").write_text("")
    (root / ".gitignore").write_text("ignored_dir/\n")
    (root / ".hidden").write_text("x")
    (root / "data.bin").write_bytes(b"a\0b")
    for d in ("ignored_dir", "node_modules", "_priv"):
        (root / d).mkdir()
        (root / d / "secret.py").write_text("secret = 1\n")
    return root


def test_tree_scan(spark, tree):
    got = {r.filepath: r.size for r in read_tree(spark, tree, batch="2").collect()}
    assert set(got) == {"small.py", "large.py", "main.go", "__init__.py", "_priv/secret.py"} and got["__init__.py"] == 0


def test_sync_search_and_tools(spark, tree, tmp_path):
    e = SearchEngine(spark, tmp_path / "store", str(tree), "Test WS")
    assert e.workspace == "test_ws" and e.progress.elapsed == 0
    first = e.sync()
    assert first.status == "done" and first.chunks_added > 10 and first.changed_or_deleted == 5
    second = e.sync()
    # the empty file has no chunks, so it keeps no hash and is looked at again
    assert (second.chunks_added, second.unchanged, second.changed_or_deleted) == (0, 4, 1)
    ids = [r.chunk_id for r in e.chunks().select("chunk_id").collect()]
    assert len(ids) == len(set(ids))
    assert e.store.table("vectors").count() == len(ids)
    assert {r.chunk_type for r in e.chunks().filter("filepath = 'large.py'").collect()} >= {"function"}
    assert "small.py" in e.smart_search("func_1 alpha token", 3).splitlines()[3]
    assert "phase3" in e.smart_search("func_1", 3)
    found = e.hybrid("big value regex:`big_\\d+\\(`", 30).collect()  # of the 30 fused, those that match
    assert found and all("big_" in r.content for r in found)
    assert "error: invalid regex" in e.smart_search("x", 1, regex="(")
    assert "main.go" not in e.semantic_search("daemon function", 9, language="py")
    assert "small.py" not in e.semantic_search("daemon function", 9, language="go")
    assert "no results" in e.semantic_search("daemon", 5, language="rb")
    assert "no results" in e.semantic_search("daemon", 5, filepath="small.py", language="go")
    assert "access denied" in e.read_full_file("../etc/passwd")
    assert e.read_full_file("main.go").startswith("1 | package main") and "not found" in e.read_full_file("nope.py")
    (tree / "small.py").write_text("def func_2():\n    return 'beta'\n")
    (tree / "main.go").unlink()
    third = e.sync()
    assert third.chunks_added == 1 and third.changed_or_deleted == 3
    assert e.chunks().filter("filepath = 'main.go'").count() == 0
    other = SearchEngine(spark, tmp_path / "store", str(tree), "other")
    assert other.chunks().count() == 0
    paths = spark.createDataFrame([("large.py",)], "filepath string")
    (tree / "large.py").unlink()
    assert e.sync_paths(paths, paths.limit(0)).changed_or_deleted == 1
    assert e.chunks().select("filepath").distinct().count() == 2
    answers = io.StringIO()
    lines = [{"id": 1, "tool": "get_sync_status"}, {"id": 2, "tool": "read_full_file", "arguments": {"filepath": "small.py"}}, {"id": 3, "tool": "nope"}]
    service.serve(e, io.StringIO("\n".join(map(json.dumps, lines)) + "\n\nbroken\n"), answers)
    got = [json.loads(x) for x in answers.getvalue().splitlines()]
    assert json.loads(got[0]["result"])["status"] == "done" and "func_2" in got[1]["result"] and "error" in got[2] and "error" in got[3]


def test_progress_is_live():
    p = SyncStatus(started=1.0)
    assert p.elapsed > 1 and SyncStatus(started=1.0, finished=3.0).elapsed == 2


def test_roots(tmp_path):
    env = {"PROJECT_ROOT": str(tmp_path), "X": str(tmp_path)}
    assert workspace.resolve_root(None, env) == tmp_path
    assert workspace.resolve_root("${X}", env) == tmp_path and workspace.resolve_root("%X%", env) == tmp_path
    (tmp_path / "w").mkdir()
    assert workspace.resolve_root(None, env | {"WORKSPACE_PATH": str(tmp_path / "w")}) == tmp_path / "w"
    with pytest.raises(ValueError):
        workspace.resolve_root("${workspaceFolder}", {})
    with pytest.raises(NotADirectoryError):
        workspace.resolve_root(str(tmp_path / "none"), {})


def test_settings(tmp_path, monkeypatch):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"model_key": "hash-1024", "other": 1}))
    s = config.load_settings(path)
    assert s.embedder == "hash-1024" and s.extra == {"other": 1}
    config.save_settings(s, path)
    assert config.load_settings(path) .embedder == "hash-1024"
    path.write_text("{")
    assert config.load_settings(path) == config.Settings()
    monkeypatch.setenv("SIFTWELL_DENSE_K", "0")
    monkeypatch.setenv("SIFTWELL_REGEX_CASE_SENSITIVE", "yes")
    k = config.Knobs.resolve(config.PROFILES["precise"])
    assert (k.dense_k, k.rerank_most, k.ms_per_doc, k.regex_case_sensitive) == (1, 12, 280, True)
    assert k.candidates(1) == 10 and k.candidates(4) == 12 and k.candidates(40) == 40
    with pytest.raises(KeyError):
        config.resolve_model("overlap", "embedder")
    assert config.resolve_model("org/x-4b", "embedder").billions == 4


def test_command_line(capsys, tmp_path, monkeypatch):
    monkeypatch.setenv("SIFTWELL_CONFIG", str(tmp_path / "c.json"))
    assert cli.main(["version"]) == 0 and cli.main(["model", "set", "hash-1024"]) == 0
    cli.main(["model", "current"])
    cli.main(["profile", "set", "fast"])
    cli.main(["profile", "current"])
    cli.main(["info"])
    cli.main(["reranker", "ls"])
    out = capsys.readouterr().out
    assert "hash-1024" in out and "fast" in out and "neutral" in out
