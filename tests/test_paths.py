import pytest
from pyspark.sql import functions as F

from siftwell.operators import paths
from siftwell.sources.gitignore import IgnoreRules

INDEXED = [
    "src/core/integration/swpulsa/datasource_product.go", "src/core/integration/host/datasource_product.go",
    "src/core/integration/host/host.go", "src/controllers/product.go", "main.py",
]


def resolve(spark, wanted):
    df = spark.createDataFrame([(p,) for p in [*INDEXED, *INDEXED, None, ""]], "filepath string")
    return sorted(r[0] for r in paths.resolve_paths(df, wanted).collect())


def test_prefixed_path_is_exact(spark):
    assert resolve(spark, "gateway/src/core/integration/swpulsa/datasource_product.go") == [INDEXED[0]]


def test_name_and_folder(spark):
    assert resolve(spark, "host.go") == [INDEXED[2]]
    assert resolve(spark, "src/core/integration") == sorted(INDEXED[:3])
    assert resolve(spark, "datasource_product.go") == sorted(INDEXED[:2])
    assert resolve(spark, "src/main.py") == []
    assert resolve(spark, "nothing/here.go") == []


def test_lexical_predicate(spark):
    df = spark.createDataFrame([(p,) for p in INDEXED], "filepath string")
    only = lambda x: [r[0] for r in df.filter(paths.lexical_path_predicate(x)).collect()]
    assert only("swpulsa/datasource_product.go") == [INDEXED[0]]
    assert len(only("core/integration")) == 3 and len(only(None)) == 5


def test_normalise_and_guards(tmp_path):
    assert paths.normalise_path("  ") is None and paths.normalise_path("./a\\b/") == "a/b"
    assert paths.normalise_path(str(tmp_path / "x"), str(tmp_path)) == "x"
    assert paths.normalise_path(str(tmp_path), str(tmp_path)) == ""
    with pytest.raises(PermissionError):
        paths.inside(tmp_path, "../etc/passwd")
    sibling = tmp_path.parent / (tmp_path.name + "2")
    sibling.mkdir()
    with pytest.raises(PermissionError):
        paths.inside(tmp_path, str(sibling / "f"))
    with pytest.raises(PermissionError):
        paths.check_root("/")
    with pytest.raises(NotADirectoryError):
        paths.check_root(tmp_path / "missing")


def test_event_paths(spark):
    df = spark.createDataFrame([("a/node_modules/x.js",), ("a/b.py",), ("../x",), ("/abs",), ("",), (None,)], "p string")
    assert [r[0] for r in df.select(paths.ignored_event_path(F.col("p"))).collect()][:2] == [True, False]
    assert [r[0] for r in df.select(paths.safe_relative_col(F.col("p"))).collect()] == [True, True, False, False, False, False]


@pytest.mark.parametrize(
    "rules,path,folder,ignored",
    [
        (["ignored_dir/"], "ignored_dir/secret.py", False, True), (["*.log"], "a/b.log", False, True), (["*.log", "!keep.log"], "keep.log", False, False),
        (["/top.txt"], "sub/top.txt", False, False), (["/top.txt"], "top.txt", False, True), (["a/**/z"], "a/b/c/z", False, True),
        (["build/"], "build", False, False), (["build/"], "build", True, True), (["# c", ""], "c", False, False), (["x[0-9].py"], "d/x3.py", False, True),
        (["doc/*.txt"], "doc/sub/a.txt", False, False), (["\\#name"], "#name", False, True),
    ],
)
def test_ignore_rules(rules, path, folder, ignored):
    assert IgnoreRules(rules).ignores(path, folder) is ignored
