import ast
import hashlib

from siftwell.operators import chunking
from siftwell.schemas import CHUNKS


def python_file(n=200):
    return "import os\n\n" + "\n".join(f"def func_{i}(a):\n    return a + {i}\n" for i in range(n)) + "\n\nclass K:\n    x = 1\n\n    def m(self):\n        return 1\n\n    y = 2\n"


def test_short_and_blank_files():
    assert chunking.chunk_file("a.py", "  \n") == []
    (c,) = chunking.chunk_file("a.py", "x = 1\n")
    assert c[0] == hashlib.md5(b"a.py:file").hexdigest() and c[2:5] == ("file", 1, 1)


def test_python_definitions():
    text = python_file()
    got = chunking.chunk_file("p/large.py", text)
    kinds = [c[2] for c in got]
    assert kinds.count("function") == 200 and kinds.count("class") == 1 and kinds.count("method") == 1
    method = next(c for c in got if c[2] == "method")
    assert method[1].startswith("# Class: K\n    def m") and method[6] == "K"
    assert method[0] == hashlib.md5(f"p/large.py:method:K:m:{method[3]}".encode()).hexdigest()
    assert len({c[0] for c in got}) == len(got)
    lines = text.splitlines()
    covered = {n for c in got for n in range(c[3], c[4] + 1)}
    assert all(not lines[n - 1].strip() for n in range(1, len(lines) + 1) if n not in covered)
    ast.parse(next(c for c in got if c[2] == "class")[1])


def test_broken_python_falls_back():
    text = "def (:\n" * 700
    got = chunking.chunk_file("b.py", text)
    assert {c[2] for c in got} == {"code_block"} and "".join(c[1] for c in got) == text
    assert all(len(c[1]) <= 4000 for c in got)


def test_go_declarations():
    body = "\n".join(f"// F{i} {{ brace in a comment\nfunc F{i}(a int) (int, error) {{\n\ts := \"}}\"\n\treturn a, nil\n}}\n" for i in range(60))
    text = "package x\n\nimport (\n\t\"fmt\"\n)\n\ntype T struct {\n\tA int\n}\n\nfunc (t *T) M() {\n}\n\n" + body
    got = chunking.chunk_file("x.go", text)
    kinds = [c[2] for c in got]
    assert kinds.count("function_declaration") == 60 and kinds.count("method_declaration") == 1 and kinds.count("type_declaration") == 1
    assert next(c for c in got if c[2] == "method_declaration")[5] == "M"


def test_long_line_is_kept():
    got = chunking.chunk_file("x.txt", "a" * 9000 + "\nb\n" + "c" * 9000)
    assert [len(c[1]) for c in got] == [9001, 2, 9000]


def test_frames(spark):
    rows = [("w", "a.py", python_file().encode()), ("w", "bad.bin", b"\xff\xfe ok"), ("w", "empty", b""), ("w", None, b"x"), (None, "n.txt", None)]
    df = spark.createDataFrame(rows, "workspace_id string, filepath string, content binary").withColumn("name", chunking.F.lit("clash"))
    out = chunking.chunk_files(df)
    assert out.schema.names == CHUNKS.names
    got = out.collect()
    assert {r.filepath for r in got} == {"a.py", "bad.bin"}
    assert "\ufffd" in next(r.content for r in got if r.filepath == "bad.bin")
    assert chunking.chunk_files(df.limit(0)).count() == 0


def test_block_fold_equals_python(spark):
    texts = ["", "a\n", "x" * 5000 + "\n" + "y\n" * 3000, "no newline at end " * 500, "\n" * 9000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: [(b.start_line, b.end_line, b.chars) for b in r.b] for r in df.select("i", chunking.block_spans_col("text").alias("b")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [(c[3], c[4], len(c[1])) for c in chunking._blocks("f", t.splitlines(keepends=True))]


def test_table_function(spark):
    chunking.register(spark)
    assert spark.sql("SELECT chunk_type, start_line FROM chunk_file('a.txt', 'hello')").collect()[0].chunk_type == "file"
