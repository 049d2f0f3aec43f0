from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.llm.files import assemble, file_texts, suffix_of
from siftwell.operators.chunking import chunk_file

CHUNK = "workspace_id string, chunk_id string, filepath string, content string, chunk_type string, start_line int, end_line int, language string"


@given(st.lists(st.sampled_from(["", "x = 1", "    y = 'a b'", "def f():", "    return 1", "class A:", "# " + "w" * 300, "é\u2028x"]), max_size=400), st.randoms())
@settings(max_examples=60, deadline=None)
def test_chunks_make_the_file_again(lines, random):
    text = "\n".join(lines) + "\n"
    chunks = [(c[3], c[4], c[1]) for c in chunk_file("a.py", text)] * 2
    random.shuffle(chunks)
    got = assemble(*map(list, zip(*chunks))) if chunks else ""
    # blank stretches at the ends are in no chunk
    assert got.rstrip() == text.rstrip() or not text.strip()


def test_suffixes():
    assert [suffix_of(p) for p in ("a/b.PY", "a.b/c", ".env", "x.tar.gz")] == ["py", "", "env", "gz"]


def test_frames(spark):
    rows = [("w", "1", "a.py", "x\n", "code_block", 1, 1, "py"), ("w", "1", "a.py", "x\n", "code_block", 1, 1, "py"), ("w", "2", "a.py", "y\n", "code_block", 4, 4, None),
            (None, "3", "b", None, "file", None, None, None), ("w", "4", None, "z", "file", 1, 1, "")]
    df = spark.createDataFrame(rows, CHUNK).selectExpr("*", "'clash' AS text", "'clash' AS parts")
    assert {(r.workspace_id, r.filepath): r.text for r in file_texts(df).collect()} == {("w", "a.py"): "x\n\n\ny\n", (None, "b"): ""}
    assert file_texts(df.limit(0)).count() == 0


def test_hot_file_of_repeats(spark):
    df = spark.range(20_000).selectExpr("'w' AS workspace_id", "'h.py' AS filepath", "'x = 1' AS content", "1 AS start_line", "1 AS end_line")
    assert [r.text for r in file_texts(df).collect()] == ["x = 1"]
