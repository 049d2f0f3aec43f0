import hashlib

from siftwell.operators import delta
from siftwell.operators.chunking import chunk_file

CHUNK = "workspace_id string, filepath string, content string, chunk_type string, start_line int, end_line int"


def test_cut_files_are_compared(spark):
    body = "import os\n\n\n" + "".join(f"def f{i}(x):\n    # {'w' * 300}\n    return x + {i}\n\n\n" for i in range(30))
    texts = {"same.py": body, "ends.py": body.rstrip("\n") + "\n", "old.py": body, "new.py": body, "one.py": "x = 1\n", "less.py": "x = 2\n"}
    rows = [("w", p, c[1], c[2], c[3], c[4]) for p, t in texts.items() for c in chunk_file(p, t)]
    assert sum(r[1] == "same.py" for r in rows) > 5 and not any(r[3] == "file" for r in rows if r[1] == "same.py")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    stored = [("w", "same.py", sha(body).upper()), ("w", "ends.py", sha(texts["ends.py"])), ("w", "old.py", sha(body + "y")),
              ("w", "one.py", sha("x = 1\n")), ("w", "less.py", sha("x = 2\n\n")), ("w", "gone.py", sha("z"))]
    chunks = spark.createDataFrame(rows + rows[:3], CHUNK)
    hashes = spark.createDataFrame(stored, "workspace_id string, filepath string, file_hash string")
    got = {r.filepath: r.status for r in delta.classify(delta.hash_chunked(chunks, hashes), hashes).collect()}
    assert got == {"same.py": "unchanged", "ends.py": "unchanged", "old.py": "modified", "new.py": "new", "one.py": "unchanged", "less.py": "modified", "gone.py": "deleted"}
