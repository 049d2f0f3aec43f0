"""Files put together from their chunks; see ``siftwell.operators.whole``."""

from siftwell.operators.whole import assemble, count_lines, file_chunks, file_texts, map_files, suffix_of

__all__ = ["assemble", "count_lines", "file_chunks", "file_texts", "map_files", "suffix_of"]
