"""The engine: keeps a workspace in step with its files and answers searches.

A search is one lazy plan: vector and lexical retrieval, fusion, the regular expression on what was fused, the
reranker on the head. Texts are joined only to the few rows that are left.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.config import Knobs
from siftwell.functions.ids import workspace_id
from siftwell.functions.text import (
    fence_name, number_lines, path_terms, quality_warning, query_tokens, skip_rerank, split_query_and_regex,
)
from siftwell.operators import chunking, delta, dense, embed, fusion, paths, rerank, sparse
from siftwell.operators.store import SnapshotStore, delete
from siftwell.schemas import CHUNKS
from siftwell.session import broadcast_if_small
from siftwell.sources.tree import read_tree


#: Paths of one batch of events up to which they are broadcast; more are joined with a shuffle.
MAX_BROADCAST_PATHS = 100_000


@dataclass
class SyncStatus:
    """State of the last sync."""

    status: str = "idle"  # scanning, deleting, processing, done, error
    files: int = 0
    chunks_added: int = 0
    unchanged: int = 0
    changed_or_deleted: int = 0
    failed: int = 0
    started: float = 0.0
    finished: float | None = None
    error: str | None = None

    @property
    def elapsed(self) -> float:
        """Seconds so far, or of the whole run once it has ended."""
        return ((self.finished or time.time()) - self.started) if self.started else 0.0

    def as_json(self) -> str:
        return json.dumps(asdict(self) | {"elapsed": round(self.elapsed, 3)}, sort_keys=True)


class SearchEngine:
    def __init__(
        self, spark: SparkSession, store_path: str, root: str | None = None, workspace: str | None = None,
        make_embedder=embed.HashEmbedder, make_reranker=rerank.OverlapReranker, knobs: Knobs | None = None,
    ):
        self.spark = spark
        self.store = SnapshotStore(spark, store_path)
        self.root = str(Path(root).expanduser().resolve()) if root else None
        self.workspace = workspace_id(self.root or ".", workspace)
        self.make_embedder, self.make_reranker = make_embedder, make_reranker
        self.knobs = knobs or Knobs.resolve()
        self.progress = SyncStatus()

    # keeping in step
    def sync(self, directory: str | None = None) -> SyncStatus:
        """Full sync of the tree, or of one folder in it."""
        if directory:
            paths.inside(self.root, directory)
        files = read_tree(self.spark, self.root, self.workspace)
        scope = None
        if directory:
            inner = paths.inside(self.root, directory).relative_to(self.root).as_posix()
            if inner != ".":
                scope = F.col("filepath").startswith(inner + "/")
        return self.sync_files(files if scope is None else files.filter(scope), scope)

    def sync_paths(self, touched: DataFrame, deleted: DataFrame) -> SyncStatus:
        """Sync of the paths (filepath) that a watch reports; the tree's own rules apply to them, and touched files that are
        no longer indexable count as deleted."""
        named = touched.select("filepath").unionByName(deleted.select("filepath")).distinct()
        small = broadcast_if_small(named, MAX_BROADCAST_PATHS)
        files = read_tree(self.spark, self.root, self.workspace).join(small, "filepath", "left_semi")
        return self.sync_files(files, keys=named)

    def sync_files(self, files: DataFrame, scope=None, keys: DataFrame | None = None) -> SyncStatus:
        """Brings the snapshot in step with ``files`` (workspace_id, filepath, content): chunks and vectors of changed and
        deleted files go, those of new and changed ones come, all tables in one commit. A file without chunks keeps no
        hash, so it is looked at again."""
        p = self.progress = SyncStatus("scanning", started=time.time())
        try:
            mine = F.col("workspace_id") == self.workspace
            stored = self.store.table("file_hashes").filter(mine)
            if scope is not None:
                stored = stored.filter(scope)
            if keys is not None:
                stored = stored.join(keys, "filepath", "left_semi")
            files = files.persist()
            changes = delta.classify(delta.hash_files(files), stored).persist()
            counts = {r.status: r.n for r in changes.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
            p.files = sum(n for s, n in counts.items() if s != "deleted")
            p.unchanged = counts.get("unchanged", 0)
            p.changed_or_deleted = sum(n for s, n in counts.items() if s != "unchanged")
            if p.changed_or_deleted:
                p.status = "deleting"
                gone = delta.to_replace(changes)
                key = ["workspace_id", "filepath"]
                kept = delete(self.store.table("chunks"), gone, key)
                live = changes.filter(F.col("status").isin("new", "modified")).select(*key, "current_hash")
                p.status = "processing"
                failed = self.spark.sparkContext.accumulator(0)
                new = chunking.chunk_files(files.join(live, key, "left_semi"), failed).persist()
                p.chunks_added, p.failed = new.count(), failed.value
                lost = delete(self.store.table("chunks"), kept, ["workspace_id", "chunk_id"]).select("workspace_id", "chunk_id")
                pair = ["workspace_id", "chunk_id"]
                hashes = live.join(new.select(*key).distinct(), key, "left_semi").withColumnRenamed("current_hash", "file_hash")
                self.store.commit(
                    chunks=kept.unionByName(new),
                    vectors=delete(self.store.table("vectors"), lost, pair).unionByName(embed.embed_chunks(new, self.make_embedder)),
                    postings=delete(self.store.table("postings"), lost, pair).unionByName(sparse.build_postings(new)),
                    file_hashes=delete(self.store.table("file_hashes"), gone, key).unionByName(hashes),
                )
                new.unpersist()
            changes.unpersist()
            files.unpersist()
            p.status = "done"
        except Exception as e:
            p.status, p.error = "error", str(e)
            raise
        finally:
            p.finished = time.time()
        return p

    def rebuild_postings(self) -> None:
        """Postings of all chunks, where an index is missing."""
        if not self.store.table("postings").limit(1).count():
            self.store.commit(postings=sparse.build_postings(self.store.table("chunks")))

    def chunks(self) -> DataFrame:
        return self.store.table("chunks").filter(F.col("workspace_id") == self.workspace)

    # retrieval
    def _scope(self, path: str | None, language: str | None = None) -> DataFrame | None:
        """(chunk_id) of the chunks that the filters leave, None without a filter; however many files a path means."""
        wanted = paths.normalise_path(path, self.root)
        if not wanted and not language:
            return None
        chunks = self.chunks()
        if wanted:
            chunks = chunks.join(paths.resolve_paths(self.chunks(), wanted), "filepath", "left_semi")
        if language:
            chunks = chunks.filter(paths.metadata_predicate(language=language))
        return chunks.select("chunk_id")

    def dense(self, query: str, k: int, scope: DataFrame | None = None) -> DataFrame:
        vector = embed.embed_text(self.make_embedder(), query)
        vectors = self.store.table("vectors").filter(F.col("workspace_id") == self.workspace)
        if scope is not None:
            vectors = vectors.join(scope, "chunk_id", "left_semi")
        return dense.top_k(vectors, vector or [0.0], k, "chunk_id")

    def sparse(self, query: str, k: int, scope: DataFrame | None = None) -> DataFrame:
        """Ids with scores: BM25 from the index, path and content matches from the chunks."""
        tokens = query_tokens(query)
        chunks = self.chunks().select("chunk_id", "filepath", "language", "content")
        by_words = sparse.bm25_from_postings(self.store.table("postings"), tokens, self.workspace)
        if scope is not None:
            by_words, chunks = by_words.join(scope, "chunk_id", "left_semi"), chunks.join(scope, "chunk_id", "left_semi")
        by_words = by_words.orderBy("bm25_score", "chunk_id").limit(k).withColumn("__o", F.lit(0))
        by_path = sparse.lexical_top_k(chunks, path_terms(tokens), k, "chunk_id", "filepath", "content")
        both = by_words.unionByName(by_path.select("chunk_id", "bm25_score", F.lit(1).alias("__o")))
        best = both.groupBy("chunk_id").agg(F.min("bm25_score").alias("bm25_score")).orderBy("bm25_score", "chunk_id").limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy("bm25_score", "chunk_id")))

    def _with_texts(self, hits: DataFrame) -> DataFrame:
        return self.chunks().dropDuplicates(["chunk_id"]).join(F.broadcast(hits), "chunk_id")  # hits are a top-k list

    def hybrid(self, query: str, n: int = 5, filepath: str | None = None, regex: str | None = None, reranked: bool = True) -> DataFrame:
        """The plan of ``smart_search``: n rows with texts, scores and ``final_rank``."""
        words, pattern, _ = split_query_and_regex(query, regex)
        k = self.knobs
        self.rebuild_postings()
        scope = self._scope(filepath)
        fused = fusion.rrf(self.dense(words, k.dense_k, scope), self.sparse(words, k.sparse_k, scope), k.recall_k, "chunk_id", k.rrf_k)
        hits = self._with_texts(fused)
        if pattern:
            hits = fusion.regex_filter(hits, pattern, "content", k.regex_case_sensitive)
        head = rerank.head_size(k.recall_k, n, k.rerank_most) if reranked else 0
        score = rerank.score_column(words, F.col("content"), self.make_reranker, rerank.budget_ms(head)) if head else F.lit(None).cast("double")
        ranked = hits.withColumn("fused_rank", F.row_number().over(Window.orderBy("fused_rank")))
        return fusion.order_reranked(ranked, head, score).orderBy("final_rank").limit(max(1, n))

    def semantic(self, query: str, n: int = 5, filepath: str | None = None, language: str | None = None) -> DataFrame:
        """The plan of ``semantic_search``."""
        k = self.knobs.candidates(n)
        hits = self._with_texts(self.dense(query, k, self._scope(filepath, language)).withColumnRenamed("rank", "fused_rank"))
        use = not skip_rerank(query)
        enough = F.max("fused_rank").over(Window.partitionBy()) > min(3, k)  # see worth_reranking; at most k rows
        score = F.when(enough, rerank.score_column(query, F.col("content"), self.make_reranker, rerank.budget_ms(k))) if use else F.lit(None).cast("double")
        return fusion.order_reranked(hits, k if use else 0, score).orderBy("final_rank").limit(max(1, n))

    # tools that answer in text
    def semantic_search(self, query: str, n: int = 5, filepath: str | None = None, language: str | None = None) -> str:
        if not query.strip():
            return "error: empty query"
        rows = self.semantic(query, n, filepath, language).collect()
        if not rows:
            warning = quality_warning(query, None)
            return "\n".join(x for x in (warning, f"no results for {query!r}" + (f" in {filepath}" if filepath else "")) if x)
        return render(rows, "score")

    def smart_search(self, query: str, n: int = 5, filepath: str | None = None, regex: str | None = None) -> str:
        if not query.strip():
            return "error: empty query"
        words, pattern, source = split_query_and_regex(query, regex)
        if pattern:
            try:
                fusion.check_pattern(pattern)
            except ValueError as e:
                return f"error: {e}"
        note = "reranked"
        try:
            rows = self.hybrid(query, n, filepath, regex).collect()
        except Exception as e:  # a failing reranker must not lose the results
            if not rerank.is_failure(e):
                raise
            rows, note = self.hybrid(query, n, filepath, regex, reranked=False).collect(), "reranker failed, fused order"
        header = [
            f"phase1: dense {self.knobs.dense_k} + sparse {self.knobs.sparse_k}, rrf k={self.knobs.rrf_k}",
            f"phase2: regex {pattern!r} ({source})" if pattern else "phase2: no regex",
            f"phase3: {note}, {len(rows)} of {n}",
        ]
        warning = quality_warning(words, 0 if not any(r.bm25_score is not None for r in rows) else None)
        body = render(rows, "hybrid_score") if rows else f"no results for {words!r}"
        return "\n".join([*header, *([warning] if warning else []), body])

    def read_full_file(self, filepath: str) -> str:
        """A file's text with line numbers."""
        try:
            target = paths.inside(self.root, filepath)
        except PermissionError:
            return f"error: access denied: {filepath} is outside of the workspace"
        if not target.is_file():
            return f"error: file not found: {filepath}"
        return number_lines(target.read_text(encoding="utf-8", errors="replace"))

    def get_sync_status(self) -> str:
        return self.progress.as_json()


def render(rows: list, score: str) -> str:
    """Results as text: a line each with rank, score and place, and the code in a fence."""
    out = []
    for i, r in enumerate(rows, 1):
        value = r.rerank_score if r.rerank_score is not None else r[score]
        head = f"[{i}] score={value:.4f} | {r.filepath}:{r.start_line}-{r.end_line} ({r.chunk_type})"
        out.append(f"{head}\n```{fence_name(r.filepath)}\n{r.content.rstrip()}\n```")
    return "\n\n".join(out)


CHUNK_COLUMNS = [f.name for f in CHUNKS]
