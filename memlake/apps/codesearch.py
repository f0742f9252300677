"""Chunked search over files."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cache_key  # noqa: F401  (same digest for file contents)
from ..operators import knn
from .embed import get_embedder

#: File endings by language (fixed values).
LANGUAGES = {
    "rust": [".rs"],
    "python": [".py"],
    "javascript": [".js", ".jsx", ".mjs"],
    "typescript": [".ts", ".tsx"],
    "go": [".go"],
    "java": [".java"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".hpp", ".cc", ".hh", ".cxx"],
    "csharp": [".cs"],
    "ruby": [".rb"],
    "php": [".php"],
    "swift": [".swift"],
    "kotlin": [".kt", ".kts"],
    "scala": [".scala"],
    "shell": [".sh", ".bash", ".zsh"],
    "sql": [".sql"],
    "html": [".html", ".htm"],
    "css": [".css", ".scss", ".sass", ".less"],
    "yaml": [".yaml", ".yml"],
    "json": [".json"],
    "markdown": [".md", ".markdown"],
    "toml": [".toml"],
}
#: Languages that are indexed where none are named (fixed values).
COMMON = ["rust", "python", "javascript", "typescript", "go", "java", "c", "cpp"]
#: Folders that are not walked (fixed values); one is a pattern.
SKIP = [
    ".git", ".svn", ".hg", "node_modules", "target", "__pycache__", ".venv", "venv", "env", ".env", "dist", "build", ".next", ".nuxt", "vendor", ".cache",
    ".tox", ".pytest_cache", ".mypy_cache", "coverage", ".coverage", ".idea", ".vscode", "*.egg-info",
]
WINDOW, OVERLAP, LEAST = 50, 10, 20


def chunk_lines(docs: DataFrame, text: str = "text", size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Add ``start_line`` (from 1), ``end_line`` and ``content`` of each window of lines; windows with
    20 characters or less besides white space at their ends are left out, as are null texts."""
    step = max(1, size - overlap)
    lines = docs.where(F.col(text).isNotNull()).withColumn("_lines", F.split(text, "\n"))
    starts = F.sequence(F.lit(0), F.size("_lines") - 1, F.lit(step))
    out = lines.withColumn("_s", F.explode(starts)).withColumn("content", F.array_join(F.slice("_lines", F.col("_s") + 1, F.lit(size)), "\n"))
    out = out.withColumn("start_line", (F.col("_s") + 1).cast("long")).withColumn("end_line", F.least(F.col("_s") + size, F.size("_lines")).cast("long"))
    return out.where(F.length(F.btrim("content", F.lit(" \t\n\r"))) > LEAST).drop("_lines", "_s")


def endings(languages: Sequence[str] | None = None) -> list[str]:
    """File endings of languages, by name or as endings themselves; unknown names give none."""
    named = [x.lower() for x in languages or COMMON]
    return sorted({e for x in named for e in ([x] if x.startswith(".") else LANGUAGES.get(x, []))})


def language(path: Column) -> Column:
    """The language of a file's ending in any case, null for others."""
    by_end = F.create_map(*[F.lit(x) for lang, ends in LANGUAGES.items() for e in ends for x in (e, lang)])
    return by_end[F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))]


def files(spark, root: str, languages: Sequence[str] | None = None) -> DataFrame:
    """``path, text, language`` of the files of some languages (common ones) below a folder."""
    raw = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    hidden = "/(" + "|".join(re.escape(s).replace(r"\*", "[^/]*") for s in SKIP) + ")/"
    below = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split("/")[-1]) + "/", "/")
    end = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return raw.where(end.isin(*endings(languages)) & ~below.rlike(hidden)).withColumn("language", language(F.col("path")))


def chunks(source: DataFrame, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """``id, path, start_line, end_line, content, language``; an id is path, line and the content's hash."""
    got = chunk_lines(source, "text", size, overlap)
    return got.select(F.concat_ws(":", "path", F.col("start_line").cast("string"), F.substring(F.sha2(F.col("content").cast("binary"), 256), 1, 8)).alias("id"), "path", "start_line", "end_line", "content", "language")


def best_of(scored: DataFrame, keys: Sequence[str], score: str, tie: str) -> DataFrame:
    """Each key's best row."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


class CodeIndex:
    """Index and search of a folder's files in a collection of a database."""

    def __init__(self, database, name: str = "code", embedder=None):
        self.database, self.embedder, self.name = database, get_embedder(embedder), name
        self.collection = database.collection(name, self.embedder.dimension, "cosine")

    def index(self, root: str, languages: Sequence[str] | None = None, progress=None) -> dict[str, int]:
        """Add the chunks of a folder; ``files, chunks, skipped, errors``. ``progress(path, number, of)`` is
        called for each file in order once its chunks are in; files that aren't UTF-8 count as errors."""
        source = files(self.database.spark, root, languages).withColumn("_bad", ~F.is_valid_utf8("text")).persist()
        broken = source.where("_bad").count()
        every, source = source, source.where("not _bad").drop("_bad")
        got = chunks(source).persist()
        meta = F.to_json(F.struct(F.col("path").alias("file"), "start_line", "end_line", "language", "content"))
        rows = got.select("id", self.embedder.column(F.col("content")).alias("vector"), meta.alias("metadata"))
        self.collection.upsert_frame(rows)
        n = {"files": source.count(), "chunks": got.count(), "skipped": source.join(got.select("path").distinct(), "path", "left_anti").count(), "errors": broken}
        if progress:
            for k, r in enumerate(source.select("path").orderBy("path").toLocalIterator(), 1):
                progress(r["path"], k, n["files"])
        got.unpersist()
        every.unpersist()
        return n

    def search(self, text: str, k: int = 10, threshold: float = 0.0) -> DataFrame:
        """``file, start_line, score, content``: k best chunks over the threshold, each place once."""
        found = knn.search(self.collection.rows(), self.embedder.embed_single(text), k).where(F.col("score") >= threshold)
        get = lambda k: F.get_json_object("metadata", f"$.{k}")
        rows = found.select("id", get("file").alias("file"), get("start_line").cast("long").alias("start_line"), "score", get("content").alias("content"))
        return best_of(rows, ["file", "start_line"], "score", "id").drop("id").orderBy(F.desc("score"), "file", "start_line")

    def stats(self) -> DataFrame:
        """``language, files, chunks`` of what is indexed."""
        get = lambda k: F.get_json_object("metadata", f"$.{k}")
        return self.collection.rows().groupBy(get("language").alias("language")).agg(F.countDistinct(get("file")).alias("files"), F.count("*").alias("chunks"))

    def clear(self) -> None:
        self.database.drop_collection(self.name)
        self.collection = self.database.collection(self.name, self.embedder.dimension, "cosine")
