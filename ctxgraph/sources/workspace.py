"""Source trees as tables: a recursive scan with predicates on the path.

Size and path filters apply to the listing; contents are read where they are
used, through whatever file system the URI names.
"""

from __future__ import annotations

import os
import re
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config

# Languages by extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyi": "python", "rs": "rust",
    "html": "html", "htm": "html", "c": "c", "h": "c", "cpp": "cpp", "cxx": "cpp", "cc": "cpp", "hpp": "cpp", "hxx": "cpp",
}
EXTENSIONS = tuple(LANGUAGES)


def language(path: Column) -> Column:
    """By file name; null if the file is of no known kind."""
    name = F.substring_index(path, "/", -1)
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(name.rlike(r"^\.env(\..*)?$"), F.lit("dotenv")).otherwise(F.element_at(table, F.regexp_extract(name, r"\.([^.]+)$", 1)))


def excluded(path: Column, names=Config().exclude_patterns) -> Column:
    """A component of the path equals one of the names."""
    if not names:
        return F.lit(False)
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def relative(path: Column, root: str, prefix: str = "") -> Column:
    """The path below ``root`` behind ``prefix``, else the whole path."""
    bare = F.regexp_replace(path, r"^file:/*", "/")
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(bare, F.lit(root)), F.concat(F.lit(prefix), F.substring(bare, len(root) + 1, 1 << 30))).otherwise(bare)


LISTED = "path string, is_dir boolean, size_bytes long, mtime_ns long"


def listing(spark: SparkSession, root: str, config: Config = Config()) -> DataFrame:
    """(path, size_bytes, mtime_ns) of all files under ``root``.

    Folders are listed level by level, in tasks; excluded ones are not entered
    and links not followed.  (Spark's own file sources pass over names that
    begin with a dot or an underscore, which source trees are full of.)"""
    from ..plans.scratch import keep

    names = set(config.exclude_patterns)

    def run(batches):
        for batch in batches:
            rows = []
            for folder in batch.column(0).to_pylist():
                where, base = fs.FileSystem.from_uri(folder)
                scheme = folder[: len(folder) - len(base)] if folder.endswith(base) else ""
                for f in where.get_file_info(fs.FileSelector(base)):
                    if f.base_name in names or (scheme in ("", "file://") and os.path.islink(f.path)):
                        continue
                    rows.append((scheme + f.path, f.type == fs.FileType.Directory, f.size or 0, f.mtime_ns or 0))
            kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "is_dir", "size_bytes", "mtime_ns"])

    level, out = spark.createDataFrame([(root,)], "path string"), None
    while True:
        got = keep(level.mapInArrow(run, LISTED), "listing")
        files = got.where("NOT is_dir").drop("is_dir")
        out = files if out is None else out.unionByName(files)
        level = got.where("is_dir").select("path")
        if level.isEmpty():
            return out
        level = level.repartition("path")


def known(spark: SparkSession, root: str, config: Config = Config(), extra: dict[str, str] | None = None) -> DataFrame:
    """(path, language, mtime_ns, size_bytes, uri) of the known files under
    ``root`` and extra roots (prefix -> folder)."""
    out = None
    for prefix, folder in {"": root, **{k + "/": v for k, v in (extra or {}).items()}}.items():
        folder = "file://" + str(Path(folder).resolve()) if "://" not in folder else folder
        part = listing(spark, folder, config).where(F.col("size_bytes") <= config.max_file_size)
        cut = len(folder.rstrip("/")) + 2
        part = part.withColumns({"uri": F.col("path"), "path": F.concat(F.lit(prefix), F.substring("path", cut, 1 << 30))})
        part = part.withColumn("language", language(F.col("path"))).where("language IS NOT NULL")
        out = part if out is None else out.unionByName(part)
    return out.select("path", "language", "mtime_ns", "size_bytes", "uri")


def read(files: DataFrame) -> DataFrame:
    """``known`` files with their contents instead of the address."""

    def run(batches):
        for batch in batches:
            content = []
            for uri in batch.column("uri").to_pylist():
                where, base = fs.FileSystem.from_uri(uri)
                with where.open_input_stream(base, compression=None) as f:
                    content.append(f.read().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "language", "mtime_ns", "size_bytes")), pa.array(content, pa.string())], names=["path", "language", "mtime_ns", "size_bytes", "content"])

    return files.mapInArrow(run, "path string, language string, mtime_ns long, size_bytes long, content string")


def scan(spark: SparkSession, root: str, config: Config = Config(), extra: dict[str, str] | None = None) -> DataFrame:
    """All known files with contents, which are read in the tasks that use them."""
    return read(known(spark, root, config, extra))


def fingerprint(files: DataFrame) -> str:
    """Of all (path, mtime), in any order: counts and sums, no gathering."""
    h = F.xxhash64("path", "mtime_ns")
    r = files.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return f"{r[0]}-{r[1] or 0}-{r[2] or 0}"


def submodules(root: str | Path) -> list[str]:
    """Paths in ``.gitmodules`` whose folder exists."""
    file = Path(root) / ".gitmodules"
    if not file.exists():
        return []
    found = re.findall(r"(?m)^\s*path\s*=\s*(.+?)\s*$", file.read_text())
    return [str(Path(root) / p) for p in found if (Path(root) / p).is_dir()]


def extra_roots(root: str | Path, others) -> list[str]:
    """Resolved roots that do not lie under the main one, once each."""
    main = Path(root).resolve()
    out: list[str] = []
    for o in others:
        p = Path(o).resolve()
        if p.is_dir() and p != main and main not in p.parents and str(p) not in out:
            out.append(str(p))
    return out


def inside(root: str | Path, path: str) -> Path:
    """the path below the root; an error if it leads out."""
    main = Path(root).resolve()
    full = (main / path).resolve()
    if full != main and main not in full.parents:
        raise ValueError(f"{path!r} is outside the workspace")
    return full
