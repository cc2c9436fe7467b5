"""Archive expansion (SRC-2, UDF-4): ZIP archives -> member rows.

The only Python-worker step of the library: ``binaryFile`` gives one row per
archive (path + bytes), ``mapInPandas`` opens each archive with the standard
``zipfile`` module and yields one row per member.  One archive is one task's
input (``binaryFile`` rows are capped at 2 GB), so the members are
repartitioned afterwards when they feed heavier steps.
"""

from __future__ import annotations

import io
import sys
import zipfile

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The task-side functions below travel to the Python workers by value, so
# executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEMBER_SCHEMA = "archive string, member string, basename string, is_dir boolean, size long, content binary, error string"

# Member suffixes extracted (case-insensitive); the legacy
# page kept ``.xls`` only.
EXTRACT_SUFFIXES = (".xls", ".xlsx")
LEGACY_SUFFIXES = (".xls",)


# Members handed to Spark together: up to this many, or this many unpacked bytes.
BATCH_MEMBERS = 1024
BATCH_BYTES = 4 * 1024 * 1024
_COLUMNS = ["archive", "member", "basename", "is_dir", "size", "content", "error"]


def _expand(batches):
    """Frames of members: small members travel together, a large one with the few
    before it, so what is unpacked at a time stays bounded."""
    rows, held = [], 0
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            for row in _members_of(path.rsplit("/", 1)[-1], content):
                rows.append(row)
                held += row[4] or 0
                if len(rows) >= BATCH_MEMBERS or held >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=_COLUMNS, dtype=object)
                    rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=_COLUMNS, dtype=object)


def _row(archive, member, data, error=None):
    is_dir = member is not None and member.endswith("/")
    base = None if member is None else member.rstrip("/").rsplit("/", 1)[-1]
    return archive, member, base, is_dir, None if data is None else len(data), data, error


def _members_of(archive, content):
    """One row for each member, unpacked as it is asked for; a broken archive or
    member is a row that says so."""
    try:
        zf = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        yield _row(archive, None, None, str(e))
        return
    with zf:
        for info in zf.infolist():
            try:
                yield _row(archive, info.filename, b"" if info.filename.endswith("/") else zf.read(info))
            except (zipfile.BadZipFile, zipfile.zlib.error, EOFError) as e:
                yield _row(archive, info.filename, None, str(e))


def read_archives(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """Archives under ``path`` (matching ``glob``) expanded to members."""
    arch = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return expand_archives(arch.select("path", "content"))


def expand_archives(archives: DataFrame) -> DataFrame:
    return archives.mapInPandas(_expand, MEMBER_SCHEMA)


def select_members(members: DataFrame, suffixes=EXTRACT_SUFFIXES) -> DataFrame:
    """SRC-2 filter: files (not folders) whose name ends with a suffix,
    case-insensitive; sub-folders are flattened to the base name."""
    low = F.lower("member")
    cond = None
    for s in suffixes:
        t = low.endswith(s)
        cond = t if cond is None else (cond | t)
    return members.where(~F.col("is_dir") & F.col("error").isNull() & cond).drop("error")


def broken(members: DataFrame) -> DataFrame:
    """Archives and members that could not be read, with the reason."""
    return members.where(F.col("error").isNotNull()).select("archive", "member", "error")


def _write_zip(batches, base: str):
    """Task-side writer used to build archives from table rows: one ZIP per
    archive key and input batch, written through pyarrow's filesystem layer
    (local or a shared cluster filesystem).  File names are deterministic
    (archive key, partition, batch), so a retried task attempt rewrites the
    same files instead of adding copies."""
    import warnings

    from pyarrow import fs
    from pyspark import TaskContext

    ctx = TaskContext.get()
    pid = ctx.partitionId() if ctx is not None else 0
    filesystem, root = fs.FileSystem.from_uri(base)
    filesystem.create_dir(root, recursive=True)
    for n, pdf in enumerate(batches):
        if pdf.empty:
            continue
        buf = io.BytesIO()
        with warnings.catch_warnings(), zipfile.ZipFile(buf, "w", compression=zipfile.ZIP_DEFLATED) as zf:
            warnings.simplefilter("ignore", UserWarning)  # repeated member names are kept, as in real archives
            for member, text in zip(pdf["member"], pdf["text"]):
                if member.endswith("/"):
                    zf.writestr(zipfile.ZipInfo(member), b"")
                else:
                    zf.writestr(member, text.encode("utf-8"))
        name = f"{root}/{pdf['archive'].iloc[0]}-p{pid:05d}-b{n:05d}.zip"
        with filesystem.open_output_stream(name) as out:
            out.write(buf.getvalue())
        yield pd.DataFrame({"zip_path": [name], "n_members": [len(pdf)]})


def write_archives(rows: DataFrame, base_uri: str) -> DataFrame:
    """Write ``archive, member, text`` rows as ZIP files (one per archive key
    and partition) under ``base_uri``; returns the written paths."""
    grouped = rows.repartition("archive").sortWithinPartitions("archive", "member")
    return grouped.mapInPandas(lambda it: _split_write(it, base_uri), "zip_path string, n_members long")


def _split_write(batches, base_uri):
    parts = (part.reset_index(drop=True) for pdf in batches for _, part in pdf.groupby("archive", sort=True))
    yield from _write_zip(parts, base_uri)
