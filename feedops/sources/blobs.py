"""Digests of fetched files of any size (A3, F1). A file has one digest, so one task reads it from end to end; it need not hold it."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedops.functions.media import MIB, content_hash
from feedops.functions.urls import unquote
from feedops.sources.tables import blob_files, read_blobs

# Fixed value: a file up to this size is one row; Spark holds about three copies of it.
WHOLE_BYTES = 32 * MIB
# A codec that changes nothing: Hadoop's way to have files of one ending neither unpacked nor split. Spark's own build of Hadoop renames the option.
_AS_IT_IS = {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec"}
_ENDING_OPTIONS = ("io.compress.passthrough.extension", "org.apache.hadoop.shaded.io.compress.passthrough.extension")
_ENDING = r"\.[A-Za-z0-9_-]+$"
# Line readers drop this mark from the start of a file.
_MARK = b"\xef\xbb\xbf"


def hash_blobs(spark: SparkSession, path: str, max_bytes: int, glob: str = "*", whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """A3 with F1: ``path``, ``length`` and ``content_hash`` of the files that ``read_blobs`` gives, equal to ``content_hash`` of their content.

    Files over ``whole_bytes`` come line by line, so a task's memory follows the longest stretch without a line feed and not the file.
    Only a name without a plain ending (``.png``) is read whole at any size.
    """
    whole_bytes = max(whole_bytes, len(_MARK))  # a file of nothing but the mark has no lines
    hashed = ("path", "length", content_hash(F.col("content")).alias("content_hash"))
    parts = [read_blobs(spark, path, min(max_bytes, whole_bytes), glob).select(*hashed)]
    over = F.col("length") > whole_bytes
    endings = blob_files(spark, path, max_bytes, glob).filter(over).select(F.regexp_extract("path", _ENDING, 0)).distinct().collect()
    for (ending,) in sorted(endings):
        if ending:
            parts.append(_lines(spark, path, whole_bytes, max_bytes, glob, ending).mapInArrow(_line_digests, "path string, length bigint, content_hash string"))
        else:
            parts.append(read_blobs(spark, path, max_bytes, glob).filter(over & ~F.col("_metadata.file_name").rlike(_ENDING)).select(*hashed))
    return reduce(DataFrame.unionByName, parts)


def _lines(spark: SparkSession, path: str, over: int, up_to: int, glob: str, ending: str) -> DataFrame:
    """Lines of the larger files of one ending, as bytes; a file's lines stay in order in one partition."""
    options = {"lineSep": "\n", "pathGlobFilter": glob, "recursiveFileLookup": "true"} | _AS_IT_IS | dict.fromkeys(_ENDING_OPTIONS, ending)
    size, name = F.col("_metadata.file_size"), F.col("_metadata.file_name")
    chosen = spark.read.options(**options).text(path).filter((size > over) & (size <= up_to) & name.endswith(ending))
    return chosen.select(unquote(F.col("_metadata.file_path")).alias("path"), size.alias("length"), F.col("value").cast("binary").alias("line"))


class _File:
    """The digest of one file so far, with and without the mark that its first line may have lost."""

    def __init__(self, path: str, length: int) -> None:
        self.path, self.length, self.seen = path, length, 0
        self.plain, self.marked = hashlib.sha256(), hashlib.sha256(_MARK)

    def add(self, lines: pa.Array) -> None:
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(lines)], lines), b"\n")[0].as_buffer()
        self._update(memoryview(joined))

    def _update(self, data: bytes | memoryview) -> None:
        self.plain.update(data)
        self.marked.update(data)
        self.seen += len(data)

    def row(self) -> tuple[str, int, str]:
        """What the lines lack of the file's length is the mark, a last line feed, both or neither."""
        missing = self.length - self.seen
        if missing not in (0, 1, len(_MARK), len(_MARK) + 1):
            raise ValueError(f"{self.path}: {self.seen} of {self.length} bytes were read")
        if missing in (1, len(_MARK) + 1):
            self._update(b"\n")
        return self.path, self.length, (self.marked if missing >= len(_MARK) else self.plain).hexdigest()


def _line_digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per file from its lines, which follow each other."""

    def done(file: _File) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in file.row()], ["path", "length", "content_hash"])

    file = None
    for batch in batches:
        paths, lines = batch.column(0), batch.column(2)
        for path in pc.unique(paths):
            own = pc.equal(paths, path)
            if file is None or file.path != path.as_py():
                if file is not None:
                    yield done(file)
                file = _File(path.as_py(), batch.column(1)[pc.index(paths, path).as_py()].as_py())
            else:
                file._update(b"\n")
            file.add(lines.filter(own))
    if file is not None:
        yield done(file)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
