"""Sources and sinks: sequences from files and back, file metadata, compression, archives."""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.errors import PipelineError, check


def empty(spark: SparkSession) -> DataFrame:
    """The empty sequence."""
    return spark.createDataFrame([], "iter bigint, pos bigint, base_uri string, doc string")


def inline(spark: SparkSession, *docs: str, base_uri: str | None = None) -> DataFrame:
    """Literal documents, in order."""
    return spark.createDataFrame([(0, i, base_uri, d) for i, d in enumerate(docs)], "iter bigint, pos bigint, base_uri string, doc string")


def load(spark: SparkSession, path: str, mask: str | None = None) -> DataFrame:
    """Documents of a file or folder, a row each, whose names match a regular expression. pos orders them by path."""
    where = lambda rows: rows.filter(F.col("_metadata.file_name").rlike(f"^(?:{mask})$")) if mask else rows
    files = where(spark.read.text(path, wholetext=True)).select(F.col("_metadata.file_path").alias("base_uri"), F.col("value").alias("doc"))
    return ordered(files, where(spark.read.format("binaryFile").load(path)).select(F.col("_metadata.file_path").alias("base_uri")))


def ordered(files: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """pos by base_uri. A listing of files (by default read from files), not their contents, is sorted by ranges and numbered by buckets."""
    from seqloom.operators.sequence import with_position
    from seqloom.plans.scratch import materialize

    uris = (files if listing is None else listing).select("base_uri").distinct().orderBy("base_uri")
    # The numbers rise over the sorted ranges with gaps; they are written, so that they are made once.
    rising = materialize(uris.select(F.lit(0).cast("bigint").alias("iter"), F.monotonically_increasing_id().alias("pos"), "base_uri"), "listing")
    places = with_position(rising).select("base_uri", (F.col("position") - 1).alias("pos"))
    return files.join(places, "base_uri").select(F.lit(0).cast("bigint").alias("iter"), "pos", "base_uri", "doc")


def data(spark: SparkSession, path: str, content_type: str = "application/octet-stream") -> DataFrame:
    """Files as c:data documents: text as text, other types in base64."""
    files = spark.read.format("binaryFile").load(path)
    if content_type.startswith("text/") or content_type.endswith("xml"):
        from seqloom.sources.xml import escape_text

        body, more = escape_text(F.decode("content", "UTF-8")), ""
    else:
        body, more = F.base64("content"), ' encoding="base64"'
    doc = F.concat(F.lit(f'<c:data xmlns:c="http://www.w3.org/ns/xproc-step" content-type="{content_type}"{more}>'), body, F.lit("</c:data>"))
    return ordered(files.select(F.col("path").alias("base_uri"), doc.alias("doc")))


def store(seq: DataFrame, path: str, compression: str | None = None, allow_effects: bool = False) -> DataFrame:
    """Write documents, one a line file part by Spark's writer; returns c:result documents. Off by default: XD0021."""
    check(allow_effects, "XD0021", "writing is not allowed in safe mode")
    w = seq.orderBy("iter", "pos").select("doc").write
    (w.option("compression", compression) if compression else w).text(path)
    return inline(seq.sparkSession, f'<c:result xmlns:c="http://www.w3.org/ns/xproc-step">{path}</c:result>')


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """path, size, modified of the files at a path, without reading them."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def directory_list(spark: SparkSession, path: str, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """name, size of a folder's files; the filters are regular expressions for whole names. A missing folder: XC0017."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        raise PipelineError("XC0017", path)
    rows = [(s.getPath().getName(), s.isDirectory(), s.getLen()) for s in fs.listStatus(where)]
    listing = spark.createDataFrame(rows, "name string, is_directory boolean, size bigint")
    kept = F.lit(True) if include is None else F.col("name").rlike(f"^(?:{include})$")
    gone = F.lit(False) if exclude is None else F.col("name").rlike(f"^(?:{exclude})$")
    return listing.filter(kept & ~gone)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1), text of one text file: the file is one row, exploded with its places."""
    whole = spark.read.text(path, wholetext=True)
    split = F.split(F.regexp_replace("value", r"\n\z", ""), "\n")
    return whole.select(F.posexplode(split).alias("line", "text")).withColumn("line", F.col("line") + 1)


def head(rows: DataFrame, n: int = 10, order: str = "line") -> DataFrame:
    """The first n rows by order; n < 0: all but the first -n."""
    if n >= 0:
        return rows.orderBy(order).limit(n)
    first = rows.orderBy(order).limit(-n).select(order)
    return rows.join(F.broadcast(first.agg(F.max(order).alias("_edge"))), F.col("_edge").isNull() | (F.col(order) > F.col("_edge"))).drop("_edge")


def tail(rows: DataFrame, n: int = 10, order: str = "line") -> DataFrame:
    """The last n rows by order; n < 0: all but the last -n. A top-n and a filter, no full sort."""
    if n >= 0:
        return rows.orderBy(F.col(order).desc()).limit(n)
    last = rows.orderBy(F.col(order).desc()).limit(-n).select(order)
    return rows.join(F.broadcast(last.agg(F.min(order).alias("_edge"))), F.col("_edge").isNull() | (F.col(order) < F.col("_edge"))).drop("_edge")


def java_properties(spark: SparkSession, path: str) -> DataFrame:
    """name, value of a .properties file: comments and blank lines apart; =, : or space between; lines that go on after a backslash, and escapes."""
    whole = spark.read.text(path, wholetext=True)
    joined = F.regexp_replace("value", r"(?<!\\)((?:\\\\)*)\\\r?\n[ \t\f]*", "$1")
    rows = whole.select(F.explode(F.split(joined, r"\r?\n")).alias("value")).filter(~F.col("value").rlike(r"^\s*(?:[#!]|$)"))
    name = F.regexp_extract("value", r"^\s*((?:\\.|[^\s=:\\])+)", 1)
    return rows.select(_unescaped(name).alias("name"), _unescaped(F.regexp_replace("value", r"^\s*(?:\\.|[^\s=:\\])+\s*[=:]?\s*", "")).alias("value"))


def _unescaped(value: Column) -> Column:
    """Escapes of a .properties file undone: those that JSON has are read as JSON, of others the backslash goes."""
    plain = F.regexp_replace(value, r"(\\\\)|\\([^tnrfu\\])", "$1$2")
    quoted = F.replace(F.replace(plain, F.lit('"'), F.lit('\\"')), F.lit("\t"), F.lit("\\t"))
    return F.coalesce(F.from_json(F.concat(F.lit('{"v":"'), quoted, F.lit('"}')), "v string")["v"], plain)


def log_port(seq: DataFrame, path: str) -> DataFrame:
    """Write what passes a port to a folder of Parquet files, for later reading; the documents pass from there."""
    seq.write.parquet(path)
    return seq.sparkSession.read.schema(seq.schema).parquet(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold JSON instead of markup, as documents (see content.json_document)."""
    from seqloom.operators.content import json_document

    return load(spark, path).withColumn("doc", json_document(F.col("doc")))


def _bytes_udf(name: str):
    if name == "gzip":

        def work(s: pd.Series) -> pd.Series:
            return s.map(lambda x: None if x is None else gzip.compress(bytes(x), mtime=0))
    else:

        def work(s: pd.Series) -> pd.Series:
            return s.map(lambda x: None if x is None else gzip.decompress(bytes(x)))

    return F.pandas_udf(work, "binary")


def gzip_bytes(value: Column, method: str = "gzip") -> Column:
    """Bytes in gzip; another method: XC0999."""
    check(method == "gzip", "XC0999", method)
    return _bytes_udf("gzip")(value)


def gunzip_bytes(value: Column, method: str = "gzip") -> Column:
    check(method == "gzip", "XC0999", method)
    return _bytes_udf("gunzip")(value)


#: Rows and bytes of content after which a batch of archives or entries goes to Spark.
ROWS, BYTES = 10_000, 1 << 22

_ENTRY = {"path": pa.string(), "name": pa.string(), "size": pa.int64(), "content": pa.binary()}


def _batches(rows: Iterator[tuple], *names: str) -> Iterator[pa.RecordBatch]:
    """Rows, the content last, as batches of bounded size."""
    held, size = [], 0
    take = lambda: pa.RecordBatch.from_arrays([pa.array(c, _ENTRY[n]) for n, c in zip(names, zip(*held, strict=True), strict=True)], names=list(names))
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) >= ROWS or size >= BYTES:
            yield take()
            held, size = [], 0
    if held:
        yield take()


def unzip(archives: DataFrame, entry: str | None = None) -> DataFrame:
    """path, name, size, content of the entries of zip archives (path, content); one row an archive is read at a time."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                if not content.is_valid:
                    continue
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for info in z.infolist():
                        if entry is None or info.filename == entry:
                            yield path, info.filename, info.file_size, z.read(info)

    kernel = lambda batches: _batches(entries(batches), "path", "name", "size", "content")
    return archives.select("path", "content").mapInArrow(kernel, "path string, name string, size bigint, content binary")


def zip_entries(entries: DataFrame) -> DataFrame:
    """path, content: one zip archive a path, of entries (path, name, content). An archive is a row.

    The entries of a path come to a task one after the other, so it writes many
    small archives without a call a path.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, name, content in zip(batch.column("path").to_pylist(), batch.column("name").to_pylist(), batch.column("content"), strict=True):
                yield path, name, content.as_py()

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for path, own in groupby(rows(batches), itemgetter(0)):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for _, name, content in own:
                    z.writestr(zipfile.ZipInfo(name), content or b"")
            yield path, out.getvalue()

    kernel = lambda batches: _batches(archives(batches), "path", "content")
    return entries.select("path", "name", "content").repartition("path").sortWithinPartitions("path", "name", "content").mapInArrow(kernel, "path string, content binary")


def zip_update(old: DataFrame, new: DataFrame, command: str = "update") -> DataFrame:
    """path, name, content of archives after a command with entries new(path, name, content), one join on path and name.

    create: only the new entries; update: new ones replace old ones or are
    added; freshen: they only replace; delete: the old ones that are not among
    them. Another command: XC0999.
    """
    check(command in ("create", "update", "freshen", "delete"), "XC0999", command)
    key, columns = ["path", "name"], ["path", "name", "content"]
    if command == "create":
        return new.select(*columns)
    if command == "delete":
        return old.select(*columns).join(new.select(*key), key, "left_anti")
    both = old.select(*columns).join(new.select(*key, F.col("content").alias("_new"), F.lit(True).alias("_is")), key, "full" if command == "update" else "left")
    return both.select(*key, F.when(F.col("_is"), F.col("_new")).otherwise(F.col("content")).alias("content"))


def _place(spark: SparkSession, path: str, allow_effects: bool):
    """(file system, path) of Hadoop; changing files is off by default: XD0021."""
    check(allow_effects, "XD0021", "changing files is not allowed in safe mode")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def copy(spark: SparkSession, source: str, target: str, allow_effects: bool = False) -> None:
    """Copy a file or folder between any file systems; a missing source: FU01."""
    fs, a = _place(spark, source, allow_effects)
    check(fs.exists(a), "FU01", source)
    to, b = _place(spark, target, allow_effects)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, to, b, False, spark.sparkContext._jsc.hadoopConfiguration())


def move(spark: SparkSession, source: str, target: str, allow_effects: bool = False) -> None:
    """Copy, then delete the source."""
    copy(spark, source, target, allow_effects)
    delete(spark, source, True, allow_effects)


def delete(spark: SparkSession, path: str, recursive: bool = False, allow_effects: bool = False, fail_on_error: bool = True) -> bool:
    """Delete a file, or with recursive a folder that is not empty; a missing one is FU01 unless fail_on_error is off."""
    fs, a = _place(spark, path, allow_effects)
    check(fs.exists(a) or not fail_on_error, "FU01", path)
    check(recursive or not fs.exists(a) or fs.getFileStatus(a).isFile() or not fs.listStatus(a), "FU02", f"{path} is not empty")
    return fs.delete(a, recursive)


def mkdir(spark: SparkSession, path: str, allow_effects: bool = False) -> bool:
    fs, a = _place(spark, path, allow_effects)
    return fs.mkdirs(a)


def touch(spark: SparkSession, path: str, allow_effects: bool = False) -> bool:
    """Create an empty file if there is none; one that is there stays as it is."""
    fs, a = _place(spark, path, allow_effects)
    return not fs.exists(a) and fs.createNewFile(a)


def tempfile(spark: SparkSession, folder: str, prefix: str = "temp", suffix: str = ".xml", allow_effects: bool = False) -> str:
    """The path of a new empty file in a folder."""
    import uuid

    path = f"{folder.rstrip('/')}/{prefix}{uuid.uuid4().hex}{suffix}"
    touch(spark, path, allow_effects)
    return path


def _view(uri: str) -> str:
    import hashlib

    return f"collection_{hashlib.md5(uri.encode()).hexdigest()}"


def register_collection(seq: DataFrame, uri: str) -> DataFrame:
    """Name a sequence for the session; it passes."""
    seq.createOrReplaceTempView(_view(uri))
    return seq


def collection(spark: SparkSession, uri: str) -> DataFrame:
    """A named sequence; an unknown name gives the empty one."""
    return spark.table(_view(uri)) if spark.catalog.tableExists(_view(uri)) else empty(spark)
