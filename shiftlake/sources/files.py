"""Landed daily files: CSV scans, one-scan header binding, load audit and landing ledger.

Files are read as text columns (no ``inferSchema`` pass over the data) and
typed afterwards by ``clean_driver_day`` from the canonical schema.
"""

from __future__ import annotations

import csv
import logging
from collections import OrderedDict
from datetime import datetime, timezone
from fnmatch import fnmatch
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftlake.functions.schema import FILE_ORDER, NA_TOKENS
from shiftlake.operators.master import union_by_name
from shiftlake.session import scratch_path

log = logging.getLogger(__name__)

# Text layout used when this library lands CSV files itself.
TS_TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
DATE_TEXT_FORMAT = "yyyy-MM-dd"

MAX_COLUMNS = 128  # cells that are read of a header which itself holds quoted line breaks
CELL_END = "\x1f"  # parts the cells of a header in the header dictionary
ROW_BITS = 34  # of ``_pos``: rows inside a file split


def na_to_null(df: DataFrame) -> DataFrame:
    """Cells holding one of pandas' default NA tokens become NULL.

    Spark's CSV ``nullValue`` takes a single token, so the rest are mapped
    after the scan (exact cell match, as pandas does).
    """
    return df.select(*[
        F.when(F.col(f"`{c}`").isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(F.col(f"`{c}`")).alias(c)
        if t == "string" else F.col(f"`{c}`")
        for c, t in df.dtypes
    ])


def read_csv(spark: SparkSession, paths, with_file_order: bool = False, multi_line: bool = False) -> DataFrame:
    """Scan CSV files sharing one header as text columns.

    A doubled quote inside a quoted cell is one quote. ``multi_line`` also
    reads quoted line breaks as cell text (a file is then not split). A
    corrupt or missing file fails the job.

    ``with_file_order`` adds ``_mtime``, ``_path``, ``_block`` from the hidden
    file metadata, the arrival order used by keep-last dedup.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = (spark.read.option("header", True).option("mode", "PERMISSIVE")
          .option("enforceSchema", False).option("quote", '"').option("escape", '"').option("multiLine", multi_line)
          .option("ignoreCorruptFiles", False).option("ignoreMissingFiles", False).csv(paths))
    return na_to_null(with_file_order_columns(df) if with_file_order else df)


def with_file_order_columns(df: DataFrame, drop=()) -> DataFrame:
    """Add the arrival order of file rows: modification time, path, block start.

    Keep-last ranks rows by these before their position, so on a key that
    occurs in several files of one batch the newest file wins.
    """
    return df.select(
        *[f"`{c}`" for c in df.columns if c not in drop],
        F.col("_metadata.file_modification_time").alias("_mtime"),
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def read_landed(spark: SparkSession, paths, multi_line: bool | None = None) -> DataFrame:
    """Scan landed daily files, choosing the reader by extension (case-insensitive).

    ``.csv`` -> text columns (typed later by the cleaning step), bound by the
    headers of their files; ``.parquet`` and ``.json`` keep their own types. Mixed extensions are read per
    format and unioned by column name. Rows carry their file arrival order
    (``_mtime``, ``_path``, ``_block``) for keep-last; the upsert drops it.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    by_fmt: OrderedDict = OrderedDict()
    for p in paths:
        low = p.lower()
        fmt = "parquet" if low.endswith(".parquet") else "json" if low.endswith((".json", ".jsonl")) else "csv"
        by_fmt.setdefault(fmt, []).append(p)
    frames = []
    for fmt, ps in by_fmt.items():
        if fmt == "csv":
            frames.append(read_csv_groups(spark, ps, with_file_order=True, skip_unreadable=False, multi_line=multi_line))
        elif fmt == "parquet":
            frames.append(with_file_order_columns(spark.read.parquet(*ps)))
        else:
            frames.append(na_to_null(with_file_order_columns(spark.read.json(ps))))
    frames = [f for f in frames if f is not None]
    if not frames:
        raise FileNotFoundError(f"no readable input file among {len(paths)} path(s)")
    return union_by_name(frames)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_files(spark: SparkSession, directory: str, pattern: str = "*.csv") -> list[str]:
    """Files in ``directory`` matching a glob, via the Hadoop FileSystem (any store)."""
    jvm = spark.sparkContext._jvm
    p, fs = _fs(spark, directory.rstrip("/") + "/" + pattern)
    st = fs.globStatus(p)
    return sorted(str(s.getPath().toString()) for s in (st or []) if s.isFile())


def read_header(spark: SparkSession, path: str) -> tuple:
    """Column names of a CSV file: reads its first line through the Hadoop FS, decompressed by its extension."""
    jvm = spark.sparkContext._jvm
    p, fs = _fs(spark, path)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(
        spark.sparkContext._jsc.hadoopConfiguration()).getCodec(p)
    stream = fs.open(p)
    try:
        source = codec.createInputStream(stream) if codec is not None else stream
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(source, "UTF-8"))
        line = reader.readLine() or ""
    finally:
        stream.close()
    return tuple(h.strip() for h in next(csv.reader([line.lstrip("\ufeff")]), []))


def _lines(reader, where, pattern: str | None) -> DataFrame:
    if pattern:
        reader = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return with_file_order_columns(reader.option("ignoreCorruptFiles", False).option("ignoreMissingFiles", False).text(where))


def scan_lines(spark: SparkSession, where, pattern: str | None = None) -> DataFrame:
    """The lines of files (with a ``pattern``: of all files below a folder that match) with their arrival order."""
    return _lines(spark.read, where, pattern)


def stream_lines(spark: SparkSession, folder: str, pattern: str = "*.csv", max_files_per_trigger: int | None = None) -> DataFrame:
    """The lines of the files that arrive below a folder."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _lines(reader, folder, pattern)


def scan_records(spark: SparkSession, paths: list[str], width: int) -> DataFrame:
    """Records by position (cells ``_c0``, ``_c1``, ..., headers as rows) of files with quoted line breaks; such files are not split."""
    reader = spark.read.schema(_cell_schema(width)).options(**CSV_OPTIONS)
    return with_file_order_columns(reader.option("multiLine", True).option("ignoreCorruptFiles", False)
                                   .option("ignoreMissingFiles", False).csv(paths))


CSV_OPTIONS = {"header": "false", "mode": "PERMISSIVE", "quote": '"', "escape": '"'}


def _cell_schema(width: int) -> str:
    return ", ".join(f"_c{i} string" for i in range(width))


class Landing:
    """Files staged once in the shared folder, and what their first lines say.

    One text scan, written as Parquet, reads every file once. The header
    dictionary is derived from the staged lines: a row per file split with
    its first line's id, and of every file the line at the smallest block
    start. Only the different header lines come to the driver, and with them
    the place of each name in each header; the file to header table stays in
    Spark. Lines are then parsed by position, as wide as the widest header.

    A quoted line break leaves a line with an odd number of quotes. Files
    with such lines are scanned once more as records with line breaks; the
    others are not. Blank lines are no rows.
    """

    def __init__(self, lines: DataFrame, multi_line: bool | None = None):
        """``multi_line``: None finds the files with quoted line breaks, True takes all as such, False none."""
        self.spark = lines.sparkSession
        odd = F.expr("""(length(value) - length(replace(value, '"', ''))) % 2 = 1""")
        self.lines, splits = self._staged(lines.where(F.trim("value") != "").withColumn("_odd", odd), 0)
        broken = [] if multi_line is False else [
            r[0] for r in (splits if multi_line else splits.where("_odd")).select("_path").distinct().collect()]
        files = self._heads(self.lines, splits, F.col("value"))
        self.parts = []
        if broken:
            widths = [len(next(csv.reader([r[0].lstrip("\ufeff")]))) if r[0].count('"') % 2 == 0 else MAX_COLUMNS
                      for r in files.where(F.col("_path").isin(broken)).select("_header").distinct().collect()]
            records, record_splits = self._staged(scan_records(self.spark, [unquote(p) for p in broken], max(widths)).withColumn("_odd", F.lit(False)), 1)
            cells = F.concat_ws(CELL_END, *[F.coalesce(F.col(f"_c{i}"), F.lit("")) for i in range(max(widths))])
            heads = self._heads(records, record_splits, cells)
            kept = ~F.col("_path").isin(broken)
            self.lines = self.lines.where(kept)
            splits, files = splits.where(kept).unionByName(record_splits), files.where(kept).unionByName(heads)
            self.parts.append(records)
        self.splits, self.files = splits, files
        found = files.groupBy("_header").agg(F.min(F.struct("_mtime", "_path")).alias("first"), F.max("_path").isin(broken).alias("cells"))
        self.headers = {r[0]: header_names(r[0].split(CELL_END) if r["cells"] else next(csv.reader([r[0].lstrip("\ufeff")])))
                        for r in sorted(found.collect(), key=lambda r: tuple(r["first"]))}  # a row per layout
        self.width = max(map(len, self.headers.values()), default=0)
        parsed = F.from_csv("value", F.lit(_cell_schema(max(1, self.width))), CSV_OPTIONS)
        self.parts.insert(0, self.lines.select(parsed.alias("_cells"), *ORDERED).select(
            *[f"_cells._c{i}" for i in range(self.width)], *ORDERED))

    def _staged(self, rows: DataFrame, part: int) -> tuple[DataFrame, DataFrame]:
        """The rows with an id, and a row per file split with its first id."""
        row = F.monotonically_increasing_id() + F.lit(part << 62)
        rows = self._stored(rows.withColumn("_row", row), "rows")
        splits = rows.groupBy("_mtime", "_path", "_block").agg(
            F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"), F.max("_odd").alias("_odd"))
        return rows, self._stored(splits, "splits")

    def _heads(self, rows: DataFrame, splits: DataFrame, header) -> DataFrame:
        """A row per file: the id of its first row, its header and its number of rows."""
        starts = splits.groupBy("_path").agg(
            F.min("_mtime").alias("_mtime"), F.min_by("_first", "_block").alias("_head"), F.sum("_n").alias("_rows"))
        found = starts.join(rows.withColumnsRenamed({"_path": "_p", "_mtime": "_m"}), (F.col("_path") == F.col("_p")) & (F.col("_head") == F.col("_row")))
        return self._stored(found.select("_path", "_mtime", "_head", "_rows", header.alias("_header")), "files")

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, "landing", name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bound(self, with_file_order: bool = True) -> DataFrame | None:
        """The rows under the names of their files' headers; a name that a file lacks is NULL. None without any file.

        Names are matched without regard to case; the first file's spelling
        stays. Cells beyond a file's header are left out. ``_pos`` is the
        place of the row in the arrival order: modification time, path,
        block, line.
        """
        if not self.headers:
            return None
        places: dict[str, tuple[str, dict[int, list[int]]]] = {}  # by lower-cased name: spelling, position -> headers
        for k, names in enumerate(self.headers.values()):
            for i, name in enumerate(names):
                places.setdefault(name.lower(), (name, {}))[1].setdefault(i, []).append(k)
        number = F.lit(0)
        if len(self.headers) > 1:
            number = F.create_map(*[x for k, h in enumerate(self.headers) for x in (F.lit(h), F.lit(k))])[F.col("_header")]
        ranked = (self.splits.withColumn("_rank", F.row_number().over(Window.orderBy("_mtime", "_path", "_block")))
                  .select("_path", "_block", "_first", "_rank"))  # a row per file split
        keys = (self.files.withColumn("_layout", number).select("_path", "_head", "_layout").join(ranked, "_path")
                .withColumnsRenamed({"_path": "_p", "_block": "_b"}))
        pos = F.shiftleft(F.col("_rank").cast("long"), ROW_BITS).bitwiseOR(F.col("_row") - F.col("_first"))
        order = ["_mtime", "_path", "_block", pos.alias("_pos")] if with_file_order else []
        frames = []
        for part in self.parts:
            out = []
            for name, at in places.values():
                value = F.lit(None).cast("string")
                for i, layouts in at.items():
                    here = F.col("_layout").isin(layouts) if len(layouts) < len(self.headers) else F.lit(True)
                    value = F.when(here, F.col(f"_c{i}")).otherwise(value) if f"_c{i}" in part.columns else value
                out.append(value.alias(name))
            rows = part.join(keys, (F.col("_path") == F.col("_p")) & (F.col("_block") == F.col("_b")))
            frames.append(rows.where(F.col("_row") != F.col("_head")).select(*out, *order))
        return na_to_null(union_by_name(frames))

    def audit(self) -> DataFrame:
        """file_path, file_modification_time, total_rows, total_columns, columns of every file that has a header."""
        if not self.headers:
            return self.spark.createDataFrame([], AUDIT_SCHEMA)
        names = F.create_map(*[x for h, n in self.headers.items() for x in (F.lit(h), F.array(*map(F.lit, n)))])
        return (self.files.withColumn("names", names[F.col("_header")])
                .select(F.col("_path").alias("file_path"), F.col("_mtime").alias("file_modification_time"), (F.col("_rows") - 1).alias("total_rows"),
                        F.size("names").alias("total_columns"), F.concat_ws(",", "names").alias("columns")))


ORDERED = ("_mtime", "_path", "_block", "_row")
AUDIT_SCHEMA = "file_path string, file_modification_time timestamp, total_rows long, total_columns int, columns string"


def header_names(cells: list[str]) -> list[str]:
    """Column names of a header's cells: trimmed, without a byte order mark; blank and repeated ones get a name of their own."""
    while len(cells) > 1 and not cells[-1].strip():
        cells = cells[:-1]
    out, seen = [], set()
    for i, cell in enumerate(cells):
        if cell.startswith("\ufeff"):
            cell = cell[1:].strip('"')
        name = base = cell.strip() or f"Unnamed: {i}"
        k = 0
        while name.lower() in seen:
            k += 1
            name = f"{base}.{k}"
        seen.add(name.lower())
        out.append(name)
    return out


def land(spark: SparkSession, where, multi_line: bool | None = None, pattern: str | None = None) -> Landing:
    """Stage files, or with a ``pattern`` all files below a folder that match."""
    return Landing(scan_lines(spark, where, pattern), multi_line)


def _fails(spark: SparkSession, path: str) -> str | None:
    try:
        spark.read.text(path).write.format("noop").mode("overwrite").save()
    except Exception as e:  # noqa: BLE001 - any reader error means the file is unreadable
        return str(e).splitlines()[0] if str(e) else repr(e)
    return None


def read_csv_groups(spark: SparkSession, paths: list[str], with_file_order: bool = True, skip_unreadable: bool = True,
                    multi_line: bool | None = None) -> DataFrame | None:
    """Files whose headers differ, bound by name in one scan.

    A file that cannot be read, or is damaged inside, is left out whole with
    a warning (the backfill), or raises without ``skip_unreadable`` (the
    daily run); files are only tried one by one after the scan has failed.
    ``None`` when no file is left.
    """
    try:
        return land(spark, paths, multi_line).bound(with_file_order) if paths else None
    except Exception:
        if not skip_unreadable:
            raise
        bad = {p: why for p in paths if (why := _fails(spark, p)) is not None}
        if not bad:
            raise
        for path, why in bad.items():
            log.warning("skipping unreadable file %s: %s", path, why)
        return read_csv_groups(spark, [p for p in paths if p not in bad], with_file_order, False, multi_line)


def load_audit(spark: SparkSession, paths, multi_line: bool | None = None) -> DataFrame:
    """One row per input file, each with its own header: path, modification time, load time, rows, columns (S3)."""
    return (land(spark, [paths] if isinstance(paths, str) else list(paths), multi_line).audit()
            .withColumn("load_time", F.current_timestamp()))


def ledger(spark: SparkSession, folder: str, pattern: str = "*.csv", multi_line: bool | None = None) -> DataFrame:
    """Every file below a folder, empty ones too, with its audit row and the file that arrived before it.

    The listing reads no content. ``previous_path`` is the last file before
    in the order of modification time and path.
    """
    listed = spark.createDataFrame(list_below(spark, folder, pattern), "file_path string, file_modification_time timestamp, bytes long")
    full = listed.where("bytes > 0").limit(1).count() > 0
    audit = land(spark, folder, multi_line, pattern).audit() if full else spark.createDataFrame([], AUDIT_SCHEMA)
    before = Window.orderBy("file_modification_time", "file_path")  # a row per file, as the listing itself
    def plain(name):
        return F.regexp_replace(name, "^([a-z0-9]+):/+", "$1:/")  # file:///x and file:/x

    found = audit.select(plain("file_path").alias("_found"), "total_rows", "total_columns", "columns")
    return (listed.join(found, plain("file_path") == F.col("_found"), "left").drop("_found")
            .withColumn("total_rows", F.coalesce("total_rows", F.lit(0).cast("long")))
            .withColumn("total_columns", F.coalesce("total_columns", F.lit(0)))
            .withColumn("previous_path", F.lag("file_path").over(before)))


def list_below(spark: SparkSession, folder: str, pattern: str = "*.csv") -> list[tuple]:
    """(path as scans show it, modification time, bytes) of every file below a folder whose name matches, hidden ones aside."""
    p, fs = _fs(spark, folder)
    found, out = fs.listFiles(p, True), []
    while found.hasNext():
        status = found.next()
        path = status.getPath()
        if fnmatch(path.getName(), pattern) and not path.getName().startswith(("_", ".")):
            out.append((path.toUri().toString(), datetime.fromtimestamp(status.getModificationTime() / 1000, timezone.utc), status.getLen()))
    return out


def latest_file(spark: SparkSession, directory: str, pattern: str = "*.csv") -> str | None:
    """Path of the most recently modified file (the reference's 'previous day' rule).

    Listing metadata only (the binary content column is pruned).
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .load(directory).select("path", "modificationTime"))
    row = files.agg(F.max_by("path", "modificationTime").alias("p")).first()
    return row["p"] if row else None


def modification_time(spark: SparkSession, path: str) -> int:
    """Modification time (ms) of one file through the Hadoop FileSystem."""
    p, fs = _fs(spark, path)
    return int(fs.getFileStatus(p).getModificationTime())


def land_csv(df: DataFrame, path: str, files: int | None = None, mode: str = "overwrite") -> None:
    """Write a frame as headed CSV text (timestamps to the microsecond)."""
    out = df.coalesce(files) if files else df
    (out.write.mode(mode).option("header", True).option("escape", '"')
     .option("timestampFormat", TS_TEXT_FORMAT).option("timestampNTZFormat", TS_TEXT_FORMAT)
     .option("dateFormat", DATE_TEXT_FORMAT).csv(path))
