"""Files to tables: delimited text with automatic dialect, JSON, Parquet, and spreadsheets."""

from __future__ import annotations

import io
import os
import re
import statistics
import zipfile
from collections import Counter
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import names as N
from ..functions import parsing as P

SEPARATORS = [",", ";", "\t", "|"]
SNIFF_CHARS, SNIFF_LINES, HEADER_LINES = 20_000, 25, 12


def read_head(spark: SparkSession, path: str, size: int = 1 << 16) -> bytes:
    """The first bytes of a file, through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = system.globStatus(where)
    if status is None or len(status) == 0:
        raise FileNotFoundError(path)
    first = status[0]
    if first.isDirectory():  # a folder of part files
        parts = [x for x in system.listStatus(first.getPath()) if not x.getPath().getName().startswith(("_", ".")) and x.getLen() > 0]
        if not parts:
            return b""
        first = min(parts, key=lambda x: x.getPath().getName())
    stream = system.open(first.getPath())
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def _outside_quotes(line: str) -> str:
    return re.sub(r'"[^"]*"', "", line)


def records(text: str) -> list[str]:
    """Lines that aren't blank; those within a quoted field belong to the line that opens it. A quote that nothing closes opens nothing."""
    out, held = [], []
    for line in text.splitlines(keepends=True):
        held.append(line)
        if sum(x.count('"') for x in held) % 2 == 0:
            out.append("".join(held))
            held = []
    return [x.rstrip("\r\n") for x in [*out, *held] if x.strip()]


def sniff_separator(text: str) -> str:
    """The separator whose count by record is high and even; quoted parts don't count."""
    lines = [_outside_quotes(x) for x in records(text[:SNIFF_CHARS])][:SNIFF_LINES]
    if not lines:
        return ","

    def merit(sep: str) -> float:
        counts = [x.count(sep) for x in lines]
        return statistics.mean(counts) - 2 * statistics.pstdev(counts) if any(counts) else -1e9

    best = max(SEPARATORS, key=merit)
    return best if merit(best) > -1e9 else ","


def detect_header_row(text: str, sep: str) -> int:
    """The first line with as many separators as most lines have: title lines above it are not data."""
    lines = [_outside_quotes(x).count(sep) for x in records(text)]
    body = lines[HEADER_LINES:] or lines[1:] or lines
    if not body:
        return 0
    usual = Counter(body if len(lines) > HEADER_LINES else lines).most_common(1)[0][0]
    return next((k for k, n in enumerate(lines[:HEADER_LINES]) if n == usual), 0)


def _numeric_share(df: DataFrame, decimal: str) -> list[bool]:
    """Which text columns read wholly as numbers under a decimal convention; one pass."""
    found = df.agg(*[F.struct(F.count(N.q(c)).alias("n"), F.count(_number(c, decimal)).alias("k")).alias(f"v{i}") for i, c in enumerate(df.columns)]).first()
    return [found[f"v{i}"]["n"] > 0 and found[f"v{i}"]["n"] == found[f"v{i}"]["k"] for i in range(len(df.columns))]


def _number(c: str, decimal: str):
    other = "," if decimal == "." else "."
    text = P.stripped(N.q(c))
    plain = F.replace(F.replace(text, F.lit(other), F.lit("")), F.lit(decimal), F.lit("."))
    grouped = F.coalesce(text.rlike(rf"^[+-]?\d{{1,3}}(\{other}\d{{3}})+(\{decimal}\d+)?$"), F.lit(False))
    simple = F.coalesce(text.rlike(rf"^[+-]?(\d+(\{decimal}\d*)?|\{decimal}\d+)([eE][+-]?\d+)?$"), F.lit(False))
    return F.when(grouped | simple, plain).try_cast("double")


def _whole_file(spark: SparkSession, path: str) -> Row:
    """Over all lines of the file: ``bad``, those that aren't UTF-8, and ``open``, those with an odd number of quotes (a quoted field runs on)."""
    lines = spark.read.text(path)
    odd = F.regexp_count(F.col("value"), F.lit('"')) % 2 == 1
    return lines.agg(F.count_if(~F.is_valid_utf8("value")).alias("bad"), F.count_if(odd).alias("open")).first()


def _without_first(raw: DataFrame, rows: int) -> DataFrame:
    """``raw`` without the first ``rows`` records of each file, by their place: other records may say the same.

    Records are numbered in reading order; a file's first piece tells where its numbers begin.
    """
    placed = raw.select("*", F.monotonically_increasing_id().alias("__at"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))
    begun = placed.filter("__block = 0").groupBy("__file").agg(F.min("__at").alias("__first"))  # a row a file
    joined = placed.join(begun, "__file", "left")
    titles = (F.col("__block") == 0) & (F.col("__at") - F.col("__first") < rows)
    return joined.filter(~F.coalesce(titles, F.lit(False))).drop("__at", "__file", "__block", "__first")


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, decimal: str | None = None, header_row: int | None = None, na_values: list[str] | None = None) -> tuple[DataFrame, dict]:
    """Delimited text: encoding, separator, header line and decimal mark are found where not given.

    Separator and header are found in the file's beginning; encoding and quoted line breaks in the whole file, by one pass of Spark. Lines above
    the header and the header itself are left out by place.
    """
    head = read_head(spark, path)
    found = _whole_file(spark, path)
    if encoding is None:
        encoding = "latin-1" if found["bad"] else "utf-8-sig" if head.startswith(b"\xef\xbb\xbf") else "utf-8"
    sample = head.decode(encoding, "replace").lstrip("\ufeff")
    whole = sample if len(head) < 1 << 16 else sample.rpartition("\n")[0]
    sep = sep or sniff_separator(whole)
    first = detect_header_row(whole, sep) if header_row is None else header_row
    lines = records(whole)
    title = lines[first] if len(lines) > first else ""
    import csv

    names = next(csv.reader([title], delimiter=sep), [])
    names = [N.clean_column_name(n, k) for k, n in enumerate(names)] or ["columna_1"]
    seen: Counter = Counter()
    unique = []
    for n in names:
        unique.append(f"{n}.{seen[n]}" if seen[n] else n)
        seen[n] += 1
    charset = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "latin-1": "ISO-8859-1"}.get(encoding, encoding)
    schema = ", ".join(f"c{k} string" for k in range(len(unique))) + ", _corrupt string"
    options = {"sep": sep, "encoding": charset, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "ignoreLeadingWhiteSpace": False}
    # records that run over lines can't be cut anywhere, so such a file is read by one task; others are split
    raw = spark.read.schema(schema).csv(path, header=first == 0, multiLine=bool(found["open"]), **options)
    if first:
        raw = _without_first(raw, first + 1)
    text = F.concat_ws(sep, *[F.coalesce(f"c{k}", F.lit("")) for k in range(len(unique))])
    too_long = F.col("_corrupt").isNotNull() & (F.length(F.regexp_replace("_corrupt", r'"[^"]*"', "")) - F.length(F.replace(F.regexp_replace("_corrupt", r'"[^"]*"', ""), F.lit(sep), F.lit(""))) > len(unique) - 1)
    kept = raw.filter(~too_long & (text != sep * (len(unique) - 1)))
    missing = na_values if na_values is not None else P.NA_STRINGS
    data = kept.select(*[F.when(~F.col(f"c{k}").isin(missing), F.col(f"c{k}")).alias(n) for k, n in enumerate(unique)])
    if decimal is None:
        dot, comma = _numeric_share(data, "."), _numeric_share(data, ",")
        decimal = "," if sum(comma) > sum(dot) else "."
        numeric = comma if decimal == "," else dot
    else:
        numeric = _numeric_share(data, decimal)
    typed = data.select(*[_typed(c, decimal, numeric[k]) for k, c in enumerate(data.columns)])
    return typed, {"separador": sep, "encoding": encoding, "decimal": decimal, "fila_encabezado_detectada": first}


def _typed(c: str, decimal: str, numeric: bool):
    return (_number(c, decimal) if numeric else N.q(c)).alias(c)


# --- spreadsheets -----------------------------------------------------------------------------

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_ODF = "{urn:oasis:names:tc:opendocument:xmlns:%s:1.0}"


def _xlsx_sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    relations = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    book = ET.fromstring(z.read("xl/workbook.xml"))
    return [(s.get("name"), "xl/" + relations[s.get(f"{_REL}id")].removeprefix("/xl/").removeprefix("xl/")) for s in book.iter(f"{_MAIN}sheet")]


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{_MAIN}numFmt")}
    dated = {k for k, code in own.items() if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", code), re.I)} | set(range(14, 23)) | {45, 46, 47}
    cells = root.find(f"{_MAIN}cellXfs")
    return {k for k, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", 0)) in dated}


def _column_index(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _xlsx_rows(z: zipfile.ZipFile, part: str) -> Iterator[list[str | None]]:
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))]
    dated = _date_styles(z)
    with z.open(part) as stream:
        for _, row in ET.iterparse(stream):
            if row.tag != f"{_MAIN}row":
                continue
            out: list[str | None] = []
            for k, cell in enumerate(row.iter(f"{_MAIN}c")):
                at = _column_index(cell.get("r")) if cell.get("r") else k
                out += [None] * (at + 1 - len(out))
                value, kind = cell.find(f"{_MAIN}v"), cell.get("t")
                text = value.text if value is not None else None
                if kind == "s" and text is not None:
                    text = shared[int(text)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                elif kind == "b" and text is not None:
                    text = "true" if text == "1" else "false"
                elif kind in (None, "n") and text is not None and int(cell.get("s", 0)) in dated:
                    text = (datetime(1899, 12, 30) + timedelta(days=float(text))).isoformat(sep=" ")
                out[at] = text
            row.clear()
            yield out


def _ods_rows(z: zipfile.ZipFile, name: str) -> Iterator[list[str | None]]:
    table = _ODF % "table"
    for sheet in ET.fromstring(z.read("content.xml")).iter(f"{table}table"):
        if sheet.get(f"{table}name") != name:
            continue
        for row in sheet.iter(f"{table}table-row"):
            out: list[str | None] = []
            for cell in row.iter(f"{table}table-cell"):
                times = int(cell.get(f"{table}number-columns-repeated", 1))
                office = _ODF % "office"
                text = cell.get(f"{office}value") or cell.get(f"{office}date-value") or "\n".join("".join(p.itertext()) for p in cell.iter(f"{_ODF % 'text'}p")) or None
                out += [text] * (times if text is not None or times < 1000 else 0)
            if any(v is not None for v in out):
                yield out


def _sheet_names(raw: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        if "content.xml" in z.namelist():
            table = _ODF % "table"
            return [s.get(f"{table}name") for s in ET.fromstring(z.read("content.xml")).iter(f"{table}table")]
        return [n for n, _ in _xlsx_sheets(z)]


def list_sheets(spark: SparkSession, path: str) -> list[str]:
    """Names of a workbook's sheets; empty if it can't be read as one."""
    try:
        return _sheet_names(read_head(spark, path, 1 << 28))
    except Exception:  # as its contract says
        return []


class SpreadsheetSource(DataSource):
    """``spark.read.format("spreadsheet")``: a sheet of an .xlsx, .xlsm or .ods workbook as text columns."""

    @classmethod
    def name(cls) -> str:
        return "spreadsheet"

    def _rows(self) -> Iterator[list[str | None]]:
        from pyarrow import fs

        system, local = fs.FileSystem.from_uri(self.options["path"]) if "://" in self.options["path"] else (fs.LocalFileSystem(), self.options["path"].removeprefix("file:"))
        with system.open_input_file(local) as f, zipfile.ZipFile(f) as z:
            if "content.xml" in z.namelist():
                names = _sheet_names(bytes(f.read_at(f.size(), 0)))
                yield from _ods_rows(z, self.options.get("sheet") or names[0])
            else:
                sheets = _xlsx_sheets(z)
                wanted = self.options.get("sheet")
                yield from _xlsx_rows(z, dict(sheets)[wanted] if wanted else sheets[0][1])

    def schema(self) -> str:
        first = next(self._rows(), [])
        return ", ".join(f"`{N.clean_column_name(n, k).replace('`', '')}` string" for k, n in enumerate(first)) or "columna_1 string"

    def reader(self, schema) -> DataSourceReader:
        return _SpreadsheetReader(self, len(schema.fields))


class _SpreadsheetReader(DataSourceReader):
    def __init__(self, source: SpreadsheetSource, width: int) -> None:
        self.source, self.width = source, width

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        for k, row in enumerate(self.source._rows()):
            if k:
                yield tuple((row + [None] * self.width)[: self.width])


# --- dispatch ---------------------------------------------------------------------------------


def _postprocess(df: DataFrame) -> DataFrame:
    """Clean names; all-null columns without a name and all-null rows go; NaN becomes null; nested values become JSON text."""
    df = df.toDF(*[N.clean_column_name(c, k) for k, c in enumerate(df.columns)])
    nested = {c: F.to_json(N.q(c)) for c, t in df.dtypes if t.startswith(("array", "struct", "map"))}
    number = {c: F.when(~F.isnan(N.q(c)), N.q(c)) for c, t in df.dtypes if t in ("double", "float")}
    decimals = {c: N.q(c).cast("double") for c, t in df.dtypes if t.startswith("decimal")}
    fresh = nested | number | decimals
    df = df.select(*[fresh.get(c, N.q(c)).alias(c) for c in df.columns])
    nameless = [c for c in df.columns if re.match(r"Unnamed|columna_\d+$", c)]
    if nameless:
        counts = df.agg(*[F.count(N.q(c)).alias(f"v{k}") for k, c in enumerate(nameless)]).first()
        df = df.drop(*[c for k, c in enumerate(nameless) if not counts[f"v{k}"]])
    return df.dropna("all")


def read_any(spark: SparkSession, path: str, sheet: str | None = None, **options) -> tuple[DataFrame, dict]:
    """A table and what was found out about the file, by its extension."""
    name = path.rstrip("/").rpartition("/")[2]
    ext = os.path.splitext(name)[1].lower()
    meta: dict = {"archivo": name, "extension": ext}
    if ext in (".xlsx", ".xlsm", ".ods"):
        spark.dataSource.register(SpreadsheetSource)
        reader = spark.read.format("spreadsheet").option("path", path)
        sheet = sheet or (list_sheets(spark, path) or [None])[0]
        text = (reader.option("sheet", sheet) if sheet else reader).load()
        numeric = _numeric_share(text, ".")
        df = text.select(*[_typed(c, ".", numeric[k]) for k, c in enumerate(text.columns)])
        meta |= {"motor": "spreadsheet", "hoja_usada": sheet}
    elif ext in (".xls", ".xlsb"):
        raise ValueError(f"{ext} is a binary format without an open reader here; save it as .xlsx")
    elif ext == ".parquet":
        df, meta["motor"] = spark.read.parquet(path), "parquet"
    elif ext in (".json", ".jsonl"):
        df, meta["motor"] = spark.read.json(path, multiLine=ext == ".json"), "json"
    else:
        df, found = read_csv(spark, path, **options)
        meta |= {"motor": "csv", **found}
    return _postprocess(df), meta


def with_row_id(df: DataFrame) -> DataFrame:
    """A row number column for order-sensitive operations; it follows file order, and stays only once the table is written."""
    return df.withColumn(N.ROW_ID, F.monotonically_increasing_id())
