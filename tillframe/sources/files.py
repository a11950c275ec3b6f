"""Loading and writing tables: CSV with a corrupt-record column, Parquet, reports."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def load_csv(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with their raw line). The schema is declared, never inferred."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = spark.read.schema(full).csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT), rows.where(F.col(CORRUPT).isNotNull())


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_parquet(spark, f"{sf_dir}/{name}.parquet")


def write_processed(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, one of this machine in local mode; an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tillframe-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Paths handed out within each workspace that is open, the innermost last.
_workspaces: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted with the workspace it was asked for in, if any."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _workspaces:
        _workspaces[-1].append(path)
    return path


@contextlib.contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """What is written to the shared folder within, written() tables and scratch paths, is deleted at the end.

    For a whole job: results that are to stay must have been written elsewhere by then.
    """
    _workspaces.append([])
    try:
        yield
    finally:
        for path in _workspaces.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends here. discard() deletes it, or the end of a workspace()."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that no later step reads."""
    for df in tables:
        _delete(df.sparkSession, df._written_to)


#: Rows of a report that are written as one file at most.
ONE_FILE = 1_000_000


def export_csv(df: DataFrame, path: str, one_file: int = ONE_FILE) -> None:
    """A report as CSV: one file up to so many rows, counted first; beyond, as many files as df has tasks, all with a header."""
    small = df.limit(one_file + 1).count() <= one_file
    (df.coalesce(1) if small else df).write.mode("overwrite").option("header", True).csv(path)


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, sort: list[str] | None = None) -> DataFrame:
    """df as a table laid out in buckets of its keys, sorted within: joins and groups by these keys need no exchange.

    Its files lie in the shared folder, its name in the session's catalog.
    """
    table_name = f"{name}_{uuid.uuid4().hex}"
    # one task for each bucket, so a bucket is one file and its order can be used
    df.repartition(buckets, *keys).write.format("parquet").option("path", scratch(df.sparkSession, name)).bucketBy(buckets, *keys).sortBy(*(sort or keys)).saveAsTable(table_name)
    return df.sparkSession.table(table_name)


def _report_rows(df: DataFrame, cap: int) -> tuple[list[str], list[tuple]]:
    """A report's columns and rows; more than cap rows are refused, never cut."""
    rows = df.limit(cap + 1).collect()
    if len(rows) > cap:
        raise ValueError(f"a report of more than {cap} rows: export it as CSV or Parquet")
    return df.columns, [tuple(r) for r in rows]


def export_xlsx(df: DataFrame, path: str, cap: int = 10_000) -> None:
    """A report as a one-sheet workbook."""
    columns, rows = _report_rows(df, cap)

    def cell(v: object) -> str:
        if isinstance(v, int | float) and not isinstance(v, bool) and v == v:
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>'

    sheet = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [tuple(columns), *rows])
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, package = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/package/2006"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="report" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, head + xml)


def export_pdf(df: DataFrame, path: str, title: str, cap: int = 2_000, lines_per_page: int = 60) -> None:
    """A report as a plain PDF table."""
    columns, rows = _report_rows(df, cap)
    text = [" | ".join(columns), *(" | ".join("" if v is None else str(v) for v in r) for r in rows)]
    pages = [text[k : k + lines_per_page] for k in range(0, len(text), lines_per_page)]
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{4 + 2 * k} 0 R' for k in range(len(pages)))}] >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>"]
    for k, lines in enumerate(pages):
        shown = [title, "", *lines]
        quoted = (s.encode("latin-1", "replace").decode("latin-1").replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)") for s in shown)
        stream = "BT /F1 8 Tf 36 806 Td 12 TL " + " ".join(f"({s}) Tj T*" for s in quoted) + " ET"
        objects += [f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * k} 0 R >>", f"<< /Length {len(stream)} >>\nstream\n{stream}\nendstream"]
    out, places = "%PDF-1.4\n", []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{k} 0 obj\n{body}\nendobj\n"
    table_ = "".join(f"{p:010d} 00000 n \n" for p in places)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table_}trailer << /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF"
    with open(path, "wb") as f:
        f.write(out.encode("latin-1", "replace"))
