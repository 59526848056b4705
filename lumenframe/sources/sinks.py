"""Tables, models and reports to files."""

from __future__ import annotations

import io
import json
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N

SHEET_ROWS_MOST = 1_048_575


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8") -> None:
    """Delimited text as ``read_csv`` reads it back: quotes doubled, white space kept, line breaks inside quotes."""
    df.write.mode("overwrite").csv(path, header=True, sep=sep, encoding=encoding, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def recipe_json(recipe: list[dict]) -> str:
    return json.dumps(recipe, ensure_ascii=False, indent=2)


def _letters(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def xlsx_bytes(df: DataFrame, sheet: str = "Datos", most: int = SHEET_ROWS_MOST) -> bytes:
    """A workbook of a small table: rows come one by one, and more than a sheet holds is refused."""
    out = io.StringIO()
    out.write('<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')

    def row(k: int, values: list) -> None:
        out.write(f'<row r="{k}">')
        for c, v in enumerate(values):
            if v is None:
                continue
            ref = f"{_letters(c)}{k}"
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                out.write(f'<c r="{ref}"><v>{v!r}</v></c>')
            else:
                out.write(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
        out.write("</row>")

    row(1, list(df.columns))
    for k, r in enumerate(df.toLocalIterator(), 2):
        if k - 1 > most:
            raise ValueError(f"a sheet holds {most} rows")
        row(k, list(r))
    out.write("</sheetData></worksheet>")
    ns = "http://schemas.openxmlformats.org"
    parts = {
        "[Content_Types].xml": f'<?xml version="1.0"?><Types xmlns="{ns}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<?xml version="1.0"?><Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="r1" Type="{ns}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<?xml version="1.0"?><workbook xmlns="{ns}/spreadsheetml/2006/main" xmlns:r="{ns}/officeDocument/2006/relationships"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<?xml version="1.0"?><Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="r1" Type="{ns}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": out.getvalue(),
    }
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return raw.getvalue()


def predictions_table(df: DataFrame, key: list[str], real: str, models: dict[str, DataFrame], classes: list[str] | None = None) -> DataFrame:
    """``key``, the real value and pred_<model> for each model, class numbers decoded."""
    out = df.select(*[N.q(k) for k in key], N.q(real).alias("real"))
    names = F.array(*[F.lit(c) for c in classes]) if classes else None
    for name, scored in models.items():
        value = F.try_element_at(names, F.col("prediction").cast("int") + 1) if classes else F.col("prediction")
        out = out.join(scored.select(*[N.q(k) for k in key], value.alias(f"pred_{name}")), key, "left")
    return out


def labelled_data(df: DataFrame, labels: DataFrame, key: str, names: DataFrame | None = None) -> DataFrame:
    """The table with its segments, and their names (a row a segment)."""
    out = df.join(labels.withColumnRenamed("prediction", "cluster"), key)
    return out.join(F.broadcast(names.select("cluster", F.col("nombre_sugerido").alias("segmento"))), "cluster", "left") if names is not None else out


def save_bundle(model, folder: str, info: dict) -> None:
    """A fitted model and, beside it, what is needed to use it."""
    model.write().overwrite().save(f"{folder}/model")
    spark = model._java_obj and __import__("pyspark").sql.SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(info, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/info")


def markdown_report(title: str, sections: dict[str, list[str] | list[dict] | str]) -> str:
    lines = [f"# {title}", ""]
    for name, body in sections.items():
        lines += [f"## {name}", ""]
        if isinstance(body, str):
            lines += [body, ""]
        elif body and isinstance(body[0], dict):
            keys = list(body[0])
            lines += ["| " + " | ".join(keys) + " |", "|" + "---|" * len(keys)]
            lines += ["| " + " | ".join(str(r[k]).replace("|", "\\|") for k in keys) + " |" for r in body] + [""]
        else:
            lines += [f"- {x}" for x in body] + [""]
    return "\n".join(lines)
