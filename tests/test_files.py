"""Readers and writers: dirty text files, spreadsheets, round trips."""

from lumenframe.sources import reader, sinks


def rows(df):
    return [tuple(r) for r in df.collect()]


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return f"file://{path}"


def test_semicolons_decimal_comma_titles_and_latin1(spark, tmp_path):
    text = "Informe de ventas\nGenerado hoy\n\nciudad;precio;nota\nBogotá;1.234,50;a\nCali;7,25;N/A\nMedellín;8,00;c\n" + "Cali;1,50;d\n" * 17
    df, meta = reader.read_any(spark, write(tmp_path / "a.csv", text, "latin-1"))
    assert meta["separador"] == ";" and meta["decimal"] == "," and meta["encoding"] == "latin-1"
    assert rows(df) == [("Bogotá", 1234.5, "a"), ("Cali", 7.25, None), ("Medellín", 8.0, "c")] + [("Cali", 1.5, "d")] * 17


def test_mark_quotes_and_ragged_lines(spark, tmp_path):
    text = '﻿name,city,n\n"Doe, J",Lima,1\n"a ""q"" b",Quito,2\nx,y,3,4\nz,w,5\n'
    df, meta = reader.read_any(spark, write(tmp_path / "b.csv", text))
    assert meta["separador"] == "," and meta["encoding"] == "utf-8-sig"
    assert rows(df) == [("Doe, J", "Lima", 1.0), ('a "q" b', "Quito", 2.0), ("z", "w", 5.0)]


def test_parquet_and_json(spark, tmp_path):
    spark.createDataFrame([(1, float("nan")), (2, 3.0)], "a int, b double").write.parquet(str(tmp_path / "t.parquet"))
    assert rows(reader.read_any(spark, str(tmp_path / "t.parquet"))[0].orderBy("a")) == [(1, None), (2, 3.0)]
    df, _ = reader.read_any(spark, write(tmp_path / "t.jsonl", '{"a": 1, "b": {"c": [1]}}\n{"a": 2}\n'))
    assert rows(df) == [(1, '{"c":[1]}'), (2, None)]


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("é <&>", 1.5, 3), (None, None, 4)], "texto string, valor double, n int")
    (tmp_path / "w.xlsx").write_bytes(sinks.xlsx_bytes(df, "Hoja"))
    path = str(tmp_path / "w.xlsx")
    assert reader.list_sheets(spark, path) == ["Hoja"]
    back, meta = reader.read_any(spark, path)
    assert meta["hoja_usada"] == "Hoja" and rows(back) == [("é <&>", 1.5, 3.0), (None, None, 4.0)]


def test_csv_round_trip_and_report(spark, tmp_path):
    df = spark.createDataFrame([("a;b", 1.5), ("ñ", 2.5)], "t string, v double")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "out.csv"))
    assert sorted(rows(reader.read_any(spark, str(tmp_path / "out.csv"))[0])) == [("a;b", 1.5), ("ñ", 2.5)]
    assert "| a | b |" in sinks.markdown_report("T", {"S": [{"a": 1, "b": 2}], "L": ["x"], "P": "text"})
    assert sinks.recipe_json([{"op": "ñ"}]).count("ñ") == 1


def test_line_breaks_in_quotes_are_part_of_a_field(spark, tmp_path):
    df, _ = reader.read_any(spark, write(tmp_path / "n.csv", 'id,nota\n1,"x\ny"\n2,"a ""b"",\n\nc"\n3,z\n'))
    assert rows(df) == [(1.0, "x\ny"), (2.0, 'a "b",\n\nc'), (3.0, "z")]


def test_rows_like_the_header_or_a_title_stay(spark, tmp_path):
    df, _ = reader.read_any(spark, write(tmp_path / "h.csv", "a,b\n1,x\na,b\n2,y\n"))
    assert rows(df) == [("1", "x"), ("a", "b"), ("2", "y")]
    text = "Informe\n\nclave;valor\n" + "".join(f"k{i};v\n" for i in range(20)) + "Informe\nclave;valor\n"
    for name in ("p1.csv", "p2.csv"):  # a folder: each file has its own title
        (tmp_path / "many.csv").mkdir(exist_ok=True)
        write(tmp_path / "many.csv" / name, text)
    for path, files in ((write(tmp_path / "t.csv", text), 1), (f"file://{tmp_path}/many.csv", 2)):
        df, meta = reader.read_any(spark, path)
        assert meta["fila_encabezado_detectada"] == 1 and df.columns == ["clave", "valor"]
        assert sorted(rows(df), key=str) == sorted([*((f"k{i}", "v") for i in range(20)), ("Informe", None), ("clave", "valor")] * files, key=str)


def test_files_read_in_pieces_lose_only_their_first_lines(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        text = "Informe\nclave;valor\n" + "".join(f"k{i};v\n" for i in range(400)) + "clave;valor\n"
        df, _ = reader.read_any(spark, write(tmp_path / "pieces.csv", text))
        assert sorted(rows(df)) == sorted([(f"k{i}", "v") for i in range(400)] + [("clave", "valor")])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_late_letter_decides_the_encoding(spark, tmp_path):
    text = "pais,n\n" + "Peru,1\n" * 20_000 + "España,2\n"
    df, meta = reader.read_any(spark, write(tmp_path / "l.csv", text, "latin-1"))
    assert meta["encoding"] == "latin-1" and ("España", 2.0) in rows(df.filter("n = 2"))
    df, meta = reader.read_any(spark, write(tmp_path / "u.csv", text))
    assert meta["encoding"] == "utf-8" and ("España", 2.0) in rows(df.filter("n = 2"))


def test_a_csv_round_trip_keeps_white_space_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([(1, '  a "b" \\ c '), (2, "x\r\ny"), (3, '"')], "n int, t string")
    sinks.write_csv(df, str(tmp_path / "rt.csv"))
    assert sorted(rows(reader.read_any(spark, str(tmp_path / "rt.csv"))[0])) == [(1.0, '  a "b" \\ c '), (2.0, "x\r\ny"), (3.0, '"')]
