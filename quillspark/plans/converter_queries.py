"""Converters over files made from the driver's tables. Files hold a bounded run of keys each, whatever the table's size."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.converters import archive, html, images, registry, vector
from quillspark.converters.base import Outcome
from quillspark.functions import text as T
from quillspark.functions.decode import decoded
from quillspark.plans import builders
from quillspark.plans.queries import query, table


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def per_row(rows: DataFrame, fn: Callable[..., list], schema: str) -> DataFrame:
    """fn(*row) -> output row, for every row, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            yield pd.DataFrame([fn(*r) for r in batch.itertuples(index=False, name=None)], columns=names)

    return rows.mapInPandas(run, schema)


def per_file(rows: DataFrame, key: str, size: int, fn: Callable[[int, pd.DataFrame], list[list]], schema: str) -> DataFrame:
    """fn(file number, rows) -> output rows, for each run of ``size`` keys."""

    def run(part: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(fn(part[0], group.drop(columns="file").sort_values(key)), columns=[c.split()[0] for c in schema.split(", ")])

    return rows.withColumn("file", F.floor(F.col(key) / size)).groupBy("file").applyInPandas(run, schema)


def text_of(data: bytes, fmt: str) -> str:
    found, error = registry.convert(data, fmt)
    return found.text if isinstance(found, Outcome) else f"error: {error}"


@query("""SELECT doc_id, CASE WHEN doc_id % 7 < 4 THEN sha256(nfc_normalize(text)) END AS text_hash,
  CASE doc_id % 7 WHEN 1 THEN 'stripped leading byte order mark' WHEN 2 THEN 'transcoded from utf-16le' WHEN 3 THEN 'transcoded from utf-16be' ELSE '' END AS warnings,
  CASE doc_id % 7 WHEN 4 THEN 'invalid_utf8: invalid UTF-8 at byte ' || strlen(text) WHEN 5 THEN 'invalid_utf16: unpaired surrogate at byte 2' WHEN 6 THEN 'unsupported-encoding: UTF-32' END AS error FROM documents""")
def text_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by their byte order marks, whole and broken, decoded on the JVM."""
    t = F.col("text")
    joined = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, bytes) else p for p in parts))
    body = t.cast("binary")
    kinds = [
        body, joined(b"\xef\xbb\xbf", body), joined(b"\xff\xfe", F.encode(t, "UTF-16LE")), joined(b"\xfe\xff", F.encode(t, "UTF-16BE")), joined(body, b"\xff"),
        joined(b"\xff\xfe\x00\xdc", F.encode(t, "UTF-16LE")), joined(b"\xff\xfe\x00\x00", body),
    ]
    data = F.lit(None).cast("binary")
    for k, kind in enumerate(kinds):
        data = F.when(F.col("doc_id") % 7 == k, kind).otherwise(data)
    found = table(spark, sf_dir, "documents").select("doc_id", data.alias("data")).select("doc_id", decoded(F.col("data")).alias("d"))
    return found.select("doc_id", F.sha2(T.normalize_text(F.col("d.text")), 256).alias("text_hash"), F.coalesce("d.warning", F.lit("")).alias("warnings"), "d.error")


@query()
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(page_id: int, markup: str) -> list:
        found, error = registry.convert((markup or "").encode(), "html")
        return [page_id, found.text if found else None, error]

    return per_row(table(spark, sf_dir, "pages").select("page_id", "html"), one, "page_id long, text string, error string")


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&amp;', '&'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS title
FROM pages WHERE trim(regexp_extract(html, '<title>(.*?)</title>', 1)) <> ''""")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").where(F.trim(F.regexp_extract("html", "<title>(.*?)</title>", 1)) != "").select("page_id", "html")
    return per_row(pages, lambda i, markup: [i, html.strip_html(markup).split("\n", 1)[0]], "page_id long, title string")


@query("""SELECT 'archive-' || doc_id // 20 || '.zip.d/' || lang || '/' || source || '/' || doc_id || '.txt' AS path, sha256(text) AS text_hash, 1 AS depth FROM documents""")
def zip_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(k: int, rows: pd.DataFrame) -> list[list]:
        name = f"archive-{k}.zip"
        data = builders.zip_of([(f"{r.lang}/{r.source}/{r.doc_id}.txt", r.text.encode()) for r in rows.itertuples()])
        return [[u.path, sha(text_of(u.data, "text")), u.depth] for u in archive.Expansion().run(name, data) if u.path != name]

    return per_file(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), "doc_id", 20, one, "path string, text_hash string, depth int")


@query("""SELECT 'archive-' || doc_id // 20 || '.zip' AS path, string_agg(doc_id || '.txt' || chr(9) || strlen(text) || chr(10), '' ORDER BY doc_id) AS listing FROM documents GROUP BY doc_id // 20""")
def zip_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(k: int, rows: pd.DataFrame) -> list[list]:
        return [[f"archive-{k}.zip", text_of(builders.zip_of([(f"{r.doc_id}.txt", r.text.encode()) for r in rows.itertuples()]), "zip")]]

    return per_file(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 20, one, "path string, listing string")


@query("""SELECT doc_id, sha256('From: ' || lang || '@example.org' || chr(10) || 'Subject: ' || source || chr(10) || chr(10) || trim(text, chr(10)) || chr(10)) AS text_hash,
  '1-' || source || '.txt' AS attachment, sha256(text) AS attachment_hash FROM documents""")
def eml_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(doc_id: int, lang: str, source: str, text: str) -> list:
        found, error = registry.convert(builders.mail_of(f"{lang}@example.org", source, text, (f"{source}.txt", text.encode())), "eml")
        return [doc_id, sha(found.text) if found else error, found.members[0][0], sha(found.members[0][1].decode())]

    return per_row(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), one, "doc_id long, text_hash string, attachment string, attachment_hash string")


_ORDERS = "string_agg(o_orderkey || chr(9) || o_orderstatus || chr(9) || o_orderpriority || chr(10), '' ORDER BY o_orderkey)"


@query(f"SELECT CAST(o_orderkey // 500 AS BIGINT) AS file, 'id' || chr(9) || 'status' || chr(9) || 'priority' || chr(10) || {_ORDERS} AS text FROM orders GROUP BY o_orderkey // 500")
def sqlite_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(k: int, rows: pd.DataFrame) -> list[list]:
        data = builders.sqlite_of("orders", "id INTEGER, status TEXT, priority TEXT", [(int(a), b, c) for a, b, c in rows.itertuples(index=False, name=None)])
        return [[k, text_of(data, "sqlite")]]

    return per_file(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey", 500, one, "file long, text string")


@query(f"SELECT CAST(o_orderkey // 500 AS BIGINT) AS file, 'id' || chr(9) || 'status' || chr(9) || 'priority' || chr(10) || {_ORDERS} AS text FROM orders GROUP BY o_orderkey // 500")
def avro_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(k: int, rows: pd.DataFrame) -> list[list]:
        data = builders.avro_of([("id", "long"), ("status", "string"), ("priority", "string")], [(int(a), b, c) for a, b, c in rows.itertuples(index=False, name=None)])
        return [[k, text_of(data, "avro")]]

    return per_file(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey", 500, one, "file long, text string")


@query("SELECT CAST(c_custkey // 500 AS BIGINT) AS file, 'c_custkey' || chr(9) || 'c_name' || chr(10) || string_agg(c_custkey || chr(9) || c_name || chr(10), '' ORDER BY c_custkey) AS text FROM customer GROUP BY c_custkey // 500")
def parquet_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(k: int, rows: pd.DataFrame) -> list[list]:
        return [[k, text_of(builders.parquet_of({c: rows[c].tolist() for c in rows.columns}), "parquet")]]

    return per_file(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 500, one, "file long, text string")


@query("""SELECT CAST(p_partkey // 200 AS BIGINT) AS file, string_agg(p_partkey || chr(9) || p_name || chr(9) || p_size || ' [=B1]' || chr(10), '' ORDER BY p_partkey) AS text, count(*) + 1 AS hidden FROM part GROUP BY p_partkey // 200""")
def xlsx_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks whose second column and first row are hidden."""

    def one(k: int, rows: pd.DataFrame) -> list[list]:
        cells = [[int(a), b, (int(c), "B1")] for a, b, c in rows.itertuples(index=False, name=None)]
        found, error = registry.convert(builders.xlsx_of("Parts", cells, (1,), (0,)), "xlsx")
        return [[k, found.text, sum(s.hidden for s in found.segments)]] if found else [[k, error, 0]]

    return per_file(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey", 200, one, "file long, text string, hidden long")


@query("""SELECT doc_id, sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> ''), chr(10) || chr(10)) || chr(10)) AS text_hash FROM documents""")
def docx_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_row(table(spark, sf_dir, "documents").select("doc_id", "text"), lambda i, t: [i, sha(text_of(builders.docx_of(t.split("\n")), "docx"))], "doc_id long, text_hash string")


@query("SELECT p_partkey, p_name || chr(10) || p_partkey || chr(10) AS pdf, p_name || chr(10) || chr(10) || p_partkey || chr(10) AS rtf FROM part")
def pdf_and_rtf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(key: int, name: str) -> list:
        return [key, text_of(builders.pdf_of([name, str(key)]), "pdf"), text_of(builders.rtf_of([name, str(key)]), "rtf")]

    return per_row(table(spark, sf_dir, "part").select("p_partkey", "p_name"), one, "p_partkey long, pdf string, rtf string")


@query("SELECT p_partkey, 'png-text' || chr(9) || 'png-text' || chr(9) || 'Comment' || chr(9) || chr(9) || p_partkey || chr(10) || 'png-text' || chr(9) || 'png-text' || chr(9) || 'Title' || chr(9) || chr(9) || p_name || chr(10) AS text, 2 AS hidden FROM part")
def image_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(key: int, name: str) -> list:
        found = images.metadata(builders.png_of([("Title", name), ("Comment", str(key))]), "png")
        return [key, found.text, sum(s.hidden for s in found.segments)]

    return per_row(table(spark, sf_dir, "part").select("p_partkey", "p_name"), one, "p_partkey long, text string, hidden int")


@query("""SELECT p_partkey, round(CASE WHEN p_size % 2 = 0 THEN p_size * (96 / 25.4) ELSE p_size * 10.0 END, 6) AS width, round(CASE WHEN p_size % 2 = 0 THEN p_size * 96.0 ELSE p_size * 20.0 END, 6) AS height FROM part""")
def svg_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(key: int, size: int) -> list:
        shape = f'width="{size}mm" height="{size}in"' if size % 2 == 0 else f'viewBox="0 0 {10 * size} {20 * size}"'
        width, height = vector.geometry(f'<?xml version="1.0"?><svg {shape} xmlns="http://www.w3.org/2000/svg"><g/></svg>'.encode())
        return [key, round(width, 6), round(height, 6)]

    return per_row(table(spark, sf_dir, "part").select("p_partkey", "p_size"), one, "p_partkey long, width double, height double")


@query("""SELECT doc_id, sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> ''), chr(10) || chr(10)) || chr(10)) AS text_hash, '' AS warnings FROM documents WHERE regexp_full_match(text, '[\\x0A\\x20-\\x7E]+')""")
def doc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy documents in pieces, narrow and wide, with the second extraction in agreement."""

    def one(doc_id: int, text: str) -> list:
        found, error = registry.convert(builders.doc_of([p.strip() for p in text.split("\n")], doc_id % 2 == 0), "doc")
        return [doc_id, sha(found.text) if found else error, "; ".join(found.warnings) if found else ""]

    rows = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\A[\x0A\x20-\x7E]+\z")).select("doc_id", "text")
    return per_row(rows, one, "doc_id long, text_hash string, warnings string")


@query("""SELECT CAST(p_partkey // 50 AS BIGINT) AS file, string_agg(p_name || chr(10) || chr(10) || 'size ' || p_size || chr(10) || chr(10) || 'é' || p_partkey, chr(10) || chr(10) ORDER BY p_partkey) || chr(10) AS text, '' AS warnings FROM part GROUP BY p_partkey // 50""")
def ppt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy presentations: a slide for each part, with two texts in the outline and one in a shape."""

    def one(k: int, rows: pd.DataFrame) -> list[list]:
        found, error = registry.convert(builders.ppt_of([([n, f"size {s}"], [f"é{key}"]) for key, n, s in rows.itertuples(index=False, name=None)]), "ppt")
        return [[k, found.text if found else error, "; ".join(w for w in found.warnings if "divergence" not in w) if found else ""]]

    return per_file(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey", 50, one, "file long, text string, warnings string")


@query("""SELECT CAST(p_partkey // 200 AS BIGINT) AS file, string_agg(p_partkey || chr(9) || p_name || chr(9) || p_size || ' [=B1]' || chr(10), '' ORDER BY p_partkey) || chr(10) || 'secret' || chr(10) AS text,
  count(*) + 2 AS hidden, '' AS warnings FROM part GROUP BY p_partkey // 200""")
def xls_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy workbooks of both versions, whose second column, first row and second sheet are hidden."""
    b1 = {True: struct.pack("<BHH", 0x44, 0, 0xC001), False: struct.pack("<BHB", 0x44, 0xC000, 1)}

    def one(k: int, rows: pd.DataFrame) -> list[list]:
        new = k % 2 == 0
        cells = [[int(a), b, (float(c), b1[new])] for a, b, c in rows.itertuples(index=False, name=None)]
        found, error = registry.convert(builders.xls_of([("Parts", 0, cells, (1,), (0,)), ("More", 2, [["secret"]], (), ())], new), "xls")
        return [[k, found.text, sum(s.hidden for s in found.segments), "; ".join(found.warnings)]] if found else [[k, error, 0, ""]]

    return per_file(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey", 200, one, "file long, text string, hidden long, warnings string")
