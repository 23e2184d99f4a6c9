"""The engine's operators over the driver's tables, each with the SQL that says the same in DuckDB.

A document is the source ``documents/<lang>/<source>/<doc_id>.txt``; a run log of two runs over all of them gives the
manifest operators something to work on: in the second run, the texts of some sources have changed.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import cells
from quillspark.functions import text as T
from quillspark.operators import agreement, bundles, dedup, intervals, manifest, outcomes, render, tree_hash
from quillspark.operators import lineage as lineages
from quillspark.operators.scan import Scan
from quillspark.plans import formats
from quillspark.plans.folders import Kept, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources: path, division, content hash and size."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("documents/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", path.alias("source_path"), F.col("lang").alias("division"), "source", "text", F.sha2("text", 256).alias("source_hash"), F.octet_length("text").cast("long").alias("source_size"))


def kept(spark: SparkSession, name: str) -> Kept:
    """Frames that a query stores while it is planned, in a folder of its own."""
    return Kept(spark, shared_folder(spark, name))


SOURCES = """sources AS (SELECT doc_id, 'documents/' || lang || '/' || source || '/' || doc_id || '.txt' AS source_path, lang AS division, source, text,
  sha256(text) AS source_hash, CAST(strlen(text) AS BIGINT) AS source_size FROM documents)"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over all sources, as manifest records."""
    s = sources(spark, sf_dir)
    copy = F.row_number().over(Window.partitionBy("source_hash").orderBy("doc_id")) > 1
    owner = F.first("source_path").over(Window.partitionBy("source_hash").orderBy("doc_id"))
    first = s.withColumns({"copy": copy, "owner": owner})
    status = F.when(F.col("source_size") < 200, "failed").when(F.col("source") == "src7", "unsupported").when(F.col("copy"), "dedup").otherwise("converted")
    one = first.select("doc_id", "division", "source_path", "source_hash", "source_size", F.col("doc_id").alias("line_no"), status.alias("status"), F.when(status == "dedup", F.col("owner")).alias("dedup_of"), F.lit(1).alias("run"))
    changed = F.col("division").isin("fr", "de") & F.col("source_hash").rlike("^[0-3]")
    again = F.when(F.col("status").isin("failed", "unsupported"), F.col("status")).when(changed, "converted").otherwise("skipped_unchanged")
    two = one.select(
        "doc_id", "division", "source_path", F.when(changed, F.sha2(F.concat("source_hash", F.lit("+")), 256)).otherwise(F.col("source_hash")).alias("source_hash"),
        "source_size", (F.col("line_no") + 1_000_000_000).alias("line_no"), again.alias("status"), F.when(again == "skipped_unchanged", F.col("dedup_of")).alias("dedup_of"), F.lit(2).alias("run"),
    )
    text = manifest.has_text(F.col("status"))
    return one.unionByName(two).withColumns(
        {
            "text_path": F.when(text, T.mirror_path(F.col("division"), F.col("source_path"))),
            "text_hash": F.when(text, F.col("source_hash")),
            "error": F.when(F.col("status") == "failed", "empty_output"),
            "converter_version": F.lit("1.2.0"),
            "rules_version": F.lit(formats.RULES_VERSION),
        }
    )


RUN_LOG = (
    SOURCES
    + """,
one AS (
  SELECT doc_id, division, source_path, source_hash, source_size, doc_id AS line_no, status, CASE WHEN status = 'dedup' THEN owner END AS dedup_of, 1 AS run
  FROM (SELECT *, CASE WHEN source_size < 200 THEN 'failed' WHEN source = 'src7' THEN 'unsupported' WHEN nth > 1 THEN 'dedup' ELSE 'converted' END AS status
    FROM (SELECT *, row_number() OVER w AS nth, first_value(source_path) OVER w AS owner FROM sources WINDOW w AS (PARTITION BY source_hash ORDER BY doc_id)))
),
two AS (
  SELECT doc_id, division, source_path, CASE WHEN changed THEN sha256(source_hash || '+') ELSE source_hash END AS source_hash, source_size, line_no + 1000000000 AS line_no,
    again AS status, CASE WHEN again = 'skipped_unchanged' THEN dedup_of END AS dedup_of, 2 AS run
  FROM (SELECT *, CASE WHEN status IN ('failed', 'unsupported') THEN status WHEN changed THEN 'converted' ELSE 'skipped_unchanged' END AS again
    FROM (SELECT *, division IN ('fr', 'de') AND substr(source_hash, 1, 1) IN ('0', '1', '2', '3') AS changed FROM one))
),
run_log AS (
  SELECT *, CASE WHEN bearing THEN division || '/' || source_path || '.txt' END AS text_path, CASE WHEN bearing THEN source_hash END AS text_hash,
    CASE WHEN status = 'failed' THEN 'empty_output' END AS error
  FROM (SELECT *, status IN ('converted', 'dedup', 'skipped_unchanged') AS bearing FROM (SELECT * FROM one UNION ALL SELECT * FROM two))
),
terminal AS (SELECT * FROM run_log QUALIFY row_number() OVER (PARTITION BY division, source_path ORDER BY line_no DESC) = 1)"""
)
STATUS_SQL = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in manifest.STATUSES)


# --- scans and inventory -------------------------------------------------------------------------------------------


@query("SELECT lang AS detected_format, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY ROLLUP (lang)")
def scan_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.inventory(sources(spark, sf_dir).withColumnRenamed("division", "detected_format"))


@query(f"WITH {SOURCES} SELECT source_path, source_size FROM sources WHERE source_size >= 4096 AND source_size >= 3.0 * (SELECT avg(source_size) FROM sources)")
def size_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.outliers(sources(spark, sf_dir), 4096, 3.0).select("source_path", "source_size")


@query(f"WITH {SOURCES} SELECT source_path, source_hash, source_size FROM sources")
def source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).select("source_path", "source_hash", "source_size")


@query()
def source_hash_blake3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.functions.hashing import blake3_hex

    return sources(spark, sf_dir).select("source_path", blake3_hex(F.col("text")).alias("source_hash"))


@query(f"""WITH {SOURCES} SELECT source_path, row_number() OVER (ORDER BY string_split(source_path, '/')) AS ord FROM sources""")
def walk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.numbered(sources(spark, sf_dir).select("source_path"), [F.split("source_path", "/")], "ord", kept(spark, "walk").store)


@query()
def stream_hash_blake3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of a language as one stream, hashed by pieces in many tasks."""
    return tree_hash.stream_hashes(table(spark, sf_dir, "documents"), ["lang"], ["doc_id"], "text", kept(spark, "stream").store)


_FILE = "CASE CAST(page_id AS BIGINT) % 7 WHEN 0 THEN '.DS_Store' WHEN 1 THEN 'base.db-wal' WHEN 2 THEN page_id || '-shm' WHEN 3 THEN page_id || '.tmp' WHEN 4 THEN '.DS_Store.txt' WHEN 5 THEN 'wal' ELSE page_id || '.html' END"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_FILE).alias("name"))


@query(f"SELECT page_id, name, NOT (name = '.DS_Store' OR suffix(name, '-wal') OR suffix(name, '-shm') OR suffix(name, '.tmp')) AS walked FROM (SELECT page_id, {_FILE} AS name FROM pages)")
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return _files(spark, sf_dir).select("page_id", "name", (~T.is_noise(name)).alias("walked"))


# --- scalar transforms and gates -----------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(nfc_normalize(regexp_replace(text, '\\r\\n?', chr(10), 'g'))) AS text_hash, CAST(strlen(nfc_normalize(regexp_replace(text, '\\r\\n?', chr(10), 'g'))) AS BIGINT) AS text_bytes FROM documents")
def passthrough_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("t"))
    return d.select("doc_id", F.sha2("t", 256).alias("text_hash"), F.octet_length("t").cast("long").alias("text_bytes"))


@query(r"""SELECT conv_id, turn, sha256(trim(regexp_replace(nfc_normalize(text), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0b]+', ' ', 'g'))) AS normal,
  sha256(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')) AS collapsed FROM conversations""")
def whitespace_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(T.comparable(t), 256).alias("normal"), F.sha2(T.collapse_spaces(t), 256).alias("collapsed"))


@query(r"""SELECT doc_id, sha256(replace(replace(replace(nfc_normalize(text), chr(9), '\t'), chr(10), '\n'), chr(13), '\r')) AS record_cell,
  sha256(translate(nfc_normalize(text), chr(10) || chr(9), '  ')) AS sheet_cell, sha256(trim(translate(text, chr(13) || chr(10), '  '))) AS line FROM documents""")
def cell_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", *(F.sha2(f(t), 256).alias(n) for f, n in ((T.escape_cell, "record_cell"), (T.flatten_cell, "sheet_cell"), (T.single_line, "line"))))


@query(f"""WITH {SOURCES} SELECT source_path, division || '/' || source_path || '.txt' AS text_path, source_path || '.segments.jsonl' AS segments_path,
  lower(hex(encode(source_path))) AS path_hex, lower(nfc_normalize(source_path)) AS run_key,
  translate(nfc_normalize(source_path), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS bundle_key FROM sources""")
def mirror_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("source_path")
    return sources(spark, sf_dir).select(
        "source_path", T.mirror_path(F.col("division"), p).alias("text_path"), T.segments_path(p).alias("segments_path"),
        T.hex_lower(p.cast("binary")).alias("path_hex"), T.run_collision_key(p).alias("run_key"), T.bundle_collision_key(p).alias("bundle_key"),
    )


_URL_PARTS = "string_split(url, '/')"


@query(f"""SELECT page_id, len({_URL_PARTS}) >= 2 AND len(list_filter({_URL_PARTS}, lambda p: p IN ('', '.', '..') OR contains(p, chr(92)) OR contains(p, ':'))) = 0 AS whole,
  len(string_split(regexp_replace(url, '^[a-z]+://', ''), '/')) >= 2 AND len(list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda p: p IN ('', '.', '..') OR contains(p, chr(92)) OR contains(p, ':'))) = 0 AS bare FROM pages""")
def recorded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.is_recorded_path(u).alias("whole"), T.is_recorded_path(F.regexp_replace(u, "^[a-z]+://", "")).alias("bare"))


_MEMBER = "CASE doc_id % 6 WHEN 0 THEN source || '/' || doc_id WHEN 1 THEN '/' || source WHEN 2 THEN 'C:' || source WHEN 3 THEN source || '/../' || lang WHEN 4 THEN source || chr(92) || lang ELSE source || chr(10) END"


@query(f"""SELECT doc_id, CASE WHEN name <> '' AND NOT regexp_matches(name, '[\\x00-\\x1F\\x7F]') AND NOT regexp_matches(name, '^[/\\\\]') AND NOT regexp_matches(name, '^[A-Za-z]:')
    AND len(list_filter(regexp_split_to_array(name, '[/\\\\]'), lambda p: p IN ('', '.', '..'))) = 0 THEN array_to_string(regexp_split_to_array(name, '[/\\\\]'), '/') END AS safe,
  CASE WHEN trim(trim(regexp_replace(list_last(regexp_split_to_array(name, '[/\\\\]')), '[\\x00-\\x1F\\x7F]', '', 'g')), '.') = '' THEN 'unnamed'
    ELSE trim(trim(regexp_replace(list_last(regexp_split_to_array(name, '[/\\\\]')), '[\\x00-\\x1F\\x7F]', '', 'g')), '.') END AS attachment
  FROM (SELECT doc_id, {_MEMBER} AS name FROM documents)""")
def safe_member_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["concat(source, '/', doc_id)", "concat('/', source)", "concat('C:', source)", "concat(source, '/../', lang)", "concat(source, chr(92), lang)", "concat(source, chr(10))"]
    name = F.expr("CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN {e}" for k, e in enumerate(kinds)) + " END")
    return table(spark, sf_dir, "documents").select("doc_id", T.safe_member(name).alias("safe"), T.attachment_name(name).alias("attachment"))


@query("""SELECT event_id, CASE WHEN value >= 0 THEN lpad(CAST(CAST(floor(value * 60) AS BIGINT) // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(value * 60) AS BIGINT) // 60 % 60 AS VARCHAR), 2, '0')
  || ':' || lpad(CAST(CAST(floor(value * 60) AS BIGINT) % 60 AS VARCHAR), 2, '0') END AS code FROM events""")
def timecodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.timecode(F.col("value") * 60).alias("code"))


@query("""SELECT p_partkey, round(CASE p_size % 8 WHEN 0 THEN p_size WHEN 1 THEN p_size * (96 / 72.0) WHEN 2 THEN p_size * 16 WHEN 3 THEN p_size * 96.0 WHEN 4 THEN p_size * (96 / 2.54)
  WHEN 5 THEN p_size * (96 / 25.4) WHEN 6 THEN p_size * (96 / 101.6) END, 6) AS px FROM part""")
def css_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("px", "pt", "pc", "in", "cm", "mm", "q", "em"))), (F.col("p_size") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(T.css_pixels(F.concat(F.col("p_size").cast("string"), unit)), 6).alias("px"))


@query("""SELECT c_custkey, CAST(c_custkey % 2000 AS INTEGER) AS "row", CAST(c_custkey % 16384 AS INTEGER) AS col FROM customer""")
def a1_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey") % 16384
    letter = lambda k: F.chr((k + 65).cast("long"))
    name = F.when(n < 26, letter(n)).when(n < 702, F.concat(letter(F.floor((n - 26) / 26)), letter((n - 26) % 26)))
    name = name.otherwise(F.concat(letter(F.floor((n - 702) / 676)), letter(F.floor((n - 702) / 26) % 26), letter((n - 702) % 26)))
    at = T.cell_position(F.concat(name, (F.col("c_custkey") % 2000 + 1).cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", at["row"].alias("row"), at["col"].alias("col"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '[=' || o_orderpriority || ']' WHEN o_orderstatus = 'O' THEN o_orderkey || ' [=' || o_orderpriority || ']' ELSE CAST(o_orderkey AS VARCHAR) END AS cell FROM orders""")
def formula_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    value = F.when(s != "F", F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.formula_cell(value, F.when(s.isin("F", "O"), F.col("o_orderpriority"))).alias("cell"))


@query("""SELECT doc_id, CASE WHEN size > 16384 THEN 'resource_limit' WHEN instr(body, chr(0)) > 0 THEN 'nul_bytes' WHEN size > 0 AND body = '' THEN 'empty_output' WHEN NOT regexp_matches(body, '[^\\s]') THEN 'no_text' ELSE 'ok' END AS gate,
  size FROM (SELECT doc_id, text AS body, CAST(strlen(text) AS BIGINT) AS size FROM documents)""")
def output_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, NUL, emptiness and meaning, cheapest first; the ceiling is lowered to where these tables have rows."""
    t, size = F.col("text"), F.octet_length("text").cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(T.output_gate(t, size, 16384), F.lit("ok")).alias("gate"), size.alias("size"))


@query("""SELECT DISTINCT user_id, event_type, regexp_full_match(event_type || '-' || user_id, '[A-Za-z0-9_-]+') AS division_ok,
  regexp_full_match(event_type || '.' || user_id, '[A-Za-z0-9][A-Za-z0-9._-]{0,63}') AS run_ok, regexp_full_match(props, '[A-Za-z0-9_-]+') AS props_ok FROM events""")
def name_grammars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    division, run = T.is_division(F.concat_ws("-", "event_type", "user_id")), T.is_run_id(F.concat_ws(".", "event_type", "user_id"))
    return e.select("user_id", "event_type", division.alias("division_ok"), run.alias("run_ok"), T.is_division(F.col("props")).alias("props_ok")).distinct()


# --- detection and routing -----------------------------------------------------------------------------------------

_NAMES = "CASE CAST(page_id AS BIGINT) % 8 WHEN 0 THEN 'a/b.TXT' WHEN 1 THEN '.env' WHEN 2 THEN 'x.tar.gz' WHEN 3 THEN 'logo.ai' WHEN 4 THEN 'icon.svg' WHEN 5 THEN 'noext' WHEN 6 THEN 'c.xlsx' ELSE 'd.msg' END"
_MAGIC = "CASE CAST(page_id AS BIGINT) // 8 % 5 WHEN 0 THEN NULL WHEN 1 THEN 'pdf' WHEN 2 THEN 'xml' WHEN 3 THEN 'gif' ELSE 'txt' END"
_EXT = "(VALUES ('txt','text'),('gz','gzip'),('ai','ai'),('svg','svg'),('xlsx','xlsx'),('msg','msg'),('pdf','pdf'),('xml','xml')) AS e(ext, format)"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", F.expr(_NAMES.replace("CAST(page_id AS BIGINT)", "page_id")).alias("path"), F.expr(_MAGIC.replace("CAST(page_id AS BIGINT) // 8", "(page_id div 8)")).alias("magic"))


@query(f"""WITH named AS (SELECT page_id, {_NAMES} AS path FROM pages)
SELECT page_id, path, CASE WHEN path = '.env' THEN 'env' ELSE format END AS declared FROM named LEFT JOIN {_EXT} ON lower(regexp_extract(path, '^.*[^/]\\.([^./]+)$', 1)) = ext""")
def declared_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.declared(_named(spark, sf_dir)).select("page_id", "path", "declared")


@query(f"""WITH named AS (SELECT page_id, {_NAMES} AS path, {_MAGIC} AS magic FROM pages),
known AS (SELECT page_id, path, magic, CASE WHEN path = '.env' THEN 'env' ELSE e.format END AS declared, CASE magic WHEN 'pdf' THEN 'pdf' WHEN 'xml' THEN 'xml' WHEN 'txt' THEN 'text' END AS seen
  FROM named LEFT JOIN {_EXT} ON lower(regexp_extract(path, '^.*[^/]\\.([^./]+)$', 1)) = ext)
SELECT page_id, declared, CASE WHEN seen IS NULL THEN coalesce(declared, 'unknown') WHEN (declared = 'ai' AND seen = 'pdf') OR (declared = 'svg' AND seen = 'xml') THEN declared ELSE seen END AS detected,
  seen IS NOT NULL AND declared IS NOT NULL AND declared <> seen AND NOT ((declared = 'ai' AND seen = 'pdf') OR (declared = 'svg' AND seen = 'xml')) AS format_mismatch,
  CASE WHEN magic = 'gif' THEN 'magic-format-outside-table: gif' END AS warning FROM known""")
def detection_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.resolved(_named(spark, sf_dir)).select("page_id", "declared", "detected", "format_mismatch", "warning")


@query(f"""WITH named AS (SELECT page_id, {_NAMES} AS path FROM pages),
known AS (SELECT page_id, coalesce(CASE WHEN path = '.env' THEN 'env' ELSE format END, 'unknown') AS detected FROM named LEFT JOIN {_EXT} ON lower(regexp_extract(path, '^.*[^/]\\.([^./]+)$', 1)) = ext)
SELECT detected, CASE WHEN detected IN ('text', 'env', 'svg', 'xml') THEN 'text-passthrough' WHEN detected IN ('pdf', 'ai') THEN 'pdf-subprocess' WHEN detected = 'xlsx' THEN 'workbook-ir' END AS converter_id,
  CASE detected WHEN 'gzip' THEN 'container-deferred' WHEN 'msg' THEN 'no-converter' WHEN 'unknown' THEN 'no-converter' END AS reason, count(*) AS n FROM known GROUP BY ALL""")
def route_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = render.declared(_named(spark, sf_dir)).withColumn("detected", F.coalesce("declared", F.lit("unknown")))
    return render.routed(found).groupBy("detected", "converter_id", "reason").agg(F.count(F.lit(1)).alias("n"))


# --- deduplication -------------------------------------------------------------------------------------------------


@query(f"""WITH {SOURCES} SELECT source_path, CASE WHEN nth = 1 THEN 'converted' ELSE 'dedup' END AS status, CASE WHEN nth > 1 THEN owner END AS dedup_of
FROM (SELECT source_path, row_number() OVER w AS nth, first_value(source_path) OVER w AS owner FROM sources WINDOW w AS (PARTITION BY source_hash ORDER BY string_split(source_path, '/')))""")
def dedup_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources(spark, sf_dir).select("source_hash", "source_path", F.split("source_path", "/").alias("ord"), F.lit("text-passthrough").alias("converter"))
    return dedup.one_converter(rows).select("source_path", "status", "dedup_of")


_ROUTED = "CASE WHEN source IN ('src0', 'src2', 'src4', 'src6', 'src8') THEN 'a' ELSE 'b' END"


@query(f"""WITH {SOURCES}, routed AS (SELECT source_hash, source_path, doc_id AS ord, {_ROUTED} AS converter FROM sources),
marked AS (SELECT *, coalesce(lag(converter) OVER w = converter, false) AS borrows FROM routed WINDOW w AS (PARTITION BY source_hash ORDER BY ord)),
numbered AS (SELECT *, sum(CASE WHEN borrows THEN 0 ELSE 1 END) OVER (PARTITION BY source_hash ORDER BY ord) AS island FROM marked)
SELECT source_path, CASE WHEN borrows THEN 'dedup' ELSE 'converted' END AS status, CASE WHEN borrows THEN first_value(source_path) OVER (PARTITION BY source_hash, island ORDER BY ord) END AS dedup_of FROM numbered""")
def dedup_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources(spark, sf_dir).select("source_hash", "source_path", F.col("doc_id").alias("ord"), F.expr(_ROUTED).alias("converter"))
    return dedup.dedup_islands(rows, kept(spark, "islands").store).select("source_path", "status", "dedup_of")


@query(f"""WITH {SOURCES}, rows AS (SELECT source_hash, source_path, doc_id AS ord, {_ROUTED} AS converter FROM sources),
seeds AS (SELECT source_hash, source_path, -1 AS ord, converter, true AS seed FROM rows WHERE converter = 'b' QUALIFY row_number() OVER (PARTITION BY source_hash ORDER BY source_path) = 1),
both_ AS (SELECT *, false AS seed FROM rows UNION ALL SELECT source_hash, source_path, ord, converter, seed FROM seeds),
marked AS (SELECT *, NOT seed AND coalesce(lag(converter) OVER (PARTITION BY source_hash ORDER BY ord) = converter, false)
  AND coalesce(max(CASE WHEN seed THEN source_path END) OVER (PARTITION BY source_hash) <> source_path, true) AS borrows FROM both_),
numbered AS (SELECT *, sum(CASE WHEN borrows THEN 0 ELSE 1 END) OVER (PARTITION BY source_hash ORDER BY ord) AS island FROM marked),
named AS (SELECT *, first_value(source_path) OVER (PARTITION BY source_hash, island ORDER BY ord) AS owner FROM numbered)
SELECT source_path, CASE WHEN borrows THEN 'dedup' ELSE 'converted' END AS status, CASE WHEN borrows THEN owner END AS dedup_of FROM named WHERE NOT seed""")
def dedup_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources(spark, sf_dir).select("source_hash", "source_path", F.col("doc_id").alias("ord"), F.expr(_ROUTED).alias("converter"))
    return dedup.seeded(rows, rows.where("converter = 'b'"), kept(spark, "seeded").store).select("source_path", "status", "dedup_of")


@query(f"""WITH {SOURCES} SELECT division, count(*) AS sources, count(DISTINCT source_hash) AS contents FROM sources GROUP BY division""")
def dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.content_counts(sources(spark, sf_dir), "division")


_PLACED = f"""placed AS (SELECT doc_id, CASE doc_id % 50 WHEN 0 THEN 'd/' || CAST(doc_id // 50 AS VARCHAR) WHEN 1 THEN 'd/' || CAST(doc_id // 50 AS VARCHAR) || '.txt/x'
  WHEN 2 THEN 'd/' || CAST(doc_id // 50 AS VARCHAR) || '.txt/x.segments.jsonl/y' ELSE 'e/' || source || '/' || doc_id END AS source_path, sha256(text) AS source_hash, {_ROUTED} AS converter, strlen(text) AS size FROM documents)"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources, some where the artifact of another is a file or a folder; some contents convert to nothing, some are only recovered."""
    g = F.floor(F.col("doc_id") / 50).cast("string")
    at = F.element_at(F.array(F.concat(F.lit("d/"), g), F.concat(F.lit("d/"), g, F.lit(".txt/x")), F.concat(F.lit("d/"), g, F.lit(".txt/x.segments.jsonl/y"))), F.least(F.col("doc_id") % 50, F.lit(2)).cast("int") + 1)
    path = F.when(F.col("doc_id") % 50 > 2, F.concat(F.lit("e/"), "source", F.lit("/"), F.col("doc_id").cast("string"))).otherwise(at)
    rows = table(spark, sf_dir, "documents").select("doc_id", path.alias("source_path"), F.sha2("text", 256).alias("source_hash"), F.expr(_ROUTED).alias("converter"), F.octet_length("text").alias("size"))
    recorded = F.when(F.col("size") % 13 != 0, F.when((F.col("size") % 7 == 0) & (F.col("converter") == "b"), "b-recovered").otherwise(F.col("converter")))
    return rows.withColumn("recorded", recorded).withColumn("ord", F.split("source_path", "/"))


@query(f"""WITH {_PLACED}, ok AS (SELECT *, size % 13 <> 0 AS fine, doc_id // 50 AS g, doc_id % 50 AS r, CASE WHEN size % 7 = 0 AND converter = 'b' THEN 'b-recovered' ELSE converter END AS recorded FROM placed),
chain AS (SELECT g, coalesce(bool_or(r = 0 AND fine), false) AS w0, coalesce(bool_or(r = 1 AND fine), false) AND NOT coalesce(bool_or(r = 0 AND fine), false) AS w1 FROM ok WHERE r < 3 GROUP BY g),
judged AS (SELECT ok.*, coalesce(CASE r WHEN 1 THEN w0 WHEN 2 THEN w0 OR w1 END, false) AS taken FROM ok LEFT JOIN chain USING (g)),
seeds AS (SELECT source_hash, min('old/' || doc_id) AS source_path FROM placed WHERE doc_id % 7 = 3 AND doc_id % 2 = 0 GROUP BY source_hash),
lined AS (SELECT source_path, source_hash, converter, recorded, 1 AS late FROM judged WHERE fine AND NOT taken UNION ALL SELECT source_path, source_hash, 'a', 'a', 0 FROM seeds),
marked AS (SELECT *, late = 1 AND coalesce(lag(converter) OVER w = converter, false) AS borrows FROM lined WINDOW w AS (PARTITION BY source_hash ORDER BY late, string_split(source_path, '/'))),
numbered AS (SELECT *, sum(CASE WHEN borrows THEN 0 ELSE 1 END) OVER (PARTITION BY source_hash ORDER BY late, string_split(source_path, '/')) AS island FROM marked),
named AS (SELECT *, first_value(source_path) OVER (PARTITION BY source_hash, island ORDER BY late, string_split(source_path, '/')) AS owner FROM numbered),
own AS (SELECT source_path, CASE WHEN borrows AND recorded = converter THEN 'dedup' ELSE 'converted' END AS status, CASE WHEN borrows AND recorded = converter THEN owner END AS dedup_of, CAST(NULL AS VARCHAR) AS error FROM named WHERE late = 1
  UNION ALL SELECT source_path, 'failed', NULL, CASE WHEN fine THEN 'mirror_write_error' ELSE 'empty_output' END FROM judged WHERE NOT fine OR taken)
SELECT source_path, status, dedup_of, error FROM own
UNION ALL SELECT source_path || '.d/#image-metadata', 'converted', NULL, NULL FROM judged WHERE size % 5 = 0""")
def borrowed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is written, who borrows and who fails among documents as sources, with failed conversions, taken places, seeds of which half are damaged, and children."""
    rows = _placed(spark, sf_dir)
    store = kept(spark, "borrowed").store
    lost = outcomes.blocked(rows.where("recorded is not null").select("source_path", "ord"), store).withColumn("taken", F.lit("Not a directory"))
    prior = table(spark, sf_dir, "documents").where("doc_id % 7 = 3").select(F.sha2("text", 256).alias("source_hash"), F.concat(F.lit("old/"), F.col("doc_id").cast("string")).alias("source_path"), F.lit("a").alias("converter"), (F.col("doc_id") % 2 == 0).alias("intact"))
    done = outcomes.assigned(rows.join(lost, "source_path", "left"), prior.where("intact").drop("intact"), store)
    error = F.when(F.col("status") == "failed", F.when(F.col("recorded").isNull(), "empty_output").otherwise("mirror_write_error"))
    beside = rows.where("size % 5 = 0").select("source_hash", F.lit("png").alias("key"), F.lit(".d/#image-metadata").alias("suffix")).distinct()
    child = outcomes.children(rows.withColumn("key", F.lit("png")).withColumn("parent_source", F.lit(None).cast("string")), beside)
    none = F.lit(None).cast("string")
    return done.select("source_path", "status", "dedup_of", error.alias("error")).unionByName(child.select("source_path", F.lit("converted").alias("status"), none.alias("dedup_of"), none.alias("error")))


@query(f"""WITH m AS (SELECT source || '.zip' AS root, doc_id AS nth, source || '.zip.d/' || doc_id || '.txt' AS source_path, sha256(text) AS source_hash FROM documents),
loose AS (SELECT 'loose/' || doc_id || '.txt' AS root, 0 AS nth, 'loose/' || doc_id || '.txt' AS source_path, sha256(text) AS source_hash FROM documents WHERE lang = 'fr'),
u AS (SELECT * FROM m UNION ALL SELECT * FROM loose)
SELECT source_path, CASE WHEN k = 1 THEN 'converted' ELSE 'dedup' END AS status, CASE WHEN k > 1 THEN owner END AS dedup_of
FROM (SELECT source_path, row_number() OVER w AS k, first_value(source_path) OVER w AS owner FROM u WINDOW w AS (PARTITION BY source_hash ORDER BY string_split(root, '/'), nth))""")
def members_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as members of ten archives, and some as sources beside them: a content is converted once, for the first in walk order wherever it stands."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("source_hash"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"))
    inside = d.select("source_hash", F.concat("source", F.lit(".zip")).alias("root"), F.col("doc_id").cast("int").alias("nth"), F.concat("source", F.lit(".zip.d/"), "name").alias("source_path"))
    loose = d.where("lang = 'fr'").select("source_hash", F.concat(F.lit("loose/"), "name").alias("root"), F.lit(0).alias("nth"), F.concat(F.lit("loose/"), "name").alias("source_path"))
    units = inside.unionByName(loose).withColumn("ord", outcomes.order_of(F.split("root", "/"), F.col("nth"))).withColumns({"converter": F.lit("text-passthrough"), "recorded": F.lit("text-passthrough"), "taken": F.lit(None).cast("string")})
    return outcomes.assigned(units, units.select("source_hash", "source_path", "converter").limit(0), kept(spark, "members").store).select("source_path", "status", "dedup_of")


@query("""SELECT lang || '/' || source || '/' || doc_id AS source_path, 'converted' AS status, sha256(text) AS text_hash, CAST(strlen(text) AS BIGINT) AS text_bytes, sha256('{}' || chr(10)) AS sidecar_hash FROM documents""")
def mirror_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written through the committing sink, with their manifest lines, and read back from mirror and manifest."""
    from quillspark.plans.run import lines_of
    from quillspark.sources import mirror, shard

    base = shared_folder(spark, "mirror")
    path = F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    d = table(spark, sf_dir, "documents").select(path.alias("source_path"), "text")
    fields = {"source_hash": F.sha2("text", 256), "source_size": F.octet_length("text").cast("long"), "detected_format": F.lit("text"), "format_mismatch": F.lit(False), "status": F.lit("converted"), "text_hash": F.sha2("text", 256)}
    fields |= {"text_path": F.concat(F.lit("d/"), "source_path", F.lit(".txt")), "converter_id": F.lit("text-passthrough"), "rules_version": F.lit(formats.RULES_VERSION), "warnings": F.expr("cast(array() as array<string>)")}
    records = d.select(F.split("source_path", "/").alias("ord"), "source_path", *(fields.get(f, F.lit(None).cast(k)).alias(f) for f, k in shard.RECORD.items() if f != "source_path"))
    change = mirror.Transaction(spark, base, f"{base}/d.jsonl", "d")
    change.stage(d.select(F.concat(F.lit("d/"), "source_path").alias("target"), F.col("text").cast("binary").alias("text"), F.lit(b"{}\n").alias("sidecar")), lines_of(records))
    change.publish()
    found = shard.read(spark, f"{base}/d.jsonl", "d")[0].select("source_path", "status", "text_path", "text_hash")
    return mirror.read_back(found, base).select("source_path", "status", "text_hash", "text_bytes", "sidecar_hash")


# --- manifest ------------------------------------------------------------------------------------------------------


@query(f"WITH {RUN_LOG} SELECT division, source_path, line_no, status, dedup_of, text_path FROM terminal")
def terminal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.terminal(run_log(spark, sf_dir)).select("division", "source_path", "line_no", "status", "dedup_of", "text_path")


@query(f"""WITH {RUN_LOG} SELECT division, count(*) AS sources, count(*) FILTER (bearing) AS with_text, round(count(*) FILTER (bearing) / count(*), 9) AS coverage, {STATUS_SQL} FROM terminal GROUP BY division""")
def coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.coverage(run_log(spark, sf_dir)).withColumn("coverage", F.round("coverage", 9))


@query(f"WITH {RUN_LOG} SELECT run, {STATUS_SQL}, count(*) AS total FROM run_log GROUP BY run")
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.status_counts(run_log(spark, sf_dir), "run")


@query(f"WITH {RUN_LOG} SELECT division, {STATUS_SQL}, count(*) AS total FROM run_log GROUP BY division")
def bundle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.counts_and_coverage(run_log(spark, sf_dir)).drop("covered", "sources")


@query(f"WITH {RUN_LOG} SELECT division, count(*) FILTER (bearing) AS covered, count(*) AS sources FROM terminal GROUP BY division")
def bundle_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.counts_and_coverage(run_log(spark, sf_dir)).select("division", "covered", "sources")


@query(f"""WITH {RUN_LOG} SELECT c.source_path, p.status IN ('converted', 'dedup', 'skipped_unchanged') AND c.source_hash = p.source_hash AS skip
FROM (SELECT * FROM run_log WHERE run = 2) c JOIN one p USING (source_path)""")
def checkpoint_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = run_log(spark, sf_dir)
    return manifest.checkpoint(log.where("run = 2").drop("status"), log.where("run = 1")).select("source_path", "skip")


_MEMBERS = """members AS (SELECT doc_id, lang, n_chars, 'zips/' || source || '.zip' AS top, 'zips/' || source || '.zip.d/' || CASE doc_id % 4 WHEN 0 THEN doc_id || '.txt' WHEN 1 THEN 'conf.d/' || doc_id || '.txt'
  WHEN 2 THEN 'in.zip.d/' || doc_id || '.txt' ELSE 'in.zip.d/x.d/deep.eml.d/' || doc_id || '.txt' END AS source_path FROM documents)"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as members of archives: at their top, in a folder that ends like a member's, in nested archives, and in mail in these."""
    top = F.concat(F.lit("zips/"), "source", F.lit(".zip"))
    inner = F.element_at(F.array(*map(F.lit, ("", "conf.d/", "in.zip.d/", "in.zip.d/x.d/deep.eml.d/"))), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat(top, F.lit(".d/"), inner, F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", top.alias("top"), path.alias("source_path"))


@query(f"""WITH {_MEMBERS} SELECT source_path, 'failed' AS status, 'container-member-removed' AS error FROM members
WHERE lang IN ('en', 'fr') AND n_chars % 3 = 0 AND n_chars % 5 <> 0 AND top IN (SELECT top FROM members WHERE lang = 'de' AND n_chars > 2000)""")
def reconcile_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of archives that some run expanded again, at any depth, of which it emitted fewer; every fifth was retired before."""
    m = _members(spark, sf_dir)
    retired = F.when(F.col("n_chars") % 5 == 0, "container-member-removed")
    prior = m.where("lang in ('en', 'fr')").select(F.col("lang").alias("division"), "source_path", F.col("top").alias("parent_source"), F.lit("txt").alias("declared_format"), retired.alias("error"))
    gone = manifest.removed_members(prior, m.where("lang = 'de' and n_chars > 2000").select(F.col("top").alias("source_path")), m.where("n_chars % 3 <> 0"))
    return gone.select("source_path", "status", "error")


@query(f"""WITH {_MEMBERS}, roots AS (SELECT DISTINCT top AS root FROM members WHERE lang = 'fr' UNION SELECT DISTINCT top || '.d/in.zip' FROM members WHERE lang = 'de')
SELECT doc_id, root FROM members, roots WHERE starts_with(source_path, root || '.d/')""")
def descendants_of_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level archives and nested ones as roots; folders such as ``conf.d`` are none."""
    m = _members(spark, sf_dir)
    nested = m.where("lang = 'de'").select(F.concat("top", F.lit(".d/in.zip")).alias("source_path"))
    roots = m.where("lang = 'fr'").select(F.col("top").alias("source_path")).unionByName(nested)
    return manifest.descendants(m, roots).select("doc_id", "root")


@query(f"""WITH {_MEMBERS}, tops AS (SELECT DISTINCT top FROM members) SELECT top AS source_path, NOT EXISTS (SELECT 1 FROM members m WHERE starts_with(m.source_path, tops.top || '.d/') AND n_chars % 17 = 0) AS intact FROM tops""")
def intact_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all that stands below an archive is intact; every seventeenth size stands for a damaged member."""
    m = _members(spark, sf_dir)
    every = manifest.whole(m.select("source_path", (F.col("n_chars") % 17 != 0).alias("intact")))
    return every.join(m.select(F.col("top").alias("source_path")).distinct(), "source_path", "left_semi")


@query("""SELECT division, source_path, line_no - min(line_no) OVER (PARTITION BY division) AS line_no, status, error FROM (SELECT lang AS division, 'd/' || doc_id || '.txt' AS source_path,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS line_no, CASE WHEN n_chars < 500 THEN 'failed' ELSE 'converted' END AS status, CASE WHEN n_chars < 500 THEN 'empty_output' END AS error FROM documents)""")
def shard_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' records written as shards, one for each language, each with a torn last line, and read back."""
    from quillspark.sources import shard

    failed = F.col("n_chars") < 500
    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    text = F.when(~failed, F.concat("lang", F.lit("/"), path, F.lit(".txt")))
    fields = {
        "schema": F.lit(shard.SCHEMA), "source_path": path, "source_hash": F.md5("text"), "source_size": F.octet_length("text"), "detected_format": F.lit("text"), "format_mismatch": F.lit(False),
        "status": F.when(failed, "failed").otherwise("converted"), "text_path": text, "text_hash": F.when(~failed, F.md5("text")), "rules_version": F.lit("10"), "error": F.when(failed, "empty_output"),
    }
    d = table(spark, sf_dir, "documents")
    lines = d.select("lang", "doc_id", F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))).alias("value"))
    # each language's lines in a folder of files, written and ended by executors; the order of the files is that of the lines
    base = shared_folder(spark, "shards")
    ranged = lines.repartitionByRange("lang", "doc_id").sortWithinPartitions("lang", "doc_id").select("lang", "value")
    ranged.write.partitionBy("lang").text(f"{base}/whole", lineSep="\n")
    out = None
    for lang in sorted(n.removeprefix("lang=") for n in os.listdir(f"{base}/whole") if n.startswith("lang=")):
        path = f"{base}/{lang}.jsonl"
        shard.joined(f"{base}/whole/lang={lang}", path, b'{"schema":"torn')
        frame = shard.read(spark, path, lang)[0]
        out = frame if out is None else out.unionByName(frame)
    place = Scan(out.select("division", "source_path", "line_no", "status", "error"), ["division"], ["line_no"], kept(spark, "shard-read").store).sum("place", F.lit(1).cast("long")).rows
    return place.select("division", "source_path", (F.col("place") - 1).alias("line_no"), "status", "error")


@query("""SELECT DISTINCT source || '.zip' AS source_path FROM documents WHERE source IN (SELECT source FROM documents WHERE lang = 'de')""")
def namespace_occupied(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    walked = d.where("lang = 'de'").select(F.concat("source", F.lit(".zip.d/"), F.col("doc_id").cast("string"), F.lit("/x.txt")).alias("source_path"))
    return manifest.occupied(d.select(F.concat("source", F.lit(".zip")).alias("source_path")).distinct(), walked)


@query(f"WITH {RUN_LOG} SELECT division, line_no, status, source_hash FROM run_log WHERE source_path = (SELECT min(source_path) FROM sources)")
def explain_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sources(spark, sf_dir).agg(F.min("source_path")).first()[0]
    return manifest.history(run_log(spark, sf_dir), path).select("division", "line_no", "status", "source_hash")


@query(f"""WITH {RUN_LOG}, ends AS (SELECT division, min(source_path) AS low, max(source_path) AS high FROM sources GROUP BY division)
SELECT division, source_path, run, status, source_hash, text_path FROM run_log JOIN ends USING (division) WHERE source_path IN (low, high)""")
def indexed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log indexed in two generations, and the records of each division's first and last source looked up in the index."""
    from quillspark.sources import index, shard

    base = shared_folder(spark, "index")
    log = kept(spark, "log").store(run_log(spark, sf_dir).withColumn("span", F.col("run").cast("long")), "log")
    own = {f: F.col(f) if f in log.columns else F.lit(None).cast(k) for f, k in shard.RECORD.items()}
    for n in (1, 2):
        for division in [r[0] for r in log.select("division").distinct().orderBy("division").collect()]:  # a handful
            one = log.where((F.col("run") == n) & (F.col("division") == division)).select(*(c.alias(f) for f, c in own.items()), "line_no", "span")
            index.written(one, f"{base}/division={division}/generation={n}")
    ends = [v for r in sources(spark, sf_dir).groupBy("division").agg(F.min("source_path"), F.max("source_path")).collect() for v in r[1:]]
    found = spark.read.schema(index.FRAME).parquet(base).where(F.col("source_path").isin(*ends))
    return found.select("division", "source_path", F.col("span").cast("int").alias("run"), "status", "source_hash", "text_path")


@query(f"""WITH {RUN_LOG}, damaged AS (SELECT doc_id, run, CASE WHEN source_size < 400 THEN 'failed' ELSE status END AS status, CASE WHEN source_size > 9000 THEN NULL ELSE text_path END AS text_path, text_hash, dedup_of, error FROM run_log)
SELECT doc_id, run, CASE WHEN status IN ('converted', 'dedup', 'skipped_unchanged') AND (text_path IS NULL OR text_hash IS NULL) THEN 'text missing'
  WHEN status IN ('converted', 'dedup', 'skipped_unchanged') AND error IS NOT NULL THEN 'error beside text'
  WHEN status NOT IN ('converted', 'dedup', 'skipped_unchanged') AND (text_path IS NOT NULL OR text_hash IS NOT NULL) THEN 'text without conversion'
  WHEN status = 'dedup' AND dedup_of IS NULL THEN 'dedup_of missing' WHEN status = 'failed' AND error IS NULL THEN 'error missing' END AS broken FROM damaged""")
def record_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = run_log(spark, sf_dir).withColumns({"status": F.when(F.col("source_size") < 400, "failed").otherwise(F.col("status")), "text_path": F.when(F.col("source_size") <= 9000, F.col("text_path"))})
    return log.select("doc_id", "run", manifest.invariant_broken(log).alias("broken"))


_STEMS = """stems AS (SELECT 'p/' || doc_id AS source_path, CASE WHEN doc_id % 97 = 1 THEN 'p/' || (doc_id + 1) WHEN doc_id % 97 = 2 THEN 'p/' || (doc_id - 1) WHEN doc_id % 41 = 0 THEN 'gone/' || doc_id WHEN doc_id % 7 = 0 OR doc_id < 3 THEN NULL
  WHEN doc_id % 5 = 0 THEN 'p/' || (doc_id - 1) ELSE 'p/' || (doc_id // 3) END AS parent_source, CASE WHEN doc_id % 11 = 0 THEN 'same' ELSE sha256(text) END AS source_hash FROM documents)"""


@query(f"""WITH RECURSIVE {_STEMS},
up AS (SELECT source_path, source_path AS here, parent_source AS nxt, CAST([] AS VARCHAR[]) AS chain, [source_path] AS way, false AS circle FROM stems
  UNION ALL SELECT up.source_path, s.source_path, s.parent_source, list_append(chain, s.source_hash), list_append(way, s.source_path), list_contains(way, s.source_path) FROM up JOIN stems s ON s.source_path = up.nxt WHERE NOT circle),
ends AS (SELECT up.*, s.source_path IS NULL AS over FROM up LEFT JOIN stems s ON s.source_path = up.nxt)
SELECT e.source_path, CASE WHEN NOT circle THEN here END AS root, CASE WHEN NOT circle THEN CAST(len(chain) AS BIGINT) END AS depth, CASE WHEN NOT circle THEN sha256(array_to_string(chain, ',')) END AS ancestors,
  CASE WHEN circle THEN 'cycle' WHEN list_contains(chain, source_hash) THEN 'recursive' WHEN nxt IS NOT NULL THEN 'orphan' ELSE 'ok' END AS state FROM ends e JOIN stems USING (source_path) WHERE circle OR over""")
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records with parents: deep chains, missing parents, records that hold themselves, circles."""
    k = F.col("doc_id")
    path = lambda c: F.concat(F.lit("p/"), c.cast("string"))
    parent = F.when(k % 97 == 1, path(k + 1)).when(k % 97 == 2, path(k - 1)).when(k % 41 == 0, F.concat(F.lit("gone/"), k.cast("string"))).when((k % 7 == 0) | (k < 3), F.lit(None).cast("string")).when(k % 5 == 0, path(k - 1)).otherwise(path(F.floor(k / 3)))
    rows = table(spark, sf_dir, "documents").select(path(k).alias("source_path"), parent.alias("parent_source"), F.when(k % 11 == 0, "same").otherwise(F.sha2("text", 256)).alias("source_hash"))
    found = lineages.lineage(rows, kept(spark, "lineage").store)
    return found.select("source_path", "root", "depth", F.sha2(F.array_join("ancestors", ","), 256).alias("ancestors"), "state")


# --- containers ----------------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT source AS root, doc_id AS ord, lang || '/' || (CASE WHEN n_chars > 1500 THEN 'A' ELSE 'a' END) || CAST(n_chars // 100 AS VARCHAR) AS path FROM documents),
c AS (SELECT *, row_number() OVER (PARTITION BY root, lower(path) ORDER BY ord) = 1 AS claimed FROM m)
SELECT root, ord, path, claimed, CASE WHEN claimed THEN root || '.d/' || path ELSE root || '.d/#collision-' || CAST(sum(CASE WHEN claimed THEN 0 ELSE 1 END) OVER (PARTITION BY root ORDER BY ord) AS BIGINT) END AS child_path FROM c""")
def member_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.when(F.col("n_chars") > 1500, "A").otherwise("a")
    path = F.concat("lang", F.lit("/"), stem, F.floor(F.col("n_chars") / 100).cast("string"))
    return manifest.claims(table(spark, sf_dir, "documents").select(F.col("source").alias("root"), F.col("doc_id").alias("ord"), path.alias("path")), kept(spark, "claims").store)


@query("""SELECT root, ord, CAST(total AS BIGINT) AS total, total <= 50000 AS fits FROM (SELECT source AS root, doc_id AS ord, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id) AS total FROM documents)""")
def expansion_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("root"), F.col("doc_id").alias("ord"), F.octet_length("text").cast("long").alias("size"))
    return manifest.expansion_budget(d, 50_000, kept(spark, "budget").store).select("root", "ord", "total", "fits")


# --- bundles -------------------------------------------------------------------------------------------------------


@query(f"""WITH {RUN_LOG}, listed AS (SELECT text_path AS path, text_hash AS hash FROM run_log WHERE run = 1 AND bearing), tree AS (SELECT text_path AS path, text_hash AS hash FROM run_log WHERE run = 2 AND bearing AND source_size < 9000)
SELECT path, CASE WHEN tree.hash IS NULL THEN 'missing' WHEN listed.hash IS NULL THEN 'unlisted' WHEN tree.hash <> listed.hash THEN 'mismatch' ELSE 'ok' END AS state FROM listed FULL JOIN tree USING (path)""")
def checksum_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = run_log(spark, sf_dir).where(manifest.has_text(F.col("status"))).select("run", "source_size", F.col("text_path").alias("path"), F.col("text_hash").alias("hash"))
    return render.compared(log.where("run = 1").select("path", "hash"), log.where("run = 2 and source_size < 9000").select("path", "hash"))


@query(f"""WITH {RUN_LOG}, tree AS (SELECT text_path AS path, source_hash AS hash FROM run_log WHERE run = 1 AND bearing AND source_size % 11 <> 0)
SELECT source_path, text_path, CASE WHEN path IS NULL THEN 'missing' WHEN hash <> text_hash THEN 'differs' ELSE 'ok' END AS state FROM (SELECT * FROM terminal WHERE bearing) r LEFT JOIN tree ON path = text_path""")
def record_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = run_log(spark, sf_dir)
    tree = log.where((F.col("run") == 1) & manifest.has_text(F.col("status")) & (F.col("source_size") % 11 != 0)).select(F.col("text_path").alias("path"), F.col("source_hash").alias("hash"))
    return bundles.artifact_states(manifest.terminal(log), tree)


_TREE = """files AS (SELECT DISTINCT regexp_replace(text_path, '\\.txt$', '') || e AS path FROM run_log, (VALUES ('.txt'), ('.segments.jsonl'), ('.review.md'), ('.bak')) AS x(e) WHERE bearing)"""


@query(f"""WITH {RUN_LOG}, {_TREE}, kept AS (SELECT regexp_replace(text_path, '\\.txt$', '') AS stem FROM terminal WHERE bearing AND source_size > 1000)
SELECT path FROM files WHERE suffix(path, '.bak') OR regexp_replace(path, '\\.(txt|segments\\.jsonl|review\\.md)$', '') NOT IN (SELECT stem FROM kept)""")
def unreferenced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = run_log(spark, sf_dir)
    ends = F.array(*map(F.lit, (".txt", ".segments.jsonl", ".review.md", ".bak")))
    files = log.where("text_path is not null").select(F.regexp_replace("text_path", r"\.txt$", "").alias("stem"), F.explode(ends).alias("e"))
    tree = files.select(F.concat("stem", "e").alias("path")).distinct()
    return bundles.unreferenced(tree, manifest.terminal(log).where("source_size > 1000"))


@query(f"""WITH {RUN_LOG}, moved AS (SELECT source_path, division, CASE WHEN source_size % 7 = 0 THEN 'xx/' || source_path || '.txt' WHEN source_size % 7 = 1 THEN replace(text_path, '/documents/', '/../') ELSE text_path END AS text_path FROM terminal)
SELECT source_path FROM moved WHERE text_path IS NOT NULL AND text_path <> division || '/' || source_path || '.txt'""")
def misplaced_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    last, size = manifest.terminal(run_log(spark, sf_dir)), F.col("source_size") % 7
    path = F.when(size == 0, F.concat(F.lit("xx/"), "source_path", F.lit(".txt"))).when(size == 1, F.replace(F.col("text_path"), F.lit("/documents/"), F.lit("/../"))).otherwise(F.col("text_path"))
    return bundles.misplaced(last.withColumn("text_path", path)).select("source_path")


@query("""WITH folded AS (SELECT translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS fold, path FROM (SELECT DISTINCT (CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END) || '/' || source || CAST(doc_id // 2 AS VARCHAR) AS path FROM documents
  UNION SELECT DISTINCT (CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang END) || '/' || source || CAST(doc_id // 2 AS VARCHAR) FROM documents))
SELECT fold, array_to_string(list_sort(list(path)), '|') AS paths FROM folded GROUP BY fold HAVING count(*) > 1""")
def collision_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    named = lambda k: d.select(F.concat(F.when(F.col("doc_id") % k == 0, F.upper("lang")).otherwise(F.col("lang")), F.lit("/"), "source", F.floor(F.col("doc_id") / 2).cast("string")).alias("text_path"))
    return manifest.collisions(named(2).unionByName(named(3))).select("fold", F.array_join("paths", "|").alias("paths"))


@query("""SELECT translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS fold, count(*) AS inputs, array_to_string(list_sort(list(DISTINCT name)), '|') AS names
FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'Div' ELSE 'div' END || CAST(doc_id // 3 AS VARCHAR) AS name FROM documents) GROUP BY 1 HAVING count(*) > 1""")
def division_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, "Div").otherwise("div"), F.floor(F.col("doc_id") / 3).cast("string"))
    return bundles.folded_collisions(table(spark, sf_dir, "documents").select(name.alias("name"))).withColumn("names", F.array_join("names", "|"))


@query(f"""WITH {RUN_LOG}, a AS (SELECT division, {STATUS_SQL} FROM run_log WHERE run = 1 GROUP BY division), b AS (SELECT division, {STATUS_SQL} FROM run_log WHERE run = 2 GROUP BY division)
SELECT division, field, recorded, found, coalesce(recorded <> found, true) AS differs FROM (SELECT division, unnest(['converted', 'failed', 'unsupported', 'skipped_unchanged', 'dedup']) AS field,
  unnest([a.converted, a.failed, a.unsupported, a.skipped_unchanged, a.dedup]) AS recorded, unnest([b.converted, b.failed, b.unsupported, b.skipped_unchanged, b.dedup]) AS found FROM a FULL JOIN b USING (division))""")
def counts_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = run_log(spark, sf_dir)
    return render.counts_compared(manifest.status_counts(log.where("run = 1"), "division"), manifest.status_counts(log.where("run = 2"), "division"))


_LISTED = """listed AS (SELECT CAST(o_orderkey AS BIGINT) AS place, 'o/' || lpad(CAST(CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey - 3 WHEN o_orderkey % 101 = 0 THEN greatest(o_orderkey - 1, 1) ELSE o_orderkey END AS VARCHAR), 12, '0') AS path FROM orders)"""


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checksum list as it is given: places and paths, with inversions and repeated paths planted."""
    k = F.col("o_orderkey")
    shown = F.when(k % 97 == 0, k - 3).when(k % 101 == 0, F.greatest(k - 1, F.lit(1))).otherwise(k)
    return table(spark, sf_dir, "orders").select(k.cast("long").alias("place"), F.concat(F.lit("o/"), F.lpad(shown.cast("string"), 12, "0")).alias("path"))


@query(f"WITH {_LISTED} SELECT place, path, coalesce(path > lag(path) OVER (ORDER BY place), true) AS rising FROM listed")
def checksum_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.order_breaks(_listed(spark, sf_dir), "place", "path", kept(spark, "order").store)


@query(f"""WITH {_LISTED}, judged AS (SELECT place, coalesce(path > lag(path) OVER (ORDER BY place), true) AS rising FROM listed)
SELECT CAST(place // 1000 AS BIGINT) AS part, count(*) AS n, count(*) FILTER (NOT rising) AS breaks, min(place) FILTER (NOT rising) AS first_break FROM judged GROUP BY ALL""")
def checksum_list_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks of a list's order in each thousand of its places, the first of each named."""
    seen = render.order_breaks(_listed(spark, sf_dir), "place", "path", kept(spark, "list-order").store)
    return seen.groupBy(F.expr("place div 1000").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("rising")).alias("breaks"), F.min(F.when(~F.col("rising"), F.col("place"))).alias("first_break"))


@query("""SELECT hash, path FROM (SELECT md5(text) AS hash, lang || '/' || source AS path FROM documents WHERE lang IN ('en', 'fr') UNION SELECT md5(text), lang || '/' || source FROM documents WHERE lang IN ('fr', 'de') UNION SELECT md5(text), lang || '/' || source FROM documents WHERE n_chars > 3000)""")
def merge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "n_chars", F.md5("text").alias("hash"), F.concat_ws("/", "lang", "source").alias("path"))
    return bundles.merged([d.where(w).select("hash", "path") for w in ("lang in ('en', 'fr')", "lang in ('fr', 'de')", "n_chars > 3000")])


@query("""SELECT o_custkey, count(DISTINCT md5(o_orderstatus)) AS versions, count(DISTINCT md5(o_orderstatus)) = 1 AS agree FROM orders GROUP BY o_custkey""")
def rules_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order states as rules snapshots of bundles; a customer's orders are the inputs of a merge."""
    return bundles.rules_agreement(table(spark, sf_dir, "orders").select("o_custkey", F.md5("o_orderstatus").alias("hash")), "o_custkey")


# --- agreement and rendering ---------------------------------------------------------------------------------------

_NORM = "trim(regexp_replace(nfc_normalize({0}), '\\s+', ' ', 'g'))"
_TOKENS = f"""pairs AS (SELECT d.doc_id, {_NORM.format('d.text')} AS a, {_NORM.format("replace(replace(d.text, '. ', ' '), ',', '')")} AS b FROM documents d),
ta AS (SELECT doc_id, t, count(*) AS c FROM (SELECT doc_id, unnest(string_split(a, ' ')) AS t FROM pairs) WHERE t <> '' GROUP BY ALL),
tb AS (SELECT doc_id, t, count(*) AS c FROM (SELECT doc_id, unnest(string_split(b, ' ')) AS t FROM pairs) WHERE t <> '' GROUP BY ALL),
sums AS (SELECT doc_id, sum(least(coalesce(ta.c, 0), coalesce(tb.c, 0))) AS both_, sum(coalesce(ta.c, 0) + coalesce(tb.c, 0)) AS all_ FROM ta FULL JOIN tb USING (doc_id, t) GROUP BY doc_id),
scored AS (SELECT doc_id, CASE WHEN coalesce(all_, 0) = 0 THEN 1.0 ELSE 2.0 * both_ / all_ END AS dice, strlen(a) AS la, strlen(b) AS lb,
  CASE WHEN greatest(strlen(a), strlen(b)) = 0 THEN 1.0 ELSE least(strlen(a), strlen(b)) / greatest(strlen(a), strlen(b)) END AS ratio FROM pairs LEFT JOIN sums USING (doc_id))"""


def _pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(" ")), F.lit(","), F.lit(""))
    return agreement.agreement(table(spark, sf_dir, "documents").select("doc_id", "text", other.alias("other")), "doc_id", "text", "other")


@query(f"WITH {_TOKENS} SELECT doc_id, round(dice, 6) AS dice FROM scored")
def dice_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair(spark, sf_dir).select("doc_id", F.round("dice", 6).alias("dice"))


@query(f"WITH {_TOKENS} SELECT doc_id, round(ratio, 6) AS length_ratio, CASE WHEN ratio >= 0.9 AND dice >= 0.95 THEN 'agreement' WHEN la < 0.5 * lb THEN 'failure' ELSE 'divergence' END AS verdict FROM scored")
def diff_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair(spark, sf_dir).select("doc_id", F.round("length_ratio", 6).alias("length_ratio"), "verdict")


_LEVEL = "CASE WHEN user_id % 3 = 0 THEN event_type ELSE 'state-' || event_type END"


@query(f"""SELECT user_id, event_id, text FROM (SELECT user_id, event_id, text, lag(text) OVER (PARTITION BY user_id ORDER BY ts, text, event_id) AS before FROM (SELECT *, {_LEVEL} AS text FROM events)) WHERE before IS NULL OR before <> text""")
def screen_state_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("text", F.expr(_LEVEL))
    return render.collapsed_states(e, ["user_id"], ["ts", "text", "event_id"], "text").select("user_id", "event_id", "text")


@query("""SELECT conv_id, string_agg('[' || lpad(CAST(turn * 5 // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(turn * 5 // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(turn * 5 % 60 AS VARCHAR), 2, '0') || ' -> '
  || lpad(CAST((turn * 5 + 5) // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST((turn * 5 + 5) // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((turn * 5 + 5) % 60 AS VARCHAR), 2, '0') || '] Speaker ' ||
  (CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END) || ': ' || trim(translate(text, chr(13) || chr(10), '  ')) || chr(10), '' ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id""")
def transcript_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    speaker = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
    rows = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") * 5.0).alias("start"), (F.col("turn") * 5.0 + 5).alias("end"), speaker.alias("speaker"), "text")
    return render.transcript(rows, "conv_id")


@query("""SELECT conv_id, turn, CAST(coalesce(sum(strlen(text) + 1) OVER w, 0) AS BIGINT) AS start, CAST(coalesce(sum(strlen(text) + 1) OVER w, 0) + strlen(text) AS BIGINT) AS "end" FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.spans(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text", kept(spark, "spans").store).select("conv_id", "turn", "start", "end")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_linenumber BETWEEN 2 AND 3 OR l_linenumber BETWEEN 6 AND 6)""")
def hidden_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame([(2, 3), (6, 6)], "first int, last int")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return intervals.containing(lines, ranges, [], "l_linenumber").select("l_orderkey", "l_linenumber")


@query("""WITH r AS (SELECT l_suppkey, l_orderkey AS first, l_orderkey + CAST(l_partkey % 900 AS BIGINT) - 40 AS last FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 45)
SELECT l_suppkey, l_orderkey, l_linenumber, count(*) AS ranges FROM lineitem l JOIN r USING (l_suppkey) WHERE l_orderkey BETWEEN first AND last GROUP BY ALL""")
def hidden_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of sheets (suppliers) that lie in hidden ranges of their own sheet, and in how many; ranges overlap, some are empty."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    ranges = lines.where("l_linenumber = 1 and l_quantity > 45").select("l_suppkey", F.col("l_orderkey").alias("first"), (F.col("l_orderkey") + F.col("l_partkey") % 900 - 40).alias("last"))
    return intervals.containing(lines.select("l_suppkey", "l_orderkey", "l_linenumber"), ranges, ["l_suppkey"], "l_orderkey").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("ranges"))


@query("""SELECT l.l_orderkey, l.l_linenumber, o.o_orderpriority AS formula FROM lineitem l LEFT JOIN (SELECT o_orderkey, o_orderpriority, 1 AS line FROM orders WHERE o_orderstatus = 'O') o ON l.l_orderkey = o.o_orderkey AND l.l_linenumber = o.line""")
def formula_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    formulas = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("o_orderpriority").alias("formula"))
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"))
    return render.looked_up(cells, formulas, ["l_orderkey", "l_linenumber"])


@query("""SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '\\n\\n+', chr(10) || chr(10), 'g'), '^\\n+', '')) AS collapsed FROM documents""")
def line_blank_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.collapse_blank_lines(F.col("text")), 256).alias("collapsed"))


@query("""SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) || chr(9) || n_name || chr(9) || CAST(n_regionkey AS VARCHAR) AS line FROM nation""")
def tsv_render_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.tsv_rows(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")


def _plain_sql(x: str) -> str:
    """A number of DuckDB without exponent and needless fraction; the tables' numbers lie under 1e15."""
    text = f"CAST({x} AS VARCHAR)"
    digits, exponent = f"replace(replace(split_part({text}, 'e', 1), '-', ''), '.', '')", f"CAST(split_part({text}, 'e-', 2) AS INTEGER)"
    small = f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END) || '0.' || repeat('0', {exponent} - 1) || rtrim({digits}, '0')"
    return f"CASE WHEN contains({text}, 'e-') THEN {small} WHEN {text} LIKE '%.0' THEN replace({text}, '.0', '') ELSE {text} END"


@query(f"""WITH e AS (SELECT vec_id, CASE WHEN embedding IS NULL THEN '' ELSE '[' || array_to_string(list_transform(embedding, lambda x: COALESCE({_plain_sql("x")}, '')), ', ') || ']' END AS shown FROM embeddings)
SELECT vec_id, sha256(shown) AS cell, CAST(length(shown) AS BIGINT) AS chars FROM e""")
def vector_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as the cell of a record; floats whose fewest digits leave a choice as in the SQL."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    shown = dict(zip(e.columns, cells.cells(e.schema, settled=True)))["embedding"]
    return e.select("vec_id", shown.alias("shown")).select("vec_id", F.sha2("shown", 256).alias("cell"), F.length("shown").cast("long").alias("chars"))


@query(f"""SELECT event_id, '{{by: {{type: ' || COALESCE(event_type, '') || ', user: ' || COALESCE(CAST(user_id AS VARCHAR), '') || ', at: ' || COALESCE(CAST(epoch_us(ts) AS VARCHAR), '') || '}}, of: {{even: [], raw: ['
  || lower(hex(encode(COALESCE(event_type, '')))) || ', ]}}, value: [' || COALESCE({_plain_sql("value")}, '') || ']}}' AS cell FROM events""")
def nested_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one nested record: structs, a map whose entries come unsorted, lists, bytes, times, numbers and nulls inside."""
    e = table(spark, sf_dir, "events")
    by = F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"), F.col("ts").alias("at"))
    of = F.create_map(F.lit("raw"), F.array(F.coalesce("event_type", F.lit("")).cast("binary"), F.lit(None).cast("binary")), F.lit("even"), F.array().cast("array<binary>"))
    record = e.select("event_id", F.struct(by.alias("by"), of.alias("of"), F.array("value").alias("value")).alias("record"))
    return record.select("event_id", cells.cell(F.col("record"), record.schema["record"].dataType).alias("cell"))
