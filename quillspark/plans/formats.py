"""Formats, how names declare them, how bytes show them, and where each is routed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

RULES_VERSION = "10"

#: Format ids with their extensions, by route (fixed values). "id" alone means that the id is the extension.
ROUTES = {
    "text-passthrough": (
        "text(txt,text,log) markdown(md,markdown) csv json jsonl(jsonl,ndjson) yaml(yaml,yml) xml tsv toml ini(ini,cfg,conf,properties) env svg ipynb "
        "python(py) shell(sh,bash,zsh) rust(rs) javascript(js,mjs,jsx) typescript(ts,tsx) sql ruby(rb) go java c(c,h) cpp(cc,cpp,hpp) csharp(cs) php "
        "perl(pl) powershell(ps1,psm1) batch(bat,cmd) terraform(tf,tfvars) hcl lookml(lkml) tmdl pbip tableau-workbook(twb) tableau-datasource(tds)"
    ),
    "html-strip": "html(html,htm,xhtml)",
    "eml-mime": "eml",
    "container-zip": "zip",
    "anydoc-document": "rtf odt odp epub docx pptx doc ppt",
    "workbook-ir": "ods xlsx xlsm xls",
    "pdf-subprocess": "pdf ai",
    "records-worker": "parquet avro sqlite(sqlite,sqlite3)",
    "image-pixel-ocr": "png jpeg(jpg,jpeg) webp",
    "asr-adapter": "mp3 wav m4a flac",
}
UNSUPPORTED = {
    "hidden-visibility-unresolved": "xlsb xla xlam",
    "engine-unpinned": "tiff(tif,tiff) mp4 mov",
    "no-jailed-rasterizer": "heic",
    "pickle-deserialization-unsafe": "pickle(pkl,pickle)",
    "converter-deferred": "arrow orc feather duckdb faiss msgpack",
    "container-deferred": "tar gzip(gz) bzip2(bz2) 7z rar",
    "proprietary-binary": "sketch psd(psd,psb) fig indd idml",
    "no-converter": "msg",
}
#: A format that a name may declare although the bytes look like the other (fixed values).
REFINES = {"ai": "pdf", "svg": "xml", "tableau-workbook": "xml", "tableau-datasource": "xml"}
BASENAMES = {".env": "env"}
VERSIONS = {
    "text-passthrough": "1.2.0", "html-strip": "1.0.0", "eml-mime": "1.0.0", "container-zip": "1.0.0", "anydoc-document": "1.0.0", "workbook-ir": "1.0.0",
    "pdf-subprocess": "1.0.0", "records-worker": "1.0.0", "image-pixel-ocr": "1.1.0", "asr-adapter": "2.0.0", "pdf-text-recovered": "1.0.0", "image-metadata": "1.0.0",
}
CONTAINERS = ("zip", "eml")
METADATA_FORMATS = ("png", "jpeg", "webp", "heic")
#: Ceilings (fixed values).
MAX_SOURCE, MAX_PART, MAX_OUTPUT = 128 << 20, 64 << 20, 64 << 20
MAX_ROWS, MAX_COLUMNS, MAX_CELLS = 1_048_576, 16_384, 10_000_000
MAX_DEPTH, MAX_CHILDREN, MAX_EXPANDED, MAX_MEMBER = 4, 1000, 1 << 30, 256 << 20
MAX_RECORDS, MAX_TABLES = 100_000, 256


class RulesError(ValueError):
    """The rules contradict themselves."""


@dataclass(frozen=True)
class FormatTable:
    """Which format a name declares, and which it may refine."""

    extensions: dict[str, str]
    basenames: dict[str, str] = field(default_factory=dict)
    refines: dict[str, str] = field(default_factory=dict)

    @property
    def ids(self) -> set[str]:
        return set(self.extensions.values()) | set(self.basenames.values())

    @staticmethod
    def build(formats: list[tuple[str, list[str]]], basenames: dict[str, str], refines: dict[str, str]) -> FormatTable:
        """A checked table; raises RulesError for reserved or repeated ids, names claimed twice, and bad refinements."""
        ids = [i for i, _ in formats]
        extensions: dict[str, str] = {}
        for i, claimed in formats:
            if i in ("unknown", "symlink"):
                raise RulesError(f"reserved id {i}")
            for e in claimed:
                if extensions.setdefault(e, i) != i or claimed.count(e) > 1:
                    raise RulesError(f"extension {e} is claimed twice")
        if len(set(ids)) < len(ids):
            raise RulesError("an id stands twice")
        for i, target in refines.items():
            if i not in ids or target not in ids or i == target or target in refines:
                raise RulesError(f"{i} must not refine {target}")
        if set(basenames.values()) - set(ids):
            raise RulesError("a basename names no format")
        return FormatTable(extensions, basenames, refines)

    def declared(self, path: str) -> str | None:
        """By extension, or by the whole name if it has none."""
        name = path.rsplit("/", 1)[-1]
        stem, dot, ext = name.rpartition(".")
        if dot and stem and ext:
            return self.extensions.get(ext.lower() if ext.isascii() else ext)
        return self.basenames.get(name)

    def resolve(self, path: str, magic: str | None) -> tuple[str | None, str, bool, str | None]:
        """(declared, detected, mismatch, warning) of a path whose bytes show the extension ``magic``."""
        declared = self.declared(path)
        if magic is None:
            return declared, declared or "unknown", False, None
        seen = self.extensions.get(magic)
        if seen is None:
            return declared, declared or "unknown", False, f"magic-format-outside-table: {magic}"
        if declared is not None and self.refines.get(declared) == seen:
            return declared, declared, False, None
        return declared, seen, declared is not None and declared != seen, None


def _parsed(text: str) -> list[tuple[str, list[str]]]:
    out = []
    for item in text.split():
        name, _, rest = item.partition("(")
        out.append((name, rest.rstrip(")").split(",") if rest else [name]))
    return out


def all_formats() -> list[tuple[str, list[str], str | None, str | None]]:
    """(id, extensions, converter, unsupported reason) of every format."""
    rows = [(i, e, route, None) for route, text in ROUTES.items() for i, e in _parsed(text)]
    return rows + [(i, e, None, reason) for reason, text in UNSUPPORTED.items() for i, e in _parsed(text)]


TABLE = FormatTable.build([(i, e) for i, e, _, _ in all_formats()], BASENAMES, REFINES)


def extension_rules(spark: SparkSession) -> DataFrame:
    """(extension, format): at most a few hundred rows, safe to broadcast."""
    return spark.createDataFrame(sorted(TABLE.extensions.items()), "extension string, format string")


def route_rules(spark: SparkSession) -> DataFrame:
    """(format, converter_id, converter_version, reason): one row per format, safe to broadcast."""
    rows = [(i, c, VERSIONS.get(c or ""), r) for i, _, c, r in all_formats()]
    return spark.createDataFrame(rows, "format string, converter_id string, converter_version string, reason string")


#: Signatures at an offset that show an extension (fixed values), the more particular first.
SIGNATURES: list[tuple[int, bytes, str]] = [
    (0, b"%PDF", "pdf"), (0, b"\x89PNG\r\n\x1a\n", "png"), (0, b"\xff\xd8\xff", "jpg"), (0, b"GIF8", "gif"), (0, b"SQLite format 3\x00", "sqlite"),
    (0, b"PAR1", "parquet"), (0, b"Obj\x01", "avro"), (0, b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "cfb"), (0, b"{\\rtf", "rtf"), (0, b"\x1f\x8b", "gz"),
    (0, b"BZh", "bz2"), (0, b"7z\xbc\xaf\x27\x1c", "7z"), (0, b"Rar!\x1a\x07", "rar"), (257, b"ustar", "tar"), (0, b"fLaC", "flac"), (0, b"ID3", "mp3"),
    (0, b"\xff\xfb", "mp3"), (0, b"ARROW1", "arrow"), (0, b"ORC", "orc"), (0, b"8BPS", "psd"), (0, b"II*\x00", "tif"), (0, b"MM\x00*", "tif"),
    (0, b"\x7fELF", "elf"), (0, b"<?xml", "xml"), (4, b"ftypM4A", "m4a"), (4, b"ftypqt", "mov"), (4, b"ftypheic", "heic"), (4, b"ftypheix", "heic"), (4, b"ftypmif1", "heic"),
    (4, b"ftypmp4", "mp4"), (4, b"ftypisom", "mp4"), (0, b"FEA1", "feather"), (8, b"DUCK", "duckdb"),
]


def magic(data: bytes) -> str | None:
    """The extension that the first bytes show, if any."""
    if data[:4] == b"RIFF":
        return {b"WEBP": "webp", b"WAVE": "wav"}.get(data[8:12])
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return _in_zip(data)
    for at, sign, ext in SIGNATURES:
        if data[at : at + len(sign)] == sign:
            return ext
    head = data[:512].lstrip(b"\xef\xbb\xbf \t\r\n").lower()
    if head.startswith((b"<!doctype html", b"<html")):
        return "html"
    if data[:2] == b"#!":
        line = data[2:128].split(b"\n")[0]
        if line.rstrip().endswith((b"/sh", b"/bash", b"/zsh", b" sh", b" bash", b" zsh")):
            return "sh"
    return None


def _in_zip(data: bytes) -> str:
    """Office and book formats by the members near the front of a zip archive."""
    head = data[:4096]
    if head[30:38] == b"mimetype":
        for kind, ext in ((b"epub+zip", "epub"), (b"opendocument.text", "odt"), (b"opendocument.spreadsheet", "ods"), (b"opendocument.presentation", "odp")):
            if kind in head[38:128]:
                return ext
    for member, ext in ((b"word/", "docx"), (b"xl/", "xlsx"), (b"ppt/", "pptx")):
        if member in data[:65536] and (b"[Content_Types].xml" in data[:65536] or b"_rels/" in data[:65536]):
            return ext
    return "zip"
