"""Converters on small files, those that should fail too."""

import struct
import wave
from io import BytesIO

import pytest

from quillspark.converters import archive, differential, document, html, images, legacy, mail, media, pdf, registry, vector, workbook
from quillspark.converters.base import ConvertError, Segment, has_meaning, passthrough, segments_problem
from quillspark.plans import builders, formats


def test_passthrough():
    assert passthrough("﻿a\r\nb".encode()).text == "a\nb"
    assert passthrough("é".encode("utf-16")).warnings == ["transcoded from utf-16le"]
    for data, code in ((b"\xff\xfe\0\0", "unsupported-encoding"), (b"\xff", "invalid_utf8"), (b"a\0", "nul_bytes"), ("﻿".encode(), "empty_output"), (b"\xff\xfea", "invalid_utf16")):
        with pytest.raises(ConvertError) as e:
            passthrough(data)
        assert e.value.code == code
    assert passthrough(b"").text == ""


def test_html():
    page = "<html><head><title>Board  Update</title><style>p{}</style></head><body><script>x<y</script><p>Revenue &amp; costs</p><ul><li>one<li>two</ul><table><tr><td>cell a</td><td>cell b</td></tr></table></body></html>"
    assert html.strip_html(page) == "Board Update\nRevenue & costs\n\none\ntwo\n\ncell a\tcell b\n"
    assert html.strip_html("<head><p>no end tag of the head") == "no end tag of the head\n"
    assert html.strip_html("a <template>b<template>c</template></template> d <!-- e --> f < g") == "a d f < g\n"
    assert html.decode_entities("&lt;&#65;&#x42;&#0;&nope;&egrave &euro;") == "<AB&#0;&nope;&egrave €"
    assert len(html.ENTITIES) == 138
    assert registry.convert(b"<p> </p>", "html")[1].startswith("empty_output")


def test_mail():
    made = mail.convert(builders.mail_of("a@b.c", "=?utf-8?q?J=C3=B6?=", "body", ("../n.txt", b"note")))
    assert made.text == "From: a@b.c\nSubject: Jö\n\nbody\n"
    assert made.members == [("1-n.txt", b"note")]
    alternative = b'From: x\nContent-Type: multipart/alternative; boundary=A\n\n--A\nContent-Type: text/html\n\n<b>h</b>\n--A\nContent-Type: text/plain\n\nplain\n--A--\n'
    assert mail.convert(alternative).text == "From: x\n\nplain\n"
    assert registry.convert(b"no header", "eml")[1].startswith("mime_parse_error")


def test_expansion():
    inner = builders.zip_of([("x.txt", b"hi")])
    data = builders.zip_of([("a.txt", b"1"), ("../b", b"2"), ("A.txt", b"3"), ("n.zip", inner), ("/abs", b"4")])
    units = list(archive.Expansion().run("p.zip", data))
    assert [(u.path, u.error and u.error.split(":")[0]) for u in units] == [
        ("p.zip.d/a.txt", None), ("p.zip.d/#unsafe-member-1", "unsafe-member-path"), ("p.zip.d/#collision-1", "member-path-collision"),
        ("p.zip.d/n.zip.d/x.txt", None), ("p.zip.d/n.zip", None), ("p.zip.d/#unsafe-member-4", "unsafe-member-path"), ("p.zip", None),
    ]
    deep = b"x"
    for k in range(7):
        deep = builders.zip_of([(f"{k}.zip" if k else "x.txt", deep)])
    assert any(u.error and u.error.startswith("container-depth-exceeded") for u in archive.Expansion().run("d.zip", deep))
    many = builders.zip_of([(str(k), b"") for k in range(1001)])
    assert [u.error.split(":")[0] for u in archive.Expansion().run("m.zip", many)] == ["container-children-exceeded"]
    assert archive.entry_count(many) == 1001
    assert [u.error.split(":")[0] for u in archive.Expansion(lambda p: True).run("o.zip", inner)] == ["container-mirror-collision"]


def test_records():
    assert registry.convert(builders.parquet_of({"id": [0], "name": ["a\tb"], "x": [1.0]}), "parquet")[0].text == "id\tname\tx\n0\ta\\tb\t1\n"
    assert registry.convert(builders.avro_of([("id", "long"), ("name", "string")], [(-5, "ü"), (1 << 40, "")]), "avro")[0].text == f"id\tname\n-5\tü\n{1 << 40}\t\n"
    found = registry.convert(builders.sqlite_of("t", "a REAL, b BLOB, c TEXT", [(1e21, b"\0\xff", None)]), "sqlite")[0]
    assert found.text == "a\tb\tc\n1000000000000000000000\t00ff\t\n"
    assert [(s.kind, s.name) for s in found.segments] == [("sheet", "t"), ("span", "t")]
    for fmt in ("parquet", "avro", "sqlite"):
        assert registry.convert(b"junk", fmt)[0] is None


def test_workbook():
    data = builders.xlsx_of("S", [[1, "covert", "x"], ["ghost row", 2.5], [(7, "SUM(C1:C1)")]], (1,), (1,))
    found = registry.convert(data, "xlsx")[0]
    assert found.text == "1\tcovert\tx\nghost row\t2.5\n7 [=SUM(C1:C1)]\n"
    raw = found.text.encode()
    assert {(s.source, raw[s.start : s.end].decode()) for s in found.segments if s.hidden} == {("column", "covert"), ("column", "2.5"), ("row", "ghost row\t2.5")}
    name = "urn:oasis:names:tc:opendocument:xmlns:"
    content = f'<o:document-content xmlns:o="{name}office:1.0" xmlns:t="{name}table:1.0" xmlns:x="{name}text:1.0"><o:body><o:spreadsheet><t:table t:name="S"><t:table-column/><t:table-column t:visibility="collapse"/><t:table-row><t:table-cell><x:p>a</x:p></t:table-cell><t:table-cell><x:p>shy</x:p></t:table-cell></t:table-row><t:table-row t:visibility="collapse"><t:table-cell><x:p>lowrow</x:p></t:table-cell></t:table-row></t:table></o:spreadsheet></o:body></o:document-content>'
    found = registry.convert(builders.zip_of([("content.xml", content.encode())]), "ods")[0]
    assert found.text == "a\tshy\nlowrow\n" and sum(s.hidden for s in found.segments) == 2
    assert registry.convert(b"\xd0\xcf", "xls")[1].startswith("visibility_read_error")


def test_documents():
    assert registry.convert(builders.docx_of(["a", " ", "b<"]), "docx")[0].text == "a\n\nb<\n"
    assert registry.convert(builders.rtf_of(["x", "y{z}"]), "rtf")[0].text == "x\n\ny{z}\n"
    assert document.rtf(rb"{\rtf1\uc1 W\u246?rld {\*\secret no}yes}") == "Wörld yes"
    book = builders.zip_of([("META-INF/container.xml", b'<c><rootfile full-path="o/p.opf"/></c>'), ("o/p.opf", b'<p><item id="i" href="c.html"/><itemref idref="i"/></p>'), ("o/c.html", b"<p>chapter</p>")])
    assert registry.convert(book, "epub")[0].text == "chapter\n"
    assert document.markdown_to_plain("# T\n\n- [x] do *it*\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n[^n]: see [l](u)\n") == "T\n\n[x] do it\n\na\tb\n1\t2\n\n[n]: see l\n"
    assert registry.convert(builders.pdf_of(["one (1)", "two"]), "pdf")[0].text == "one (1)\ntwo\n"
    assert registry.convert(b"%PDF-1.4\n1 0 obj\n<<>>\nendobj", "pdf")[1].startswith("pdf_no_text_layer")


def test_images():
    png = builders.png_of([("Title", "a\\b\tc"), ("Empty", " ")])
    found = images.metadata(png, "png")
    assert found.text == "png-text\tpng-text\tTitle\t\ta\\\\b\\tc\n" and found.segments[0].hidden
    assert images.metadata(builders.png_of([]), "png") is None
    assert registry.convert(builders.png_of([], 4000, 1), "png")[1].startswith("image-ocr-runtime-missing")
    assert images.preflight(builders.png_of([], 4000, 1), "png")[0].startswith("image_ocr_long_edge")
    with pytest.raises(ConvertError, match="image-ocr-area-exceeded"):
        images.preflight(png[:16] + struct.pack(">II", 5000, 5000) + png[24:], "png")
    xmp = '<x:xmpmeta xmlns:x="a:" xmlns:dc="d:" xmlns:r="r:"><dc:title><r:Alt><r:li xml:lang="en">One</r:li><r:li>Two</r:li></r:Alt></dc:title></x:xmpmeta>'
    assert images.xmp_rows(xmp, "xmp") == [("xmp", "xmp-dc-title", "dc:title", "en", "One; Two")]
    exif = b"II*\0" + struct.pack("<IHHHII", 8, 1, 315, 2, 6, 26) + b"\0\0\0\0" + b"Anna\0\0"
    assert images.exif_rows(exif) == [("exif", "exif-artist", "315", None, "Anna")]


def test_sound():
    out = BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1), file.setsampwidth(2), file.setframerate(8000)
        file.writeframes(b"\0\0" * 8000)
    assert registry.convert(out.getvalue(), "wav")[1].startswith("asr-no-speech")
    assert media.transcript([media.Speech(61, 62, 2, "b\nc"), media.Speech(0, 1, 1, "a")]) == "[00:00:00 -> 00:00:01] Speaker 1: a\n[00:01:01 -> 00:01:02] Speaker 2: b c\n"
    assert media.screen_states([(2, "b"), (1, "a"), (3, "b"), (4, "a")]) == [(1, "a"), (2, "b"), (4, "a")]


def test_detection():
    resolve = formats.TABLE.resolve
    assert len(formats.TABLE.ids) == 88
    assert resolve("a.ai", "pdf") == ("ai", "ai", False, None)
    assert resolve("a.txt", "png") == ("text", "png", True, None)
    assert resolve("a.txt", "gif") == ("text", "text", False, "magic-format-outside-table: gif")
    assert resolve(".env", None)[1] == "env" and resolve("x/none", None)[1] == "unknown"
    assert formats.magic(b"#!/bin/sh\n") == "sh" and formats.magic(builders.docx_of(["a"])) == "docx" and formats.magic(builders.zip_of([("a", b"")])) == "zip"
    for bad in ([("unknown", [])], [("a", ["x"]), ("b", ["x"])], [("a", []), ("a", [])]):
        with pytest.raises(formats.RulesError):
            formats.FormatTable.build(bad, {}, {})
    with pytest.raises(formats.RulesError):
        registry.Registry([("text", "text-passthrough", "9.9.9")])


def test_segments():
    raw = "café au lait".encode()
    assert segments_problem([Segment("span", 0, len(raw), "document")], raw) is None
    for s in (Segment("span", 0, 99, "d"), Segment("span", 4, 5, "d"), Segment("sheet", 0, 1, "d"), Segment("span", 3, 2, "d")):
        assert segments_problem([s], raw)
    assert has_meaning("a") and not has_meaning("​ \n")


def test_vector_geometry():
    assert vector.geometry(b'<svg width="1in" height="48pt"/>') == (96.0, 64.0)
    assert vector.geometry(b'<svg width="100%" viewBox="-5 -5 20,10"><g/>') == (20.0, 10.0)
    for bad in (b"<html/>", b"<svg/>", b"junk", b'<!DOCTYPE x [<!ENTITY a "b">]><svg width="1" height="1"/>'):
        with pytest.raises(ConvertError):
            vector.geometry(bad)


def test_compound_files():
    big, small = bytes(range(256)) * 40, b"small stream"
    file = legacy.CompoundFile(builders.cfb_of({"Big": big, "Small": small, "Other": b"", "Larger still": big * 9}))
    assert file.stream("Big") == big and file.stream("Small") == small and file.stream("Larger still") == big * 9
    assert file.stream("Absent") is None
    for bad in (b"", b"x" * 600, builders.cfb_of({"Big": big})[:700]):
        with pytest.raises(ConvertError):
            legacy.CompoundFile(bad).stream("Big")


def test_legacy_documents():
    for wide in (False, True):
        found = document.convert(builders.doc_of(["One café", "", "two"], wide), "doc")
        assert found.text == "One café\n\ntwo\n" and not found.warnings
    shown = legacy._shown("a\x13 HYPERLINK x \x14link\x15 b\rcell\x07two\x07\x07after\r\x01\x1e")
    assert shown == "alink b\n\ncell\ttwo\n\nafter\n\n-"
    data = bytearray(builders.doc_of(["secret"]))
    at = data.index(b"\xec\xa5")
    data[at + 11] |= 1
    with pytest.raises(ConvertError, match="encrypted"):
        document.convert(bytes(data), "doc")


def test_legacy_presentations():
    found = document.convert(builders.ppt_of([(["Title", "point\rnext"], ["shape é"]), ([], ["second"])]), "ppt")
    assert found.text == "Title\n\npoint\n\nnext\n\nshape é\n\nsecond\n"
    assert all(w.startswith("differential-divergence: ") for w in found.warnings)


def test_legacy_workbooks():
    total = struct.pack("<BHHHHBBH", 0x25, 0, 2, 0xC000, 0xC001, 0x42, 1, 4)
    long = [["x" * 5000 + "é"], ["y" * 9000], ["short"]]
    sheets = [("Visible", 0, [["a", "covert", 1.5], ["ghost", "", -3], [(7.0, total)]], (1,), (1,)), ("Secret", 2, long, (), ())]
    found = workbook.convert(builders.xls_of(sheets), "xls")
    raw = found.text.encode()
    assert found.text.startswith("a\tcovert\t1.5\nghost\t\t-3\n7 [=SUM(A1:B3)]\n\n") and long[0][0] in found.text and long[1][0] in found.text
    assert {raw[s.start : s.end].decode() for s in found.segments if s.hidden and s.source in ("row", "column")} == {"covert", "", "ghost\t\t-3"}
    assert [(s.name, s.hidden) for s in found.segments if s.kind == "span" and s.source == "sheet"] == [("Visible", False), ("Secret", True)]
    assert not found.warnings
    unread = workbook.convert(builders.xls_of([("S", 0, [[(2.0, b"\x39\0\0")]], (), ())]), "xls")
    assert unread.text == "2\n" and unread.warnings == ["formulas-unread: 1 cells show their values alone"]
    for data, reason in ((b"x", "visibility_read_error"), (builders.cfb_of({"Workbook": b"\x09\x08\x04\0\0\x02\0\0"}), "visibility_read_error"), (builders.xls_of(sheets)[:-600], "")):
        with pytest.raises(ConvertError, match=reason):
            workbook.convert(data, "xls")


def test_differential_verdicts(monkeypatch):
    data = builders.doc_of(["one two three four"])
    monkeypatch.setitem(differential.SCANS, "doc", lambda _: "one two three four " * 3)
    with pytest.raises(ConvertError, match="differential-divergence: secondary=.* len_ratio=0.3"):
        document.convert(data, "doc")
    assert registry.convert(data, "doc")[1].startswith("differential-divergence")
    monkeypatch.setitem(differential.SCANS, "doc", lambda _: "one two three")
    assert document.convert(data, "doc").warnings[0].startswith("differential-divergence: ")

    def broken(_):
        raise ConvertError("malformed", "x")

    monkeypatch.setitem(differential.SCANS, "doc", broken)
    assert document.convert(data, "doc").warnings == ["differential-unavailable: malformed"]


def test_pdf_with_pictures():
    plain = builders.pdf_of(["some text"])
    picture = b"9 0 obj\n<</Length 20>>\nstream\nq 1 0 0 1 0 0 cm /Im1 Do Q\nendstream\nendobj\n"
    one, two = (plain.replace(b"trailer", picture * n + b"trailer") for n in (1, 2))
    assert pdf.convert(plain).warnings == []
    assert (pdf.convert(one).converter_id, pdf.convert(one).warnings) == ("pdf-subprocess", ["pdf_partial_text: 1 of 2 pages show a picture and no text"])
    assert pdf.convert(two).converter_id == "pdf-text-recovered"


def test_heic_metadata():
    box = lambda kind, body: struct.pack(">I4s", len(body) + 8, kind) + body
    tiff = b"II*\0\x08\0\0\0\x01\0" + struct.pack("<HHI4s", 0x0131, 2, 4, b"abc\0") + b"\0\0\0\0"
    item = b"\0\0\0\0" + tiff
    infe = box(b"infe", b"\x02\0\0\0" + struct.pack(">HH", 1, 0) + b"Exif\0")
    head = box(b"ftyp", b"heic\0\0\0\0")
    meta = lambda at: box(b"meta", b"\0\0\0\0" + box(b"iinf", b"\0\0\0\0\0\x01" + infe) + box(b"iloc", b"\0\0\0\0\x44\0" + struct.pack(">HHHHII", 1, 1, 0, 1, at, len(item))))
    data = head + meta(len(head) + len(meta(0)) + 8) + box(b"mdat", item)
    found = images.metadata(data, "heic")
    assert "abc" in found.text and found.text.count("\n") == 1
    with pytest.raises(ConvertError):
        images.metadata(data[:-10], "heic")
    assert images.metadata(head, "heic") is None


def test_packed_sound_is_measured():
    flac = b"fLaC\0\0\0\x22" + bytes(10) + (44_100 << 44 | 44_100 * 30).to_bytes(8, "big") + bytes(16)
    assert media.preflight(flac, "flac") == 30
    frame = b"\xff\xfb\x90\0".ljust(417, b"\0")
    assert abs(media.preflight(frame * 100, "mp3") - 100 * 1152 / 44_100) < 1e-9
    movie = b"\0\0\0\x6cmvhd\0\0\0\0" + struct.pack(">IIII", 0, 0, 1000, 4_000_000) + bytes(80)
    with pytest.raises(ConvertError, match="asr-duration-exceeded"):
        media.preflight(movie, "m4a")
    for data, fmt in ((b"x", "flac"), (b"", "mp3"), (b"y" * 50, "m4a")):
        with pytest.raises(ConvertError, match="asr-malformed"):
            media.preflight(data, fmt)
    assert registry.convert(flac, "flac")[1] == "engine-unpinned: no decoder for 30 s of flac"
