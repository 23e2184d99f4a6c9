"""HTML to visible text, by a flat scan over tags without a tree."""

from __future__ import annotations

import re
from html.entities import name2codepoint

from quillspark.converters.base import ConvertError, Outcome, Segment, normalize
from quillspark.plans import formats

#: Elements that may stand in a head (fixed values).
HEAD_CONTENT = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
#: Elements that break the line at both tags (fixed values).
BLOCKS = frozenset("address article aside blockquote dd div dl dt figure footer h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table tr ul".split())
#: Named references besides those of Latin-1 (fixed values).
NAMES = (
    "amp apos gt lt quot Dagger OElig Prime Scaron Yuml bdquo bull circ dagger emsp ensp euro fnof frasl hellip ldquo lrm lsaquo lsquo mdash minus "
    "ndash oelig oline permil prime rdquo rlm rsaquo rsquo sbquo scaron thinsp tilde trade zwj zwnj"
).split()
ENTITIES = {n: c for n, c in name2codepoint.items() if 160 <= c <= 255} | {n: name2codepoint.get(n, 39) for n in NAMES}
#: Elements whose content is not markup: shown as characters, or not shown.
RAW_TEXT = frozenset("script style xmp iframe noembed noframes noscript".split())
CHARACTERS = frozenset("title textarea".split())
#: Whether an end tag that only an ancestor's end implies breaks the line too.
IMPLIED_BREAKS = False

_TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<close>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|(?P<other>[!?/][^>]*)(?:>|\Z))", re.S)
_REFERENCE = re.compile(r"&([^;]{0,38});")


def decode_entities(text: str) -> str:
    """Numeric references and the named ones above; all others, and NUL, stay as written."""

    def one(m: re.Match) -> str:
        body = m[1]
        if body[:1] == "#":
            digits, base = (body[2:], 16) if body[1:2] in ("x", "X") else (body[1:], 10)
            try:
                value = int(digits, base) if digits.isascii() and digits.isalnum() else 0
            except ValueError:
                value = 0
            good = 0 < value < 0x110000 and not 0xD800 <= value < 0xE000
            return chr(value) if good else m[0]
        return chr(ENTITIES[body]) if body in ENTITIES else m[0]

    out, at = [], 0
    while (start := text.find("&", at)) >= 0:
        m = _REFERENCE.match(text, start)
        if m and len(text[start : m.end()].encode()) <= 40:
            shown = one(m)
            if shown != m[0]:
                out += [text[at:start], shown]
                at = m.end()
                continue
        out.append(text[at : start + 1])
        at = start + 1
    return "".join([*out, text[at:]])


def collapse(text: str) -> str:
    return re.sub(r"[ \t\n\r\f]+", " ", text)


def assemble(title: str, raw: str) -> str:
    """Title first, then lines with trimmed cells, without leading blank lines and with runs of them as one."""
    out, started, pending = [], False, False
    for line in raw.split("\n"):
        cells = [collapse(c).strip() for c in line.split("\t")]
        while len(cells) > 1 and not cells[-1]:
            cells.pop()
        shown = "\t".join(cells)
        if not shown:
            pending = started
            continue
        out.append("\n" * pending + shown + "\n")
        started, pending = True, False
    head = collapse(title).strip()
    return (head + "\n" if head else "") + "".join(out)


def strip_html(markup: str) -> str:
    """The visible text of a page."""
    title: list[str] = []
    raw: list[str] = []
    open_blocks: list[str] = []
    in_head = in_title = title_done = row_has_cell = False
    templates = charged = at = 0
    ending: str | None = None  # the raw-text element that is open

    def show(text: str, entities: bool = True) -> None:
        nonlocal charged
        charged += len(text)
        if charged > formats.MAX_OUTPUT:
            raise ConvertError("resource_limit", f"captured content exceeds the {formats.MAX_OUTPUT} byte ceiling")
        if templates or not text:
            return
        text = decode_entities(text) if entities else text
        if in_title:
            title.append(text)
        elif not in_head:
            raw.append(collapse(text))

    while at < len(markup):
        if ending:
            m = re.compile(rf"</{ending}(?=[\s/>])", re.I).search(markup, at)
            stop = m.start() if m else len(markup)
            if ending in CHARACTERS:
                show(markup[at:stop])
            ending, at = None, stop
            continue
        start = markup.find("<", at)
        start = len(markup) if start < 0 else start
        m = _TAG.match(markup, start) if start < len(markup) else None
        if m is None and start < len(markup):  # a lone sign is text
            nxt = markup.find("<", start + 1)
            nxt = len(markup) if nxt < 0 else nxt
            show(markup[at:nxt])
            at = nxt
            continue
        show(markup[at:start])
        if m is None:
            break
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["close"]:
            if name == "head":
                in_head = False
            elif name == "title" and in_title:
                in_title, title_done = False, True
            elif name == "template":
                templates = max(0, templates - 1)
            elif name in BLOCKS and name in open_blocks:
                while open_blocks:
                    top = open_blocks.pop()
                    if top == name or IMPLIED_BREAKS:
                        raw.append("\n")
                    if top == name:
                        break
            continue
        if in_head and name not in HEAD_CONTENT:
            in_head = False
        if name == "head":
            in_head = True
        elif name == "title" and not title_done:
            in_title = True
        elif name == "template":
            templates += 1
        elif name == "br":
            raw.append("\n")
        elif name in ("td", "th"):
            if row_has_cell:
                raw.append("\t")
            row_has_cell = True
        elif name in BLOCKS:
            raw.append("\n")
            open_blocks.append(name)
            if name == "tr":
                row_has_cell = False
        if name in RAW_TEXT or name in CHARACTERS:
            ending = name
        elif name == "plaintext":
            show(markup[at:], entities=False)
            break
    return assemble("".join(title), "".join(raw))


def convert(data: bytes) -> Outcome:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise ConvertError("invalid_utf8", f"invalid UTF-8 at byte {e.start}") from None
    warnings = ["stripped leading byte order mark"] if text[:1] == "﻿" else []
    text = normalize(strip_html(text.removeprefix("﻿")))
    if data and not text:
        raise ConvertError("empty_output", f"source is {len(data)} bytes but holds no visible text")
    return Outcome(text, "html-strip", warnings, [Segment("span", 0, len(text.encode()), "document")])


