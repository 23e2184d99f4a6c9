"""Legacy workbooks (BIFF5 and BIFF8): sheets with what is hidden, and a scan that knows neither sheets nor formulas."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from quillspark.converters.base import ConvertError
from quillspark.converters.legacy import _stream
from quillspark.converters.records import number
from quillspark.converters.workbook import Sheet, piece

#: Record types (fixed values).
BOF, EOF, CONTINUE, BOUNDSHEET, SST, FILEPASS, CODEPAGE = 0x809, 0x0A, 0x3C, 0x85, 0xFC, 0x2F, 0x42
NUMBER, RK, MULRK, LABEL, RSTRING, LABELSST, BOOLERR, FORMULA, STRING, ROW, COLINFO = 0x203, 0x27E, 0xBD, 0x204, 0xD6, 0xFD, 0x205, 0x06, 0x207, 0x208, 0x7D
#: How errors are shown (fixed values).
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}
#: Operators of formulas in two operands, and functions by number with their operands, None where a count is given (fixed values).
OPERATORS = {3: "+", 4: "-", 5: "*", 6: "/", 7: "^", 8: "&", 9: "<", 10: "<=", 11: "=", 12: ">=", 13: ">", 14: "<>", 15: " ", 16: ",", 17: ":"}
FUNCTIONS = {
    0: ("COUNT", None), 1: ("IF", None), 4: ("SUM", None), 5: ("AVERAGE", None), 6: ("MIN", None), 7: ("MAX", None), 15: ("SIN", 1), 16: ("COS", 1), 19: ("PI", 0), 20: ("SQRT", 1),
    24: ("ABS", 1), 25: ("INT", 1), 27: ("ROUND", 2), 31: ("MID", 3), 32: ("LEN", 1), 36: ("AND", None), 37: ("OR", None), 38: ("NOT", 1), 48: ("TEXT", 2), 63: ("RAND", 0), 65: ("DATE", 3),
    74: ("NOW", 0), 101: ("HLOOKUP", None), 102: ("VLOOKUP", None), 115: ("LEFT", None), 116: ("RIGHT", None), 169: ("COUNTA", None), 221: ("TODAY", 0), 336: ("CONCATENATE", None), 345: ("SUMIF", None), 346: ("COUNTIF", 2),
}


def records(data: bytes, at: int = 0) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """(type, body, continuations) from a place in the stream on."""
    held: tuple[int, bytes, list[bytes]] | None = None
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        body = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == CONTINUE and held:
            held[2].append(body)
            continue
        if held:
            yield held
        held = (kind, body, [])
    if held:
        yield held


def shared_strings(body: bytes, more: list[bytes]) -> list[str]:
    """The table of strings, whose characters may go on in the next record, which then says anew how wide they are."""
    parts, part, at = [body, *more], 0, 8
    out: list[str] = []

    def take(n: int) -> bytes:
        nonlocal part, at
        got = b""
        while n > len(got):
            if at >= len(parts[part]):
                part, at = part + 1, 0
                if part >= len(parts):
                    raise ConvertError("workbook_parse_error", "the table of strings is cut")
            step = parts[part][at : at + n - len(got)]
            got += step
            at += len(step)
        return got

    for _ in range(min(struct.unpack_from("<I", body, 4)[0], sum(map(len, parts)))):
        size, flags = struct.unpack("<HB", take(3))
        runs = struct.unpack("<H", take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", take(4))[0] if flags & 4 else 0
        text, wide = [], flags & 1
        while size:
            if at >= len(parts[part]):
                part, at = part + 1, 1
                if part >= len(parts):
                    raise ConvertError("workbook_parse_error", "the table of strings is cut")
                wide = parts[part][0] & 1
            room = (len(parts[part]) - at) // (2 if wide else 1)
            n = min(size, room)
            if not n:
                raise ConvertError("workbook_parse_error", "a string is cut inside a character")
            text.append(take(2 * n).decode("utf-16le", "replace") if wide else take(n).decode("latin-1"))
            size -= n
        take(4 * runs + extra)
        out.append("".join(text))
    return out


def string(body: bytes, at: int, new: bool, page: str, short: bool = False) -> str:
    """A string with its length in front, in two bytes or one."""
    size, at = (body[at], at + 1) if short else (struct.unpack_from("<H", body, at)[0], at + 2)
    if not new:
        return body[at : at + size].decode(page, "replace")
    wide = body[at] & 1
    return body[at + 1 : at + 1 + size * (2 if wide else 1)].decode("utf-16le" if wide else "latin-1", "replace")


def rk(word: int) -> float:
    value = float((word >> 2) - (1 << 30 if word & 0x80000000 else 0)) if word & 2 else struct.unpack("<d", struct.pack("<Q", (word & 0xFFFFFFFC) << 32))[0]
    return value / 100 if word & 1 else value


def _name(row: int, col: int, relative: int) -> str:
    letters, k = "", col
    while k >= 0:
        letters, k = chr(65 + k % 26) + letters, k // 26 - 1
    return f"{'' if relative & 1 else '$'}{letters}{'' if relative & 2 else '$'}{row + 1}"


def formula(tokens: bytes, new: bool) -> str | None:
    """The formula that tokens stand for, or None if one isn't known."""
    stack: list[str] = []
    at = 0
    try:
        while at < len(tokens):
            kind = tokens[at]
            base = kind if kind < 0x20 else 0x20 | kind & 0x1F
            at += 1
            if base in OPERATORS:
                right, left = stack.pop(), stack.pop()
                stack.append(left + OPERATORS[base] + right)
            elif base in (0x12, 0x13):
                stack.append(("+" if base == 0x12 else "-") + stack.pop())
            elif base == 0x14:
                stack.append(stack.pop() + "%")
            elif base == 0x15:
                stack.append(f"({stack.pop()})")
            elif base == 0x16:
                stack.append("")
            elif base == 0x17:
                text = string(tokens, at, new, "cp1252", short=True)
                at += 1 + (1 + len(text) * (2 if tokens[at + 1] & 1 else 1) if new else len(text))
                stack.append('"' + text.replace('"', '""') + '"')
            elif base == 0x19:
                if tokens[at] & 0x10:
                    stack.append(f"SUM({stack.pop()})")
                at += 3 + (2 * (struct.unpack_from("<H", tokens, at + 1)[0] + 1) if tokens[at] & 4 else 0)
            elif base == 0x1C:
                stack.append(ERRORS[tokens[at]])
                at += 1
            elif base == 0x1D:
                stack.append("TRUE" if tokens[at] else "FALSE")
                at += 1
            elif base == 0x1E:
                stack.append(str(struct.unpack_from("<H", tokens, at)[0]))
                at += 2
            elif base == 0x1F:
                stack.append(number(struct.unpack_from("<d", tokens, at)[0]))
                at += 8
            elif base in (0x24, 0x25):
                ends = 1 if base == 0x24 else 2
                rows = struct.unpack_from(f"<{ends}H", tokens, at)
                at += 2 * ends
                if new:
                    cols = struct.unpack_from(f"<{ends}H", tokens, at)
                    at += 2 * ends
                    names = [_name(r, c & 0xFF, (c >> 14 & 1) | (c >> 14 & 2)) for r, c in zip(rows, cols)]
                else:
                    names = [_name(r & 0x3FFF, tokens[at + k], (r >> 14 & 1) | (r >> 14 & 2)) for k, r in enumerate(rows)]
                    at += ends
                stack.append(":".join(names))
            elif base in (0x21, 0x22):
                count = None
                if base == 0x22:
                    count, at = tokens[at] & 0x7F, at + 1
                name, fixed = FUNCTIONS[struct.unpack_from("<H", tokens, at)[0] & 0x7FFF]
                at += 2
                n = count if count is not None else fixed
                if n is None or n > len(stack):
                    return None
                given = stack[len(stack) - n :]
                del stack[len(stack) - n :]
                stack.append(f"{name}({','.join(given)})")
            else:
                return None
    except (IndexError, KeyError, struct.error):
        return None
    return stack[0] if len(stack) == 1 else None


def _value(kind: int, body: bytes, strings: list[str], new: bool, page: str) -> Iterator[tuple[int, int, str]]:
    """(row, column, text) of the cells in a record; a formula's own text follows in another."""
    if kind == MULRK:
        row, col = struct.unpack_from("<HH", body)
        for k in range((len(body) - 6) // 6):
            yield row, col + k, number(rk(struct.unpack_from("<I", body, 6 + 6 * k)[0]))
        return
    if kind not in (NUMBER, RK, LABEL, RSTRING, LABELSST, BOOLERR, FORMULA):
        return
    row, col = struct.unpack_from("<HH", body)
    if kind == NUMBER:
        text = number(struct.unpack_from("<d", body, 6)[0])
    elif kind == RK:
        text = number(rk(struct.unpack_from("<I", body, 6)[0]))
    elif kind == LABELSST:
        at = struct.unpack_from("<I", body, 6)[0]
        text = strings[at] if at < len(strings) else ""
    elif kind == BOOLERR:
        text = ERRORS.get(body[6], "#N/A") if body[7] else "true" if body[6] else "false"
    elif kind == FORMULA:
        if body[12:14] != b"\xff\xff":
            text = number(struct.unpack_from("<d", body, 6)[0])
        else:
            text = {1: "true" if body[8] else "false", 2: ERRORS.get(body[8], "#N/A")}.get(body[6], "")
    else:
        text = string(body, 6, new, page)
    yield row, col, text


def _globals(data: bytes) -> tuple[bool, str, list[str], list[tuple[int, int, int, str]]]:
    """Whether the strings are of the new kind, the code page, the shared strings, and (place, state, type, name) of the sheets."""
    new, page, strings, sheets = True, "cp1252", [], []
    for k, (kind, body, more) in enumerate(records(data)):
        if k == 0:
            if kind != BOF or len(body) < 4 or struct.unpack_from("<H", body)[0] not in (0x500, 0x600):
                raise ConvertError("visibility_read_error", "the workbook's version is not known")
            new = struct.unpack_from("<H", body)[0] == 0x600
        elif kind == FILEPASS:
            raise ConvertError("visibility_read_error", "the workbook is encrypted")
        elif kind == CODEPAGE:
            code = struct.unpack_from("<H", body)[0]
            page = {1200: "utf-16le", 32768: "mac-roman", 32769: "cp1252"}.get(code, f"cp{code}")
            try:
                b"".decode(page)
            except LookupError:
                page = "cp1252"
        elif kind == BOUNDSHEET:
            place, state, sort = struct.unpack_from("<IBB", body)
            sheets.append((place, state & 3, sort, string(body, 6, new, page, short=True)))
        elif kind == SST:
            strings = shared_strings(body, more)
        elif kind == EOF:
            break
    return new, page, strings, sheets


def xls(data: bytes) -> tuple[list[Sheet], list[str]]:
    """The worksheets and warnings; what hides a row or column must be readable, or the workbook fails."""
    try:
        _, book = _stream(data, "Workbook", "Book")
    except ConvertError as e:
        raise ConvertError("visibility_read_error", str(e)) from None
    new, page, strings, places = _globals(book)
    out, unread = [], 0
    for place, state, sort, name in places:
        if sort != 0:
            continue
        sheet, last = Sheet(name, state != 0), None
        found = records(book, place)
        if next(found, (0, b"", []))[0] != BOF:
            raise ConvertError("visibility_read_error", f"no sheet at the place of {name!r}")
        depth, ended = 1, False
        for kind, body, _ in found:
            try:
                if kind == BOF:  # a chart inside the sheet
                    depth += 1
                elif kind == EOF:
                    depth -= 1
                    if not depth:
                        ended = True
                        break
                elif depth > 1:
                    continue
                elif kind == ROW:
                    row, height, flags = struct.unpack_from("<H", body)[0], struct.unpack_from("<H", body, 6)[0], struct.unpack_from("<H", body, 12)[0]
                    if flags & 0x20 or height & 0x7FFF == 0:
                        sheet.hidden_rows.append((row, row))
                elif kind == COLINFO:
                    first, end, width, _, flags = struct.unpack_from("<5H", body)
                    if flags & 1 or width == 0:
                        sheet.hidden_cols.append((first, end))
                elif kind == STRING and last:
                    sheet.put(*last, piece(string(body, 0, new, page)))
                for row, col, text in _value(kind, body, strings, new, page):
                    own = None
                    if kind == FORMULA:
                        own = formula(body[22 : 22 + struct.unpack_from("<H", body, 20)[0]], new)
                        unread += own is None
                        last = (row, col)
                    sheet.put(row, col, piece(text), piece(own) if own else None)
            except (struct.error, IndexError) as e:
                raise ConvertError("visibility_read_error" if kind in (ROW, COLINFO) else "workbook_parse_error", str(e)) from None
        if not ended:
            raise ConvertError("visibility_read_error", f"the sheet {name!r} has no end")
        out.append(sheet)
    return out, [f"formulas-unread: {unread} cells show their values alone"] if unread else []


def xls_scan(data: bytes) -> str:
    """The values of all cells in the order of the stream, by one pass that knows no sheets."""
    _, book = _stream(data, "Workbook", "Book")
    new, page, strings, _ = _globals(book)
    out: list[str] = []
    for kind, body, _ in records(book):
        if kind == STRING:
            out.append(string(body, 0, new, page))
        out += [text for _, _, text in _value(kind, body, strings, new, page)]
    return "\n".join(t for t in out if t)
