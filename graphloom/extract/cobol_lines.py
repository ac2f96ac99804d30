"""The lines of COBOL programs with what stands around each of them, batch by batch, and the paragraphs of their texts with their places.

A program stands in one row, so the task that holds the row can walk over its lines once: what is carried from line to line needs no shuffle
and no sort. Extractors keep the few lines that they ask for; only those are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa

OPERATIONS = ("PERFORM", "READ", "WRITE", "MOVE", "OPEN", "CLOSE", "DISPLAY", "IF", "GO", "ADD")
#: Words that begin a statement, and so end one that runs over several lines.
STATEMENTS = (*OPERATIONS, "ACCEPT", "CALL", "COMPUTE", "DELETE", "DIVIDE", "ELSE", "EVALUATE", "EXIT", "GOBACK", "INITIALIZE", "INSPECT", "MULTIPLY", "REWRITE", "SET", "START", "STOP", "STRING", "SUBTRACT", "UNSTRING", "WHEN", "END-IF", "END-READ", "END-PERFORM", "END-EVALUATE", "END-WRITE")
NOT_PARAGRAPHS = ("EXIT", "GOBACK", "END-IF", "END-PERFORM")
NOT_UNITS = ("SECTION", "DIVISION")
#: Characters of a batch that is handed on; a longer program goes alone.
SLICE = 200_000

_OPERATIONS, _STATEMENTS, _VERBS = frozenset(OPERATIONS), frozenset(STATEMENTS), frozenset(s for s in STATEMENTS if not s.startswith("END-"))
_DIVISIONS = frozenset(("IDENTIFICATION", "ENVIRONMENT", "DATA", "PROCEDURE"))
#: The end of a line as Java's $ has it, and what may stand there.
_END = "(?=[\x85\u2028\u2029]?\\Z)"
_ENDS = frozenset(" \t\x0b\f\r\x85\u2028\u2029")
_FULL_STOP = frozenset(".\x85\u2028\u2029")
_TAIL = re.compile(rf"\s+{_END}", re.ASCII)
_WORD = re.compile(r"\s*([A-Za-z0-9-]+)", re.ASCII)
_DIVISION = re.compile(r"\s+DIVISION", re.ASCII | re.IGNORECASE)
_SECTION = re.compile(r"\s*([A-Za-z0-9-]+)\s+SECTION(?u:\b)", re.ASCII | re.IGNORECASE)
_DESCRIBED = re.compile(r"\s*[FS]D\s+([A-Za-z0-9-]+)", re.ASCII | re.IGNORECASE)
_ITEM = re.compile(r"\s*(\d{2})\s+([A-Za-z0-9-]+)", re.ASCII)
_PARAGRAPH = re.compile(rf" {{0,7}}([A-Za-z0-9][A-Za-z0-9-]*)\s*\.{_END}", re.ASCII)
_HEADER = re.compile(rf" {{0,7}}[A-Za-z0-9][A-Za-z0-9-]*(?:\s+SECTION)?\s*\.{_END}", re.ASCII | re.IGNORECASE)
#: A literal, a number with a point, a word, any other character.
_TOKEN = re.compile(r"\"[^\"]*+\"?|'[^']*+'?|\d+\.\d+|[A-Za-z0-9][A-Za-z0-9-]*+|[^\sA-Za-z0-9]", re.ASCII)

_STATEMENT = pa.struct([("paragraph", pa.string()), ("op", pa.string()), ("text", pa.string()), ("end", pa.int32())])
_LINES = {"file_name": pa.string(), "line": pa.int32(), "last": pa.int32(), "raw": pa.string(), "word": pa.string(), "division": pa.string(), "opens_division": pa.bool_(), "section": pa.string(), "file": pa.string(), "level": pa.string(), "item": pa.string(), "record": pa.string(), "paragraph": pa.string(), "paragraph_no": pa.int32(), "paragraph_end": pa.int32(), "op": pa.string(), "op_text": pa.string(), "op_end": pa.int32(), "statements": pa.list_(_STATEMENT)}
LINES = "file_name string, line int, last int, raw string, word string, division string, opens_division boolean, section string, file string, level string, item string, record string, paragraph string, paragraph_no int, paragraph_end int, op string, op_text string, op_end int, statements array<struct<paragraph:string,op:string,text:string,end:int>>"


def _batches(parts: Iterator[pa.RecordBatch], columns: dict[str, pa.DataType], rows_of: Callable[[str, str], list[list]]) -> Iterator[pa.RecordBatch]:
    """Rows of ``columns`` of batches of programs (file_name, text)."""
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), columns.values(), strict=True)], names=[*columns])
    for part in parts:
        rows, held = [], 0
        for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            rows += rows_of(name, text or "")
            held += len(text or "")
            if held >= SLICE and rows:
                yield made(rows)
                rows, held = [], 0
        if rows:
            yield made(rows)


def line_batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batches(parts, _LINES, _lines)


def _lines(name: str, text: str) -> list[list]:
    """The lines of a program: what is carried up to each of them; on the first line of a paragraph, an operation or a statement its end, too."""
    cut = text.split("\n")
    last, rows = len(cut), []
    division = section = file = record = paragraph = None
    head = operation = statement = None  # rows, or parts of them, that go on
    number = 0
    for n, raw in enumerate(cut, 1):
        if raw[-1:] in _ENDS:
            raw = _TAIL.sub("", raw)
        code = "" if raw[6:7] == "*" else raw
        found = _WORD.match(code)
        word = found[1].upper() if found else ""
        opens = word in _DIVISIONS and _DIVISION.match(code, found.end()) is not None
        if opens:
            division = word
        entered = _SECTION.match(code)
        if entered:
            section = entered[1].upper()
        if opens or (entered and not any(map(str.isdigit, entered[1]))):
            file = ""
        elif word in ("FD", "SD") and (described := _DESCRIBED.match(code)):
            file = described[1].upper()
        row = [name, n, last, raw, word, division, opens, section, file, *[None] * 9, []]
        rows.append(row)
        if division == "DATA":
            item = _ITEM.match(code)
            if item and item[1] not in ("66", "88"):
                if item[1] in ("01", "77"):
                    record = item[2].upper()
                row[9:12] = item[1], item[2].upper(), record
        if division != "PROCEDURE":
            continue
        named = _PARAGRAPH.match(code) if code[-1:] in _FULL_STOP else None
        if named and named[1].upper() not in NOT_PARAGRAPHS:
            if head:
                head[14] = n - 1
            head, number = row, number + 1
            row[12:15] = named[1].upper(), number, last

        # operations begin a line
        if not opens and code.strip(" "):
            if word in _STATEMENTS or named:
                operation = row if word in _OPERATIONS else None
                if operation:
                    row[15], row[17] = word, n
            elif operation and operation[15] in ("OPEN", "CLOSE"):
                operation[16] = f"{operation[16] or operation[3]} {code}"
                operation[17] = n
            if code.endswith("."):
                operation = None

        # statements begin anywhere
        if code[-1:] in _FULL_STOP and _HEADER.match(code):
            paragraph = word
        elif not opens:
            for token in _TOKEN.findall(code[7:72]):
                upper = token.upper()
                if token == "." or upper.startswith("END-"):
                    statement = None
                elif upper in _VERBS:
                    statement = {"paragraph": paragraph, "op": upper.lower(), "text": [token], "end": n}
                    row[18].append(statement)
                elif statement:
                    statement["text"].append(token)
                    statement["end"] = n
    for row in rows:
        for told in row[18]:
            told["text"] = " ".join(told["text"])
    return rows


#: A line with its end, which may be of any of three kinds; the last one may have none.
_LINE = re.compile(r"[^\r\n]*+(?:\r\n|\n|\r)|[^\r\n]++")
_UNIT = re.compile(rf" {{0,7}}([A-Za-z0-9][A-Za-z0-9-]*)\.\s*{_END}", re.ASCII)
_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_UNITS = {"file_name": pa.string(), "unit_no": pa.int64(), "unit": pa.string(), "start_line": pa.int32(), "end_line": pa.int32(), "start_offset": pa.int64(), "end_offset": pa.int64(), "start_byte": pa.int64(), "end_byte": pa.int64(), "text": pa.string()}
UNITS = "file_name string, unit_no long, unit string, start_line int, end_line int, start_offset long, end_offset long, start_byte long, end_byte long, text string"


def unit_batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batches(parts, _UNITS, _units)


def _units(name: str, text: str) -> list[list]:
    """Paragraphs after the first line that says PROCEDURE DIVISION, each up to the next one, without white space at either end."""
    cut, begun, heads, at = _LINE.findall(text), False, [], 0
    for n, raw in enumerate(cut, 1):
        if begun and (found := _UNIT.match(raw.rstrip("\r\n"))) and found[1].upper() not in NOT_UNITS:
            heads.append((n, at, found[1].upper()))
        begun = begun or "PROCEDURE DIVISION" in raw.upper()
        at += len(raw)
    rows, byte, done = [], 0, 0
    for k, (n, start, unit) in enumerate(heads):
        following = heads[k + 1] if k + 1 < len(heads) else (len(cut) + 1, len(text), "")
        raw = text[start : following[1]]
        own = raw.lstrip(" ")
        indent, own = len(raw) - len(own), own.rstrip(_SPACE)
        byte += len(text[done : start + indent].encode())
        done = start + indent
        rows.append([name, k + 1, unit, n, following[0] - 1, done, done + len(own), byte, byte + len(own.encode()), own])
    return rows
