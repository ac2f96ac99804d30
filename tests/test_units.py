"""Units and bytes against plain string work."""

import re

from graphloom.extract import units

HEAD = "       PROCEDURE DIVISION.\n"
TEXTS = {
    "a": "       X.\n" + HEAD + "           MOVE 1 TO A.\n       P-1.\n           MOVE 'é€😀' TO B.\n\n       p-2.   \n           PERFORM P-1 MOVE 1 TO X.\n           IF A = 1\n  \n",
    "b": HEAD.replace("\n", "\r\n") + "P.\r\n           OPEN INPUT F\r\n               G.\r\n",
    "c": HEAD.replace("\n", "\r") + "       ü.\r       SECTION.\r       Q.\r\r",
    "d": "       P-1.\n           STOP RUN.\n",
    "e": "",
    "f": None,
    "g": "procedure division\n P. \n   P-1.\n   P-1.",
    "h": HEAD + "       LAST. \n       R.\n           DISPLAY 'x'.　 \n",
}


def plain(text):
    lines = re.findall(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+", text or "")
    begun = next((i for i, x in enumerate(lines) if "PROCEDURE DIVISION" in x.upper()), len(lines))
    heads = [(i, m[1].upper()) for i, x in enumerate(lines) if i > begun and (m := re.match(r"^ {0,7}([A-Za-z0-9][A-Za-z0-9-]*)\.\s*$", x.rstrip("\r\n"), re.ASCII)) and m[1].upper() not in units.NOT_UNITS]
    for n, (i, name) in enumerate(heads):
        end = heads[n + 1][0] if n + 1 < len(heads) else len(lines)
        raw = "".join(lines[i:end])
        start = len("".join(lines[:i])) + len(raw) - len(raw.lstrip())
        bytes_before = len("".join(lines[:i]).encode()) + len(raw) - len(raw.lstrip())
        yield n + 1, name, i + 1, end, start, start + len(raw.strip()), bytes_before, bytes_before + len(raw.strip().encode()), raw.strip()


def files(spark):
    return spark.createDataFrame([(k, v, "clash") for k, v in TEXTS.items()], "file_name string, text string, line string")


def test_units_against_plain_strings(spark):
    got = sorted(map(tuple, units.units(files(spark)).collect()))
    assert got == sorted((k, *row) for k, v in TEXTS.items() for row in plain(v))
    assert {r[0] for r in got} == {"a", "b", "c", "g", "h"}
    for name, _, _, _, _, start, end, first, last, text in got:
        assert TEXTS[name][start:end] == text == TEXTS[name].encode()[first:last].decode()
    assert units.units(files(spark).limit(0)).collect() == []


def test_every_place_in_bytes(spark):
    places = [(k, i) for k, v in TEXTS.items() for i in range(len(v or "") + 3)] + [("none", 1), ("a", -1)]
    got = {(r["file_name"], r["place"]): r["byte"] for r in units.byte_places(files(spark), spark.createDataFrame(places, "file_name string, place int")).collect()}
    assert got == {(k, i): len(TEXTS[k][:i].encode()) if TEXTS.get(k) and i >= 0 else None for k, i in places}


def test_evidence_of_units(spark):
    got = {(r["file_name"], r["unit_no"]): r for r in units.unit_evidence(files(spark)).collect()}
    assert set(got) == {(k, row[0]) for k, v in TEXTS.items() for row in plain(v)}
    one, two = got["a", 1], got["a", 2]
    assert one["unit_counts"] == {"move": 1} and one["file_counts"] == {"move": 2, "perform": 1, "if": 1}
    assert two["unit_counts"] == {"perform": 1, "if": 1} and [(o["op"], o["start"]) for o in two["operations"]] == [("perform", 8), ("if", 9)]
    assert [tuple(r) for r in one["relations"]] == [("P-2", "PERFORMS", "P-1"), ("a", "CONTAINS_PARAGRAPH", "P-1")]
    assert [tuple(r) for r in two["relations"]] == [("P-2", "PERFORMS", "P-1"), ("a", "CONTAINS_PARAGRAPH", "P-2")]
    opened = got["b", 1]
    assert [(o["op"], o["start"], o["end"]) for o in opened["operations"]] == [("open", 3, 4)]
    assert got["c", 1]["unit_counts"] is None and got["c", 1]["operations"] == []
