"""Lines of programs are told where the program lies: nothing of them is sorted or shuffled but what an extractor keeps."""

from graphloom.extract import cobol, units

TEXT = """       DATA DIVISION.
       FILE SECTION.
       FD F-A.
       01 R-A.
          05 X PIC 9.
       PROCEDURE DIVISION.
       P-1.
           OPEN INPUT F-A
                OUTPUT F-B
           PERFORM P-1 THRU P-3. WRITE R-A.
      *    WRITE R-B.
       P-2.
       P-3.
           GO TO P-2."""


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_lines_go_through_one_shuffle_of_texts(spark):
    files = spark.createDataFrame([("a", TEXT), ("b", None)], "file_name string, text string")
    lines = cobol.program_lines(files)
    for told in (lines, cobol.statements(lines), cobol.operations(lines), cobol.variables(lines), cobol.paragraphs(lines), units.units(files)):
        assert _plan(told).count("Exchange") == 1 and "Window" not in _plan(told) and "Sort" not in _plan(told)
    assert [(r["op"], r["text"], r["start"], r["end"]) for r in cobol.operations(lines).orderBy("start").collect()] == [("open", "OPEN INPUT F-A OUTPUT F-B", 8, 9), ("perform", "PERFORM P-1 THRU P-3. WRITE R-A.", 10, 10), ("goto", "GO TO P-2.", 14, 14)]
    assert sorted(map(tuple, cobol.links(lines).drop("file_name").collect())) == [("F-A", "WRITES_RECORD", "R-A"), ("P-1", "PERFORMS", "P-1"), ("P-1", "PERFORMS", "P-2"), ("P-1", "PERFORMS", "P-3"), ("P-3", "GOES_TO", "P-2"), ("a", "WRITES", "F-A")]
    assert lines.filter("file_name = 'b'").count() == 1
