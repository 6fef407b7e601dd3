"""Reason codes from source text: a file is read in chunks of lines."""

from logsift.operators.catalogs import codes_from_source

SRC = ['// ## Intake :: DONE', '// Business checks', '    A_CODE("A_CODE", "first", ReasonCategory.BUSINESS_EXCEPTION),',
       '    B_CODE("B_CODE", "second", ReasonCategory.TECHNICAL_EXCEPTION),', '// ## Match',
       '    C_CODE("C_CODE", "no section", ReasonCategory.BUSINESS_EXCEPTION),',
       '    private static Map tempMap = new HashMap<>();', '        tempMap.put(12001, new ReasonCode("D_CODE", "data"));',
       '// Data access', '        tempMap.put(17002, new ReasonCode("E_CODE", "again"));',
       '    x = tempMap = new HashMap', '        tempMap.put(17003, new ReasonCode("F_CODE", "later"));']


def test_chunks_carry_stage_and_section(spark):
    rows = [(f, i, l) for f in ("S.java", None) for i, l in enumerate(SRC)] + [("S.java", None, "// Before all")]
    df = spark.createDataFrame(rows, "file string, line_no int, line string")
    wanted = {"A_CODE": ("Intake", "Business checks"), "B_CODE": ("Intake", "Business checks"), "C_CODE": ("Match", ""),
              "D_CODE": ("", ""), "E_CODE": ("", "Data access"), "F_CODE": ("", "Data access")}
    for chunk in (1, 2, 5, 10000):
        out = codes_from_source(df, chunk_lines=chunk)
        assert {r.code: (r.stage, r.section) for r in out.collect()} == wanted
