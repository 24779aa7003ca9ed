"""Line dedup against a direct reading of the rule."""

import duckdb

from check_queries import compare
from kgspark.llm.line_dedup import dedup_lines
from kgspark.llm.q05_line_dedup import SQL, op5_line_dedup


def brute(rows):
    seen, out = set(), []
    for key, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines, gone = (text or "").split("\n"), set()
        for p in range(len(lines) - 2):
            body = tuple(lines[p:p + 3])
            if any(x.strip(" \t\r") for x in body):
                if body in seen:
                    gone |= {p, p + 1, p + 2}
                seen.add(body)
        out.append((key, len(lines), len(gone), "\n".join(x for p, x in enumerate(lines) if p not in gone)))
    return out


def test_awkward_rows(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\na\na\na\na"), (4, "\n\n\n\n"), (5, "\n \n\t\n"), (6, None), (7, ""),
            (8, "b\nc\nd\n"), (9, "b\nc\nd\r\nz"), (10, "a\nb\nc"), (None, "q\na\nb\nc"), (11, "l\n" * 4000 + "a\nb\nc"),
            (12, "one\ntwo"), (13, "one\ntwo")]
    df = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, lines string").selectExpr("*", "1 AS me")
    found = dedup_lines(df)
    assert found.schema["row"].dataType.names == df.columns
    assert sorted((repr((r.row.doc_id, r.n_lines, r.n_removed, r.text)) for r in found.collect())) == sorted(map(repr, brute(rows)))


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")], "doc_id long, text string")
    assert sorted((r.row.doc_id, r.text) for r in dedup_lines(df).collect()) == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "")]
    assert dedup_lines(df.limit(0)).count() == 0


def test_op5_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df, cur = op5_line_dedup(spark, sf), con.execute(SQL)
    rows = [tuple(r) for r in df.collect()]
    assert compare(df.columns, rows, [c[0] for c in cur.description], cur.fetchall()) is None
    assert sum(r[2] for r in rows) > 0
