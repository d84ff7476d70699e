"""Dumps by byte ranges: the same rows wherever the ranges end."""

import random

import pytest

from lodestar.sources import catalog, dumps

COLUMNS = ["a", "b", "c"]


def written(seed, rows):
    """A dump with strings that hold quotes, parentheses, statements and line ends; and its rows."""
    r, out, want = random.Random(seed), [], []
    texts = ["it's", ")", "('x', 1)", "é)'(", "", "INSERT INTO p (a) VALUES ('", "line\r\nend", "a\\", "null", "; ,", "NULL", ")" * 5, "x" * 300]
    while len(want) < rows:
        order = r.choice([["a", "b", "c"], ["c", "a", "b"], None])
        lines = []
        for _ in range(r.randint(1, 9)):
            row = {k: r.choice([r.choice(texts), None, str(r.randint(0, 99))]) for k in COLUMNS}
            quoted = lambda v: "NULL" if v is None else v if v.isdigit() and r.random() < 0.5 else "'" + v.replace("'", "''") + "'"
            lines.append("(" + r.choice([", ", ",", " , "]).join(quoted(row[k]) for k in order or COLUMNS) + ")")
            want.append(tuple(row[k] for k in COLUMNS))
        names = "" if order is None else " (" + ", ".join(f"`{c}`" for c in order) + ")"
        out.append(f"INSERT INTO `p`{names} VALUES{r.choice([' ', chr(10)])}" + r.choice([",", ",\n"]).join(lines) + ";\n")
    return "".join(out), want


@pytest.mark.parametrize("size", [37, 64, 500, 4096, 1 << 27])
def test_same_rows_whatever_the_ranges(spark, tmp_path, size):
    text, want = written(size, 150)
    (tmp_path / "p.sql").write_bytes(text.encode())
    assert [tuple(r[c] for c in COLUMNS) for r in catalog.insert_rows(text, COLUMNS)] == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = dumps.read_dump(spark, str(tmp_path / "p.sql"), COLUMNS).orderBy("unit").collect()
        ranges = dumps.segments(spark, str(tmp_path / "p.sql")).select("range").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [tuple(r[c] for c in COLUMNS) for r in got] == want
    assert ranges > 1 or size > len(text)


def test_errors_and_several_files(spark, tmp_path):
    (tmp_path / "x.sql").write_text("INSERT INTO p (a, b, c) VALUES (1, 2, 3);")
    (tmp_path / "y.sql").write_text("-- nothing (here)\nINSERT INTO p VALUES (4,5,6), (7,8,9);\n")
    assert sorted(r.a for r in dumps.read_dump(spark, str(tmp_path), COLUMNS).collect()) == ["1", "4", "7"]
    for i, bad in enumerate(["INSERT INTO p (a, b, c) VALUES (1, 2);", "INSERT INTO p (a, b) VALUES (1, 2);", "INSERT INTO p (a, b, c) VALUES (1, 2, 'x"]):
        (tmp_path / f"bad{i}").mkdir()
        (tmp_path / f"bad{i}" / "z.sql").write_text(bad)
        with pytest.raises(Exception, match="columns|value"):
            dumps.read_dump(spark, str(tmp_path / f"bad{i}"), COLUMNS).collect()
