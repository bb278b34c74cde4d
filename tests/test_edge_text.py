import pytest

from tarnflow.schemas import GraphError
from tarnflow.sources.edge_text import from_dataframe, is_header, read_edge_text

#: A row a rule of the grammar: separators, blanks, line ends, comments, headers, further columns, zeros, limits.
GOOD = [
    ("src,dst\n17,4\n4,90\n90,17", [(17, 4), (4, 90), (90, 17)]),
    ("17\t4\n4\t90\n", [(17, 4), (4, 90)]),
    ("  8  ,  9  \n 9\t 8 \r\n", [(8, 9), (9, 8)]),
    ("\r\n#a,b\r\n  # 1,2\r\n\r\nu,v\r\n#5,6\r\n60,61\r\n   \r\n", [(60, 61)]),
    ("12,13,0.5,note\n13\t14\tx,y\n", [(12, 13), (13, 14)]),
    ("x\n007,8\n2147483647,0", [(7, 8), (2147483647, 0)]),
    ("", []),
    ("# nothing but this\n", []),
    ("99\n3,1\n", [(3, 1)]),
    ("p\rq,1\n3,1\n", [(3, 1)]),  # a lone carriage return ends no line
    ("3,1\n3,1\n1,1\n", [(3, 1), (3, 1), (1, 1)]),  # copies and loops are kept here
]
BAD = [
    ("u,v\n5,6\n\n6,-7\n", ":4: negative id: -7"),
    ("-3,5\n", ":1: negative id: -3"),
    ("u,v\n4,4000000001\n", "id exceeds int32: 4000000001"),
    ("u,v\n000123456789012345678901234567890,1\n", "id exceeds int32: 000123456789012345678901234567890"),
    ("u,v\n6,six\n", "not a number: 'six'"),
    ("u,v\n#\n77\n", ":3: expected two columns"),
    ("h\n+8,3\n", "not a number: '+8'"),
    ("h\n-0,3\n", "negative id: -0"),
    ("h\n8,\n", "not a number: ''"),
    ("h\n8\t3,4\n", "not a number: '3,4'"),
    ("h\n\t8\t3\n", "not a number: ''"),
    ("h\n8 3\n", "expected two columns"),
    ("h\n2147483648,0\n", "id exceeds int32: 2147483648"),
    ("h\n55555555555555555555555z,0\n", "id exceeds int32"),
    ("u,v\n1,2\n3,x\n4,y\n", ":3: not a number: 'x'"),  # the lowest one
]


def _write(tmp_path, text):
    path = tmp_path / "edges.csv"
    path.write_bytes(text.encode())
    return str(path)


@pytest.mark.parametrize("text, want", GOOD)
def test_good(spark, tmp_path, text, want):
    assert sorted(map(tuple, read_edge_text(spark, _write(tmp_path, text)).collect())) == sorted(want)


@pytest.mark.parametrize("text, want", BAD)
def test_bad(spark, tmp_path, text, want):
    with pytest.raises(GraphError) as e:
        read_edge_text(spark, _write(tmp_path, text)).collect()
    assert want in str(e.value)


def test_transpose_and_dataframe(spark, tmp_path):
    assert read_edge_text(spark, _write(tmp_path, "u,v\n30,40\n"), transpose=True).collect() == [(40, 30)]
    assert from_dataframe(spark.createDataFrame([(1, 2)], "a long, b long"), "a", "b").collect() == [(1, 2)]


def test_many_splits_and_line_number(spark, tmp_path):
    rows = ["u,v"] + [f"{i},{i * i % 911}" for i in range(1, 1000)]
    path = _write(tmp_path, "\n".join(rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert read_edge_text(spark, path).count() == 999
        rows[613] = "1,wrong"
        (tmp_path / "edges.csv").write_text("\n".join(rows))
        with pytest.raises(GraphError, match=":614: not a number"):
            read_edge_text(spark, path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


@pytest.mark.parametrize("line", ["1,2," + "x" * 270000, "1,2," + "é" * 132000, "# " + "c" * 262144, " " * 262144])
def test_long_lines_of_any_kind(spark, tmp_path, line):
    with pytest.raises(GraphError, match="longer than 262144"):
        read_edge_text(spark, _write(tmp_path, f"u,v\n{line}\n")).collect()


def test_longest_line(spark, tmp_path):
    assert read_edge_text(spark, _write(tmp_path, "1,2," + "é" * 131000 + "\n")).collect() == [(1, 2)]


def test_header_rule():
    assert is_header("1,two") and is_header("42") and not is_header("-1,2") and not is_header("3000000000,1")
