"""Edge lists in text: the first two columns of comma- or tab-separated lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.schemas import MAX_ID, MAX_LINE, GraphError

NUMBER = "^-?[0-9]+$"


def _strip(text: Column) -> Column:
    """Without spaces and carriage returns at the ends; tabs are content."""
    return F.btrim(text, F.lit(" \r"))


def _columns(line: Column) -> tuple[Column, Column, Column]:
    parts = F.split(line, F.when(F.contains(line, F.lit("\t")), F.lit("\t")).otherwise(F.lit(",")), -1)
    return F.size(parts) >= 2, _strip(F.get(parts, F.lit(0))), _strip(F.get(parts, F.lit(1)))


def _fault(token: Column) -> Column:
    """What is wrong with an id, null if nothing."""
    digits = F.ltrim(token, F.lit("0"))
    lead = F.length(F.ltrim(F.regexp_extract(token, "^[0-9]+", 0), F.lit("0")))
    # A number that 64 bits can't hold is too large whatever follows it.
    huge = (lead > 20) | ((lead == 20) & (F.ltrim(F.regexp_extract(token, "^[0-9]+", 0), F.lit("0")) > F.lit("18446744073709551615")))
    return (
        F.when(token.startswith("-"), F.concat(F.lit("negative id: "), token))
        .when(huge, F.concat(F.lit("id exceeds int32: "), token))
        .when(~token.rlike("^[0-9]+$"), F.concat(F.lit("not a number: '"), token, F.lit("'")))
        .when((F.length(digits) > 10) | (F.lpad(digits, 10, "0") > F.lit(str(MAX_ID))), F.concat(F.lit("id exceeds int32: "), F.when(digits == "", F.lit("0")).otherwise(digits)))
    )


def is_content(line: Column) -> Column:
    stripped = _strip(line)
    return (stripped != "") & ~stripped.startswith("#")


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Content lines with ``src``, ``dst`` and ``err``; ids are null where err tells why.  Lines of any kind that are too long are errors."""
    long = F.octet_length(F.col(column)) >= MAX_LINE
    kept = lines.where(is_content(F.col(column)) | long).withColumn("_line", _strip(F.col(column)))
    two, a, b = _columns(F.col("_line"))
    parsed = kept.withColumn("_two", two).withColumn("_a", a).withColumn("_b", b)
    err = F.when(long, F.lit(f"line is longer than {MAX_LINE} bytes")).when(~F.col("_two"), F.lit("expected two columns")).otherwise(F.coalesce(_fault(F.col("_a")), _fault(F.col("_b"))))
    parsed = parsed.withColumn("err", err)
    ids = [F.when(F.col("err").isNull(), F.col(c).try_cast("int")).alias(n) for c, n in (("_a", "src"), ("_b", "dst"))]
    return parsed.select(*lines.columns, *ids, "err")


def is_header(line: str) -> bool:
    """Whether a first content line names columns: fewer than two, or one of two that isn't a number."""
    s = line.strip(" \r")
    parts = s.split("\t" if "\t" in s else ",")
    number = lambda t: t.removeprefix("-").isdigit() and t.isascii()
    return len(parts) < 2 or not all(number(p.strip(" \r")) for p in parts[:2])


def read_edge_text(spark: SparkSession, path: str, transpose: bool = False) -> DataFrame:
    """``src, dst`` of a text file, unchecked for loops and copies.

    Lines end at newlines only.  A file's first content line may be a header; only that row is left out.  A line that can't be read is an
    error that names the lowest such line.  Splits are Spark's own: a line belongs to the split in which it starts.
    """
    text = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    firsts = text.where(is_content(F.col("value"))).groupBy("file").agg(F.min(F.struct("block", "row", "value")).alias("head")).select("file", "head.*").collect()  # a row a file
    headers = [(r["file"], r["block"], r["row"]) for r in firsts if is_header(r["value"])]
    if headers:
        gone = spark.createDataFrame(headers, "file string, block long, row long")
        text = text.join(F.broadcast(gone), ["file", "block", "row"], "left_anti")
    parsed = parse_lines(text)
    bad = parsed.where("err IS NOT NULL").orderBy("file", "block", "row").first()
    if bad is not None:
        # Only now are line numbers worth a pass in file order.
        path = bad["file"].removeprefix("file://")
        numbered = spark.read.option("lineSep", "\n").text(bad["file"]).rdd.zipWithIndex()
        value = bad["value"]
        line = numbered.filter(lambda x: x[0][0] == value).map(lambda x: x[1]).min() + 1
        raise GraphError(f"{path}:{line}: {bad['err']}")
    names = ("dst", "src") if transpose else ("src", "dst")
    return parsed.select(F.col(names[0]).alias("src"), F.col(names[1]).alias("dst"))


def from_dataframe(df: DataFrame, src: str, dst: str, transpose: bool = False) -> DataFrame:
    """Edges from two id columns; ids must be 0 to 2147483647 and not null, which scan() checks."""
    a, b = (dst, src) if transpose else (src, dst)
    return df.select(F.col(a).cast("int").alias("src"), F.col(b).cast("int").alias("dst"))
