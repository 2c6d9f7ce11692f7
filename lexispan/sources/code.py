"""Source files made from templates, a set for each part, so that what is to be found in them can be told in SQL as well."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract

MARK = "{i}"


class Code:
    """Files (path, text), in each of which {i} stands for a part's key."""

    def __init__(self, spark: SparkSession, sf_dir: str, files: dict[str, str]):
        self.spark, self.sf_dir, self.templates = spark, sf_dir, files

    @cached_property
    def contents(self) -> DataFrame:
        files = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("content")) for p, t in self.templates.items()])
        key = F.col("p_partkey").cast("string")
        rows = self.spark.read.parquet(f"{self.sf_dir}/part.parquet").select("p_partkey", F.explode(files).alias("f"))
        rows = rows.select(F.replace("f.path", F.lit(MARK), key).alias("path"), F.col("p_partkey").alias("mtime"), F.replace("f.content", F.lit(MARK), key).alias("content"))
        return rows.select("path", "mtime", F.octet_length("content").cast("bigint").alias("size"), "content")

    @cached_property
    def files(self) -> DataFrame:
        return self.contents.select("path", "mtime", "size")

    @cached_property
    def lines(self) -> DataFrame:
        return extract.lines_of(self.contents)


def expected(columns: str, rows: list[tuple]) -> str:
    """The rows, for each part, as a statement of DuckDB; columns as in DDL, texts with {i} for the part's key."""
    names = [c.strip().split(" ") for c in columns.split(",")]

    def value(v, kind: str) -> str:
        if v is None:
            return f"NULL::{kind}"
        return f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else f"{v}::{kind}"

    listed = ", ".join("(" + ", ".join(value(v, k) for v, (_, k) in zip(r, names, strict=True)) + ")" for r in rows)
    out = ", ".join(f"replace({n}, '{MARK}', i::VARCHAR) AS {n}" if k == "VARCHAR" else n for n, k in names)
    return f"SELECT {out} FROM (SELECT p_partkey AS i FROM part) CROSS JOIN (VALUES {listed}) AS t({', '.join(n for n, _ in names)})"
