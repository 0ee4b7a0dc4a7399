"""Extractors of a user's own as table functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn

FOUND = "path string, language string, line int, col int, end_col int, text string, symbol string"
Extract = Callable[[str, str, str], Iterable[tuple]]


def extracted(files: DataFrame, extract: Extract, columns: str = "") -> DataFrame:
    """R2 by a user's function: what ``extract(path, language, content)`` finds in each of ``files`` (path, language, content, …).

    It yields (line, col, text) and a value for each of ``columns`` (a DDL list of its
    own further columns). The table function takes the files as a table that it asks
    for partitioned by path, and states its schema itself; rows have the columns that
    ``extract_references`` gives, so R4 takes them. A null content is an empty one.
    """
    own = StructType.fromDDL(columns).names if columns else []
    schema = StructType.fromDDL(FOUND + (f", {columns}" if columns else ""))

    @udtf
    class Extractor:
        @staticmethod
        def analyze(files: AnalyzeArgument) -> AnalyzeResult:
            missing = {"path", "language", "content"} - set(files.dataType.names)
            if missing:
                raise ValueError(f"the table of files lacks {sorted(missing)}")
            return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("path")])

        def eval(self, file) -> Iterable[tuple]:
            for line, col, text, *more in extract(file["path"], file["language"], file["content"] or ""):
                if len(more) != len(own):
                    raise ValueError(f"{len(own)} further values expected, {len(more)} given")
                yield (file["path"], file["language"], line, col, col + len(text), text, text.lower(), *more)

    return Extractor(files.select("path", "language", "content").asTable())
