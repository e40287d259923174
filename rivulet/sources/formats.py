"""Data formats: JSON and CSV, in and out, and times."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, DataFrameReader, DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns that are tried in turn for a time; local fields are taken as UTC.
TIME_PATTERNS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]X", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd",
)


def parse_instant(column: Column | str) -> Column:
    """A time from text in any of ``TIME_PATTERNS``; null where none fits."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(p)) for p in TIME_PATTERNS))


@dataclass(frozen=True)
class JsonFormat:
    """One object a line.  Unknown fields are ignored, or refused if ``strict``."""

    strict: bool = False
    name: str = "json"

    def reader(self, reader: DataFrameReader, schema: str) -> DataFrameReader:
        return reader.schema(schema).format("json")

    def read(self, reader, schema: str, path: str) -> DataFrame:  # noqa: ANN001
        if not self.strict:
            return self.reader(reader, schema).load(path)
        kind = T._parse_datatype_string(schema)
        lines = reader.format("text").load(path).where(F.length(F.trim("value")) > 0)
        extra = F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, kind.names)))
        checked = F.when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(extra, ", ")))).otherwise(F.col("value"))
        return lines.select(F.from_json(checked.cast("string"), kind).alias("r")).select("r.*")

    def write(self, df: DataFrame, writer: DataFrameWriter, path: str) -> None:
        writer.json(path)


@dataclass(frozen=True)
class CsvFormat:
    """Comma-separated values.

    ``columns``: names in the order of the file (for reading), or the columns
    to write and their order.  With ``header`` a line that begins with the first
    column's name is skipped.  Rows that do not fit the schema are dropped.
    """

    columns: tuple[str, ...] = ()
    header: bool = False
    separator: str = ","
    null: str = ""
    times: dict[str, str] = field(default_factory=dict)
    name: str = "csv"

    def read(self, reader, schema: str, path: str) -> DataFrame:  # noqa: ANN001
        kind = T._parse_datatype_string(schema)
        names = list(self.columns) or kind.names
        given = T.StructType([T.StructField(n, T.StringType()) for n in names])
        options = {"sep": self.separator, "mode": "DROPMALFORMED", "header": "false"}
        if self.null:
            options["nullValue"] = self.null
        rows = reader.options(**options).schema(given).csv(path)
        if self.header:
            rows = rows.where(~F.coalesce(F.col(names[0]) == names[0], F.lit(False)))
        made = []
        for f in kind:
            c = F.col(f.name)
            made.append((parse_instant(c) if isinstance(f.dataType, T.TimestampType) else c.try_cast(f.dataType)).alias(f.name))
        # a value that is there and does not fit its type makes its row malformed
        bad = [F.col(f.name).isNotNull() & (F.length(f.name) > 0) & m.isNull() for f, m in zip(kind, made, strict=True) if not isinstance(f.dataType, T.StringType)]
        for b in bad:
            rows = rows.where(~b)
        return rows.select(*made)

    def write(self, df: DataFrame, writer: DataFrameWriter, path: str) -> None:
        writer.options(header=self.header, sep=self.separator, nullValue=self.null or "null", emptyValue="").csv(path)

    def shaped(self, df: DataFrame) -> DataFrame:
        """The chosen columns, times by their patterns."""
        cols = list(self.columns) or df.columns
        return df.select(*(F.date_format(c, self.times[c]).alias(c) if c in self.times else F.col(c) for c in cols))


@dataclass(frozen=True)
class ParquetFormat:
    """Columnar files."""

    name: str = "parquet"

    def read(self, reader, schema: str, path: str) -> DataFrame:  # noqa: ANN001
        return reader.schema(schema).parquet(path)

    def write(self, df: DataFrame, writer: DataFrameWriter, path: str) -> None:
        writer.parquet(path)


Format = JsonFormat | CsvFormat | ParquetFormat
