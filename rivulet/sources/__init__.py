"""Sources, sinks and formats."""

from .formats import CsvFormat, JsonFormat, ParquetFormat, parse_instant
from .sinks import ConsoleSink, FileSink, LogSink, MemorySink, PartitionedSink, ServiceSink, register_writer
from .sources import (
    DelayedListSource,
    FileSource,
    ListSource,
    PointerSource,
    ServiceSource,
    object_store_source,
    register_adapter,
)

__all__ = [
    "ConsoleSink", "CsvFormat", "DelayedListSource", "FileSink", "FileSource", "JsonFormat", "ListSource", "LogSink", "MemorySink",
    "ParquetFormat", "PartitionedSink", "PointerSource", "ServiceSink", "ServiceSource", "object_store_source", "parse_instant",
    "register_adapter", "register_writer",
]
