import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def brute():
    """Brute-force helpers that share no code with the operators."""
    import zlib

    class Brute:
        @staticmethod
        def crc(ids):
            return zlib.crc32(np.array(ids, "<u4").tobytes())

        @staticmethod
        def fold(i, parts):
            return zlib.crc32(str(i).encode()) % parts

    return Brute


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [
        (0, "the same text again and again for a while", "en", 1), (1, "the same text again and again for a while", "en", 1),
        (1, "the same text again and again for a while", "en", 1), (2, None, None, None), (3, "", "en", 0), (None, "no id here at all", None, 1),
        (4, "w " * 60_000, "en", 0), (5, " \t\n", "en", 0), (6, "Ünïcödé «quoted» 日本語 text 😀 ΑΣ", "de", 1), (7, "a\u0001b\x00c   d", "en", 1),
        (8, "İstanbul <|endoftext|> don't 123", "tr", 1),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, toxic int").selectExpr("*", "'x' AS h", "1 AS row", "'y' AS fp")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")
