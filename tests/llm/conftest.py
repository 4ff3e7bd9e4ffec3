from __future__ import annotations

import pytest

#: Rows that every operator must take: nulls, blanks, repeats, clashing names, one very long text.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, key int, luck double, part string, n_lines int, size int, bucket int, mark int, __rest string, __gone int, __words int, row int, places int, name string, turn int, copies int, own_id int, chunk int, e int, kind int, g int, groups string, url string, host string"


def document(doc_id, text, lang="en", source="s1"):
    return (doc_id, text, lang, source, None, "x", 1, 0.5, None, 3, 9, 2, 7, "r", 4, 5, 6, 1, "n", 2, 3, 8, 1, 2, 3, 4, "gs", "u", "h")


@pytest.fixture(scope="session")
def odd_rows(spark):
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
    prose = "one two three four five six seven eight nine ten eleven twelve " * 8
    rows = [
        document(1, None), document(2, ""), document(3, " \t\n\x0b"), document(4, "a"), document(5, prose), document(5, prose), document(6, prose),
        document(None, prose), document(None, None, None, None), document(7, long), document(8, "é" * 300, None, "s2"), document(9, "\x00 zero", "en", None), document(10, prose, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_rows(odd_rows):
    return odd_rows.where("false")


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(1, 0, 1), (2, 1, 0), (5, 1, 0), (5, None, 1), (6, None, None), (None, 0, 1), (999, 1, 1), (7, 1, 0), (10, 0, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
