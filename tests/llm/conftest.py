import pytest

LONG = "lorem ipsum dolor sit amet, " * 9000


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty, blank and very long texts, repeated rows, copies, and columns with clashing names."""
    rows = [
        (None, "a text without an id, long enough to be a line"), (1, None), (2, ""), (3, " \t\n\n "), (4, "word"),
        (5, LONG), (6, "the very same text stands here twice over\nand its second line as well"),
        (6, "the very same text stands here twice over\nand its second line as well"),
        (7, "the very same text stands here twice over\nand its second line as well"), (8, "😀 é ñ ß İ 日本語"), (9, LONG)]
    names = ("id", "row", "block", "fold", "x", "unit", "_row", "source")
    return spark.createDataFrame(
        [(*r, *(n for n in names)) for r in rows],
        "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")
