"""Fill-in-the-middle texts: a document is cut in three and its parts are written in another order.

One full match of ``(unit)*`` with a regex library that keeps every repetition
of a capture gives the ends of all units at once: their number is the length and
two of them are the cuts. A unit is a code point unless another pattern is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT, SPM_PERCENT = 10, 20
CODE_POINT = "(?s:.)"


def numbers(key: str) -> list[int]:
    """Four 32-bit numbers that a key gives."""
    digest = sha256(f"1:{key}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4)]


@lru_cache(maxsize=8)
def _repeated(unit: str):
    import regex

    return regex.compile(f"({unit})*")


def unit_ends(text: str, unit: str = CODE_POINT) -> list[int]:
    """Ends of the consecutive units of a text."""
    match = _repeated(unit).fullmatch(text)
    if match is None:
        raise ValueError("the unit pattern does not cover the text")
    return match.ends(1)


def cut(text: str, key: str, unit: str = CODE_POINT) -> tuple[int, str, int, int]:
    """(units, form, end of the prefix, end of the middle); the ends are places in the text."""
    h1, h2, h3, h4 = numbers(key)
    ends = unit_ends(text, unit)
    n = len(ends)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - PLAIN_PERCENT:
        return n, "plain", a, b
    return n, "spm" if h4 % 100 < SPM_PERCENT else "psm", a, b


def write(text: str, form: str, a: int, b: int) -> str:
    if form == "plain":
        return text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that was written. A mark cannot arise where two parts meet, since it
    starts with ``<`` and ends with ``>`` and the text has none, so the first is the one."""
    if form == "plain":
        return output
    lead, inner = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output.removeprefix(lead).split(inner, 1)
    two, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = CODE_POINT,
                with_text: bool = True) -> DataFrame:
    """One row per input row: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, output.

    ``n`` counts units; prefix_chars and middle_chars count the code points of
    these parts and are null for the form ``plain``. A null text is empty, hence
    plain; a null id counts as an empty one in the hash. The digests are of the
    output and of the text restored from it. Without ``with_text`` the output
    itself is left out. Repeated rows stay; an empty table gives an empty result.
    Each text is matched as a whole; a task holds one text's unit ends at a time.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = ("doc_id long, n long, form string, prefix_chars long, middle_chars long, "
              "output_sha256 string, restored_sha256 string" + ", output string" * with_text)
    names = [part.split()[0] for part in schema.split(", ")]

    def one(key: int | None, text: str) -> tuple:
        n, form, a, b = cut(text, "" if key is None else str(key), unit)
        output = write(text, form, a, b)
        back = restore(output, form)
        lengths = (None, None) if form == "plain" else (a, b - a)
        digests = (sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (output, back))
        return (n, form, *lengths, *digests, *([output] if with_text else []))

    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            made = [one(i, t.as_py() or "") for i, t in zip(ids.to_pylist(), batch.column("text"))]
            columns = list(zip(*made)) or [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, types))], names)

    return rows.mapInArrow(run, schema)
