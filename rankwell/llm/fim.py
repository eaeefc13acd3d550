"""Fill-in-middle: two cuts of a text, its blocks put in another order around sentinels, and back.

The text is a bytearray. Sentinels are inserted at the cuts, neighbouring blocks change places by
three reversals of bytes, and the same rotation with its ends exchanged restores the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import whole_text
from rankwell.llm.pieces import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WIDTH = 3  # bytes of every sentinel
P, S, M = (mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))
REARRANGED = 90  # of 100 texts
SPM = 20  # of 100 rearranged texts: the suffix first
SLICE_BYTES = 16_000_000


def rotate(buffer: bytearray, start: int, middle: int, end: int) -> None:
    """Exchange the neighbouring blocks [start, middle) and [middle, end) by three reversals."""
    buffer[start:middle] = buffer[start:middle][::-1]
    buffer[middle:end] = buffer[middle:end][::-1]
    buffer[start:end] = buffer[start:end][::-1]


def arrange(text: bytes, first: int, second: int, form: str) -> bytearray:
    """The text cut at two byte offsets, as ``psm`` or ``spm``."""
    buffer = bytearray(text)
    for at, mark in ((second, S), (first, M), (0, P)):
        buffer[at:at] = mark
    suffix = second + 2 * WIDTH
    rotate(buffer, 0 if form == "spm" else first + WIDTH, suffix, len(buffer))
    return buffer


def restore(output: bytes, form: str) -> bytes:
    """The text of an output; the marks are found, as no rearranged text holds one."""
    if form == "plain":
        return bytes(output)
    buffer = bytearray(output)
    if form == "spm":
        start, inner = 0, output.index(P)
        rotate(buffer, start, inner, len(buffer))
        middle, suffix = buffer.index(M), len(buffer) - inner
    else:
        start, inner = output.index(S), output.index(M)
        rotate(buffer, start, inner, len(buffer))
        middle, suffix = start, start + len(buffer) - inner
    for at in (suffix, middle, 0):
        del buffer[at : at + WIDTH]
    return bytes(buffer)


def choose(key: object, text: str, seed: int) -> tuple[str, int, int]:
    """Form of a text and its two cuts in code points, from the hash of seed and key alone."""
    name = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    a, b, kept, order = (int(name[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or kept % 100 >= REARRANGED or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return "plain", 0, 0
    a, b = sorted((a % (len(text) + 1), b % (len(text) + 1)))
    return ("spm" if order % 100 < SPM else "psm"), a, b


def _rearrange(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                rows = []
                for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    form, a, b = choose(key, text, seed)
                    if form == "plain":
                        rows.append((len(text), form, None, None, text))
                        continue
                    coded = text.encode()
                    first, second = (a, b) if len(coded) == len(text) else (len(text[:k].encode()) for k in (a, b))
                    rows.append((len(text), form, a, b - a, arrange(coded, first, second, form).decode()))
                n, forms, before, between, outputs = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(n, pa.int64()),
                        pa.array(forms, pa.string()),
                        pa.array(before, pa.int64()),
                        pa.array(between, pa.int64()),
                        pa.array(outputs, pa.string()),
                    ],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def rearranged(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """One row per document: doc_id, n (code points), form, prefix_chars, middle_chars, output.

    Null counts as empty, and an empty text stays ``plain`` with null lengths, as does a text that
    holds a sentinel. A null key is hashed as no digits. Rows repeated under one key and text get the
    same cuts. Texts of any length are cut whole. An empty table gives an empty result; other columns
    are not read.
    """
    rows = docs.select(F.col(key).alias("doc_id"), whole_text(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _rearrange(seed), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "output", SLICE_BYTES):
            pairs = zip(part.column("output").to_pylist(), part.column("form").to_pylist())
            texts = [output if form == "plain" else restore(output.encode(), form).decode() for output, form in pairs]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "restored"])


def restored(rows: DataFrame) -> DataFrame:
    """``rearranged`` rows with ``restored``, the text rebuilt from output and form alone."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_restored, f"{fields}, restored string")
