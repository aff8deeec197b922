"""SentencePiece ids back to texts, as a table operator: the other half of ``segmentations``."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

SPACE = "▁"
UNKNOWN = " ⁇ "  # what the library writes for an unknown piece


@functools.cache
def loaded(path: str) -> list[bytes]:
    """The bytes that each id stands for; the worker keeps them, their size is the vocabulary's."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            out.append(bytes([int(model.id_to_piece(i)[3:5], 16)]))
        elif model.is_unknown(i):
            out.append(UNKNOWN.encode())
        elif model.is_control(i) or model.is_unused(i):
            out.append(b"")
        else:
            out.append(model.id_to_piece(i).replace(SPACE, " ").encode())
    return out


def decoded(raw: list[bytes], ids: np.ndarray) -> str:
    """The text of ids, without the space that encoding puts before the first word; bytes that are no UTF-8 become
    U+FFFD."""
    if len(ids) and int(ids.max()) >= len(raw):
        raise ValueError(f"id {int(ids.max())} is not in the vocabulary")
    return b"".join(map(raw.__getitem__, ids.tolist())).decode(errors="replace").removeprefix(" ")


def decode_ids(rows: DataFrame, model: str, *, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``rows`` with ``text_col``, the text of ``ids_col`` (little-endian u32). No shuffle.

    Null ids give a null text, no ids an empty one; an id outside the vocabulary is an error. Repeated rows come back as
    often, an empty table gives no rows. All columns come back, whatever their names; one named ``text_col`` is refused.
    """
    if text_col.lower() in {c.lower() for c in rows.columns}:
        raise ValueError(f"column with the name of the result: {text_col}")
    common.tuned(rows.sparkSession)

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        raw = loaded(model)
        for batch in batches:
            yield pa.array([decoded(raw, np.frombuffer(x.as_buffer(), dtype="<u4")) if x.is_valid else None for x in batch], pa.string())

    return rows.withColumn(text_col, text(F.col(f"`{ids_col}`")))
