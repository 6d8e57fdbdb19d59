"""Media columns: payloads kept in progressive JPEG files, and what reading the files gives.

A null text counts as an empty one. Each text's UTF-8 bytes are padded with spaces to a positive multiple of 192. Equal
texts give equal files, tensors and features; repeated rows and rows with a null id each give a row. Columns other than the id and the text are
ignored, whatever their names. Files are handled a bounded number of bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jpeg
from tidemark.llm.common import few, map_arrow, table, text_of

#: Bytes of a payload's unit: three blocks of 64.
UNIT = 192
#: Bytes handled at a time, beyond a single file.
PORTION = 1_000_000


def _portions(items: list[bytes]) -> Iterator[list[bytes]]:
    own, size = [], 0
    for x in items:
        if own and size + len(x) > PORTION:
            yield own
            own, size = [], 0
        own.append(x)
        size += len(x)
    if own:
        yield own


def _kind(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes (of the text), media (a progressive JPEG file that keeps the padded bytes)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch.column(1).to_pylist()
        padded = [x + b" " * (-len(x) % UNIT if x else UNIT) for x in raw]
        media = [m for portion in _portions(padded) for m in jpeg.encode(portion)]
        return pa.record_batch([batch.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return map_arrow(df.select(id_col, text_of(text_col).cast("binary").alias("text")), run, f"`{id_col}` {_kind(df, id_col)}, n_bytes long, media binary")


def describe(rgb: np.ndarray) -> str:
    """Height, width, the channels' sums, and the sum of steps between neighbours in a row: whole numbers."""
    steps = int(np.abs(np.diff(rgb.astype(np.int16), axis=1)).sum(dtype=np.int64)) if rgb.shape[1] > 1 else 0
    r, g, b = rgb.reshape(-1, 3).sum(0, dtype=np.int64).tolist()
    return f"{rgb.shape[0]}x{rgb.shape[1]}:{r}:{g}:{b}:{steps}"


def read_media(media: DataFrame, id_col: str = "doc_id", keep_tensor: bool = True) -> DataFrame:
    """The columns of to_media()'s result, with payload (binary), height, width, feature, and the tensor, rgb (if not told otherwise).

    rgb holds height * width * 3 bytes, row by row. Null files give null in all new columns."""
    names = media.columns
    new = [("payload", pa.binary(), "binary"), ("height", pa.int32(), "int"), ("width", pa.int32(), "int"), ("feature", pa.string(), "string"), *([("rgb", pa.binary(), "binary")] if keep_tensor else [])]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        files = batch.column(names.index("media")).to_pylist()
        rows = []
        for portion in _portions([x for x in files if x is not None]):
            heads, c = jpeg.coefficients(portion)
            for f, payload, rgb in zip(heads, jpeg.payloads(heads, c), jpeg.tensors(heads, c), strict=True):
                rows.append((payload, f.height, f.width, describe(rgb), *([rgb.tobytes()] if keep_tensor else [])))
        rest = iter(rows)
        rows = [next(rest) if x is not None else (None,) * len(new) for x in files]
        return pa.record_batch([*batch.columns, *(pa.array([r[i] for r in rows], kind) for i, (_, kind, _) in enumerate(new))], names=[*names, *(n for n, _, _ in new)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema), *(f"{n} {kind}" for n, _, kind in new)])
    return map_arrow(media, run, schema)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as progressive JPEG and read back; digests of both and the images' features."""
    read = read_media(to_media(few(table(spark, sf_dir, "documents"))))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.octet_length("rgb").cast("long").alias("rgb_bytes"),
        F.sha2("rgb", 256).alias("rgb_sha256"),
    )
