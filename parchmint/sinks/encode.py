"""PNG images, data URLs and file names."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def png_bytes(rgb: np.ndarray) -> bytes:
    """A PNG of an RGB image."""
    h, w = rgb.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), dtype=np.uint8), np.ascontiguousarray(rgb).reshape(h, w * 3)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    header = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def data_url(content: Column, media_type: str) -> Column:
    return F.concat(F.lit(f"data:{media_type};base64,"), F.base64(content))


def output_name(prefix: str, day: Column, suffix: str) -> Column:
    """prefix-YYYY-MM-DD.suffix of a timestamp in UTC, whatever the session's zone."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), day.cast("timestamp").cast("timestamp_ntz"))
    return F.concat(F.lit(f"{prefix}-"), F.date_format(utc, "yyyy-MM-dd"), F.lit(f".{suffix}"))


def not_empty(files: DataFrame, content: str = "content") -> DataFrame:
    """files; a file without a byte is an error when it is written."""
    ok = F.length(content) > 0
    return files.withColumn(content, F.when(ok, F.col(content)).otherwise(F.raise_error(F.lit("the file is empty")).cast("binary")))


def write_files(files: DataFrame, path: str) -> None:
    """Write (name, content) rows as a Parquet table of files that are not empty."""
    not_empty(files).write.mode("overwrite").parquet(path)
