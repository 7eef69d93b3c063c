"""PNG files: a Spark sink that writes one file an image, and a scan that decodes files by bands of rows.

The sink is a Python data source with a two-phase commit: a task writes its files under names of its own in a staging folder and
reports them, and only files that a successful job reports are moved to their places, so retried, speculative and lost tasks
leave nothing behind. Paths may be in any store that pyarrow opens by its address.

The scan reads files in compressed form, a row each; what they unfold to comes out in bands, so no image is a row or an array.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.model import BGR
from tessera.sources.images import PIXELS, encode_png

BAND = 1 << 20  # bytes of pixels that are decoded at once
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # fixed values: samples a pixel by colour type


def _store(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:", "file://", 1))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # staged name, final name


class PngWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.staging = path, overwrite, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        store, base = _store(self.path)
        store.create_dir(f"{base}/{self.staging}")
        files = []
        for row in iterator:
            name = f"{row['image_id']}.png"
            staged = f"{self.staging}/{uuid.uuid4().hex}-{name}"
            with store.open_output_stream(f"{base}/{staged}") as out:
                out.write(bytes(row["png"]))
            files.append((staged, name))
        return Written(files)

    def commit(self, messages) -> None:
        store, base = _store(self.path)
        store.create_dir(base)
        if self.overwrite:
            for found in store.get_file_info(FileSelector(base)):
                if found.type == FileType.File and found.base_name.endswith(".png"):
                    store.delete_file(found.path)
        for staged, name in (f for m in messages if m for f in m.files):
            store.move(f"{base}/{staged}", f"{base}/{name}")
        self.abort(messages)
        with store.open_output_stream(f"{base}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        store, base = _store(self.path)
        if store.get_file_info(f"{base}/{self.staging}").type == FileType.Directory:
            store.delete_dir(f"{base}/{self.staging}")


class PngSink(DataSource):
    """df.write.format("png_files").mode("overwrite" or "append").save(path) of rows image_id, png."""

    @classmethod
    def name(cls) -> str:
        return "png_files"

    def schema(self) -> str:
        return "image_id long, png binary"

    def writer(self, schema: StructType, overwrite: bool) -> PngWriter:
        return PngWriter(self.options["path"], overwrite)


def write_png(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """b, g, r rasters as files path/<image_id>.png."""
    df.sparkSession.dataSource.register(PngSink)
    encode_png(df).write.format("png_files").mode(mode).save(path)


def _chunks(file: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at + 8 <= len(file):
        (size,), kind = struct.unpack_from(">I", file, at), file[at + 4 : at + 8]
        yield kind, file[at + 8 : at + 8 + size]
        at += 12 + size


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line of samples from its filtered form and the line above; `step` bytes a pixel."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if kind not in (3, 4):
        raise ValueError(f"filter {kind}")
    out, up = np.zeros(len(line) + step, np.int64), np.concatenate([np.zeros(step, np.int64), above.astype(np.int64)])
    for i, x in enumerate(line.tolist(), step):  # each sample needs the one before it
        a, b, c = out[i - step], up[i], up[i - step]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i] = (x + guess) & 255
    return out[step:].astype(np.uint8)


def bands(file: bytes, band: int = BAND) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(h, w, first row, samples [rows, w, 3] in the order b, g, r) of an 8-bit PNG without interlacing, band by band."""
    parts = list(_chunks(file)) if file[:8] == SIGNATURE else []
    head = next((data for kind, data in parts if kind == b"IHDR"), None)
    if head is None:
        raise ValueError("not a PNG file")
    w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", head)
    if depth != 8 or interlace or colour not in CHANNELS:
        raise ValueError(f"PNG of depth {depth}, colour type {colour}, interlace {interlace}")
    palette = np.frombuffer(next((data for kind, data in parts if kind == b"PLTE"), b""), np.uint8).reshape(-1, 3)
    step = CHANNELS[colour]
    size = 1 + step * w
    at_once, above, row = max(1, band // size), np.zeros(step * w, np.uint8), 0
    unzip, rest = zlib.decompressobj(), b""
    lines: list[np.ndarray] = []

    def made() -> tuple[int, int, int, np.ndarray]:
        a = np.stack(lines).reshape(len(lines), w, step)
        rgb = palette[a[:, :, 0]] if colour == 3 else np.repeat(a[:, :, :1], 3, axis=2) if step < 3 else a[:, :, :3]
        return h, w, row - len(lines), rgb[:, :, ::-1]

    for data in (d for kind, d in parts if kind == b"IDAT"):
        while data:
            rest += unzip.decompress(data, at_once * size)
            data = unzip.unconsumed_tail
            for at in range(0, len(rest) - size + 1, size):
                above = _unfiltered(rest[at], np.frombuffer(rest, np.uint8, size - 1, at + 1), above, step)
                lines.append(above)
                row += 1
                if len(lines) == at_once:
                    yield made()
                    lines = []
            rest = rest[len(rest) // size * size :]
    if lines:
        yield made()
    if row != h:
        raise ValueError(f"{row} of {h} rows")


def scan_png(spark: SparkSession, path: str, band: int = BAND) -> DataFrame:
    """b, g, r rasters of the PNG files of a folder; image_id is the number that a file is named by, else a hash of its name."""
    stem = F.regexp_extract("path", r"([^/]*)\.png$", 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    files = files.select(F.coalesce(F.when(stem.rlike(r"^-?\d{1,18}$"), stem.cast("long")), F.xxhash64("path")).alias("image_id"), "content")

    def pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for image, content in zip(b["image_id"], b["content"]):
                for h, w, first, a in bands(content, band):
                    row, col = np.divmod(np.arange(a.shape[0] * w, dtype=np.int32), np.int32(w))
                    yield pd.DataFrame({"image_id": image, "h": np.int32(h), "w": np.int32(w), "row": row + np.int32(first), "col": col, **{c: a[:, :, k].ravel().astype(np.int32) for k, c in enumerate(BGR)}})

    return files.mapInPandas(pixels, PIXELS)
