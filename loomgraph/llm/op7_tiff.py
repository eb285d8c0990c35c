"""TIFF media columns: image directories are walked, strips and tiles decoded (PackBits, LZW, deflate), predictors
undone, and every page gives one row.

The query stores each text as such a file and reads it back. The file's layout follows from the payload alone."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import tiff
from loomgraph.llm.common import utf8

WIDTH, STRIP_BYTES, TILE = 64, 1 << 16, 64
PAGE = "page int, width int, height int, bits int, samples int, compression int, predictor int, tiled boolean, pixels binary, feature string, error string"


def payload(text: bytes) -> bytes:
    """Padded with zero bytes up to the least positive multiple of 64."""
    return text.ljust(max(1, -(-len(text) // 64)) * 64, b"\0")


def stored(data: bytes) -> bytes:
    """The payload as a grey 8-bit page, 64 pixels wide. Its checksum picks compression, predictor and layout."""
    pick = zlib.crc32(data) % 8
    image = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    compression = tiff.PACKBITS if pick == 0 else tiff.LZW if pick == 1 else tiff.DEFLATE
    return tiff.write([image], compression, predictor=2 if pick in (2, 3) else 1, tile=TILE if pick in (4, 5) else 0, strip_bytes=STRIP_BYTES)


def feature(pixels: np.ndarray) -> str:
    """Size, mean, and 64 bits that tell where an 8 x 9 grid of mean grey gets darker to the right."""
    grey = pixels.reshape(pixels.shape[0], pixels.shape[1], -1).sum(2, dtype=np.int64)
    rows, columns = (np.arange(k) * n // k for k, n in ((8, grey.shape[0]), (9, grey.shape[1])))
    tall, wide = (np.maximum(1, np.diff([*at, n])) for at, n in ((rows, grey.shape[0]), (columns, grey.shape[1])))
    small = np.add.reduceat(np.add.reduceat(grey, rows, axis=0), columns, axis=1) / np.outer(tall, wide)
    bits = int("".join("1" if b else "0" for b in (small[:, 1:] < small[:, :-1]).ravel()), 2)
    return f"{pixels.shape[1]}x{pixels.shape[0]}:{grey.mean() / max(1, pixels[0, 0].size):.4f}:{bits:016x}"


def _sub(batch: pa.RecordBatch, sizes, most: int = 16 << 20):
    """Slices of a batch with about `most` bytes each, one row at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def store(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, media. A null text is stored as an empty one; other columns are not read."""

    def run(batches):
        for batch in batches:
            for part in _sub(batch, (len(x) for x in utf8(batch.column(1)))):
                texts = list(utf8(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array([stored(payload(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_pages(files: DataFrame, media: str = "media", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per page of each file: the carried columns, then page, width, height, bits, samples, compression, predictor, tiled,
    pixels (row after row, samples together, 16-bit ones little-endian), feature, error.

    A null file gives no row. What is damaged or not supported gives a row that has only an error; the other pages are read.
    A carried column may not have the name of a page's column."""
    clash = {x.split()[0] for x in PAGE.split(", ")} & set(carry)
    if clash:
        raise ValueError(f"carried columns clash with page columns: {sorted(clash)}")
    rows = files.select(*carry, F.col(media).cast("binary"))
    kinds = rows.drop(media).schema if media not in carry else rows.select(*carry).schema
    names = [x.split()[0] for x in PAGE.split(", ")]
    types = [pa.int32()] * 7 + [pa.bool_(), pa.binary(), pa.string(), pa.string()]

    def of(data: bytes | None) -> list[tuple]:
        if data is None:
            return []
        wrong = lambda e: (None,) * 10 + (f"{type(e).__name__}: {e}"[:200],)
        out = []
        try:
            for p in tiff.pages(data):
                out.append(wrong(p) if isinstance(p, Exception) else (p.index, p.width, p.height, p.bits, p.samples, p.compression, p.predictor, p.tiled, p.pixels.astype(p.pixels.dtype.newbyteorder("<")).tobytes(), feature(p.pixels), None))
        except Exception as e:  # a damaged file or chain of pages
            out.append(wrong(e))
        return out

    def run(batches):
        for batch in batches:
            for part in _sub(batch, (len(x) for x in utf8(batch.column(batch.num_columns - 1)))):
                found = [(i, p) for i, x in enumerate(part.column(part.num_columns - 1)) for p in of(x.as_py())]
                kept = part.take(pa.array([i for i, _ in found], pa.int64()))
                columns = zip(*(p for _, p in found), strict=True) if found else [()] * len(names)
                yield pa.RecordBatch.from_arrays([*kept.columns[:-1], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*kept.schema.names[:-1], *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), PAGE])
    return rows.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns, from the bytes read back."""
    files = store(docs).select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    read = read_pages(files, "media", ("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    return read.select("doc_id", "n_bytes", F.length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(F.substring(F.col("pixels"), -64, 64)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")
