"""Shared pieces of the training-data operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.storage import forget, shared_dir, written  # noqa: F401 - for the operators

#: ASCII white space as the contracts list it: 0x20 and 0x09-0x0D. bytes.split() splits at exactly these.
SPACE = " \t\n\x0b\x0c\r"
#: Bytes of a batch for Python. A batch stands in the JVM and in Python at once, for each core; Spark's own limit is 64 MB.
BATCH_BYTES = 4 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_join(rows: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """rows joined with `one`, which has a row per key. A key that many rows have doesn't stay in one task: the hash as a second
    join key gives both sides an exchange of their own, even where `one` was just grouped by the key, and such joins are split at run time."""
    h = f"_{key}_hash"
    return rows.withColumn(h, F.xxhash64(key)).join(one.withColumn(h, F.xxhash64(key)), [key, h]).drop(h)


def shared(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcasts a value of bounded size; the result gives it back in a task."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's batches for Python are of about BATCH_BYTES, unless it has a limit of its own. Not taken back: plans run after the function that made them."""
    if spark.conf.get(_BATCH_LIMIT, None) is None:
        spark.conf.set(_BATCH_LIMIT, str(BATCH_BYTES))


def crc_mod(column: str, by: int) -> Column:
    """crc32 of the id as text, modulo by; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(by))


def threshold(most: int, n: int) -> int:
    """Signed 64-bit hashes below it are `most` of `n`."""
    return -(1 << 63) + min((most << 64) // n, (1 << 64) - 1)


def bounded_sample(rows: DataFrame, id_col: str, most: int, seed: int, partitions: int = 8) -> DataFrame:
    """About `most` rows (all, if there are fewer), chosen by a hash of the id, in a few partitions.

    For fitting models only. The count runs over the id column alone. Rows of one id go in together or not at all."""
    n = rows.select(id_col).count()
    if n > most:
        rows = rows.where(F.xxhash64(F.lit(seed), F.col(id_col)) < F.lit(threshold(most, n)))
    return rows.repartition(partitions)


class WordHash(dict):
    """word bytes -> 64-bit hash; kept for as many words as `most`."""

    def __init__(self, most: int = 100_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def by_bytes(texts: Iterable[bytes], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) in runs of about `most` bytes, one text at least: bounds the arrays made from them."""
    run: list[bytes] = []
    first = total = 0
    for i, t in enumerate(texts):
        if run and total + len(t) > most:
            yield first, run
            run, first, total = [], i, 0
        run.append(t)
        total += len(t)
    if run:
        yield first, run


def utf8(column) -> Iterator[bytes]:
    """The texts of an Arrow string column as UTF-8; null as empty. Decodes nothing."""
    import pyarrow as pa

    for v in column.cast(pa.large_binary()):
        yield v.as_py() or b""


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that the order of hashes tells nothing about their parts."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Odd multipliers for word positions in a gram.
_ODD = [(0x9E3779B97F4A7C15 * (2 * i + 1) ** 3) & 0xFFFFFFFFFFFFFFFF | 1 for i in range(64)]


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = words[:n] * np.uint64(_ODD[0])
    for j in range(1, k):
        total += words[j : j + n] * np.uint64(_ODD[j])
    return mixed(total)
