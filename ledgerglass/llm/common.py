"""Shared helpers: reading tables, tables in the shared folder, bounded batches, one model a worker, word caches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of an Arrow batch, and so of the rows that a Python worker is sent at once. All operators of this folder use one size.
BATCH_BYTES = 4 << 20
#: Characters of the texts that are cut into words at once.
SLICE = 2 << 20
#: Removes the shuffle files of a write or a count as soon as it has ended.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, and so a Python worker's memory; a longer row is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Unset, only a session in one process (tests) may use a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def tidy(spark: SparkSession):
    """What runs inside leaves no shuffle files behind."""
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, before)


#: Of the usual tasks, one in so many writes a table that is small beside its documents, so that it is not many tiny files.
SMALL, FEWEST = 16, 4


def settle(df: DataFrame, name: str, codec: str = "snappy", small: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, a lost executor loses nothing. small: few bytes a document, right behind a shuffle, as one task then does the work of several."""
    spark = df.sparkSession
    if small:
        df = df.coalesce(max(FEWEST, int(spark.conf.get("spark.sql.shuffle.partitions")) // SMALL))
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*settled: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in settled:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def crc_mod(column: str, n: int):
    """crc32 of an id's decimal text, modulo n (null stays null)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A batch's texts; null is empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def slices(texts: list[str], most: int = SLICE) -> Iterator[list[str]]:
    """The texts in order, about so many characters at once."""
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > most:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function made once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            if batch.num_rows:
                yield apply(batch)

    return df.mapInArrow(run, schema)


_held: dict = {}


def held(key: tuple, make: Callable):
    """make(), kept in this Python worker until another model takes its place: workers serve many operators, and hold one model at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


class Memo:
    """A bounded map from words to values (bytes or small ints), filled on demand, in two generations of about `most` bytes each.

    When the young one is full it becomes the old one; words that come again move back. Results never depend on it.
    """

    ENTRY = 200  # bytes of an entry besides the letters of key and value

    def __init__(self, fill: Callable[[list], list], most: int = 12 << 20):
        self.fill, self.most, self.size = fill, most, 0
        self.young: dict = {}
        self.old: dict = {}

    def add(self, missing: list) -> list:
        """The values of distinct words that the young generation lacks, which it learns."""
        values = list(map(self.old.get, missing)) if self.old else [None] * len(missing)
        new = [w for w, v in zip(missing, values, strict=True) if v is None]
        if new:
            found = self.fill(new)
            if len(new) < len(missing):
                rest = iter(found)
                found = [next(rest) if v is None else v for v in values]
            values = found
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0
        self.young.update(zip(missing, values, strict=True))
        self.size += sum(map(len, missing)) + self.ENTRY * len(missing)
        if isinstance(values[0], bytes):
            self.size += sum(map(len, values))
        return values

    def of(self, words: list) -> list:
        """The values of distinct words."""
        values = list(map(self.young.get, words))
        places = [k for k, v in enumerate(values) if v is None]
        if places:
            for k, v in zip(places, self.add([words[k] for k in places]), strict=True):
                values[k] = v
        return values

    def each(self, words: list) -> list:
        """The values of words, which may repeat."""
        known = dict.fromkeys(words)
        known = dict(zip(known, self.of(list(known)), strict=True))
        return list(map(known.__getitem__, words))

    def fetch(self, lists: list[list]) -> list[list]:
        """The values of the words of each list."""
        flat, out, at = self.each([w for own in lists for w in own]), [], 0
        for own in lists:
            out.append(flat[at : at + len(own)])
            at += len(own)
        return out
