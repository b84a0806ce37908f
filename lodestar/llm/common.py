"""What the operators share: word rules, staging in the shared folder, block sizes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.files import shared_dir

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters between words, for str.translate and str.split.
_SPACES = {c: " " for c in range(0x09, 0x0E)}

_staged: list[tuple[SparkSession, str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def words_of(text: str | None) -> list[str]:
    """The words of a text by the rule of WORD; none for null."""
    if not text:
        return []
    return [w for w in text.translate(_SPACES).split(" ") if w]


def word_count(text: Column | str) -> Column:
    """Number of words by the rule of WORD, as long; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Rows of texts, and bytes, that pass between the JVM and Python at once.
TEXTS_PER_BATCH = 512
BYTES_PER_BATCH = 8 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, in a session that passes at most TEXTS_PER_BATCH rows and BYTES_PER_BATCH to Python at once: texts can be long, and a batch is held several times over."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", TEXTS_PER_BATCH), ("maxBytesPerBatch", BYTES_PER_BATCH)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(conf.get(key).rstrip("b")) <= most:
            conf.set(key, most)
    return df


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: this cuts lineage and survives lost executors.

    The folders are removed when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar-{label}-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.parquet(path)
    if not _staged:
        atexit.register(_sweep)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of what is executed in here as soon as it has ended: staged tables are read instead."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind as it takes to be no column of df, whatever the case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives its memory back to the system when a task ends: workers live on, and each kind of
    task that they ran would otherwise keep its share."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Return memory that neither Arrow's pool nor the allocator needs any more to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def drop_staged(df: DataFrame) -> None:
    """Remove the staged files that df reads, once nothing needs them."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lodestar-" in path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _sweep() -> None:
    for spark, path in _staged:
        with contextlib.suppress(Exception):  # the session may be gone already
            _delete(spark, path)
