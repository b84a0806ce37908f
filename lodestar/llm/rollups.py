"""Token counts as rollups maintained by deltas.

A change is an insert, a delete or a revised count of one document under one tokenizer version. A batch of changes is
summed into signed deltas per source, language and tokenizer, written to a folder of its own and committed by one rename.
Totals are the sums of all committed batches; since they add up, the order of batches doesn't matter. A batch whose id is
committed already is not applied again, so a retry, or a second writer of the same batch, changes nothing; a batch that
was lost on the way leaves nothing that is read. fold() replaces committed batches by their sum; the folders that it lists
at its start are what it sums, records and deletes, so a batch that is committed meanwhile stays a folder of its own.

Defined results: null sources and languages are groups of their own; a null count is 0; an unknown kind of change is an
error; a change without a row to its delete still counts (the sums are additive, not checked against documents); groups
whose documents and tokens are both 0 are left out; an empty batch is committed and changes nothing; repeated changes in
one batch count each time; other columns are not read. For changes_between, nulls in source, language and tokenizer are
equal to each other; a null doc_id names no document, so such a row is deleted if it is old and inserted if it is new.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from functools import reduce
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import WORD, shared_dir, staged, word_count

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
INSERT, DELETE, REVISE = "insert", "delete", "revise"
#: Times that a reading is begun anew because a fold removed what it had listed.
READS = 5
#: What errors say of a file that is not there any more.
GONE = re.compile(r"FileNotFound|FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist")
T = TypeVar("T")


def deltas(changes: DataFrame) -> DataFrame:
    """The signed sums of changes (kind, source, lang, tokenizer, tokens, old_tokens)."""
    new, old = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("tokens", "old_tokens"))
    kind = F.col("kind")
    unknown = F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null")))).cast("long")
    docs = F.when(kind == INSERT, 1).when(kind == DELETE, -1).when(kind == REVISE, 0).otherwise(unknown)
    tokens = F.when(kind == INSERT, new).when(kind == DELETE, -new).when(kind == REVISE, new - old)
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("docs"), F.sum(tokens).cast("long").alias("tokens"))


def changes_between(old: DataFrame, new: DataFrame) -> DataFrame:
    """The changes that make old counts (doc_id, source, lang, tokenizer, tokens) the new ones.

    A document that moves to another source or language is deleted from the one and inserted into the other. doc_id and
    tokenizer name a row; rows that share them are told apart by their number among these, in order of their tokens.
    """
    names = ("doc_id", *KEYS)
    number = F.row_number().over(Window.partitionBy(*names).orderBy("tokens"))
    side = lambda df, p: df.withColumn("n", number).select(F.lit(True).alias(f"{p}_here"), *[F.col(c).alias(f"{p}_{c}") for c in (*names, "n", "tokens")])
    same = reduce(lambda x, y: x & y, [F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in (*KEYS, "n")], F.col("a_doc_id") == F.col("b_doc_id"))
    named = lambda df: df.select(*names, "tokens").where("doc_id IS NOT NULL")
    both = side(named(old), "a").join(side(named(new), "b"), same, "full_outer")
    pick = lambda c: F.when(F.col("b_here").isNull(), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c)
    kind = F.when(F.col("a_here").isNull(), INSERT).when(F.col("b_here").isNull(), DELETE).otherwise(REVISE)
    rows = both.select(kind.alias("kind"), *[pick(c) for c in (*KEYS, "tokens")], F.col("a_tokens").alias("old_tokens"))
    rows = rows.where((F.col("kind") != REVISE) | ~F.col("tokens").eqNullSafe(F.col("old_tokens")))
    none = F.lit(None).cast("long")
    for df, kind in ((old, DELETE), (new, INSERT)):
        rows = rows.union(df.where("doc_id IS NULL").select(F.lit(kind), *KEYS, F.col("tokens").cast("long"), none))
    return rows


class Rollup:
    """A rollup in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for part in ("batches", "lost"):
            self._fs.mkdirs(self._path(f"{self.path}/{part}"))

    def _place(self, batch: str) -> str:
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        return f"{self.path}/batches/{batch}"

    def _folders(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.path}/batches")))

    def batches(self) -> list[str]:
        """The ids of all committed batches, folded ones included."""
        names = self._settled(self._everything)
        return sorted(n for n in names if not n.startswith("fold="))

    def _everything(self) -> set[str]:
        names = self._folders()
        return {*names, *self._folded(names)}

    def _folded(self, names: list[str]) -> set[str]:
        """What the folds among names hold: batches and older folds."""
        return {b for name in names if name.startswith("fold=") for b in self._members(name)}

    def _settled(self, read: Callable[[], T]) -> T:
        """What a reading gives that no fold has taken a folder away from meanwhile."""
        for _ in range(READS):
            try:
                return read()
            except (Py4JJavaError, PySparkException) as error:
                if not GONE.search(str(error)):
                    raise
        raise RuntimeError(f"{self.path} is folded faster than it can be read")

    def _members(self, name: str) -> list[str]:
        at = self._path(f"{self.path}/batches/{name}/_members")
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of changes; False, without any effect, if it is committed already."""
        place = self._place(batch)
        if batch in self.batches():
            return False
        draft = f"{self.path}/lost/{batch}-{uuid.uuid4().hex}"
        deltas(changes).write.parquet(draft)
        return self._commit(draft, place)

    def _commit(self, draft: str, place: str) -> bool:
        """Rename a written draft into place; if another writer was first, drop it."""
        if not self._fs.exists(self._path(place)) and self._fs.rename(self._path(draft), self._path(place)):
            inner = self._path(f"{place}/{draft.rsplit('/', 1)[1]}")
            if self._fs.exists(inner):  # the place was made meanwhile, and the draft moved into it
                self._fs.delete(inner, True)
                return False
            return True
        self._fs.delete(self._path(draft), True)
        return False

    def _read(self, names: list[str]) -> DataFrame:
        places = [f"{self.path}/batches/{name}" for name in names]
        return self.spark.read.schema(DELTA).parquet(*places) if places else self.spark.createDataFrame([], DELTA)

    def _listed(self) -> tuple[list[str], list[str]]:
        """All folders, and those whose sum is the totals: the ones that no fold holds."""
        names = self._folders()
        folded = self._folded(names)
        return names, [n for n in names if n not in folded]

    def _sums(self, names: list[str]) -> DataFrame:
        sums = self._read(names).groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))
        return sums.where("docs <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens: the sums of all committed batches, those that a fold holds once."""
        sums = self._settled(lambda: staged(self._sums(self._listed()[1]), "totals"))
        return sums.withColumnsRenamed({"docs": "n_docs", "tokens": "n_tokens"})

    def fold(self) -> bool:
        """Replace the committed batches of this moment by one folder that holds their sum and their ids; whether it did.

        Readers see the one or the other. Of two folds at once, the first to be committed counts, and the other one's draft goes.
        """
        names, current = self._settled(self._listed)
        if len(names) < 2:
            return False
        number = 1 + max([int(n.removeprefix("fold=")) for n in names if n.startswith("fold=")], default=0)
        draft = f"{self.path}/lost/fold-{uuid.uuid4().hex}"
        try:
            members = sorted({*names, *self._folded(names)})
            self._sums(current).write.parquet(draft)
        except (Py4JJavaError, PySparkException) as error:
            if not GONE.search(str(error)):
                raise
            return False  # another fold was first
        out = self._fs.create(self._path(f"{draft}/_members"))
        out.write(bytearray(json.dumps(members).encode()))
        out.close()
        if not self._commit(draft, f"{self.path}/batches/fold={number:09d}"):
            return False
        for name in names:
            self._fs.delete(self._path(f"{self.path}/batches/{name}"), True)
        return True


#: Texts with copies up to which their table is broadcast: 20 MB.
FEW_TEXTS = 300_000


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, words, guess, quarters, copy) of every whole text.

    words: number of words. quarters: UTF-8 bytes in fours, rounded up; guess: the same from characters, which a revision
    puts right. copy: whether a row with a smaller doc_id has the same text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    fours = lambda n: F.ceil(n / 4).cast("long")
    rows = docs.select("doc_id", "source", "lang", word_count(text).alias("words"), fours(F.length(text)).alias("guess"), fours(F.octet_length(text)).alias("quarters"), F.md5(text).alias("whole"))
    rows = staged(rows, "counts")
    least = rows.groupBy("whole").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select(F.col("whole").alias("w"), "least")
    least = staged(least, "least")  # texts with copies only
    few = least.count() <= FEW_TEXTS
    rows = rows.join(F.broadcast(least) if few else least, F.col("whole") == F.col("w"), "left")
    return rows.withColumn("copy", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))).drop("whole", "w", "least", "most")


def corpus_totals(docs: DataFrame) -> DataFrame:
    """The totals of a corpus after four batches: all documents under two tokenizers, one of them by a guess; the guesses
    revised, in a batch that is sent twice; exact copies deleted."""
    spark = docs.sparkSession
    rows = staged(counted(docs), "counted")
    rollup = Rollup(spark, f"{shared_dir(spark)}/lodestar-rollup-{uuid.uuid4().hex}")
    none = F.lit(None).cast("long").alias("old_tokens")
    change = lambda kind, tokenizer, tokens, old=none: rows.select(F.lit(kind).alias("kind"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(tokens).alias("tokens"), old, "copy")
    rollup.apply("load-words-1", change(INSERT, "words-1", "words"))
    rollup.apply("load-quarters-1", change(INSERT, "quarters-1", "guess"))
    revised = change(REVISE, "quarters-1", "quarters", F.col("guess").alias("old_tokens"))
    for _ in range(2):
        rollup.apply("revise-quarters-1", revised)
    rollup.apply("delete-copies", change(DELETE, "words-1", "words").union(change(DELETE, "quarters-1", "quarters")).where("copy"))
    rollup.fold()
    return rollup.totals()


SQL = f"""
WITH r AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
k AS (SELECT * FROM r WHERE NOT coalesce(doc_id > least, false)),
c AS (
  SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(text, '{WORD}')) AS n FROM k
  UNION ALL SELECT source, lang, 'quarters-1', (strlen(text) + 3) // 4 FROM k)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM c GROUP BY ALL
"""
