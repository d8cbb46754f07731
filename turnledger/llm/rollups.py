"""Token counts by source, language and tokenizer version, maintained from deltas.

A delta is a signed row: an inserted document adds its tokens, a deleted one takes them
away, a revised count takes the old one away and adds the new one. A batch of deltas is
summed to one additive row per group and written to a folder named after the batch; the
rename of the finished folder is the commit. A batch that is there already is not written
again, so a job that repeats after a failure counts nothing twice. Totals are sums over
all committed batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

GROUP = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"


def deltas(docs: DataFrame, tokens: Column, tokenizer: str, sign: int) -> DataFrame:
    """Signed rows for documents that come (sign 1) or go (sign -1)."""
    return docs.select(
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.lit(tokenizer).alias("tokenizer"),
        F.lit(sign).cast("long").alias("documents"),
        (F.coalesce(tokens, F.lit(0)).cast("long") * sign).alias("tokens"),
    )


def revised(docs: DataFrame, old: tuple[Column, str], new: tuple[Column, str]) -> DataFrame:
    """Signed rows for documents whose count changes: old and new (tokens, tokenizer).
    One pass over the documents gives both signs."""
    sides = [
        F.struct(
            F.lit(tokenizer).alias("tokenizer"),
            F.lit(sign).cast("long").alias("documents"),
            (F.coalesce(tokens, F.lit(0)).cast("long") * sign).alias("tokens"),
        )
        for (tokens, tokenizer), sign in ((old, -1), (new, 1))
    ]
    return docs.select(
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.inline(F.array(*sides)),
    )


class Rollup:
    """A folder of committed batches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        files = jvm.org.apache.hadoop.fs
        self._at = lambda p: files.Path(p)
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._at(self.path).getFileSystem(conf)
        context = files.FileContext.getFileContext(self._fs.getUri(), conf)
        strict = spark.sparkContext._gateway.new_array(getattr(files, "Options$Rename"), 0)
        # Fails if the target exists, unlike the rename of the file system.
        self._rename = lambda a, b: context.rename(self._at(a), self._at(b), strict)

    def _folder(self, batch: str) -> str:
        if not batch or not set(batch) <= set(SAFE):
            raise ValueError(f"a batch is named with letters, digits, '_' and '-': {batch!r}")
        return f"{self.path}/batches/{batch}"

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._at(self._folder(batch)))

    def batches(self) -> list[str]:
        top = self._at(f"{self.path}/batches")
        if not self._fs.exists(top):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(top))

    def commit(self, batch: str, rows: DataFrame | Sequence[DataFrame]) -> bool:
        """Add a batch of signed rows; False if a batch of that name is there already.

        Two writers of the same batch race for the rename: one wins, the other's files go.
        """
        target = self._folder(batch)
        if self.committed(batch):
            return False
        signed = rows if isinstance(rows, DataFrame) else reduce(DataFrame.unionByName, rows)
        summed = signed.groupBy(*GROUP).agg(
            F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")
        )
        staged = f"{self.path}/staged/{batch}-{uuid.uuid4().hex}"
        summed.write.parquet(staged)
        self._fs.mkdirs(self._at(f"{self.path}/batches"))
        try:
            self._rename(staged, target)
        except Py4JJavaError:
            self._fs.delete(self._at(staged), True)
            if self.committed(batch):
                return False
            raise
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens): groups that hold documents or
        tokens. Without any batch there is no row."""
        names = self.batches()
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*[self._folder(b) for b in names])
        return (
            rows.groupBy(*GROUP)
            .agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
            .filter("documents != 0 OR tokens != 0")
        )


SAFE = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-"
