"""Token totals kept by signed deltas.

A batch of changes is aggregated to additive deltas per (source, lang, tokenizer version) and written under its
batch id; the totals are the sum of a snapshot and of the committed deltas after it. A batch counts from the
moment its commit marker is written, and once: committing an id again, after a crash or a redelivery, either finds
it committed and does nothing or overwrites what was half written. Corpus rows are never reread to maintain the
totals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photonlake.llm.bpe import encoder
from photonlake.llm.rans import library_tokenizer
from photonlake.llm.storage import Scratch, bounded_batches, table

KEYS = ("source", "lang", "tokenizer")
_DELTA = "source string, lang string, tokenizer string, documents bigint, tokens bigint"
#: White space between words.
GAP = r"[\x20\x09-\x0D]+"

Tokenizer = Callable[[], Callable[[pa.Array], Iterator[np.ndarray]]]


def rank_tokenizer(path: str) -> Tokenizer:
    """Ids by a file of ranks; see ``bpe``."""
    return lambda: lambda column: encoder(path).cache.ids(column)


def counted(rows: DataFrame, wanted: dict[str, tuple[str, Tokenizer]]) -> DataFrame:
    """``rows`` without the text columns, and for each new name the number of tokens of a text column by a tokenizer (null text: null)."""
    texts = {text for text, _ in wanted.values()}
    kept = [i for i, c in enumerate(rows.columns) if c not in texts]
    at = {name: rows.columns.index(text) for name, (text, _) in wanted.items()}
    schema = T.StructType([*(rows.schema.fields[i] for i in kept), *(T.StructField(n, T.LongType()) for n in wanted)])

    def run(batches):
        make = {name: tokenizer() for name, (_, tokenizer) in wanted.items()}
        for batch in batches:
            columns = [batch.column(i) for i in kept]
            for name, of in make.items():
                text = batch.column(at[name])
                n = np.fromiter(map(len, of(text)), np.int64, len(text))
                columns.append(pa.array(n, mask=text.is_null().to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def signed(rows: DataFrame, sign: int, tokens: str | F.Column, documents: int = 1) -> DataFrame:
    """Changes (source, lang, tokenizer, documents, tokens) of rows that come (+1) or go (-1); a null count is 0."""
    count = F.coalesce(F.col(tokens) if isinstance(tokens, str) else tokens, F.lit(0)).cast("bigint")
    return rows.select(*[F.col(k).cast("string").alias(k) for k in KEYS], F.lit(sign * documents).cast("bigint").alias("documents"), (count * sign).alias("tokens"))


def inserts(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    return signed(rows, 1, tokens)


def deletes(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    return signed(rows, -1, tokens)


def revisions(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Rows whose count changed: the difference alone, no document more or less."""
    return signed(rows, 1, F.coalesce(F.col(after), F.lit(0)) - F.coalesce(F.col(before), F.lit(0)), documents=0)


class TokenTotals:
    """Totals in a folder of the shared store."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        """A Hadoop path below the root and its file system."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path, store = self._path(name)
        return store.exists(path)

    def _children(self, name: str) -> list[str]:
        path, store = self._path(name)
        return sorted(x.getPath().getName() for x in store.listStatus(path)) if store.exists(path) else []

    def _snapshot(self) -> str | None:
        """The newest snapshot that is complete."""
        whole = [x for x in self._children("snapshots") if self._exists(f"snapshots/{x}/batches/_SUCCESS")]
        return f"snapshots/{whole[-1]}" if whole else None

    def _folded(self, snapshot: str) -> DataFrame:
        return self.spark.read.schema("batch string").parquet(f"{self.root}/{snapshot}/batches")

    def committed(self, batch: str) -> bool:
        held = self._snapshot()
        return self._exists(f"deltas/{batch}/_SUCCESS") or (held is not None and not self._folded(held).filter(F.col("batch") == batch).isEmpty())

    def commit(self, batch: str, *changes: DataFrame) -> bool:
        """Add a batch of signed changes; False if this id is already in."""
        if not batch or batch[0] in "._" or set(batch) - set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_."):
            raise ValueError(f"not a batch id: {batch!r}")
        if self.committed(batch):
            return False
        all_ = reduce(DataFrame.unionByName, changes)
        delta = all_.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).filter("documents <> 0 or tokens <> 0")
        delta.write.mode("overwrite").parquet(f"{self.root}/deltas/{batch}")
        return True

    def _open(self) -> list[str]:
        """Committed batches that no snapshot has folded."""
        found = [x for x in self._children("deltas") if self._exists(f"deltas/{x}/_SUCCESS")]
        held = self._snapshot()
        if not held or not found:
            return found
        folded = {r["batch"] for r in self._folded(held).filter(F.col("batch").isin(found)).collect()}
        return [x for x in found if x not in folded]

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) over all committed batches; combinations with nothing left are absent."""
        return self._sum(self._snapshot(), self._open())

    def _sum(self, held: str | None, batches: list[str]) -> DataFrame:
        paths = [f"{self.root}/deltas/{x}" for x in batches] + ([f"{self.root}/{held}/totals"] if held else [])
        if not paths:
            return self.spark.createDataFrame([], _DELTA)
        out = self.spark.read.schema(_DELTA).parquet(*paths).groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return out.filter("documents <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Fold all committed batches into a new snapshot, so that the totals read one small table; as often as wanted, while no other writer runs.

        The list of folded batches is written last: until then the old snapshot and the deltas count. From then on
        the folded deltas are passed over, and they and older snapshots are removed.
        """
        held, batches = self._snapshot(), self._open()
        number = int(held.rsplit("/", 1)[1]) + 1 if held else 0
        new = f"snapshots/{number:09d}"
        self._sum(held, batches).write.mode("overwrite").parquet(f"{self.root}/{new}/totals")
        ids = self.spark.createDataFrame([(x,) for x in batches], "batch string")
        (ids.union(self._folded(held)) if held else ids).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{new}/batches")
        for name in [*(f"deltas/{x}" for x in batches), *([held] if held else [])]:
            path, store = self._path(name)
            store.delete(path, True)


def corpus_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of ``documents`` by two packaged tokenizers after four batches: all documents come in, those labelled
    quality 0 go, the others' counts by one tokenizer are revised to texts with collapsed white space, and the
    deletion is delivered again.

    Null and empty texts are documents of 0 tokens; null sources and languages are values of their own; a document
    labelled twice goes if one label says so; empty tables give no totals.
    """
    bounded_batches(spark)
    tight = F.regexp_replace("text", GAP, " ")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", F.when(tight != F.col("text"), tight).alias("tight"))
    shared, multi = library_tokenizer(public_tokenizers.path("byte_bpe_50k.json")), rank_tokenizer(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    counts = counted(docs, {"shared": ("text", shared), "multi": ("text", multi), "revised": ("tight", multi)})
    bad = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id", F.lit(True).alias("bad")).distinct()
    scratch = Scratch(spark, "token-counts")
    ledger = scratch.table(counts.join(bad, "doc_id", "left"), "ledger")
    by = {v: ledger.withColumn("tokenizer", F.lit(f"byte-bpe-{v}-50k")) for v in ("shared", "multi")}
    totals = TokenTotals(spark, scratch.path("totals"))
    totals.commit("load", *[inserts(rows, v) for v, rows in by.items()])
    gone = [deletes(rows.filter("bad"), v) for v, rows in by.items()]
    totals.commit("drop-low-quality", *gone)
    totals.compact()
    totals.commit("tighten", revisions(by["multi"].filter("bad is null and revised is not null"), "multi", "revised"))
    totals.commit("drop-low-quality", *gone)
    return totals.totals()
