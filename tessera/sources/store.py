"""A store of feature blocks, bucketed and sorted by their key, and the assembly of blocks into one table without a shuffle."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .io import exists, shared_folder


class FeatureStore:
    """Blocks of one row a key, each a table of `buckets` files dealt by the hash of the key and sorted by it.

    Writing a block moves its rows once; every later join of blocks reads bucket by bucket and moves
    nothing. All blocks of a store share the number of buckets, by default the session's shuffle
    partitions, so a bucket of a large store stays as large as a shuffle partition. A store lives in a
    folder of its own, a session that did not write it attaches to it, and drop() removes it.
    """

    def __init__(self, spark: SparkSession, key: str, path: str | None = None, buckets: int | None = None):
        self.spark, self.key = spark, key
        self.path = path or f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.prefix = "tessera_" + re.sub(r"[^A-Za-z0-9]+", "_", self.path)[-40:].strip("_").lower() + "_"
        self.columns: dict[str, list[str]] = {}

    def _table(self, block: str) -> str:
        return self.prefix + re.sub(r"[^A-Za-z0-9_]+", "_", block).lower()

    def put(self, block: str, df: DataFrame) -> None:
        """Writes a block anew. A key that is null or repeats is an error, for a join by it would lose or multiply rows."""
        (df.repartition(self.buckets, self.key).write.mode("overwrite").format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", f"{self.path}/{block}").saveAsTable(self._table(block)))
        stored = self.spark.table(self._table(block))
        # grouped within buckets: no row moves
        if not stored.groupBy(self.key).agg(F.count("*").alias("n")).where(F.col(self.key).isNull() | (F.col("n") > 1)).isEmpty():
            raise ValueError(f"block {block} has a null or repeated {self.key}")
        self.columns[block] = stored.columns

    def attach(self, blocks: Iterable[str]) -> "FeatureStore":
        """Names blocks that another session has written in this store's folder, with the same number of buckets."""
        for block in blocks:
            place = f"{self.path}/{block}"
            if not exists(self.spark, place):
                raise ValueError(f"no block {block} in {self.path}")
            schema = self.spark.read.parquet(place).schema
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._table(block)} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{place}'")
            self.columns[block] = schema.names
        return self

    def block(self, name: str) -> DataFrame:
        return self.spark.table(self._table(name))

    def assemble(self, blocks: list[str]) -> DataFrame:
        """The keys of the first block with the columns of all, in their order; a key that a later block lacks has NULLs there.

        Characters other than letters, digits and underscores are taken out of names; of names that are
        then equal, in whatever case, the first holds.
        """
        out, taken = None, {self.key.lower()}
        for name in blocks:
            df = self.block(name)
            new = {}
            for c in df.columns:
                n = re.sub(r"[^A-Za-z0-9_]+", "", c)
                if n.lower() not in taken:
                    taken.add(n.lower())
                    new[c] = n
            df = df.select(self.key, *[F.col(f"`{c}`").alias(n) for c, n in new.items()])
            out = df if out is None else out.join(df.hint("merge"), self.key, "left")
        return out

    def drop(self) -> None:
        """Removes the tables and the folder; results of assemble() that were not stored elsewhere end with them."""
        for block in self.columns:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(block)}")
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self.columns = {}
