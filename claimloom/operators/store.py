"""Keyed tables as snapshot folders: read, compute, write the next version, then switch to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, update: list[str]) -> DataFrame:
    """Rows of ``new`` added to ``old``; on a known key only the ``update`` columns change. The last of ``new`` per key
    counts (by an optional ``seq`` column)."""
    order = Window.partitionBy(key).orderBy(F.desc("seq") if "seq" in new.columns else F.lit(1))
    latest = new.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")
    o, n = old.alias("o"), latest.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    known, given = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()

    def pick(c: str):
        mine, theirs = F.col(f"o.{c}"), F.col(f"n.{c}") if c in latest.columns else F.lit(None)
        if c == key:
            return F.coalesce(mine, theirs).alias(c)
        return F.when(known & given, theirs if c in update else mine).when(known, mine).otherwise(theirs).alias(c)

    return joined.select(*[pick(c) for c in old.columns])


def insert_new(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``old`` with the rows of ``new`` whose key it lacks, each key once."""
    fresh = new.dropDuplicates([key]).join(old.select(key), key, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def delete_cascade(tables: dict[str, DataFrame], doc_id) -> dict[str, DataFrame]:
    """All tables without a document, its facts, their relations (either side) and its failures."""
    gone = tables["facts"].where(F.col("doc_id") == doc_id).select(F.col("id").alias("gone")).distinct()
    relations = tables["relations"]
    for side in ("a_id", "b_id"):
        relations = relations.join(gone.withColumnRenamed("gone", side), side, "left_anti")
    keep = ~F.col("doc_id").eqNullSafe(doc_id)
    return tables | {"relations": relations.select(*tables["relations"].columns), "facts": tables["facts"].where(keep), "failures": tables["failures"].where(keep), "documents": tables["documents"].where(~F.col("id" if "id" in tables["documents"].columns else "doc_id").eqNullSafe(doc_id))}


DOCUMENT_UPDATES = ["title", "publisher", "published", "n_pages", "status", "stats"]
RELATION_UPDATES = ["type", "reason_code", "confidence", "explanation", "analysis", "adjudicator"]


class Store:
    """Tables under one folder, ``<root>/<table>/v=<n>/b=<k>``: the batches of the highest finished version are the table.

    New keys are appended as a batch of their own, so a micro-batch writes its own rows only; changed and deleted rows
    make a new version. Versions and batches count only when their ``_SUCCESS`` file exists, so a lost executor or driver
    leaves the last state in place.
    """

    #: Batches from which a version is written anew as one.
    MOST_BATCHES = 64

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs, self._path = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path

    def _numbers(self, folder: str, mark: str) -> list[int]:
        where = self._path(folder)
        if not self._fs.exists(where):
            return []
        return sorted(int(s.getPath().getName()[2:]) for s in self._fs.listStatus(where) if s.getPath().getName().startswith(mark))

    def _batches(self, name: str, v: int) -> list[int]:
        folder = f"{self.root}/{name}/v={v}"
        return [k for k in self._numbers(folder, "b=") if self._fs.exists(self._path(f"{folder}/b={k}/_SUCCESS"))]

    def version(self, name: str) -> int:
        """The highest version whose first batch is finished; 0 where there is none."""
        return max((v for v in self._numbers(f"{self.root}/{name}", "v=") if 0 in self._batches(name, v)), default=0)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}/v={self.version(name)}/b=0"

    def read(self, name: str) -> DataFrame | None:
        v = self.version(name)
        return self.spark.read.parquet(*[f"{self.root}/{name}/v={v}/b={k}" for k in self._batches(name, v)]) if v else None

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` as the table's next version."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={self.version(name) + 1}/b=0")
        return self.read(name)

    def append(self, name: str, new: DataFrame, key: str = "id") -> DataFrame:
        """Rows of ``new`` whose key the table lacks, each key once, as a batch; of the table only the keys are read."""
        old = self.read(name)
        if old is None:
            return self.write(name, new.dropDuplicates([key]))
        fresh = new.dropDuplicates([key]).join(old.select(key), key, "left_anti").select(*old.columns)
        v, taken = self.version(name), self._numbers(f"{self.root}/{name}/v={self.version(name)}", "b=")
        fresh.write.mode("overwrite").parquet(f"{self.root}/{name}/v={v}/b={taken[-1] + 1}")
        return self.write(name, self.read(name)) if len(taken) >= self.MOST_BATCHES else self.read(name)

    def vacuum(self, keep: int = 2) -> None:
        """Delete versions older than the last ``keep``."""
        for name in ("documents", "facts", "relations", "failures", "registry"):
            for v in range(1, self.version(name) - keep + 1):
                self._fs.delete(self._path(f"{self.root}/{name}/v={v}"), True)

    def upsert_documents(self, new: DataFrame) -> DataFrame:
        old = self.read("documents")
        return self.write("documents", new.dropDuplicates(["id"]) if old is None else upsert(old, new, "id", DOCUMENT_UPDATES))

    def add_facts(self, new: DataFrame) -> int:
        """Insert facts whose id is new; returns how many were offered."""
        offered = new.count()
        self.append("facts", new)
        return offered

    def add_relations(self, new: DataFrame) -> int:
        """Insert relations; a known id takes the new verdict. Only where one is known is the table written anew."""
        offered, old = new.count(), self.read("relations")
        if old is None or new.join(old.select("id"), "id", "left_semi").isEmpty():
            self.append("relations", new)
        else:
            self.write("relations", upsert(old, new, "id", RELATION_UPDATES))
        return offered

    def add_failures(self, new: DataFrame) -> int:
        offered = new.count()
        self.append("failures", new)
        return offered

    def relink(self, **options) -> DataFrame:
        """Judge every pair anew and put the result in the place of the relations table."""
        from .linking import relink

        return self.write("relations", relink(self.read("facts"), **options).withColumn("analysis", F.to_json("analysis")))

    def delete_document(self, doc_id) -> None:
        tables = {n: self.read(n) for n in ("documents", "facts", "relations", "failures")}
        for name, df in delete_cascade(tables, doc_id).items():
            self.write(name, df)

    def document_by_sha(self, sha: str) -> DataFrame:
        return self.read("documents").where(F.col("sha256") == sha)


def new_documents(incoming: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """Incoming documents whose content is not known yet, each content once; with ``force`` known contents as well, which
    the caller deletes first (``known_copies`` names them)."""
    each = incoming.dropDuplicates(["sha256"])
    return each if force else each.join(known.select("sha256"), "sha256", "left_anti")


def known_copies(incoming: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Keys of known documents whose content comes in again: they are deleted before a forced ingest."""
    return known.join(incoming.select("sha256").distinct(), "sha256", "left_semi").select(key)
