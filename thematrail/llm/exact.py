"""Exact dedup against a persistent digest index (DataFrame functions only).

The index is a table of SHA-256 digests, bucketed and sorted by digest. A load of
documents is grouped by digest, anti-joined with the index by sort-merge and what
is new is appended, so a load never shuffles the index. Every entry names its load, so
a load cut off by a lost job is repeated with the same result.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .store import scratch_path, written

INDEX_SCHEMA = "digest binary, keep_id bigint, load_rows bigint, load_id string"
LAYOUT_SCHEMA = "generation bigint, buckets int, folder string"


def text_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text as 32 bytes; null counts as the empty text."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


class DigestIndex:
    """Digests of all texts loaded so far, each with the id of the document that stands for it and the load that brought it.

    ``path`` is where the index lies (default: a new folder in the shared folder). ``buckets`` is how many parts the
    digests of a new index are split into; take at least ``spark.sql.shuffle.partitions``, so that loads are dealt to
    the buckets and not the other way round. An index keeps its number of buckets in a small layout table beside the
    digests, so an existing one is opened by its path alone. One program at a time may write to an index.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "digest-index")
        self.table = None
        layout = self._layout()
        if layout is None:
            buckets = buckets or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
            layout = self._begin(0, buckets, self._folder())
        self._open(layout)

    def _folder(self) -> str:
        return f"{self.path}/digests-{uuid4().hex}"

    def _layout(self) -> Row | None:
        """The newest layout, or None for an index that does not exist yet."""
        try:
            layouts = self.spark.read.schema(LAYOUT_SCHEMA).parquet(f"{self.path}/layout")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return layouts.agg(F.max_by(F.struct("*"), "generation").alias("newest")).head().newest  # one row

    def _begin(self, generation: int, buckets: int, folder: str) -> Row:
        values = F.lit(generation).cast("bigint"), F.lit(buckets), F.lit(folder)
        names = [c.split()[0] for c in LAYOUT_SCHEMA.split(", ")]
        self.spark.range(1, numPartitions=1).select(*[v.alias(n) for v, n in zip(values, names)]).write.mode("append").parquet(f"{self.path}/layout")
        return self._layout()

    def _create(self, buckets: int, folder: str) -> str:
        table = f"digest_index_{uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {table} ({INDEX_SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
            f"INTO {buckets} BUCKETS LOCATION '{folder}'"
        )
        return table

    def _open(self, layout: Row) -> None:
        self.close()
        self.generation, self.buckets, self.folder = layout
        self.table = self._create(self.buckets, self.folder)

    def close(self) -> None:
        """Take the table out of the session's catalogue; the files of the index stay."""
        if self.table:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self.table = None

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def _write(self, rows: DataFrame, table: str, buckets: int, folder: str) -> None:
        columns = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]
        (
            rows.select(columns).repartition(buckets, "digest").write.mode("append").format("parquet")
            .bucketBy(buckets, "digest").sortBy("digest").option("path", folder).saveAsTable(table)
        )
        self.spark.catalog.refreshTable(table)

    def append(self, fresh: DataFrame) -> None:
        self._write(fresh, self.table, self.buckets, self.folder)

    def compact(self, buckets: int | None = None) -> None:
        """Write the index anew with one sorted file a bucket, in ``buckets`` parts (default: as many as before).

        Every load adds a file to each bucket, and buckets of several files must be sorted again when they are
        merged. The new files count from the moment their layout row is written; a job lost before that changes
        nothing. The files before stay until they are cleared away.
        """
        buckets, folder = buckets or self.buckets, self._folder()
        table = self._create(buckets, folder)
        self._write(self.read(), table, buckets, folder)
        self.spark.sql(f"DROP TABLE {table}")
        self._open(self._begin(self.generation + 1, buckets, folder))

    def load(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", load_id: str | None = None) -> DataFrame:
        """Deduplicate documents against the index and themselves, and append what is new.

        One row per row of ``docs``: doc_id, digest (binary), keep_id, group_size (rows of
        this load with the same text), kept. Of equal texts new to the index the largest
        doc_id stays (a null id only if there is no other); rows repeated with that id
        leave one. Texts that another load brought are all dropped and name its keep_id.
        Null texts count as empty, other columns are not looked at, an empty table gives none.

        ``load_id`` names the load. A load that is repeated under its name, because a job or the driver was lost at
        any moment after it began, gives the same decisions again and appends only what is still missing: texts that the
        index has from this load count as new. Without a name every call is a load of its own, so the same documents
        given twice are known the second time.
        """
        load_id = load_id or uuid4().hex
        rows = written(
            docs.select(
                F.col(doc_id).cast("bigint").alias("doc_id"), text_digest(F.col(text)).alias("digest"),
                F.monotonically_increasing_id().alias("row_no"),
            ),
            "digests",
        )
        groups = rows.groupBy("digest").agg(
            F.max(F.struct("doc_id", "row_no")).alias("last"), F.count(F.lit(1)).alias("load_rows")
        )
        groups = groups.select(
            "digest", F.col("last.doc_id").alias("keep_id"), F.col("last.row_no").alias("keep_row"), "load_rows", F.lit(load_id).alias("load_id")
        )
        known = self.read()
        others = known.filter(F.col("load_id") != load_id).select("digest", F.col("keep_id").alias("old_id"))
        old = groups.hint("merge").join(others, "digest").select(
            "digest", F.col("old_id").alias("keep_id"), F.lit(None).cast("bigint").alias("keep_row"), "load_rows", "load_id"
        )
        fresh = groups.hint("merge").join(others, "digest", "left_anti")
        decided = written(fresh.unionByName(old), "digest-groups")  # before the index grows
        again = known.filter(F.col("load_id") == load_id).select("digest")
        self.append(decided.filter(F.col("keep_row").isNotNull()).hint("merge").join(again, "digest", "left_anti"))
        return rows.hint("merge").join(decided, "digest").select(
            "doc_id", "digest", "keep_id", F.col("load_rows").alias("group_size"),
            F.coalesce(F.col("row_no") == F.col("keep_row"), F.lit(False)).alias("kept"),
        )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The decision for every document (see ``DigestIndex.load``), on a new index if none is given."""
    if index is not None:
        return index.load(docs)
    index = DigestIndex(docs.sparkSession)
    decided = index.load(docs)
    index.close()
    return decided


def without_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows that stay, with the columns of ``docs``: one for each text that is new to the index."""
    kept = exact_dedup(docs, index).filter("kept").select(F.col("doc_id").alias("keep"), "digest")
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("own"), text_digest(F.col("text")).alias("digest")
    )
    same = (F.col("a.digest") == F.col("b.digest")) & F.col("a.own").eqNullSafe(F.col("b.keep"))
    return rows.alias("a").join(kept.alias("b"), same, "left_semi").dropDuplicates(["digest", "own"]).select("row.*")
