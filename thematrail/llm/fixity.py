"""Fixity audit of archived records with Merkle trees.

Records lie one after another in archive files. Their digests are hashed over ranges of offsets, ranges over wider ranges, up to
one root of the collection. Each level of a replica's tree is written once. Replicas whose roots agree are equal; otherwise
the trees are descended level by level, only below nodes that differ or that one replica lacks, down to the damaged records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import written

#: Bytes of an offset range of the lowest level; ranges (and files) that one node of the next level covers.
RANGE_BYTES, FANOUT = 1 << 16, 16

#: Pages that are stored in one archive file.
FILE_RECORDS = 1000


def warc_record(page_id: Column, url: Column, payload: Column) -> Column:
    """A WARC 1.0 resource record as bytes; null url and payload count as empty."""
    body = F.coalesce(payload.cast("string"), F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url.cast("string"), F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def _file_of(rows: DataFrame, file_records: int) -> Column:
    """The file of a page: neighbouring ids; rows without id are dealt by digest to files below 0 of about as many records."""
    strays = rows.filter("page_id IS NULL").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(file_records))).cast("bigint")).scalar()
    return F.when(F.col("page_id").isNull(), -1 - F.pmod(F.xxhash64("digest"), strays)).otherwise(F.floor(F.col("page_id") / file_records)).cast("bigint")


def record_table(pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """(page_id, file, offset, length, digest) of the pages stored as WARC records by one replica.

    A file takes ``file_records`` neighbouring page ids, in order of id; offsets are those of this replica, so
    a record that is cut or lost here moves all that follow it in its file.
    """
    return archive_index(pages, file_records=file_records).drop("replica_digest")


def archive_index(pages: DataFrame, replica: Column | None = None, file_records: int = FILE_RECORDS) -> DataFrame:
    """(page_id, file, offset, length, digest, replica_digest) of the pages stored as WARC records.

    A file takes ``file_records`` neighbouring page ids, in order of id (rows without id are in files below 0). ``replica`` gives the
    payload that the replica holds at the place of the record (default: the same), null if the record is missing there.
    """
    replica = F.col("html") if replica is None else replica
    record, copy = warc_record(F.col("page_id"), F.col("url"), F.col("html")), warc_record(F.col("page_id"), F.col("url"), replica)
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.octet_length(record).cast("bigint").alias("length"), F.sha2(record, 256).alias("digest"), F.when(replica.isNotNull() | F.col("html").isNull(), F.sha2(copy, 256)).alias("replica_digest"),
    )
    rows = rows.withColumn("file", _file_of(pages.select(F.col("page_id").cast("bigint").alias("page_id")), file_records))
    order = Window.partitionBy("file").orderBy("page_id", "digest", F.col("replica_digest").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("page_id", "file", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("bigint").alias("offset"), "length", "digest", "replica_digest")


def merkle_levels(leaves: DataFrame, file_levels: int, levels: int) -> list[DataFrame]:
    """Nodes (level, file, node, digest) of every level, from offset ranges up to the root, each level written and read for the next.

    ``leaves`` holds (file, offset, digest); records with a null digest are missing. Below ``file_levels`` a node is a range of
    offsets of a file, at ``file_levels`` a file, above a range of files. A node's digest is the SHA-256 of its children's places and digests, in order, so records that moved change it.
    """
    hashed = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda x: F.concat_ws(":", x["at"], x["digest"])), ","), 256)
    level = leaves.filter("digest IS NOT NULL").select("file", F.floor(F.col("offset") / RANGE_BYTES).alias("node"), F.col("offset").alias("at"), "digest")
    out = []
    for k in range(levels + 1):
        nodes = written(level.groupBy("file", "node").agg(hashed.alias("digest")), f"tree-{k}")
        out.append(nodes.select(F.lit(k).alias("level"), "file", "node", "digest"))
        if k < file_levels:
            level = nodes.select("file", F.floor(F.col("node") / FANOUT).alias("node"), F.col("node").alias("at"), "digest")
        else:
            level = nodes.select(F.floor(F.col("file") / FANOUT).alias("file"), "node", F.col("file").alias("at"), "digest")
    return out


def _shape(tables: list[DataFrame]) -> tuple[int, int, int] | None:
    """First file, levels up to a file and levels in all of trees that cover all the tables; None if they hold no record."""
    spans = [t.agg(F.max("offset").alias("offset"), F.max("file").alias("last"), F.min("file").alias("first")).first() for t in tables]
    spans = [x for x in spans if x["offset"] is not None]
    if not spans:
        return None
    first = min(x["first"] for x in spans)
    file_levels, ranges = 0, max(x["offset"] for x in spans) // RANGE_BYTES
    while ranges:
        file_levels, ranges = file_levels + 1, ranges // FANOUT
    levels, files = file_levels, max(x["last"] for x in spans) - first  # files are counted from the first
    while files:
        levels, files = levels + 1, files // FANOUT
    return first, file_levels, levels


def differing_ranges(ours: DataFrame, theirs: DataFrame, first: int, file_levels: int, levels: int) -> DataFrame:
    """(file, node) of the offset ranges whose records differ between two tables of (file, offset, digest).

    Both trees are walked down from the root together; a node that only one of them has differs. Below nodes that agree
    nothing is read, and a descent that finds nothing more to follow ends.
    """
    trees = [merkle_levels(x.select((F.col("file") - first).alias("file"), "offset", "digest"), file_levels, levels) for x in (ours, theirs)]
    suspects = None
    for k in range(levels, -1, -1):
        a, b = (tree[k].select("file", "node", F.col("digest").alias(name)) for tree, name in zip(trees, "ab"))
        if suspects is not None:
            over = [F.col("file"), F.floor(F.col("node") / FANOUT)] if k < file_levels else [F.floor(F.col("file") / FANOUT), F.col("node")]
            up = [c.alias(n) for c, n in zip(over, ("up_file", "up_node"))]
            a, b = (x.select("*", *up).join(suspects, ["up_file", "up_node"], "left_semi").drop("up_file", "up_node") for x in (a, b))
        differ = written(a.join(b, ["file", "node"], "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("file", "node"), "suspects")
        if k and differ.isEmpty():
            return differ
        suspects = differ.select(F.col("file").alias("up_file"), F.col("node").alias("up_node"))
    return differ


def audit_replicas(archive: DataFrame, replica: DataFrame) -> DataFrame:
    """Compare two tables of records: what is not the same in both, with the place in each.

    Columns: file, status, offset, digest (of the archive's record), replica_offset, replica_digest. ``status`` is
    - ``moved``: the record lies at another offset of the same file; equal records are matched in order of offset;
    - ``corrupt``: another record lies at its offset, and neither lies elsewhere in the other replica's file;
    - ``missing`` or ``surplus``: only the archive or only the replica has it.
    Tables hold (file, offset, digest), one row a place; rows with a null among these are no records, other columns are not
    looked at. Equal tables, also two empty ones, give no rows and are decided by their roots. Only records in offset ranges
    that differ are compared, so a record that moved between two of these is found, and one that did not move is never read.
    """
    ours, theirs = (written(x.select("file", "offset", "digest").dropna(), "records") for x in (archive, replica))
    shape = _shape([ours, theirs])
    kind = "file bigint, status string, offset bigint, digest string, replica_offset bigint, replica_digest string"
    if shape is None:
        return archive.sparkSession.createDataFrame([], kind)
    ranges = differing_ranges(ours, theirs, *shape)
    spot = ranges.select((F.col("file") + shape[0]).alias("file"), "node")
    a, b = (x.withColumn("node", F.floor(F.col("offset") / RANGE_BYTES)).join(spot, ["file", "node"], "left_semi").drop("node") for x in (ours, theirs))
    a, b = (written(x.join(y, ["file", "offset", "digest"], "left_anti"), "differing") for x, y in ((a, b), (b, a)))
    turn = Window.partitionBy("file", "digest").orderBy("offset")
    a, b = (x.withColumn("turn", F.row_number().over(turn)) for x in (a, b))
    b = b.withColumnRenamed("offset", "replica_offset")
    moved = a.join(b, ["file", "digest", "turn"]).select("file", "digest", "turn", "offset", "replica_offset")
    moved = written(moved, "moved")
    rest_a = a.join(moved, ["file", "digest", "turn"], "left_anti").select("file", "offset", "digest")
    rest_b = b.join(moved, ["file", "digest", "turn"], "left_anti")
    rest_b = rest_b.select("file", F.col("replica_offset").alias("offset"), F.col("digest").alias("replica_digest"))
    rest = rest_a.join(rest_b, ["file", "offset"], "full")
    status = F.when(F.col("digest").isNull(), "surplus").when(F.col("replica_digest").isNull(), "missing").otherwise("corrupt")
    rest = rest.select(
        "file", status.alias("status"), F.when(F.col("digest").isNotNull(), F.col("offset")).alias("offset"), "digest",
        F.when(F.col("replica_digest").isNotNull(), F.col("offset")).alias("replica_offset"), "replica_digest",
    )
    return moved.select("file", F.lit("moved").alias("status"), "offset", "digest", "replica_offset", F.col("digest").alias("replica_digest")).unionByName(rest)


def audit(index: DataFrame) -> DataFrame:
    """Compare a replica with the archive place by place: (page_id, file, offset, length, digest, status) of every record.

    ``index`` names the digest that the replica holds at each place of the archive (see ``archive_index``); ``status`` is
    intact, corrupt or missing. For replicas with offsets of their own see ``audit_replicas``. Both trees are descended
    as there; a collection that agrees is decided by its root. The height follows from the largest file and file number.
    Records need no order, equal records at different offsets are different leaves, an empty table gives none.
    """
    index = written(index, "index")
    shape = _shape([index])
    if shape is None:
        return index.select("page_id", "file", "offset", "length", "digest", F.lit("intact").alias("status"))
    copy = index.select("file", "offset", F.col("replica_digest").alias("digest"))
    ranges = differing_ranges(index, copy, *shape).select(F.col("file").alias("s_file"), F.col("node").alias("s_node"))
    inside = (F.col("file") - shape[0] == F.col("s_file")) & (F.floor(F.col("offset") / RANGE_BYTES) == F.col("s_node"))
    status = F.when(F.col("s_file").isNull() | F.col("digest").eqNullSafe(F.col("replica_digest")), "intact").when(F.col("replica_digest").isNull(), "missing").otherwise("corrupt")
    return index.join(ranges, inside, "left").select("page_id", "file", "offset", "length", "digest", status.alias("status"))
