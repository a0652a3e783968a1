"""Helpers that several operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster. A folder of our own only on a single machine where none is named, as
    in tests; on a cluster that names none this raises, as executors would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="scribewash-"))
    return _OWN_DIR[0]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts the lineage: a lost executor costs the rerun of a scan, not of what made the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scribewash_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote: only once everything that reads them has itself been written."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scribewash_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of plans that are no longer referenced.

    The cleaner acts when the driver's JVM collects its garbage; between two phases that each shuffle about as
    much as the input, waiting for that to happen by chance would hold both on disk.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents. A table of few files, such as the one file of each small test table, is dealt out to the
    cores; whether it is hangs on the number of files alone, and a table of many files is never shuffled."""
    df = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < min(cores, 8) else df


#: Ids that are broadcast at most: 16 bytes each in the hash table of longs.
MAX_BROADCAST_IDS = 500_000


def without_ids(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows of ``ids`` (one column); null ids stay.

    A counted, small set is broadcast, so that no text is shuffled; a larger one is joined by a shuffle.
    """
    ids = materialise(ids.select(F.col(ids.columns[0]).alias(doc_id)).distinct(), "ids")
    side = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids.hint("merge")
    return docs.join(side, doc_id, "left_anti").select(*docs.columns)


def utf8(col: str | Column) -> Column:
    """A text column as UTF-8 bytes; null as no bytes."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string").cast("binary"), F.lit(b""))


_BLANK = re.compile(rb"[\x20\t-\r]")


def byte_parts(b: bytes, size: int) -> Iterator[bytes]:
    """``b`` in parts of about ``size`` bytes, cut at ASCII blanks only: no word is torn, a longer one is in one part."""
    at = 0
    while len(b) - at > size:
        hit = _BLANK.search(b, at + size)
        end = hit.end() if hit else len(b)
        yield b[at:end]
        at = end
    if at < len(b):
        yield b[at:] if at else b


def crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of a column as text, modulo n; -1 for null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % F.lit(n), F.lit(-1)).cast("int")


def labelled_sample(rows: DataFrame, label: str, text: str, per_label: int, max_labels: int) -> list[tuple[object, bytes]]:
    """About ``per_label`` (at most twice as many) distinct labelled texts of each label, on the driver.

    The ``max_labels`` most frequent labels count (of equals, those that sort first): a column of dirty values
    does not reach the driver. Rows are chosen by a hash of the text alone, so the choice depends neither on
    ids nor on the layout of the data, and the copies of one text count once. Ties cannot occur: a text is a
    key. The sample's size is bounded by the parameters, not by the data.
    """
    usable = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("y"), F.col(text).cast("string").alias("t"))
    counts = usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "y").limit(max_labels).collect()
    if not counts:
        return []
    shares = rows.sparkSession.createDataFrame([(r.y, min(1.0, 1.25 * per_label / r.n)) for r in counts], usable.select("y", F.lit(0.0).alias("share")).schema)
    point = F.pmod(F.xxhash64("t"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = usable.join(F.broadcast(shares), "y").where(point < F.col("share")).groupBy("t").agg(F.min("y").alias("y"))
    by: dict[object, list[tuple[int, object, bytes]]] = {}
    for r in chosen.select("y", F.col("t").cast("binary").alias("t"), F.xxhash64("t").alias("h")).toLocalIterator():
        by.setdefault(r.y, []).append((r.h, r.y, bytes(r.t)))
    return [(y, t) for rows_ in (sorted(v)[: 2 * per_label] for _, v in sorted(by.items())) for _, y, t in rows_]


def sample_by_labels(
    docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, per_label: int
) -> tuple[list[tuple[int, bytes]], dict[int, int]]:
    """As ``labelled_sample``, with 0/1 labels in a table of their own: (sample, rows of each label).

    Only ids and hashes of texts meet the labels; the texts of the chosen rows (a bounded number) are
    then fetched by a second scan. The larger of two labels of one id counts.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id"))
    known = known.agg(F.max(label).cast("int").alias("_y"))
    counts = {r[0]: r[1] for r in known.groupBy("_y").agg(F.count(F.lit(1))).collect()}
    if not counts:
        return [], {}
    keyed = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_h"))
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col("_y") == value, F.lit(min(1.0, 1.25 * per_label / n))).otherwise(share)
    point = F.pmod(F.col("_h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # What no label's share lets in need not meet the labels.
    most = max(min(1.0, 1.25 * per_label / n) for n in counts.values())
    chosen = keyed.where(point < most).join(known, "_id").where(point < share).groupBy("_h").agg(F.min("_y").alias("_y"), F.min("_id").alias("_id"))
    by: dict[int, list[tuple[int, int, int]]] = {}
    for r in chosen.toLocalIterator():
        by.setdefault(r._y, []).append((r._h, r._id, r._y))
    picked = [x for v in by.values() for x in sorted(v)[: 2 * per_label]]
    if not picked:
        return [], counts
    ids = docs.sparkSession.createDataFrame([(i,) for i in sorted({i for _, i, _ in picked})], "_id long")
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("binary").alias("_t"), F.xxhash64(text).alias("_h"))
    got = {r._h: bytes(r._t) for r in texts.join(F.broadcast(ids), "_id").toLocalIterator() if r._t is not None}
    return [(y, got[h]) for h, _, y in sorted(picked) if h in got], counts
