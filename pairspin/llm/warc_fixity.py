"""WARC records, and a Merkle audit of replicas.  DataFrame functions only.

Each record of an archive is hashed, together with its offset range, into a leaf; ``FANOUT`` neighbouring nodes
are hashed, in order, into the node above, up to one root an archive.  Two replicas are compared by
their roots, and only below nodes that differ are children looked at, level by level, down to the
records.  Those are then matched by record id, so that a lost record is told apart from records that only moved.

Bodies are read once, to hash them; everything after moves rows of a few dozen bytes.  Archives have
``ARCHIVE_RECORDS`` ids each, so no window or node is large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import materialize, table

ARCHIVE_RECORDS, FANOUT = 1000, 16
_EOL = "\r\n"


def record_text(key: Column, url: Column, body: Column) -> Column:
    """A WARC 1.1 resource record; null parts are empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.1{_EOL}WARC-Type: resource{_EOL}WARC-Record-ID: <urn:page:"),
        text(key),
        F.lit(f">{_EOL}WARC-Target-URI: "),
        text(url),
        F.lit(f"{_EOL}Content-Type: text/html{_EOL}Content-Length: "),
        F.octet_length(text(body)).cast("string"),
        F.lit(_EOL * 2),
        text(body),
        F.lit(_EOL * 2),
    )


def leaves(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(archive, idx, record_id, copy, start, size, digest, hash): a leaf for each record, in the order of ids.

    Records that repeat an id are copies, told apart by number in the order of their digests.  Records without
    an id go to archives of their own, by address.
    """
    record = record_text(F.col(key), F.col(url), F.col(body))
    archive = F.coalesce(F.expr(f"`{key}` div {ARCHIVE_RECORDS}"), -1 - F.expr(f"pmod(hash(`{url}`), 1024)").cast("long"))
    rows = pages.select(archive.alias("archive"), F.col(key).cast("long").alias("record_id"), F.octet_length(record).cast("long").alias("size"), F.sha2(record.cast("binary"), 256).alias("digest"))
    order = Window.partitionBy("archive").orderBy("record_id", "digest")
    rows = rows.withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("archive", "record_id").orderBy("digest", "idx")).cast("long"))
    leaf = F.concat_ws(":", "start", "size", F.coalesce(F.col("record_id").cast("string"), F.lit("")), "digest")
    return rows.withColumn("hash", F.sha2(leaf.cast("binary"), 256)).select("archive", "idx", "record_id", "copy", "start", "size", "digest", "hash")


def tree(of: DataFrame, levels: int) -> DataFrame:
    """(archive, n0, n1, ...): nodes (hash, start, stop) of each level as arrays; the last level is the root if there are enough.

    An archive's records are one row's array, which its id range bounds; the levels are projections of it.
    """
    node = F.struct("idx", "hash", "start", (F.col("start") + F.col("size")).alias("stop"))
    out = of.groupBy("archive").agg(F.array_sort(F.collect_list(node)).alias("n0"))
    for k in range(levels):
        parts = f"transform(sequence(0, cast((size(n{k}) - 1) div {FANOUT} as int)), p -> slice(n{k}, p * {FANOUT} + 1, {FANOUT}))"
        text = "concat(array_join(transform(s, x -> x.hash), ''), ':', array_min(transform(s, x -> x.start)), ':', array_max(transform(s, x -> x.stop)))"
        out = out.withColumn(f"n{k + 1}", F.expr(f"transform({parts}, (s, p) -> named_struct('idx', p, 'hash', sha2(cast({text} as binary), 256), 'start', array_min(transform(s, x -> x.start)), 'stop', array_max(transform(s, x -> x.stop))))"))
    return out


def _levels(*sets: DataFrame) -> int:
    most = reduce(DataFrame.unionByName, [s.agg(F.max("idx").alias("m")) for s in sets]).agg(F.max("m")).first()[0] or 0
    n = 0
    while most >= FANOUT**n:
        n += 1
    return n


def mismatches(a: DataFrame, b: DataFrame, levels: int) -> DataFrame:
    """(archive, idx) of records that differ, or that one side lacks, found from the roots of two trees downwards."""
    x, y = a.alias("x"), b.alias("y")
    both = x.join(y, "archive", "full").where(~F.expr(f"x.n{levels}[0].hash <=> y.n{levels}[0].hash"))
    bad = both.withColumn("bad", F.array(F.lit(0)))
    for k in range(levels - 1, -1, -1):
        last = f"greatest(coalesce(size(x.n{k}), 0), coalesce(size(y.n{k}), 0)) - 1"
        below = f"filter(sequence(bad_up * {FANOUT}, least(bad_up * {FANOUT} + {FANOUT - 1}, {last})), i -> not (get(x.n{k}, i).hash <=> get(y.n{k}, i).hash))"
        bad = bad.withColumn("bad", F.expr(f"flatten(transform(bad, bad_up -> {below}))"))
    return bad.select("archive", F.explode("bad").alias("idx"))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(archive, record_id, copy, status, start, replica_start, size, replica_size) of every record that isn't the same in both.

    ``primary`` and ``replica`` are leaves.  Status: ``missing`` in the replica, ``extra`` there, ``changed`` content, or
    ``moved`` only.  Equal replicas, and two empty ones, give no rows.
    """
    primary, replica = materialize(primary, "warc-leaves"), materialize(replica, "warc-leaves")
    n = _levels(primary, replica)
    bad = materialize(mismatches(tree(primary, n), tree(replica, n), n).withColumn("idx", F.col("idx").cast("long")), "warc-mismatch")
    where = ["archive", "record_id", "copy"]
    x = primary.join(bad, ["archive", "idx"], "left_semi").select(*where, F.col("start").alias("s1"), F.col("size").alias("z1"), F.col("digest").alias("d1"))
    y = replica.join(bad, ["archive", "idx"], "left_semi").select(*where, F.col("start").alias("s2"), F.col("size").alias("z2"), F.col("digest").alias("d2"))
    x, y = x.alias("x"), y.alias("y")
    same = (F.col("x.archive") == F.col("y.archive")) & F.col("x.record_id").eqNullSafe(F.col("y.record_id")) & (F.col("x.copy") == F.col("y.copy"))
    status = F.when(F.col("d2").isNull(), "missing").when(F.col("d1").isNull(), "extra").when(F.col("d1") != F.col("d2"), "changed").otherwise("moved")
    found = x.join(y, same, "full").where(~(F.col("s1").eqNullSafe(F.col("s2")) & F.col("d1").eqNullSafe(F.col("d2"))))
    return found.select(
        *(F.coalesce(F.col(f"x.{c}"), F.col(f"y.{c}")).alias(c) for c in where),
        status.alias("status"),
        F.col("s1").alias("start"),
        F.col("s2").alias("replica_start"),
        F.col("z1").alias("size"),
        F.col("z2").alias("replica_size"),
    )


def damaged(pages: DataFrame) -> DataFrame:
    """The replica that the query audits: by digest of the id, one page of 256 has its last sign changed, one of 256 lacks its second half, one of 4096 is lost."""
    h = F.md5(F.col("page_id").cast("string").cast("binary"))
    n = F.length("html")
    html = F.when(h.startswith("00"), F.concat(F.expr("left(html, length(html) - 1)"), F.lit("\x7f"))).when(h.startswith("01"), F.expr("left(html, length(html) div 2)")).otherwise(F.col("html"))
    return pages.where(~F.coalesce(h.startswith("020"), F.lit(False))).withColumn("html", F.when(n > 0, html).otherwise(F.col("html")))


def op4_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(leaves(pages), leaves(damaged(pages)))


def _oracle() -> str:
    def side(source: str) -> str:
        return f"""SELECT *, row_number() OVER (PARTITION BY archive ORDER BY record_id, digest) - 1 AS idx,
  CAST(sum(size) OVER (PARTITION BY archive ORDER BY record_id, digest ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start,
  row_number() OVER (PARTITION BY archive, record_id ORDER BY digest) AS copy
  FROM (SELECT page_id // {ARCHIVE_RECORDS} AS archive, page_id AS record_id, CAST(strlen(rec) AS BIGINT) AS size, sha256(rec) AS digest FROM (
    SELECT page_id, 'WARC/1.1' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e || 'WARC-Target-URI: ' || coalesce(url, '') || e ||
      'Content-Type: text/html' || e || 'Content-Length: ' || strlen(coalesce(html, '')) || e || e || coalesce(html, '') || e || e AS rec
    FROM {source}, (SELECT chr(13) || chr(10) AS e)))"""

    broken = """(SELECT page_id, url, CASE WHEN length(html) > 0 AND h LIKE '00%' THEN left(html, length(html) - 1) || chr(127)
  WHEN length(html) > 0 AND h LIKE '01%' THEN left(html, length(html) // 2) ELSE html END AS html
  FROM (SELECT *, md5(CAST(page_id AS VARCHAR)) AS h FROM pages) WHERE h NOT LIKE '020%')"""
    return f"""WITH a AS ({side("pages")}), b AS ({side(broken)})
SELECT coalesce(a.archive, b.archive) AS archive, coalesce(a.record_id, b.record_id) AS record_id, coalesce(a.copy, b.copy) AS copy,
  CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'extra' WHEN a.digest <> b.digest THEN 'changed' ELSE 'moved' END AS status,
  a.start AS start, b.start AS replica_start, a.size AS size, b.size AS replica_size
FROM a FULL JOIN b ON a.archive = b.archive AND a.record_id = b.record_id AND a.copy = b.copy
WHERE a.start IS DISTINCT FROM b.start OR a.digest IS DISTINCT FROM b.digest"""


QUERIES = {"op4_merkle_fixity": op4_merkle_fixity}
ORACLE_SQL = {"op4_merkle_fixity": _oracle()}
