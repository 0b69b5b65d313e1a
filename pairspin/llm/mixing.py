"""Mixing sources to target weights by Pfair scheduling.  DataFrame functions only.

Time is cut into slots; a slot takes one block of ``block_docs`` documents of one source.  With integer
shares n of a period of W slots, block b of a source may run from release floor(b W / n) and must run before
deadline ceil((b + 1) W / n).  Earliest deadline first among the released blocks meets every
window, as the weights sum to one; so after any number of slots each source has had its share to within
less than one block.  The schedule repeats after W slots, so one period is planned from the
shares alone (W steps, whatever the data) and becomes a literal; a block's slot then is arithmetic.

A document's place within its source is its rank by digest.  Ranks come from counts by (source, digest
prefix) and a window within that pair, so a source with a third of all rows is spread over 4,096 groups,
and no window or sort spans a source.  Rows of one key are in the order of a hash of the whole row; a key that very many rows
share is cut by that hash into cells of its own, so null keys are no hot group either.

Every row is kept.  ``mixed`` tells the slots before the first one that some source can't fill with a whole block;
from there on the slots of sources that have run out stay empty.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import quoted, table

#: Sources without a share of their own, and null sources, share this one.
OTHER = "*"
#: Hexadecimal digits of the digest that split a source for ranking.
PREFIX = 3
#: A cell of so many rows, if it also has 1/512 of all, is looked into for keys that many rows share; the places are the same either way.
CELL_ROWS = 100_000

#: The production shares of ``op2``: parts of a period.
SHARES: dict[str, int] = {"src0": 12, **{f"src{k}": 1 + k % 4 for k in range(1, 20)}, OTHER: 2}
BLOCK_DOCS = 8


def pfair_period(shares: Mapping[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period of ``sum(shares)`` slots; ties go to the smaller name."""
    period, done = sum(shares.values()), dict.fromkeys(sorted(shares), 0)
    slots: dict[str, list[int]] = {s: [] for s in done}
    for slot in range(period):
        ready = [(-(-(done[s] + 1) * period // shares[s]), s) for s in done if done[s] < shares[s] and done[s] * period // shares[s] <= slot]
        chosen = min(ready)[1]
        slots[chosen].append(slot)
        done[chosen] += 1
    return slots


def mix(docs: DataFrame, shares: Mapping[str, int], block_docs: int = BLOCK_DOCS, key: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` with columns mix_group, mix_block, mix_pos, mix_slot, mix_release, mix_deadline, mix_mixed.

    The order (mix_slot, mix_pos) is the mixture.  Shares of sources without rows are left out, and
    the rest fill the period.  Null sources belong to the pooled share; null keys rank as an empty
    digest text; repeated rows each get a place of their own.  An empty table gives an empty one.  Columns of ``docs`` with the new names are replaced.
    """
    placed = _placed(docs, shares, block_docs, key, source)
    new = ["mix_group", "mix_block", "mix_pos", "mix_slot", "mix_release", "mix_deadline", "mix_mixed"]
    return placed.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in new), *new)


def _cells(rows: DataFrame) -> DataFrame:
    """``rows`` with ``mix_prefix``: an ordered cell within (mix_group, order by digest and tie), small whatever the keys."""
    rows = rows.withColumn("mix_prefix", F.substring("mix_digest", 1, PREFIX))
    sizes = rows.groupBy("mix_group", "mix_prefix").agg(F.count("*").alias("n"))
    least = max(CELL_ROWS, (rows.count() - 1) // 512 + 1)
    large = [r.mix_prefix for r in sizes.where(F.col("n") >= least).select("mix_prefix").distinct().collect()]  # 512 at most
    if not large:
        return rows
    counts = rows.where(F.col("mix_prefix").isin(large)).groupBy("mix_digest").agg(F.count("*").alias("n"))
    hot = F.array(*(F.lit(r.mix_digest) for r in counts.where(F.col("n") >= least).collect())).cast("array<string>")  # 512 at most
    digest = F.col("mix_digest")
    # what comes before a hot digest, its rows by their hash, what comes after it
    after = F.format_string("%04d", F.size(F.filter(hot, lambda x: x < digest)))
    part = F.when(F.array_contains(hot, digest), F.concat(F.lit("+"), F.substring("mix_tie", 1, PREFIX))).otherwise(F.lit(""))
    return rows.withColumn("mix_prefix", F.concat("mix_prefix", after, part))


def _placed(docs: DataFrame, shares: Mapping[str, int], block_docs: int, key: str, source: str) -> DataFrame:
    """Each row of ``docs`` as the struct ``row``, with its place."""
    if any(not isinstance(n, int) or n < 1 for n in shares.values()):
        raise ValueError("shares are positive integers")
    named = sorted(s for s in shares if s != OTHER)
    group = F.when(F.col(source).isin(named), F.col(source)).otherwise(F.lit(OTHER)) if named else F.lit(OTHER)
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    row = F.struct(*(F.col(quoted(c)) for c in docs.columns))
    told = [F.col(quoted(c)) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    tie = F.lpad(F.hex(F.xxhash64(*told)), 16, "0")
    rows = _cells(docs.select(row.alias("row"), group.alias("mix_group"), digest.alias("mix_digest"), tie.alias("mix_tie")))

    cells = rows.groupBy("mix_group", "mix_prefix").agg(F.count("*").alias("n"))
    sizes = {r.mix_group: r.n for r in cells.groupBy("mix_group").agg(F.sum("n").alias("n")).collect()}  # as many rows as shares, at most
    active = {s: shares.get(s, 1) for s in sizes}
    period, slots = sum(active.values()), pfair_period(active)

    before = Window.partitionBy("mix_group").orderBy("mix_prefix").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("mix_group", "mix_prefix", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("mix_before"))
    inside = F.row_number().over(Window.partitionBy("mix_group", "mix_prefix").orderBy("mix_digest", "mix_tie")) - 1
    ranked = rows.withColumn("mix_inside", inside).join(starts, ["mix_group", "mix_prefix"]).withColumn("mix_rank", F.col("mix_before") + F.col("mix_inside"))

    def by_group(value) -> Column:
        out = F.lit(None)
        for s in sorted(active):
            out = F.when(F.col("mix_group") == s, value(s)).otherwise(out)
        return out

    block = F.expr(f"mix_rank div {block_docs}")
    share = by_group(lambda s: F.lit(active[s])).cast("long")
    slot = by_group(lambda s: F.expr(f"(mix_block div {active[s]}) * {period} + element_at(array({','.join(map(str, slots[s]))}), cast(mix_block % {active[s]} as int) + 1)"))
    horizon = min((period * (n // block_docs // active[s]) + slots[s][n // block_docs % active[s]] for s, n in sizes.items()), default=0)
    return (
        ranked.withColumn("mix_block", block)
        .withColumn("mix_pos", F.col("mix_rank") % block_docs)
        .withColumn("mix_slot", slot.cast("long"))
        .withColumn("mix_share", share)
        .withColumn("mix_release", F.expr(f"mix_block * {period} div mix_share"))
        .withColumn("mix_deadline", F.expr(f"((mix_block + 1) * {period} + mix_share - 1) div mix_share"))
        .withColumn("mix_mixed", F.col("mix_slot") < horizon)
        .select("row", "mix_group", "mix_block", "mix_pos", "mix_slot", "mix_release", "mix_deadline", "mix_mixed")
    )


def mixed_order(docs: DataFrame, shares: Mapping[str, int], block_docs: int = BLOCK_DOCS, key: str = "doc_id", source: str = "source", places: bool = False) -> DataFrame:
    """The rows and columns of ``docs`` in the order of the mixture: range-partitioned by slot, sorted within.

    Only the frame itself has this order: Spark scans the files written from it in order of their length.  With
    ``places`` the columns mix_slot and mix_pos, which tell it anywhere, stay.
    """
    placed = _placed(docs, shares, block_docs, key, source).repartitionByRange("mix_slot", "mix_pos").sortWithinPartitions("mix_slot", "mix_pos")
    if not places:
        return placed.select("row.*")
    return placed.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("mix_slot", "mix_pos")), "mix_slot", "mix_pos")


def op2_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mix(table(spark, sf_dir, "documents").select("doc_id", "source"), SHARES)
    return placed.select("doc_id", "source", *(F.col(f"mix_{c}").alias(c) for c in ("block", "pos", "slot", "release", "deadline", "mixed")))


def _oracle() -> str:
    names = ", ".join(f"'{s}'" for s in sorted(SHARES) if s != OTHER)
    shares = ", ".join(f"('{s}', {n})" for s, n in sorted(SHARES.items()))
    return f"""
WITH RECURSIVE share(grp, n) AS (VALUES {shares}),
doc AS (SELECT doc_id, source, CASE WHEN source IN ({names}) THEN source ELSE '{OTHER}' END AS grp, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
size AS (SELECT grp, count(*) AS c FROM doc GROUP BY grp),
act AS (SELECT grp, CAST(n AS BIGINT) AS n, c FROM share JOIN size USING (grp)),
total AS (SELECT CAST(sum(n) AS BIGINT) AS w FROM act),
edf(slot, grp, n, done, picked, was) AS (
  SELECT CAST(-1 AS BIGINT), grp, n, CAST(0 AS BIGINT), false, CAST(0 AS BIGINT) FROM act
  UNION ALL
  SELECT slot, grp, n, done + CAST(rk = 1 AS BIGINT), rk = 1, done FROM (
    SELECT slot + 1 AS slot, grp, n, done, row_number() OVER (ORDER BY CASE WHEN done < n AND done * w // n <= slot + 1 THEN ((done + 1) * w + n - 1) // n ELSE 1000000000 END, grp) AS rk
    FROM edf, total WHERE slot + 1 < w)
),
pattern AS (SELECT grp, was AS i, slot FROM edf WHERE picked),
ranked AS (SELECT doc_id, source, grp, row_number() OVER (PARTITION BY grp ORDER BY h, doc_id) - 1 AS r FROM doc),
placed AS (
  SELECT doc_id, source, r // {BLOCK_DOCS} AS block, r % {BLOCK_DOCS} AS pos, n, w, (r // {BLOCK_DOCS}) // n * w + p.slot AS slot
  FROM ranked JOIN act USING (grp) CROSS JOIN total JOIN pattern p ON p.grp = ranked.grp AND p.i = (r // {BLOCK_DOCS}) % n),
horizon AS (SELECT min((c // {BLOCK_DOCS}) // n * w + p.slot) AS z FROM act CROSS JOIN total JOIN pattern p ON p.grp = act.grp AND p.i = (c // {BLOCK_DOCS}) % n)
SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(pos AS BIGINT) AS pos, CAST(slot AS BIGINT) AS slot,
  CAST(block * w // n AS BIGINT) AS release, CAST(((block + 1) * w + n - 1) // n AS BIGINT) AS deadline, slot < z AS mixed
FROM placed, horizon"""


QUERIES = {"op2_pfair_mixing": op2_pfair_mixing}
ORACLE_SQL = {"op2_pfair_mixing": _oracle()}
