"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

Every source's documents are laid out on a line in seeded order and cut into equal-token blocks.
Blocks are granted one after another to the source with the highest quotient target / (2k + 1);
consecutive grants fill the shards of the mix, so each shard has an integer quota per source. Which
blocks of its line a source contributes follows from its quota and a seeded offset: block i is taken
floor(((i + 1) K + o) / M) - floor((i K + o) / M) times, which spreads K takes evenly over M blocks.

Granting by highest quotients gives the same quotas as rounding each target divided by one common divisor.
Sources of few blocks are cut finer (`FINEST` blocks), and their quotas are taken in that second form, with
their block as the divisor, so that their words come near their targets too; a source at its limit is taken
twice whole. `shard_quotas` gives the integer block quotas of each shard and source.

Null texts have size 0, null sources are one source (ordered last), repeated rows are rows of their
own, a null doc_id is laid out like any other. Extra columns are ignored (`apply` keeps them). An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftnet.llm.common import persist

WEIGHTS = (3, 1, 2)
#: Blocks granted in all; the grant table has this many rows at any input size.
BLOCKS = 65_536
SHARDS = 64
#: A source's line has at least this many blocks (or words, if fewer): small sources get finer blocks.
FINEST = 1024
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: tuple[int, int] = (3, 2), weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, ord, target): shares of the mix by weight, none above twice its source.

    The excess of a source at its limit is reshared by weight until none is above: in ascending order
    of size / weight, a source is at its limit while its share of what is left would exceed it.
    """
    num, den = share
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("ord") % len(weights) + 1).cast("int")).cast("long")
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("ord", (F.row_number().over(order) - 1).cast("long")).withColumn("w", w)
    by_room = Window.orderBy((F.col("source_size") / F.col("w")).asc(), "ord")
    everything = Window.partitionBy()
    src = src.select("*", F.sum("source_size").over(everything).alias("total"))
    src = src.select("*", (2 * F.sum("source_size").over(by_room) - 2 * F.col("source_size")).alias("capped"), (F.sum("w").over(everything) - F.sum("w").over(by_room) + F.col("w")).alias("w_left"))
    left = num * F.col("total") - den * F.col("capped")
    src = src.select("*", (left * F.col("w") < 2 * den * F.col("source_size") * F.col("w_left")).alias("free"), (left / (den * F.col("w_left"))).alias("level"))
    src = src.withColumn("level", F.max(F.when(F.col("free"), F.col("level"))).over(everything))
    return src.select("source", "source_size", "ord", "total", F.when(F.col("free"), F.col("level") * F.col("w")).otherwise(2.0 * F.col("source_size")).alias("target"))


def quotas(plan: DataFrame, blocks: int = BLOCKS, shards: int = SHARDS, share: tuple[int, int] = (3, 2)) -> DataFrame:
    """(ord, shard, blocks): integer block quotas of each shard and source, by highest quotients."""
    each = F.greatest(F.lit(1), F.ceil(share[0] * F.col("total") / (share[1] * blocks))).cast("long")
    seats = plan.where("target > 0").select("ord", "target", each.alias("block"), F.round(share[0] * F.col("total") / (share[1] * each)).cast("long").alias("house"))
    asked = seats.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("target") / F.col("block")).cast("long") + 1)).alias("k"))
    ranked = asked.select("ord", "house", (F.row_number().over(Window.orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), "ord", "k")) - 1).alias("rank"))
    return ranked.where("rank < house").groupBy("ord", F.floor(F.col("rank") * shards / F.col("house")).cast("int").alias("shard")).agg(F.count("*").alias("blocks"))


def shard_quotas(docs: DataFrame, share: tuple[int, int] = (3, 2), weights: tuple[int, ...] = WEIGHTS, blocks: int = BLOCKS, shards: int = SHARDS) -> DataFrame:
    """(source, shard, blocks) of docs(text, source): how many blocks of each source each shard of the mix has."""
    plan = persist(targets(docs.select("source", word_count(F.col("text")).alias("size")), share, weights))
    return plan.select("source", "ord").join(quotas(plan, blocks, shards, share), "ord").select("source", "shard", "blocks")


def mix(docs: DataFrame, seed: str = SEED, share: tuple[int, int] = (3, 2), weights: tuple[int, ...] = WEIGHTS, blocks: int = BLOCKS, shards: int = SHARDS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of each row of docs(doc_id, text, source)."""
    place = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    sized = persist(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), place.alias("place")).withColumn("bucket", F.substring("place", 1, 3)))

    plan = persist(targets(sized.groupBy("source", "bucket").agg(F.sum("size").alias("size")), share, weights))
    granted = quotas(plan, blocks, shards, share).groupBy("ord").agg(F.sum("blocks").alias("granted"))
    size, block = F.col("source_size"), F.greatest(F.lit(1), F.ceil(share[0] * F.col("total") / (share[1] * blocks))).cast("long")
    lines = plan.join(granted, "ord", "left").withColumn("unit", F.greatest(F.lit(1).cast("long"), F.least(block, F.expr(f"source_size div {FINEST}"))))
    lines = lines.withColumn("m", F.greatest(F.lit(1).cast("long"), F.expr("source_size div unit")))
    takes = F.when(F.col("unit") == block, F.coalesce(F.col("granted"), F.lit(0))).otherwise(F.round(F.col("target") / F.col("unit")).cast("long"))
    takes = F.when(F.col("target") >= 2 * size, 2 * F.col("m")).otherwise(F.least(takes, 2 * F.col("m")))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|offset|"), F.col("ord").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % F.col("m")
    lines = persist(lines.select(F.col("source").alias("line"), "source_size", "target", "unit", "m", takes.alias("k"), offset.alias("o")))

    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("bucket")
    starts = persist(buckets.select(F.col("source").alias("line"), F.col("bucket").alias("part"), (F.sum("in_bucket").over(before) - F.col("in_bucket")).alias("base")))
    within = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.join(starts, sized["source"].eqNullSafe(starts["line"]) & (sized["bucket"] == starts["part"])).drop("line", "part")
    placed = placed.withColumn("b", F.col("base") + F.sum("size").over(within)).withColumn("a", F.col("b") - F.col("size"))
    placed = placed.join(lines, placed["source"].eqNullSafe(lines["line"])).drop("line")
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.expr(_taken("b")) - F.expr(_taken("a"))).cast("long").alias("taken"))


def apply(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: rows of docs(doc_id, text, source, n_chars, ...) as often as it takes them.

    A document of which more words than its size are taken stands there whole and again; one of which part is
    taken is cut after its last word taken. Rows equal in doc_id, source and size share their words evenly.
    Documents of which nothing is taken go. Extra columns are kept as they are, whatever their names.
    """
    each = mix(docs.select("doc_id", "text", "source"), **options).groupBy("doc_id", "source", "size").agg((F.sum("taken") / F.count("*")).cast("long").alias("taken"))
    each = persist(each.where("taken > 0").select(F.struct("doc_id", "source", "size").alias("of"), "taken"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.withColumn("size", word_count(F.col("row.text")))
    same = F.col("row.doc_id").eqNullSafe(F.col("of.doc_id")) & F.col("row.source").eqNullSafe(F.col("of.source")) & (F.col("size") == F.col("of.size"))
    rows = rows.join(each, same).drop("of")
    whole = F.expr("array_repeat(cast(null as bigint), cast(taken div size as int))")
    part = F.expr("if(taken % size = 0, cast(array() as array<bigint>), array(taken % size))")
    rows = rows.withColumn("first", F.explode(F.concat(whole, part)))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("first").cast("int")), "")
    new = {"text": F.when(F.col("first").isNull(), F.col("row.text")).otherwise(F.col("head")), "n_chars": F.when(F.col("first").isNull(), F.col("row.n_chars")).otherwise(F.char_length("head"))}
    rows = rows.withColumn("head", F.when(F.col("first").isNotNull(), head))
    return rows.select(*((new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns))


def _taken(x: str) -> str:
    """Words taken before place x of a source's line; the last block also has what is left over."""
    i = f"least({x} div unit, m - 1)"
    return f"((({i}) * k + o) div m) * unit + ((((({i}) + 1) * k + o) div m) - ((({i}) * k + o) div m)) * ({x} - ({i}) * unit)"


def mix_sql(columns: str = "doc_id, size, source_size, target, taken", docs: str = "documents") -> str:
    """The same mix as DuckDB SQL."""
    weights = "[" + ", ".join(map(str, WEIGHTS)) + "]"
    return f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null')) AS place FROM {docs}),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS ord FROM sized GROUP BY source),
src1 AS (SELECT *, {weights}[(ord % {len(WEIGHTS)}) + 1]::BIGINT AS w, (sum(source_size) OVER ())::BIGINT AS total FROM src),
src2 AS (SELECT *, 2 * (sum(source_size) OVER r)::BIGINT - 2 * source_size AS capped, (sum(w) OVER ())::BIGINT - (sum(w) OVER r)::BIGINT + w AS w_left
         FROM src1 WINDOW r AS (ORDER BY source_size / w, ord)),
src3 AS (SELECT *, (3 * total - 2 * capped) * w < 4 * source_size * w_left AS free, (3 * total - 2 * capped) / (2 * w_left) AS level
         FROM src2),
plan AS (SELECT source, source_size, ord, total, CASE WHEN free THEN (max(CASE WHEN free THEN level END) OVER ()) * w ELSE 2.0 * source_size END::DOUBLE AS target,
         greatest(1, ceil(3 * total / (2 * {BLOCKS})))::BIGINT AS block FROM src3),
plan1 AS (SELECT *, round(3 * total / (2 * block))::BIGINT AS house FROM plan),
asked AS (SELECT ord, house, target, unnest(range(0, ceil(target / block)::BIGINT + 2)) AS k FROM plan1 WHERE target > 0),
ranked AS (SELECT ord, house, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, ord, k) - 1 AS rank FROM asked),
granted AS (SELECT ord, count(*) AS granted FROM ranked WHERE rank < house GROUP BY ord),
lines AS (SELECT *, greatest(1, source_size // unit) AS m FROM (
  SELECT plan1.*, coalesce(granted, 0) AS granted, greatest(1, least(block, source_size // {FINEST})) AS unit FROM plan1 LEFT JOIN granted USING (ord))),
lines1 AS (SELECT *, CASE WHEN target >= 2 * source_size THEN 2 * m WHEN unit = block THEN least(granted, 2 * m) ELSE least(round(target / unit)::BIGINT, 2 * m) END AS q,
           ('0x' || substr(md5('{SEED}|offset|' || ord), 1, 8))::BIGINT % m AS o FROM lines),
placed AS (SELECT doc_id, source, size, (sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS b FROM sized),
joined AS (SELECT p.doc_id, p.source, p.size, l.source_size, l.target, l.unit, l.m, l.q, l.o, p.b, p.b - p.size AS a,
           least(p.b // l.unit, l.m - 1) AS ib, least((p.b - p.size) // l.unit, l.m - 1) AS ia
           FROM placed p JOIN lines1 l ON p.source IS NOT DISTINCT FROM l.source),
mixed AS (SELECT *, (((ib * q + o) // m) * unit + ((((ib + 1) * q + o) // m) - ((ib * q + o) // m)) * (b - ib * unit)
         - ((ia * q + o) // m) * unit - ((((ia + 1) * q + o) // m) - ((ia * q + o) // m)) * (a - ia * unit))::BIGINT AS taken FROM joined)
SELECT {columns} FROM mixed"""
