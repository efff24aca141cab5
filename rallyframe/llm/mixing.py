"""Mixing sources to target weights by Pfair scheduling, in DataFrame expressions only.

The documents of a source are numbered in the order of a hash of their id, by ranges of (source, hash) whose counts are
added up, so a source of any size is spread over tasks and is never collected; BLOCK_DOCS numbers in a row are a block,
so all blocks but a source's last one are equally large. Target weights are whole parts of a period of slots: those given,
or by default the sources' sizes to the power TEMPER; no source gets less than one part, so targets below 1 / PERIOD are
rounded up to it. The i-th block of a source with c of the PERIOD parts is released at slot floor(i * PERIOD / c) and due
by ceil((i + 1) * PERIOD / c); the released block with the earliest deadline gets the slot (ties: the first source by
name). As the parts add up to the period, every deadline is met, and in any prefix of slots a source is less than one
block away from its share. The schedule repeats after one period, so only one period is computed, in one row of
at most MAX_SOURCES sources, and the slot of any block follows from its number alone.

More sources are dealt into groups of at most MAX_SOURCES sources of like weight (by a hash, with no order over all of them).
A group has one period, in one row, as a source has parts in it; the groups are scheduled in the same way with the
sums of their weights, in groups again if they are many. The slots that a group gets are the slots of its own schedule,
so with two levels a source is less than two blocks away from its share in any prefix.

The mix ends when every block has been placed; until then sources that run out start again, so no row is dropped. Weights
far from the sizes make such a mix long: a source with a thousandth of the weight and most of the rows has all others
repeated until it is through. `most_copies` bounds this: a block is then placed that often at most, and the slots of
a source that is through stay empty.

Cases: null and empty sources are one source; rows with null or equal ids are numbered one after the other and stay
separate; an empty table gives no rows; a column `mix` of the input is replaced (stage() returns the input's columns
only, whatever their names); mixed() refuses more than MAX_SOURCES sources, mixed_any() takes any number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyframe.llm import common

NAME = "op6_pfair_mix"

PERIOD = 1024
BLOCK_DOCS = 64
TEMPER = 0.7
MAX_SOURCES = PERIOD // 4
#: Sources are grouped by the power of two of their weight; lighter ones than this many powers below the top are one class.
WEIGHT_CLASSES = 40


def source_of(col: str = "source") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def weighted(sizes: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """sizes with w, the weight of each source."""
    if weights is None:
        return sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(TEMPER)))
    given = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, float(v)))) if weights else F.create_map().cast("map<string,double>")
    return sizes.withColumn("w", F.coalesce(F.element_at(given, F.col("source")), F.lit(0.0)))


def periods(items: DataFrame) -> DataFrame:
    """source, n, g, parts, slots: one period for each group g of at most MAX_SOURCES items.

    items: source, n, w, g."""
    one = items.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("source", "n", "w"))).alias("s"))
    total = F.greatest(F.aggregate("s", F.lit(0.0), lambda a, x: a + x["w"]), F.lit(1e-300))
    one = one.withColumn("quota", F.transform("s", lambda x: (PERIOD - F.size("s")) * x["w"] / total))
    whole = F.transform("quota", lambda q: F.floor(q).cast("int") + 1)
    one = one.withColumn("whole", whole)
    left = F.lit(PERIOD) - F.aggregate("whole", F.lit(0), lambda a, x: a + x)
    by_rest = F.array_sort(F.transform("quota", lambda q, i: F.struct((-F.round(q - F.floor(q), 9)).alias("rest"), i.alias("i"))))
    one = one.withColumn("more", F.slice(F.transform(by_rest, lambda x: x["i"]), F.lit(1), left))
    # where all weights are 0 there is more left than one part for each
    one = one.withColumn("parts", F.transform("whole", lambda k, i: k + F.array_contains("more", i).cast("int")))
    one = one.withColumn("rest", F.lit(PERIOD) - F.aggregate("parts", F.lit(0), lambda a, x: a + x))
    one = one.withColumn("parts", F.transform("parts", lambda k, i: k + F.when(i == 0, F.col("rest")).otherwise(0)))

    def step(a: Column, t: Column) -> Column:
        released = F.transform("parts", lambda c, i: F.when(F.floor(F.get(a["next"], i) * PERIOD / c) <= t, F.struct(F.ceil((F.get(a["next"], i) + 1) * PERIOD / c).alias("due"), i.alias("i"))))
        pick = F.array_min(released)["i"]
        out = F.array_append(a["out"], pick)
        return F.struct(F.transform(a["next"], lambda k, i: k + (i == F.element_at(out, -1)).cast("int")).alias("next"), out.alias("out"))

    zero = F.struct(F.transform("parts", lambda c: F.lit(0)).alias("next"), F.array().cast("array<int>").alias("out"))
    picks = F.aggregate(F.sequence(F.lit(0), F.lit(PERIOD - 1)), zero, step, lambda a: a["out"])
    slots = one.where(F.size("s") > 0).select("g", F.posexplode(picks).alias("slot", "i")).groupBy("g", "i").agg(F.array_sort(F.collect_list("slot")).alias("slots"))
    rows = one.select("g", F.posexplode(F.arrays_zip("s", "parts")).alias("i", "x")).select("g", "i", "x.s.source", "x.s.n", "x.parts")
    return rows.join(slots, ["g", "i"]).drop("i")


def schedule(sizes: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """source, n, blocks, parts, slots (those of its parts in the period), placed (blocks of it in the whole mix).

    sizes: source, n. weights: a target for each source; those left out get one part."""
    if sizes.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = periods(weighted(sizes, weights).withColumn("g", F.lit(""))).withColumn("blocks", F.ceil(F.col("n") / BLOCK_DOCS))
    end = F.max(slot_of(F.col("blocks") - 1) + 1).over(Window.partitionBy(F.lit(1)))
    rows = rows.withColumn("end", end)
    placed = F.floor(F.col("end") / PERIOD) * F.col("parts") + F.size(F.filter("slots", lambda t: t < F.col("end") % PERIOD))
    return rows.select("source", "n", "blocks", "parts", "slots", placed.alias("placed"))


def grouped(items: DataFrame) -> DataFrame:
    """items (source, n, w) with g: groups of at most MAX_SOURCES items of like weight, half as many on average."""
    top = F.lit(items.agg(F.max("w")).first()[0] or 1.0)
    binade = F.when(F.col("w") > 0, F.greatest(F.floor(F.log2(F.col("w") / top)).cast("int"), F.lit(-WEIGHT_CLASSES))).otherwise(-WEIGHT_CLASSES)
    items = items.withColumn("binade", binade)
    counts = items.groupBy("binade").count().collect()
    spread = 1
    while True:
        deals = F.create_map(*(F.lit(x) for r in counts for x in (r.binade, spread * -(-r["count"] // (MAX_SOURCES // 2)))))
        dealt = items.withColumn("g", F.concat_ws("/", "binade", F.pmod(F.xxhash64("source"), F.element_at(deals, F.col("binade")))))
        if dealt.groupBy("g").count().agg(F.max("count")).first()[0] <= MAX_SOURCES:
            return dealt.drop("binade")
        spread *= 2


def levels(items: DataFrame) -> DataFrame:
    """source, n, levels (parts and slots in its group's period, in that of the group's group, and so on).

    items: source, n, w, as a table; at least one row."""
    rows = items.count()
    level = F.array(F.struct("parts", "slots"))
    if rows <= MAX_SOURCES:
        return periods(items.withColumn("g", F.lit(""))).select("source", "n", level.alias("levels"))
    items = common.written(grouped(items))
    top = items.agg(F.max("w")).first()[0] or 1.0
    whole = F.sum(F.round(F.col("w") / top * 1e15).cast("decimal(20,0)")).cast("double")  # in whole units: the same in any order
    above = levels(common.written(items.groupBy(F.col("g").alias("source")).agg(F.lit(0).cast("long").alias("n"), whole.alias("w"))))
    inner = periods(items.repartition(-(-rows // (8 * MAX_SOURCES)), "g"))
    return inner.join(above.select(F.col("source").alias("g"), F.col("levels").alias("above")), "g").select("source", "n", F.concat(level, "above").alias("levels"))


def slot_through(i: Column) -> Column:
    """The slot of the i-th block of a source with `levels`: its slot in each period is its group's block in the next."""
    return F.aggregate("levels", i.cast("long"), lambda s, x: (F.floor(s / x["parts"]) * PERIOD + F.get(x["slots"], (s % x["parts"]).cast("int"))).cast("long"))


def schedule_in_groups(sizes: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """source, n, blocks, levels, placed, for any number of sources, at least one."""
    rows = common.written(levels(common.written(weighted(sizes, weights))).withColumn("blocks", F.ceil(F.col("n") / BLOCK_DOCS)))
    end = F.lit(rows.agg(F.max(slot_through(F.col("blocks") - 1) + 1)).first()[0])
    placed = F.aggregate(F.reverse("levels"), end.cast("long"), lambda e, x: (F.floor(e / PERIOD) * x["parts"] + F.size(F.filter(x["slots"], lambda t: t < e % PERIOD))).cast("long"))
    return rows.select("source", "n", "blocks", "levels", placed.alias("placed"))


def slot_of(i: Column) -> Column:
    """The slot of the i-th block of a source with `parts` and `slots`."""
    return F.floor(i / F.col("parts")) * PERIOD + F.get("slots", (i % F.col("parts")).cast("int"))


def numbered(docs: DataFrame, id_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """Two tables. row (all columns of docs), source, part, at: the rows in order of source and hash of the id, by ranges. source,
    part, first, before, n: of each source and range, its first place and the source's rows in the ranges before."""
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), source_of(source_col).alias("source"), F.md5(key.cast("binary")).alias("hash"), key.alias("key"))
    order = ["source", "hash", "key", "tie"]
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    table = common.written(rows.select("row", "source", F.shiftright("at", 33).alias("part"), "at"))
    counts = table.groupBy("source", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return table, common.written(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))


def dealt(rows: DataFrame, ranges: DataFrame, plan: DataFrame, slot: Callable[[Column], Column], few: bool, most_copies: int | None) -> DataFrame:
    """row, and in `mix`: source, block, copy and slot. A row for each time that a document is placed.

    plan: plan (a struct with source, blocks, placed and what slot() reads). few: the ranges with their plans, which are as many
    as partitions and sources, are bounded by MAX_SOURCES sources, so they are broadcast."""
    known = ranges.select(F.col("source").alias("s"), F.col("part").alias("p"), "first", "before").join(plan, F.col("s") == F.col("plan.source"))
    placed = rows.join(F.broadcast(known) if few else known, (F.col("part") == F.col("p")) & (F.col("source") == F.col("s")))
    placed = placed.select("row", F.floor((F.col("at") - F.col("first") + F.col("before")) / BLOCK_DOCS).alias("block"), "plan.*")
    copies = F.floor((F.col("placed") - 1 - F.col("block")) / F.col("blocks"))
    if most_copies is not None:
        copies = F.least(copies, F.lit(most_copies - 1).cast("long"))
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies)))
    at = slot(F.col("block") + F.col("copy") * F.col("blocks"))
    return placed.select("row", F.struct("source", "block", "copy", at.alias("slot")).alias("mix"))


def rows_mixed(docs: DataFrame, weights: dict[str, float] | None, id_col: str, source_col: str, most_copies: int | None = None, groups: bool = True) -> DataFrame:
    rows, ranges = numbered(docs, id_col, source_col)
    sizes = common.written(ranges.groupBy("source").agg(F.sum("n").alias("n")))
    if sizes.count() <= MAX_SOURCES or not groups:
        plan = schedule(sizes, weights).select(F.struct("source", "blocks", "parts", "slots", "placed").alias("plan"))
        return dealt(rows, ranges, plan, slot_of, True, most_copies)
    plan = common.written(schedule_in_groups(sizes, weights).select(F.struct("source", "blocks", "levels", "placed").alias("plan")))
    return dealt(rows, ranges, plan, slot_through, False, most_copies)


def with_mix(mixed_rows: DataFrame, docs: DataFrame) -> DataFrame:
    return mixed_rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != "mix"), "mix")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", most_copies: int | None = None) -> DataFrame:
    """docs with `mix`, by one schedule; refuses more than MAX_SOURCES sources."""
    return with_mix(rows_mixed(docs, weights, id_col, source_col, most_copies, groups=False), docs)


def mixed_any(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", most_copies: int | None = None) -> DataFrame:
    """mixed(), and for more sources than it takes, by schedules in groups."""
    return with_mix(rows_mixed(docs, weights, id_col, source_col, most_copies), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_any(common.table(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", "mix.source", "mix.block", "mix.copy", "mix.slot")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix places it."""
    return rows_mixed(docs, None, "doc_id", "source").select("row.*")


#: For `documents` as a table or CTE of that name with doc_id and source.
MIX_SQL = f"""
sizes AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1),
numbered AS (SELECT *, row_number() OVER (ORDER BY source) AS i, count(*) OVER () AS m, pow(n, {TEMPER}) AS w FROM sizes),
quotas AS (SELECT *, ({PERIOD} - m) * w / sum(w) OVER () AS quota FROM numbered),
ranked AS (
  SELECT *, floor(quota) + 1 AS whole, row_number() OVER (ORDER BY round(quota - floor(quota), 9) DESC, i) AS by_rest,
    {PERIOD} - sum(floor(quota) + 1) OVER () AS left_over FROM quotas
),
parted AS (SELECT source, n, i, CAST(whole + CASE WHEN by_rest <= left_over THEN 1 ELSE 0 END AS BIGINT) AS parts FROM ranked),
lists AS (SELECT list(parts ORDER BY i) AS c FROM parted),
edf AS (
  SELECT -1 AS t, CAST(0 AS BIGINT) AS pick, list_transform(c, lambda x: CAST(0 AS BIGINT)) AS nxt, c FROM lists WHERE len(c) > 0
  UNION ALL
  SELECT t, pick, list_transform(range(1, len(c) + 1), lambda i: nxt[i] + CASE WHEN i = pick THEN 1 ELSE 0 END), c FROM (
    SELECT t + 1 AS t, nxt, c, list_min(list_filter(list_transform(range(1, len(c) + 1), lambda i:
      CASE WHEN (nxt[i] * {PERIOD}) // c[i] <= t + 1 THEN ((nxt[i] + 1) * {PERIOD} + c[i] - 1) // c[i] * 1048576 + i END), lambda x: x IS NOT NULL)) % 1048576 AS pick
    FROM edf WHERE t + 1 < {PERIOD}
  )
),
slots AS (SELECT pick AS i, list(t ORDER BY t) AS slots FROM edf WHERE t >= 0 GROUP BY pick),
planned AS (SELECT *, (n + {BLOCK_DOCS - 1}) // {BLOCK_DOCS} AS blocks FROM parted JOIN slots USING (i)),
ended AS (SELECT *, max((blocks - 1) // parts * {PERIOD} + slots[(blocks - 1) % parts + 1] + 1) OVER () AS mix_end FROM planned),
placed AS (SELECT *, mix_end // {PERIOD} * parts + len(list_filter(slots, lambda t: t < mix_end % {PERIOD})) AS placed FROM ended),
dealt AS (
  SELECT d.*, p.source AS mix_source, p.blocks, p.parts, p.slots, p.placed,
    (row_number() OVER (PARTITION BY p.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id) - 1) // {BLOCK_DOCS} AS block
  FROM documents d JOIN placed p ON coalesce(d.source, '') = p.source
),
mix AS (SELECT *, unnest(range(0, (placed - 1 - block) // blocks + 1)) AS copy FROM dealt)
"""

SQL = f"""WITH RECURSIVE {MIX_SQL}
SELECT doc_id, mix_source AS source, block, copy,
  (block + copy * blocks) // parts * {PERIOD} + slots[(block + copy * blocks) % parts + 1] AS slot FROM mix
"""
