"""Mixing sources to target weights on a low-discrepancy schedule.

Sources are taken in code-point order (null last) and weighted; their targets
share all words by weight, and what a target has beyond three times its source
is shared again by weight until none is above. The schedule is a sequence of
slots of one block of words each: slot k maps the golden-ratio point
``k * phi mod 1`` through the cumulative targets to a source, so every stretch of
the schedule holds the sources in nearly their target shares. Slots are ranked
within their source. Each source's documents, in a seeded shuffle, form a stream
of words that is repeated up to three times; slot number r of a source holds the
words [r * block, (r + 1) * block) of its stream. So the schedule decides how many
words a source gives (a few blocks around its target, and never more than three
times its size), where each document stands in the mix, and in which order.

A block has ``BLOCK`` words, or fewer where that would make fewer than ``SLOTS``
slots, so the rounding to whole blocks stays small at every size. A source whose
share is too small to be hit gets one slot, at the end, with its target's words.

Texts without words, null ones included, are never taken. Repeated rows are
documents of their own. Rows without doc_id are shuffled by their text. Very long
texts span many slots. An empty table gives an empty result. Columns of the
documents may have any names: they travel in a struct. There is one row a source
in the plan, which windows in one task order; sources are named corpora, not urls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import beside, boxed, running_total, shuffle_key, table, words, written

WEIGHTS = (1, 2, 3)
MOST_TIMES = 3
#: Words of a block at most, slots that shorter blocks make room for, and the seed of the shuffle.
BLOCK, SLOTS, SEED = 2048, 1 << 18, 17
#: Points lie on [0, 2**31); GOLDEN is 2**31 over the golden ratio, made odd.
BITS, GOLDEN, CELL_BITS = 31, 1327217885, 12


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, a hash of the text, and the shuffle key with its slice."""
    key = shuffle_key(SEED)
    df = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("text_hash"), key.alias("key"))
    return df.withColumn("slice", F.substring("key", 1, 3))


def targets(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """One row a source: src (its place), source, source_size, target (double), goal (target as whole words).

    A source is full if its share of what the fuller ones leave exceeds three
    times its size. Sources are sorted by that multiple over their weight, so
    the full ones come first. The table has one row a source, so ordering it
    in one task is cheap.
    """
    places = Window.orderBy(F.col("source").isNull(), "source")
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), (F.pmod(F.col("src"), F.lit(len(weights))) + 1).cast("int"))
    df = by.withColumn("src", (F.row_number().over(places) - 1).cast("int")).withColumn("weight", w.cast("long"))
    order = Window.orderBy(F.col("source_size").cast("double") / F.col("weight"), "src")
    all_, before, rest = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(all_)
    left = total - MOST_TIMES * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    df = df.withColumn("_left", left).withColumn("_rest", F.sum("weight").over(rest))
    df = df.withColumn("_full", F.col("_left") * F.col("weight") >= MOST_TIMES * F.col("source_size") * F.col("_rest"))
    # The first source that isn't full fixes the level for itself and all after it.
    level = F.first(F.when(~F.col("_full"), F.struct("_left", "_rest")), ignorenulls=True).over(all_)
    target = F.when(F.col("_full"), (MOST_TIMES * F.col("source_size")).cast("double")).otherwise(level["_left"].cast("double") / level["_rest"] * F.col("weight"))
    df = df.withColumn("target", target)
    return df.select("src", "source", "source_size", "target", F.rint("target").cast("long").alias("goal"))


def schedule(spark: SparkSession, goals: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, int]:
    """``goals`` with n_slots and length (the words its stream gives), the slots (k, src, rank), and the words of a block. ``goals`` has one row a source."""
    total = goals.agg(F.sum("goal")).first()[0] or 0
    block = max(1, min(block, total // SLOTS))
    n = -(-total // block)
    upto = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    edge = F.floor(F.sum("goal").over(upto).cast("double") / F.lit(float(max(total, 1))) * F.lit(float(2**BITS))).cast("long")
    spans = goals.where("goal > 0").withColumn("hi", edge).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("src")), F.lit(0)))
    cells = F.sequence(F.shiftright("lo", BITS - CELL_BITS), F.shiftright(F.col("hi") - 1, BITS - CELL_BITS))
    spans = spans.where("hi > lo").select("src", "lo", "hi", F.explode(cells).alias("cell"))
    point = F.pmod(F.pmod(F.col("k"), F.lit(2**BITS)) * GOLDEN, F.lit(2**BITS))
    slots = spark.range(n).withColumnRenamed("id", "k").withColumn("u", point).withColumn("cell", F.shiftright("u", BITS - CELL_BITS))
    slots = beside(slots, spans, "cell", "inner").where("u >= lo and u < hi").select("k", "src")
    slots = slots.withColumn("part", F.expr(f"k div {max(1, -(-n // 1024))}"))
    slots = written(running_total(slots, ["src"], "part", ["k"], F.lit(1), "rank").select("k", "src", "rank"), "mix-slots")
    counts = slots.groupBy("src").agg(F.count(F.lit(1)).alias("hits"))
    length = F.when(F.col("hits").isNull(), F.col("goal")).otherwise(F.least(F.col("hits") * block, MOST_TIMES * F.col("source_size")))
    plan = goals.join(counts, "src", "left").select("src", "source", "source_size", "target", F.coalesce("hits", F.lit(0)).alias("hits"), length.alias("length"))
    plan = written(plan, "mix-plan")
    extra = plan.where("hits = 0 and length > 0").select(F.lit(n).alias("k"), "src", F.lit(0).cast("long").alias("rank"))
    return plan, slots.unionByName(extra), block


def mixed(docs: DataFrame, block: int = BLOCK, weights=WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """The placed documents, and the pieces of them that slots take.

    Placed: doc_id, source, size, text_hash, source_size, target, src, start (place of the
    document in its source's stream). Pieces: src, start, epoch, k, word_from, word_to.
    """
    spark = docs.sparkSession
    sizes = written(sized(docs), "mix-sizes")
    goals = written(targets(sizes, weights), "mix-targets")
    plan, slots, block = schedule(spark, goals, block)
    known = beside(sizes.withColumnRenamed("source", "_s"), plan, F.col("_s").eqNullSafe(F.col("source")), "inner").drop("_s")
    placed = written(running_total(known, ["src"], "slice", ["key", "doc_id", "size"], F.col("size"), "start").drop("key", "slice"), "mix-placed")
    epochs = placed.where("size > 0 and length > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(MOST_TIMES - 1))))
    epochs = epochs.withColumn("a", F.col("epoch") * F.col("source_size") + F.col("start")).where("a < length").withColumn("b", F.least(F.col("a") + F.col("size"), F.col("length")))
    # A source without a hit has one slot, whatever its length.
    rank = lambda x: F.when(F.col("hits") == 0, F.lit(0).cast("long")).otherwise(F.expr(f"{x} div {block}"))
    ranks = epochs.withColumn("rank", F.explode(F.sequence(rank("a"), rank("(b - 1)"))))
    pieces = ranks.join(slots, ["src", "rank"])
    whole = F.col("hits") == 0
    lo = F.when(whole, F.col("a")).otherwise(F.greatest(F.col("a"), F.col("rank") * block))
    hi = F.when(whole, F.col("b")).otherwise(F.least(F.col("b"), (F.col("rank") + 1) * block))
    return placed, pieces.select("src", "start", "epoch", "k", (lo - F.col("a")).alias("word_from"), (hi - F.col("a")).alias("word_to"))


def _with_pieces(placed: DataFrame, got: DataFrame, how: str) -> DataFrame:
    """``got`` is keyed by src and start, which only one document with words has."""
    got = got.withColumnsRenamed({"src": "_src", "start": "_start"})
    return placed.join(got, (F.col("src") == F.col("_src")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0), how).drop("_src", "_start")


def taken(docs: DataFrame, block: int = BLOCK, weights=WEIGHTS) -> DataFrame:
    """doc_id, source, size, text_hash, source_size, target, taken and first_slot (the first slot with a word of it, or null) of every document."""
    placed, pieces = mixed(docs, block, weights)
    got = pieces.groupBy("src", "start").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"), F.min("k").alias("first_slot"))
    return _with_pieces(placed, got, "left").select("doc_id", "source", "size", "text_hash", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def resampled(docs: DataFrame, block: int = BLOCK, weights=WEIGHTS) -> DataFrame:
    """``docs`` in the order of the schedule, each document where slots take at least half of its words, so up to three times.

    Partitions are ranges of the schedule and sorted by it, so written files hold the mix in order.
    """
    placed, pieces = mixed(docs, block, weights)
    each = pieces.groupBy("src", "start", "epoch").agg(F.min("k").alias("k"), F.sum(F.col("word_to") - F.col("word_from")).alias("got"))
    places = F.sort_array(F.collect_list(F.struct("k", "epoch", "start")))  # three at most
    got = _with_pieces(placed, each, "inner").where("2 * got >= size").groupBy("src", "start", "doc_id", "source", "text_hash").agg(places.alias("_places"))
    key = ["_d", "_s", "_t"]
    got = written(got.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("text_hash").alias("_t"), F.col("start").alias("_start"), "_places"), "mix-places")
    own = boxed(docs, F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.xxhash64("text").alias("_t"))
    # Documents and places are numbered, and equal numbers brought together, in one shuffle of the texts; a join would take two.
    every = own.unionByName(got, allowMissingColumns=True).repartition(*key).withColumn("_own", F.col("_start").isNull())
    every = every.withColumn("_i", F.row_number().over(Window.partitionBy(*key, "_own").orderBy("_start")))
    every = every.withColumn("_places", F.max("_places").over(Window.partitionBy(*key, "_i")))
    met = every.where("_own and _places is not null").select("_row", F.explode("_places").alias("_p"))
    return met.repartitionByRange("_p").sortWithinPartitions("_p").select("_row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


SQL = r"""
with recursive d as (select doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint size,
 md5('{seed}:' || coalesce(doc_id::varchar, md5(coalesce(text, '')))) key from documents),
s as (select source, sum(size)::bigint source_size, row_number() over (order by source is null, source) - 1 src from d group by source),
sw as (select *, 1 + src % 3 w from s),
lv as (select 0 step, 0::double full_size, (select sum(source_size)::double from sw) / (select sum(w) from sw) level
 union all select step + 1, f.a, ((select sum(source_size)::double from sw) - f.a) / nullif(f.b, 0) from lv,
 lateral (select coalesce(sum(3 * source_size) filter (3 * source_size <= level * w), 0)::double a, coalesce(sum(w) filter (3 * source_size > level * w), 0) b from sw) f
 where step < 1000 and f.a > lv.full_size),
last as (select level from lv order by step desc limit 1),
t as (select src, source, source_size, case when level is null then (3 * source_size)::double else least((3 * source_size)::double, level * w) end target from sw, last),
g as (select *, round_even(target, 0)::bigint goal from t),
c as (select total, greatest(1, least({block}, total // {slots}))::bigint block from (select sum(goal)::bigint total from g)),
n as (select total, block, (total + block - 1) // block n from c),
e as (select src, floor(sum(goal) over (order by src)::double / greatest(total, 1)::double * {points}::double)::bigint hi, goal from g, n where goal > 0),
sp as (select src, coalesce(lag(hi) over (order by src), 0) lo, hi from e),
sl as (select k, src, row_number() over (partition by src order by k) - 1 rank from (select k, (k % {points}) * {golden} % {points} u from n, unnest(range(n.n)) r(k)) join sp on u >= lo and u < hi),
h as (select g.*, hits, case when hits is null then goal else least(hits * block, 3 * source_size) end length from g left join (select src, count(*) hits from sl group by src) using (src), n),
p as (select d.doc_id, d.size, h.*, coalesce(sum(d.size) over (partition by d.source order by key, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint start
 from d join h on d.source is not distinct from h.source),
q as (select p.*, (length // greatest(source_size, 1) * size + greatest(0, least(size, length % greatest(source_size, 1) - start)))::bigint taken, block, n.n from p, n)
select doc_id, size, source_size, target, taken, case when taken > 0 then case when hits is null then q.n else k end end first_slot
from q left join sl on sl.src = q.src and sl.rank = q.start // block
""".replace("{seed}", str(SEED)).replace("{block}", str(BLOCK)).replace("{slots}", str(SLOTS)).replace("{points}", str(2**BITS)).replace("{golden}", str(GOLDEN))
