"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is dealt into blocks of about equal size by a keyed hash of the document id,
so the blocks in index order are a random permutation of it. A source's target fixes how
many whole passes over its blocks the mix takes and how many words of one more pass; its
quota is the exact number of blocks, counting each pass. The quotas of all sources are
split among the output shards by a binary tree: at each node the left half gets a
multivariate-hypergeometric draw of the node's quotas, exactly as large as its share,
and the right half gets the rest. A shard then owns a run of each source's permuted
blocks, disjoint from all other shards', and its rows are shuffled locally.

Only DataFrame functions are used. Grouping is by source and block; what is joined back
to the documents is one row for each source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.session import durable

#: Words in a block, about.
BLOCK_WORDS = 65_536
#: Blocks whose running sums are taken together.
SUPER_BLOCKS = 1024
#: A document is taken so many times at most.
MAX_REPEATS = 3
#: Bytes of per-source rows up to which they are sent to every task; more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: Output shards: two to this power.
TREE_DEPTH = 5
#: Sources that may count as hot where there are too many for all to be sent.
HOT_SOURCES = 500
SEED = 20_231
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(*keys: Column) -> Column:
    """A number in (0, 1) fixed by the keys."""
    return (F.pmod(F.xxhash64(F.lit(SEED), *keys), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, weight, target, n_rows`` from ``source, size`` rows.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share the sum of
    all sizes. A target stops at ``MAX_REPEATS`` times its source's size; what is over is
    reshared by weight until none is above. In closed form: with the sources ordered by
    the size at which they stop for their weight, a prefix stops and the rest share what
    the prefix leaves.
    """
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    weighed = totals.withColumn("weight", ((F.row_number().over(ordered) - 1) % 3 + 1).cast("double")).withColumn("cap", (F.col("source_size") * MAX_REPEATS).cast("double"))
    everything = Window.partitionBy(F.lit(0))
    by_cap = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    share = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    shared = weighed.withColumn("share", share).withColumn("free", F.col("share") * F.col("weight") < F.col("cap"))
    # The first source that is free sets the share of all after it; sources before it stop.
    settled = shared.withColumn("level", F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("share").alias("share")))).over(everything))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level.share") * F.col("weight")))
    return settled.select("source", "source_size", "weight", target.alias("target"), "n_rows")


def _row_bytes(per_source: DataFrame) -> Column:
    lists = [F.coalesce(F.size(F.col(f)) * 8, F.lit(0)) for f in ("__plan.loose", "__plan.starts") if "__plan" in per_source.columns]
    return sum(lists, F.lit(256))


def _with_source(left: DataFrame, per_source: DataFrame, source: str, key: str) -> DataFrame:
    """``left`` joined on ``source`` with a durable table that has a row and a count ``n_rows`` for each source (``key``).

    A table that is measured to be small is sent to every task. Of a larger one the
    sources with most rows are, of which there can't be many; a shuffle deals only the
    others, so that a hot source stays spread however many sources there are.
    """
    same = F.col(source).eqNullSafe(F.col(key))
    rows = per_source.drop("n_rows")
    if (per_source.agg(F.sum(_row_bytes(per_source))).first()[0] or 0) <= BROADCAST_BYTES:
        return left.join(F.broadcast(rows), same)
    total = per_source.agg(F.sum("n_rows")).first()[0] or 0
    is_hot = (F.col("n_rows") >= max(1, -(-total // HOT_SOURCES))) & (_row_bytes(per_source) <= 8 * BROADCAST_BYTES // HOT_SOURCES)
    hot, rest = F.broadcast(per_source.where(is_hot).drop("n_rows")), per_source.where(~is_hot).drop("n_rows")
    return left.join(hot, same).unionByName(left.join(hot.select(key), same, "left_anti").join(rest, same))


def _quotas(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """A row for each source: passes, blocks, where the last pass ends, and its loose documents.

    Of the last pass, blocks before ``whole`` are taken. Documents of the next blocks fill
    up the remainder: a run in hashed order, then smaller ones that still fit, and one that
    goes beyond if that ends nearer.
    """
    plan = goals.withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.lit(MAX_REPEATS), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int"))
    plan = plan.withColumn("rest", F.when(F.col("passes") < MAX_REPEATS, F.col("target") - F.col("passes") * F.col("source_size")).otherwise(0.0))
    plan = plan.withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("source_size") / BLOCK_WORDS)).cast("long"))
    plan = durable(plan)
    dealt = _deal(rows, plan.select(F.col("source").alias("__s"), "blocks", "n_rows"))
    sums = durable(dealt.groupBy("source", "block").agg(F.sum("size").alias("words")))
    supers = sums.groupBy("source", F.floor(F.col("block") / SUPER_BLOCKS).alias("super")).agg(F.sum("words").alias("in_super"))
    upto = supers.withColumn("base", F.sum("in_super").over(Window.partitionBy("source").orderBy("super")) - F.col("in_super"))
    within = Window.partitionBy("source", "super").orderBy("block")
    running = (
        sums.withColumn("super", F.floor(F.col("block") / SUPER_BLOCKS)).withColumn("upto", F.sum("words").over(within))
        .join(upto.select(F.col("source").alias("__s"), F.col("super").alias("__p"), "base"), F.col("source").eqNullSafe(F.col("__s")) & (F.col("super") == F.col("__p")))
        .select("source", "block", "words", (F.col("base") + F.col("upto")).alias("upto"))
    )
    goal = plan.select(F.col("source").alias("__s"), "rest")
    # The last block that fits is loosened too, so that there are documents to choose from.
    fits = running.join(goal, F.col("source").eqNullSafe(F.col("__s"))).where(F.col("upto") <= F.col("rest"))
    last = fits.groupBy("source").agg(F.max("block").alias("last"))
    plan = plan.join(last.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s").withColumn("whole", F.greatest(F.lit(0), F.coalesce(F.col("last"), F.lit(-1))).cast("long"))
    taken = running.join(plan.select(F.col("source").alias("__s"), "whole"), F.col("source").eqNullSafe(F.col("__s"))).where(F.col("block") < F.col("whole")).groupBy("source").agg(F.sum("words").alias("sure"))
    plan = plan.join(taken.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s", "last").withColumn("gap", F.col("rest") - F.coalesce(F.col("sure"), F.lit(0)))
    return durable(_loose(dealt, durable(plan)))


def _deal(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """``rows`` with the block of each document among its source's ``blocks``."""
    return _with_source(rows, blocks, "source", "__s").withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id")), F.col("blocks"))).drop("__s", "blocks")


def _loose(dealt: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with the ids of the documents of loose blocks that the last pass takes."""
    pool = _with_source(dealt, plan.select(F.col("source").alias("__s"), "whole", "gap", "n_rows"), "source", "__s").where(
        (F.col("gap") > 0) & (F.col("block") >= F.col("whole")) & (F.col("block") < F.col("whole") + 4) & F.col("doc_id").isNotNull()
    )
    docs = pool.groupBy("source", "block", "doc_id").agg(F.sum("size").alias("size"), F.max("gap").alias("gap")).where("size > 0")
    order = Window.partitionBy("source").orderBy("block", F.xxhash64(F.lit(SEED + 1), "doc_id"), "doc_id")
    upto = docs.withColumn("upto", F.sum("size").over(order)).withColumn("fits", F.col("upto") <= F.col("gap"))
    run = upto.groupBy("source").agg(
        F.collect_list(F.when(F.col("fits"), F.col("doc_id"))).alias("run"),
        (F.max("gap") - F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))), F.lit(0))).alias("left"),
        F.collect_list(F.when(~F.col("fits"), F.struct((-F.col("size")).alias("minus"), F.col("doc_id").alias("id")))).alias("others"),
    )
    empty = F.struct(F.col("left").alias("left"), F.array().cast("array<bigint>").alias("ids"))

    def fill(state: Column, doc: Column) -> Column:
        fits = -doc["minus"] <= state["left"]
        return F.struct(
            F.when(fits, state["left"] + doc["minus"]).otherwise(state["left"]).alias("left"),
            F.when(fits, F.concat(state["ids"], F.array(doc["id"]))).otherwise(state["ids"]).alias("ids"),
        )

    able = F.array_sort(F.filter("others", lambda d: -d["minus"] <= F.col("left")))
    filled = run.select("source", "run", "others", F.explode(F.array(F.aggregate(able, empty, fill))).alias("filled"))
    # One more document if it ends nearer to the goal, though beyond it.
    beyond = F.array_min(
        F.transform(
            F.filter("others", lambda d: ~F.array_contains(F.col("filled.ids"), d["id"])), lambda d: F.struct(F.abs(F.col("filled.left") + d["minus"]).alias("off"), d["id"].alias("id"))
        )
    )
    nearer = filled.select("source", "run", "filled", F.explode(F.array(beyond)).alias("beyond"))
    more = F.when(F.col("beyond.off") < F.col("filled.left"), F.array("beyond.id")).otherwise(F.array().cast("array<bigint>"))
    chosen = nearer.select(F.col("source").alias("__s"), F.concat("run", "filled.ids", more).alias("loose"))
    joined = plan.join(chosen, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    nothing = F.array().cast("array<bigint>")
    partial = F.when(F.size(F.coalesce("loose", nothing)) > 0, F.least(F.col("blocks"), F.col("whole") + 4)).otherwise(F.col("whole"))
    return joined.withColumn("loose", F.coalesce("loose", nothing)).withColumn("quota", F.when(F.col("source_size") > 0, F.col("passes") * F.col("blocks") + partial).otherwise(0).cast("long"))


def _hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` from ``total`` units are among its ``good`` ones, by inversion.

    Weights relative to the mode follow from the ratio of neighbouring terms; they are
    summed over twelve standard deviations, beyond which nothing shows in a double.
    """
    bad = total - good
    low, high = F.greatest(F.lit(0).cast("long"), draws - bad), F.least(good, draws)
    mode = F.least(high, F.greatest(low, F.floor((draws + 1).cast("double") * (good + 1).cast("double") / (total + 2).cast("double"))))
    share = good.cast("double") / F.greatest(total, F.lit(1))
    width = F.ceil(12 * F.sqrt(draws * share * (1 - share)) + 12).cast("long")
    first, last = F.greatest(low, mode - width), F.least(high, mode + width)

    def ratio(k: Column) -> Column:
        """The weight of k + 1 over that of k."""
        return (good - k).cast("double") * (draws - k).cast("double") / ((k + 1).cast("double") * (bad - draws + k + 1).cast("double"))

    def term(at: Column) -> Column:
        return F.struct(at.cast("long").alias("k"), F.lit(1.0).alias("w"))

    start = F.array(term(mode))
    above = F.when(last > mode, F.sequence(mode + 1, last)).otherwise(F.array().cast("array<bigint>"))
    below = F.when(first < mode, F.sequence(mode - 1, first)).otherwise(F.array().cast("array<bigint>"))

    def up(terms: Column, k: Column) -> Column:
        return F.concat(terms, F.array(F.struct(k.alias("k"), (F.element_at(terms, -1)["w"] * ratio(k - 1)).alias("w"))))

    def down(terms: Column, k: Column) -> Column:
        return F.concat(terms, F.array(F.struct(k.alias("k"), (F.element_at(terms, -1)["w"] / ratio(k)).alias("w"))))

    terms = F.concat(F.aggregate(above, start, up), F.slice(F.aggregate(below, start, down), 2, 1 << 30))
    whole = F.aggregate(terms, F.lit(0.0), lambda s, t: s + t["w"])

    def walk(state: Column, t: Column) -> Column:
        left = state["left"] - t["w"]
        return F.struct(F.when(state["left"] > 0, t["k"]).otherwise(state["k"]).alias("k"), left.alias("left"))

    return F.aggregate(terms, F.struct(mode.cast("long").alias("k"), (u * whole).alias("left")), walk, lambda s: s["k"])


def _draw(level: int) -> Callable[[Column, Column], Column]:
    """A step over the sources of a node: the left child's share of the next source."""

    def draw(state: Column, x: Column) -> Column:
        got = _hypergeometric(x["q"], state["total"], state["draws"], _uniform(F.lit(level), F.col("node"), x["last"], x["name"]))
        return F.struct(
            (state["total"] - x["q"]).alias("total"),
            (state["draws"] - got).alias("draws"),
            F.concat(state["left"], F.array(F.struct(x["last"].alias("last"), x["name"].alias("name"), got.alias("q")))).alias("left"),
        )

    return draw


def split_quotas(plan: DataFrame, depth: int = TREE_DEPTH) -> DataFrame:
    """``source, starts``: where each of the two-to-the-``depth`` shards' runs of a source begin.

    A node of the tree is one row with the quotas of all sources (a list as long as there
    are sources). Its left child's quotas are drawn source by source, each from what the
    sources before it have left, which is the multivariate-hypergeometric law.
    """
    entry = F.struct(F.col("source").isNull().alias("last"), F.coalesce("source", F.lit("")).alias("name"), F.col("quota").alias("q"))
    nodes = plan.agg(F.array_sort(F.collect_list(entry)).alias("quotas")).select(F.lit(0).cast("long").alias("node"), "quotas")
    for level in range(depth):
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda s, x: s + x["q"])
        first = F.struct(total.alias("total"), F.floor((total + F.col("node") % 2) / 2).alias("draws"), F.array().cast("array<struct<last:boolean,name:string,q:bigint>>").alias("left"))

        drawn = nodes.select("node", "quotas", F.explode(F.array(F.aggregate("quotas", first, _draw(level), lambda s: s["left"]))).alias("left"))
        rest = F.zip_with("quotas", "left", lambda a, b: F.struct(a["last"].alias("last"), a["name"].alias("name"), (a["q"] - b["q"]).alias("q")))
        children = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), rest.alias("quotas")))
        nodes = drawn.select(F.explode(children).alias("c")).select("c.node", "c.quotas")
    shares = nodes.select("node", F.explode("quotas").alias("x")).select("node", "x.last", "x.name", "x.q")
    runs = shares.groupBy("last", "name").agg(F.array_sort(F.collect_list(F.struct("node", "q"))).alias("runs"))
    nothing = F.array(F.lit(0).cast("long"))
    starts = F.aggregate("runs", nothing, lambda s, r: F.concat(s, F.array(F.element_at(s, -1) + r["q"])))
    return runs.select(F.when(~F.col("last"), F.col("name")).alias("source"), F.slice(starts, 1, 1 << depth).alias("starts"))


def _plan(rows: DataFrame, depth: int) -> DataFrame:
    """One row ``__source, n_rows, __plan`` for each source: all that places its documents."""
    plan = _quotas(rows, durable(targets(rows)))
    starts = split_quotas(plan, depth).withColumnRenamed("source", "__t")
    joined = plan.join(starts, F.col("source").eqNullSafe(F.col("__t")))
    fields = ("source_size", "target", "passes", "blocks", "whole", "loose", "starts")
    return durable(joined.select(F.col("source").alias("__source"), "n_rows", F.struct(*fields).alias("__plan")))


def _places(doc_id: Column, plan: Column) -> Column:
    """A document's places: an array of ``pass, shard, at``."""
    block = F.pmod(F.xxhash64(F.lit(SEED), doc_id), plan["blocks"])
    extra = (block < plan["whole"]) | ((block < plan["whole"] + 4) & F.coalesce(F.array_contains(plan["loose"], doc_id), F.lit(False)))
    times = F.when(plan["source_size"] > 0, plan["passes"] + F.when(extra, 1).otherwise(0)).otherwise(0)

    def place(k: Column) -> Column:
        unit = k * plan["blocks"] + block
        shard = F.size(F.filter(plan["starts"], lambda s: s <= unit)) - 1
        return F.struct(k.cast("int").alias("pass"), shard.cast("int").alias("shard"), F.xxhash64(F.lit(SEED + 2), doc_id, k).alias("at"))

    return F.when(times > 0, F.transform(F.sequence(F.lit(0), times - 1), place)).otherwise(F.array().cast("array<struct<pass:int,shard:int,at:bigint>>"))


def _measured(docs: DataFrame) -> DataFrame:
    return durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")))


def mix(docs: DataFrame, depth: int = TREE_DEPTH) -> DataFrame:
    """One row for each row of ``docs`` with the places that it has in the mix.

    Columns: ``doc_id, source, size, source_size, target`` and ``places``, an array of
    ``pass, shard, at`` where ``at`` orders a shard's rows at random. A row without words
    (null or empty text) has size 0 and goes along with its block; a null source is the
    last source; repeated rows share their block and count each; a null doc_id is placed
    like any other but is never used to fill up a remainder; an empty table gives no
    rows. Only doc_id, source and text are read.
    """
    rows = _measured(docs)
    joined = _with_source(rows, _plan(rows, depth), "source", "__source")
    places = _places(F.col("doc_id"), F.col("__plan"))
    return joined.select("doc_id", "source", "size", F.col("__plan.source_size").alias("source_size"), F.col("__plan.target").alias("target"), places.alias("places"))


def mixed_documents(docs: DataFrame, depth: int = TREE_DEPTH) -> DataFrame:
    """The mix itself: a row of ``docs`` for each of its places, with ``mix_shard`` and ``mix_pass``.

    A shard's rows are in its own partitions, shuffled locally; a partition may hold
    several shards, in runs. What is null, empty or repeated is as in ``mix``; a document
    that the mix takes no time has no row. Any column may be there already, but for one
    named ``mix_shard`` or ``mix_pass``, which is replaced.
    """
    own = [c for c in docs.columns if c.lower() not in ("mix_shard", "mix_pass")]
    plan = _plan(_measured(docs), depth)
    # A row travels as one column, so that its names meet no others.
    rows = docs.select(F.struct(*own).alias("row"), F.col("source").cast("string").alias("source"))
    placed = _with_source(rows, plan, "source", "__source").select("row", F.explode(_places(F.col("row.doc_id").cast("long"), F.col("__plan"))).alias("place"))
    dealt = placed.repartition(F.col("place.shard"), F.pmod("place.at", F.lit(16))).sortWithinPartitions("place.shard", "place.at")
    return dealt.select("row.*", F.col("place.shard").alias("mix_shard"), F.col("place.pass").alias("mix_pass"))
