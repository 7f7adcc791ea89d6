"""Mixing of sources to target weights, by DataFrame functions alone.

Each source's words are packed into blocks of fixed length. Every output shard draws how many blocks it takes of each source
from a multinomial distribution by the sources' targets, and gets the next range of each source's slots; draws beyond a source's
slots go to sources that were drawn too rarely, so that every source gets exactly its slots. A source's n-th slot takes the
block that the source's own permutation of indexes gives for n; a further permutation begins when all blocks are used. Slots
join blocks by index.

Defined cases: null text has no words; a document without words is taken 0 times; a null source is a source of its own, the
last; rows that share a doc_id, and rows alike in every column, are documents of their own; rows with a null doc_id are kept; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, written

#: Words in a block of a large source, and the number of blocks that smaller sources are cut into.
BLOCK, LEAST_BLOCKS = 1024, 1024
#: Slots of one output shard.
SHARD = 4096
#: Documents in one bucket of a source, about.
BUCKET_DOCS = 20_000
#: Slots whose owners are kept together, so at most as many sources.
OWNED = 256
#: Slots that one task makes.
SLOTS_A_TASK = 1 << 14
ROUNDS = 10
#: How many times a word may be taken.
MOST = 3


def permuted(x: Column, n: Column, *key: Column | str) -> Column:
    """A pseudo-random permutation of 0 ... n-1 at x: swap-or-not rounds, a bijection for any n."""
    def step(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit("partner"), r, *key), n) - at, n)
        return F.when(F.xxhash64(F.lit("swap"), r, F.greatest(at, partner), *key).bitwiseAND(1) == 1, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), step)


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target over (source, source_size): weights 1, 2, 3 repeating in code point order, null last.

    A target is MOST times the source's size or its weight times one level common to the others; sources by the level at which
    they are full, running sums give the level for each number of full ones, and the first that fits holds.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weighed = sizes.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1)
    by = Window.orderBy("full_at", F.col("source").isNull(), "source")
    everything = Window.partitionBy(F.lit(1))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    filled = weighed.withColumn("full_at", MOST * F.col("source_size") / F.col("weight"))
    filled = filled.withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    filled = filled.withColumn("level", (F.col("total") - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    # the first that fits has the highest level of those that fit, whichever sources are full at one level
    level = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything)
    return filled.select("source", "source_size", F.least(F.col("weight") * F.coalesce(level, F.lit(0.0)), (MOST * F.col("source_size")).cast("double")).alias("target"))


class Mix:
    """The mix of `docs`: its documents' places in their sources, its shards' draws and slots, and how often each block is taken."""

    def __init__(self, docs: DataFrame, seed: int = 1, block: int = BLOCK, shard: int = SHARD, bucket_docs: int = BUCKET_DOCS) -> None:
        self.seed, self.shard = seed, shard
        size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
        rows = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), _key().alias("key")), "sizes")
        buckets = rows.count() // bucket_docs + 1
        placed = rows.withColumn("bucket", F.pmod(F.xxhash64("key", F.lit("bucket")), F.lit(buckets)))
        groups = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        sources = targets(groups.groupBy("source").agg(F.sum("words").alias("source_size")))
        width = F.least(F.lit(block), F.greatest(F.lit(1), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("long")
        within = Window.partitionBy("source").orderBy("bucket")
        groups = _with_source(groups, sources.withColumn("width", width)).withColumn("blocks", F.ceil(F.col("words") / F.col("width")))
        groups = written(groups.withColumn("first", F.sum("blocks").over(within) - F.col("blocks")), "groups")
        local = Window.partitionBy("source", "bucket").orderBy("key", "doc_id")
        placed = placed.withColumn("start", F.sum("size").over(local.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        g = groups.toDF(*(f"g_{c}" for c in groups.columns))
        #: first and start tell where in the blocks of its source a document begins.
        self.docs = placed.join(g, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("bucket") == F.col("g_bucket"))).select(
            "doc_id", "source", "key", "size", "start", F.col("g_width").alias("width"), F.col("g_first").alias("first"), F.col("g_source_size").alias("source_size"), F.col("g_target").alias("target"))
        totals = groups.groupBy("source").agg(F.sum("blocks").alias("blocks"), F.any_value("source_size").alias("source_size"), F.any_value("target").alias("target")).where("blocks > 0")
        slots = F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long")
        order = Window.orderBy(F.col("source").isNull(), "source")
        totals = totals.select("source", "blocks", slots.alias("slots")).where("slots > 0")
        #: source, blocks, slots, low: the sources' shares of all slots, one after another.
        self.totals = written(totals.withColumn("low", F.sum("slots").over(order) - F.col("slots")), "totals")
        self.all = self.totals.agg(F.sum("slots")).first()[0] or 0
        self.tasks = self.all // SLOTS_A_TASK + 1
        self.drawn = written(self._drawn(), "draws")
        #: shard, slot, source, block: what the mix is made of.
        self.slots = self._slots()
        times = self.slots.groupBy("source", "block").agg(F.count("*").alias("times"))
        spans = self.docs.where("size > 0").withColumn("at", F.explode(F.expr("sequence(start div width, (start + size - 1) div width)")))
        spans = spans.withColumn("block", F.col("first") + F.col("at")).withColumn("begin", F.greatest("start", F.col("at") * F.col("width")) - F.col("start"))
        spans = spans.withColumn("words", F.least(F.col("start") + F.col("size"), (F.col("at") + 1) * F.col("width")) - F.col("start") - F.col("begin"))
        # never broadcast: slots look as few as the draws they are exploded from
        t = times.toDF("t_source", "t_block", "times").hint("merge")
        #: doc_id, key, source, first, start, begin, words, times: runs of words of a document and how often they are taken.
        self.spans = spans.join(t, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("block") == F.col("t_block"))).select("doc_id", "key", "source", "first", "start", "begin", "words", "times")

    def _drawn(self) -> DataFrame:
        """shard, source, begin, drawn, kept: each shard's multinomial draw of sources, and how many of it are among the source's slots.

        Every slot of a shard draws a number below the sum of all slots; whose slot that is, that source it draws. Who owns
        which slots is kept by runs of OWNED slots, a row for each run. begin counts what earlier shards have drawn of the source,
        which gives the shard its range of the source's slots.
        """
        first, last = (F.floor(x / OWNED).cast("long") for x in (F.col("low"), F.col("low") + F.col("slots") - 1))
        owned = self.totals.withColumn("chunk", F.explode(F.sequence(first, last)))
        owned = owned.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct((F.col("low") + F.col("slots")).alias("end"), "source"))).alias("owners"))
        # written, so that Spark knows its size when it settles the join: what is exploded looks as small as what it comes from
        owned = written(owned, "owned")
        asked = self.totals.sparkSession.range(0, self.all, 1, self.tasks).select((F.col("id") / self.shard).cast("long").alias("shard"), F.pmod(F.xxhash64(F.lit("draw"), F.lit(self.seed), "id"), F.lit(max(1, self.all))).alias("number"))
        owner = F.filter("owners", lambda o: o["end"] > F.col("number"))[0]["source"]
        drawn = asked.withColumn("chunk", F.floor(F.col("number") / OWNED).cast("long")).join(owned, "chunk").groupBy("shard", owner.alias("source")).agg(F.count("*").alias("drawn"))
        before = F.sum("drawn").over(Window.partitionBy("source").orderBy("shard")) - F.col("drawn")
        ranged = _with_source(drawn.withColumn("begin", before), self.totals.select("source", "slots"))
        return ranged.select("shard", "source", "begin", "drawn", F.greatest(F.lit(0), F.least("drawn", F.col("slots") - F.col("begin"))).cast("long").alias("kept"))

    def _slots(self) -> DataFrame:
        """The slots of the draws: n-th slots of sources. What a source has drawn beyond its slots goes to those that have drawn too few.

        Both are few, about the square root of all slots, and are matched by their number.
        """
        in_shard = Window.partitionBy("shard").orderBy(F.col("source").isNull(), "source")
        kept = self.drawn.withColumn("at", F.sum("kept").over(in_shard) - F.col("kept")).where("kept > 0").repartition(self.tasks, "shard", "source")
        kept = kept.select("shard", "source", F.posexplode(F.expr("sequence(begin, begin + kept - 1)")).alias("p", "n"), "at").select("shard", "source", "n", (F.col("at") + F.col("p")).alias("place"))
        free = self.drawn.groupBy("shard").agg(F.sum("kept").alias("at"), F.sum(F.col("drawn") - F.col("kept")).alias("free")).where("free > 0")
        free = free.withColumn("low", F.sum("free").over(Window.orderBy("shard")) - F.col("free"))
        free = free.select("shard", "at", F.posexplode(F.expr("sequence(low, low + free - 1)")).alias("p", "x")).select("shard", (F.col("at") + F.col("p")).alias("place"), "x")
        got = self.drawn.groupBy("source").agg(F.sum("kept").alias("got")).withColumnRenamed("source", "name")
        short = self.totals.join(got, F.col("source").eqNullSafe(F.col("name")), "left").select("source", F.coalesce("got", F.lit(0)).alias("got"), (F.col("slots") - F.coalesce("got", F.lit(0))).alias("short")).where("short > 0")
        short = short.withColumn("low", F.sum("short").over(Window.orderBy(F.col("source").isNull(), "source")) - F.col("short"))
        short = short.select("source", "got", F.posexplode(F.expr("sequence(low, low + short - 1)")).alias("p", "x")).select("source", (F.col("got") + F.col("p")).alias("n"), "x")
        every = kept.unionByName(free.hint("merge").join(short, "x").select("shard", "source", "n", "place"))
        every = _with_source(every, self.totals.select("source", "blocks"))
        index = permuted(F.col("n") % F.col("blocks"), F.col("blocks"), F.lit(self.seed), F.coalesce("source", F.lit("")), F.floor(F.col("n") / F.col("blocks")))
        # within its shard a slot's place is drawn by a permutation too, else a source's slots would be side by side
        slot = permuted(F.col("place"), F.least(F.lit(self.shard).cast("long"), F.lit(self.all) - F.col("shard") * self.shard), F.lit(self.seed), F.lit("slot"), F.col("shard"))
        return every.select("shard", slot.alias("slot"), "source", index.alias("block"))

    def draws(self) -> DataFrame:
        """shard, source, blocks: what each shard takes of each source."""
        return self.slots.groupBy("shard", "source").agg(F.count("*").alias("blocks"))

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken: the words of each document that the mix takes, repeats counted."""
        some = self.spans.groupBy("key", "source", "first", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        s = some.toDF("s_key", "s_source", "s_first", "s_start", "taken")
        # a document without words may begin where another does, but has another key, and none of its own is taken
        same = (F.col("key") == F.col("s_key")) & (F.col("first") == F.col("s_first")) & (F.col("start") == F.col("s_start")) & F.col("source").eqNullSafe(F.col("s_source"))
        return self.docs.join(s, same, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _key() -> Column:
    """What rows of a source share only if they have the same doc_id and text."""
    return F.xxhash64("doc_id", "text")


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows joined with what `sources` has of their source, null being one of them."""
    named = sources.withColumnRenamed("source", "name")
    return rows.join(named, F.col("source").eqNullSafe(F.col("name"))).drop("name")


def mixed_documents(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The documents of the mix: each text is the words taken of it, pass by pass, a pass to a line; those not taken go.

    Rows alike in doc_id, text and source are told apart by their number, and each has the runs of its own place.
    """
    mix = Mix(docs, seed)
    # keys that are never null: rows are dealt once, for the join and for the numbers of rows alike
    pair = lambda: (F.xxhash64("key", "source").alias("r_k1"), F.xxhash64(F.lit("again"), "source", "key").alias("r_k2"))
    runs = mix.spans.select(*pair(), F.struct("first", "start", "begin", "words", "times").alias("run")).groupBy("r_k1", "r_k2").agg(F.sort_array(F.collect_list("run")).alias("r_runs"))
    # the documents as one column, so that no name of theirs meets ours
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("r_d"), _key().alias("key"), F.col("source").cast("string").alias("source")).select("r_d", *pair())
    joined = whole.join(runs, ["r_k1", "r_k2"])
    number = F.row_number().over(Window.partitionBy("r_k1", "r_k2").orderBy(F.xxhash64("r_d")))
    starts = F.array_distinct(F.transform("r_runs", lambda r: F.struct(r["first"], r["start"])))
    joined = joined.withColumn("r_start", F.try_element_at(starts, number))
    joined = joined.withColumn("r_runs", F.filter("r_runs", lambda r: F.struct(r["first"], r["start"]) == F.col("r_start")))
    words = F.regexp_extract_all("r_d.text", F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    one = lambda p: F.trim(F.array_join(F.transform(F.filter("r_runs", lambda r: r["times"] > p), lambda r: F.array_join(F.slice(F.col("r_words"), r["begin"].cast("int") + 1, r["words"].cast("int")), "")), ""))
    text = F.array_join(F.filter(F.array(*(one(p) for p in range(MOST))), lambda x: x != ""), "\n")
    made = joined.withColumn("r_words", words).withColumn("r_text", text).where("r_text <> ''")
    new = {"text": F.col("r_text"), "n_chars": F.length("r_text").cast("long")}
    return made.select(*(new.get(c, F.col("r_d")[c]).alias(c) for c in docs.columns))
