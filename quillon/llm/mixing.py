"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame operations only).

Sources are ranked by name (code points, null last) and weigh 5, 2, 1, repeating. Together they get
``share`` times all words, split by weight; a target stops at ``cap`` times its source's words and the
excess is shared again by weight. The schedule is a sequence of equal slots of ``block`` words: slot j
takes the point ``j * 2654435769 mod 2^32`` (the golden-ratio sequence) and belongs to the source whose
interval of the cumulated targets holds it. The k-th slot of a source takes the k-th block of its
documents, shuffled by md5 and laid end to end, twice over at most; so every prefix of the schedule is
mixed in proportion, and no word is taken more than ``cap`` times.

Every ranking runs in two levels (buckets, then rows within a bucket), so a source that holds a third
of the rows is spread over many tasks.

Defined cases: a null text or one without words has size 0 and takes 0; null sources form one source,
ranked last; a source without words has target 0; an empty table gives an empty result; repeated rows
are separate documents (ties fall to the same block order, so their counts agree in sum); other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.llm.shared import store

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
GOLDEN = 2654435769  # 2^32 over the golden ratio
RING = 1 << 32
CELLS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sized: DataFrame, share: float = 1.5, cap: int = 2) -> DataFrame:
    """(source, source_size, weight, target) of (source, size) rows."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")).cast("long"))
    # A source is full when the water level at which it would fill is not above the level reached.
    ratio = F.col("source_size") / F.col("weight")
    upto, every = Window.orderBy("ratio").rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    per = per.withColumn("ratio", ratio).withColumns({
        "full_words": F.sum("source_size").over(upto) * cap,
        "full_weight": F.sum("weight").over(upto),
        "all_weight": F.sum("weight").over(every),
        "budget": F.sum("source_size").over(every) * F.lit(float(share)),
    })
    per = per.withColumn("full", F.col("full_words") + F.col("ratio") * cap * (F.col("all_weight") - F.col("full_weight")) <= F.col("budget"))
    per = per.withColumns({
        "rest": F.col("budget") - F.sum(F.when(F.col("full"), F.col("source_size") * cap).otherwise(0)).over(every),
        "open_weight": F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(every),
    })
    target = F.when(F.col("full"), (F.col("source_size") * cap).cast("double")).otherwise(F.col("weight") * (F.col("rest") / F.col("open_weight")))
    return per.select("source", "source_size", "weight", target.alias("target"))


def schedule(goals: DataFrame, block: int, cap: int = 2, chunk: int = 4096) -> DataFrame:
    """Slots of the mix: (slot, source, rank), rank counting a source's slots from 0."""
    spark = goals.sparkSession
    every = Window.partitionBy()
    upto = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    spans = goals.withColumns({"total": F.sum("target").over(every), "hi": F.sum("target").over(upto)}).filter("total > 0")
    spans = spans.withColumns({
        "last": F.row_number().over(Window.orderBy(F.col("source").desc_nulls_first())) == 1,
        "from_": F.floor((F.col("hi") - F.col("target")) / F.col("total") * RING),
        "to_": F.floor(F.col("hi") / F.col("total") * RING),
    }).withColumn("to_", F.when(F.col("last"), F.lit(RING)).otherwise(F.col("to_"))).filter("to_ > from_")
    width = RING // CELLS
    cells = spans.select("source", "from_", "to_", F.explode(F.sequence(F.expr(f"from_ div {width}"), F.expr(f"(to_ - 1) div {width}"))).alias("cell"))
    n = goals.agg(F.ceil(F.sum("target") / block).alias("n")).first()["n"] or 0
    slots = spark.range(int(n)).withColumnRenamed("id", "slot").withColumn("point", (F.col("slot") % (1 << 31) * GOLDEN) % RING)
    slots = slots.withColumn("cell", F.expr(f"point div {width}")).join(cells, "cell").filter("point >= from_ and point < to_")
    slots = slots.select("slot", "source", F.expr(f"slot div {chunk}").alias("chunk"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.groupBy("source", "chunk").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    local = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    ranked = slots.withColumn("local", local).alias("s").join(starts.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")) & (F.col("s.chunk") == F.col("t.chunk")))
    return ranked.select("s.slot", "s.source", (F.col("t.start") + F.col("s.local")).alias("rank"))


def shuffled(sized: DataFrame, buckets: int, seed: str = "mix") -> DataFrame:
    """``sized`` with the first word's place (``at``) in its source, documents in md5 order."""
    keyed = sized.withColumn("key", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    keyed = keyed.withColumn("bucket", F.expr(f"cast(conv(substr(key, 1, 6), 16, 10) as bigint) * {buckets} div {1 << 24}"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("held")).withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = local.alias("d").join(starts.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.bucket") == F.col("t.bucket")))
    return joined.select("d.doc_id", "d.source", "d.size", (F.col("t.start") + F.col("d.local")).alias("at"), F.col("d.row_key"))


def mix(docs: DataFrame, share: float = 1.5, cap: int = 2, block: int = 256, docs_per_bucket: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs`` (doc_id, text, source).

    Returns the schedule's pieces (slot, source, doc_id, row_key, pass_, from_word, words): ``words`` words
    of the document from ``from_word``, in slot order; and the documents (doc_id, row_key, size, source_size,
    target, taken). ``row_key`` tells rows of the same doc_id apart.
    """
    sized = store(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text", "source").alias("row_key")), "sizes")
    goals = store(targets(sized, share, cap), "targets")
    slots = schedule(goals, block, cap)
    buckets = max(16, sized.count() // docs_per_bucket)
    laid = store(
        shuffled(sized, buckets).alias("d").join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
        .select("d.doc_id", "d.row_key", "d.source", "d.size", "d.at", "g.source_size", "g.target"), "laid")
    runs = laid.filter("size > 0").withColumn("pass_", F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))).withColumn("first", F.col("at") + F.col("pass_") * F.col("source_size"))
    blocks = runs.withColumn("rank", F.explode(F.sequence(F.expr(f"first div {block}"), F.expr(f"(first + size - 1) div {block}"))))
    blocks = blocks.withColumns({"lo": F.greatest(F.col("first"), F.col("rank") * block), "hi": F.least(F.col("first") + F.col("size"), (F.col("rank") + 1) * block)})
    pieces = blocks.alias("b").join(slots.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")) & (F.col("b.rank") == F.col("s.rank")))
    pieces = store(pieces.select("s.slot", "b.source", "b.doc_id", "b.row_key", "b.at", "b.pass_", (F.col("b.lo") - F.col("b.first")).alias("from_word"), (F.col("b.hi") - F.col("b.lo")).alias("words")), "pieces")
    took = pieces.groupBy("doc_id", "source", "at", "row_key").agg(F.sum("words").alias("taken"))
    same = (F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.at") == F.col("t.at")) & (F.col("d.row_key") == F.col("t.row_key")) & (F.col("d.size") > 0))
    out = laid.alias("d").join(took.alias("t"), same, "left")
    return pieces, out.select("d.doc_id", "d.row_key", "d.size", "d.source_size", "d.target", F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken"))
