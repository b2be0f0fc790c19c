"""Document fingerprints: a homomorphic multiset hash (DataFrame operations only).

A text is the multiset of its paragraphs (lines). Its fingerprint is a vector of sums over them, each lane
modulo 2^32: so equal multisets have equal fingerprints in any order, and a paragraph is added or taken
away by adding or subtracting its own vector (``plus`` and ``minus``). A paragraph's vector has

* ``WIDE`` lanes of 32 bits, two from each of four hashes of the whole paragraph, which decide equality, and
* ``SIGNS`` lanes that sum a weight of either sign over the paragraph's blocks, from the bits of two block
  hashes. The mean square of such lanes of a difference estimates how much of their blocks two texts don't
  share, which gives a likeness from two fingerprints alone. The first 64 code points of a paragraph are blocks of 4,
  hashed with their place, so that short texts have enough of them; the rest are blocks of 16. The mean square grows with
  the square of the weight, so blocks of 16 weigh 2 and count as much as the 4 small ones of as many code points.

Defined cases: a null text counts as the empty text, whose fingerprint is all zero; two empty texts are
alike with 1; very long texts only add terms (lanes wrap modulo 2^32); repeated rows and equal texts get equal
fingerprints; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WIDE, SIGNS = 8, 128
LOW = 0xFFFFFFFF
PAIR = (1 << 32) + 1  # two lanes of 32 bits in a long


def sums(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Distinct ``keys`` with ``acc``, the summed lanes of ``text`` packed for the way (see ``lanes``), and ``copies``, the
    number of rows that have them. Rows of equal keys must have equal texts.

    Blocks and paragraphs become rows and are summed by key, the larger part of it before the shuffle (or all of it, where
    ``rows`` are dealt by some of the keys already); a key that a third of all rows share costs no more than its rows.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    none = F.lit(None).cast("long")
    block = lambda weight, *key: F.struct(F.xxhash64(*key).alias("a"), F.xxhash64(*key, F.lit("b")).alias("b"), F.lit(weight).cast("long").alias("_k"), *[none.alias(f"w{i}") for i in range(WIDE // 2)])
    small = lambda p: F.transform(F.regexp_extract_all(F.substring(p, 1, 64), F.lit("[^\n]{1,4}"), F.lit(0)), lambda q, i: block(1, q, i))
    large = lambda p: F.transform(F.regexp_extract_all(F.substring(p, 65, 1 << 30), F.lit("[^\n]{1,16}"), F.lit(0)), lambda q: block(2, q))
    paragraphs = F.filter(F.split(raw, "\n"), lambda p: p != "")
    # each pair of wide lanes is a hash of the whole paragraph, with a seed of its own
    lines = F.transform(paragraphs, lambda p: F.struct(none.alias("a"), none.alias("b"), none.alias("_k"), *[F.xxhash64(p, F.lit(f"w{i}")).alias(f"w{i}") for i in range(WIDE // 2)]))
    blocks = F.flatten(F.transform(paragraphs, lambda p: F.concat(small(p), large(p))))
    mark = F.array(F.struct(*[none.alias(c) for c in ("a", "b", "_k", *[f"w{i}" for i in range(WIDE // 2)])]))
    parts = rows.select(*keys, F.posexplode(F.concat(mark, lines, blocks)).alias("p", "x")).select(*keys, "p", "x.*")
    signs = [f"coalesce(sum((shiftright({h}, {s}) & {PAIR}) * _k), 0L) as {h}{s}" for h in "ab" for s in range(SIGNS // 4)]
    wide = [f"coalesce(sum(shiftrightunsigned(w{i // 2}, {32 * (i % 2)}) & {LOW}), 0L) as lane{i}" for i in range(WIDE)]
    summed = parts.groupBy(*keys).agg(*map(F.expr, ["sum(if(p = 0, 1L, 0L)) as copies", "coalesce(sum(_k), 0L) as n", *wide, *signs]))
    packed = ["n div copies"] + [f"shiftleft((lane{i + 1} div copies) & {LOW}, 32) | ((lane{i} div copies) & {LOW})" for i in range(0, WIDE, 2)] + [f"{h}{s} div copies" for h in "ab" for s in range(SIGNS // 4)]
    return summed.select(*keys, "copies", F.expr("array(" + ", ".join(packed) + ")").alias("acc"))


def lanes(acc: str) -> Column:
    """The fingerprint, array<bigint> of WIDE and then SIGNS lanes from 0 to 2^32 - 1, of packed sums."""
    packed = F.col(acc)
    both = lambda x, of: F.array(*[of(half).bitwiseAND(F.lit(LOW)) for half in (x.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(x, 32))])
    wide = F.transform(F.slice(packed, 2, WIDE // 2), lambda x: both(x, lambda half: half))
    signs = F.transform(F.slice(packed, 2 + WIDE // 2, SIGNS // 2), lambda x: both(x, lambda half: half * 2 - packed[0]))
    return F.flatten(F.concat(wide, signs))


def plus(one: Column, other: Column) -> Column:
    """The fingerprint of both multisets together."""
    return F.zip_with(one, other, lambda a, b: (a + b).bitwiseAND(F.lit(LOW)))


def minus(one: Column, other: Column) -> Column:
    """The fingerprint of ``one`` without ``other``."""
    return F.zip_with(one, other, lambda a, b: (a - b).bitwiseAND(F.lit(LOW)))


def text_form(vec: Column) -> Column:
    """Lowercase hex, eight digits a lane."""
    return F.array_join(F.transform(vec, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def _energy(lanes: Column) -> Column:
    signed = lambda x: (x - F.when(x > 0x7FFFFFFF, F.lit(1 << 32)).otherwise(F.lit(0))).cast("double")
    return F.aggregate(lanes, F.lit(0.0), lambda acc, x: acc + signed(x) * signed(x))


def likeness(one: Column, other: Column) -> Column:
    """About the share of text in common blocks (Dice), 1 for equal fingerprints, 0 to 1."""
    a, b = (F.slice(v, WIDE + 1, SIGNS) for v in (one, other))
    both = _energy(a) + _energy(b)
    close = F.when(both == 0, F.lit(0.0)).otherwise(1.0 - _energy(minus(a, b)) / both)
    return F.when(one == other, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), close)))


def ranges(docs: DataFrame, payload: list[str], buckets: int | None = None) -> tuple[DataFrame, Window]:
    """``docs`` dealt to ranges (``_range``) of doc_id that are cut at actual ids, and the order within one.

    The first rows of a range also go to the range before, as guests (``_guest``), so that no row needs more than its
    own range to find the row that follows; those of the first range are guests of the last.
    """
    n = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / n) for i in range(n + 1)]), 20_000).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))[:-1] if cuts else []  # each cut, but for the last id, starts a range
    if not cuts:
        cuts = [docs.agg(F.min("doc_id").alias("m")).first()["m"] or 0]
    step = max(1, int(len(cuts) ** 0.5))
    coarse, fine = cuts[::step], [cuts[i : i + step] for i in range(0, len(cuts), step)]
    many = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    block = F.size(F.filter(many(coarse), lambda c: c <= F.col("doc_id")))
    place = F.size(F.filter(F.element_at(F.array(*map(many, fine)), F.greatest(block, F.lit(1))), lambda c: c <= F.col("doc_id")))
    # ids are not null here but in odd tables; those rows sort first
    at = F.when(F.col("doc_id").isNull() | (block == 0), F.lit(0)).otherwise((block - 1) * step + place - 1)
    dealt = docs.withColumn("_at", at)
    opens = F.element_at(F.array(*map(many, fine)), F.expr(f"cast(_at div {step} + 1 as int)"))
    is_first = F.col("doc_id") == F.element_at(opens, (F.col("_at") % step + 1).cast("int"))
    last = F.lit(len(cuts) - 1 + len(cuts))
    copies = F.when(F.col("doc_id").isNull(), F.array(F.col("_at"), last)).when(is_first & (F.col("_at") > 0), F.array(F.col("_at"), F.col("_at") - 1 + len(cuts))).when(is_first, F.array(F.col("_at"), last)).otherwise(F.array("_at"))
    spread = dealt.withColumn("_copy", F.explode(copies)).withColumns({"_guest": F.col("_copy") >= len(cuts), "_range": F.col("_copy") % len(cuts)})
    return spread.drop("_at", "_copy"), Window.partitionBy("_range").orderBy("_guest", F.col("doc_id").asc_nulls_first(), *payload)


def with_edits(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, the edited text's sha256, and the vectors of the text, the edited text and the next text.

    The edit replaces the last quarter of a text's code points by the first as many of the next document's. Texts move
    once, to their range of ids; the sums are made there, by range and place in it, and need no other shuffle.
    """
    spread, order = ranges(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["text"])
    n = F.char_length("text")
    cut = F.expr("char_length(text) div 4")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - cut).cast("int")), F.substring(F.col("_next"), F.lit(1), cut.cast("int")))
    led = spread.withColumns({"_place": F.row_number().over(order), "_next": F.lead("text").over(order)})
    led = led.select("_range", "_place", "_guest", "doc_id", n.cast("long").alias("n_chars"), "text", F.when(~F.col("_guest"), edited).alias("edited"))
    led = led.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    both = F.array(F.struct(F.lit(0).alias("_which"), F.col("text").alias("_of")), F.struct(F.lit(1).alias("_which"), F.col("edited").alias("_of")))
    keys = ["_range", "_place", "_guest", "doc_id", "n_chars", "edited_sha256"]
    each = led.select(*keys, F.explode(both).alias("x")).select(*keys, "x.*").filter("_which = 0 or not _guest")
    made = sums(each, [*keys, "_which"], "_of")
    along = Window.partitionBy("_range").orderBy("_place", "_which")
    out = made.withColumns({"edited_acc": F.lead("acc", 1).over(along), "next_acc": F.lead("acc", 2).over(along)}).filter("_which = 0 and not _guest")
    return out.select("doc_id", "n_chars", "edited_sha256", lanes("acc").alias("vec"), lanes("edited_acc").alias("edited_vec"), lanes("next_acc").alias("next_vec"))
