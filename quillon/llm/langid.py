"""Language identification by compression: the language whose dictionary makes the text smallest.

For each language a raw-content zstandard dictionary is made from a bounded sample of labelled texts; a text is
lower-cased and compressed with each dictionary, whole, and gets the language of the smallest frame. ``score`` turns the sizes into a share:
``2^(-size / SCALE)`` of the best against the sum over all languages. A text whose score is below ``narrow`` is
rejected (``rejected``): its margin doesn't tell the languages apart.

The sample: of each language the ``docs`` labelled texts (at most) with the smallest md5 of their doc_id among those picked by a
hash at a rate set by the language's count (``SAMPLE_DOCS``); of each text the first ``DICT_BYTES / docs`` bytes (1,000) at most go into the
dictionary. Both are bounds on what is learned from alone: every text is judged whole. So the driver holds ``DICT_BYTES`` a language,
whatever the input.

Defined cases: null texts and texts without a letter get ``und`` with score 0 and are rejected, as is every text when
nothing was learned; ties go to the first language in order; very long texts are compressed whole; a null doc_id is
neither held out nor learned from; repeated rows are judged alike; an empty table gives an empty result; other columns stay as they
are, but ``lang_pred``, ``score`` and ``rejected`` of the input are replaced.
"""

from __future__ import annotations

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

DICT_BYTES, SAMPLE_DOCS = 32_000, 32
LEVEL, SCALE = 6, 1.0
NARROW = 0.5
LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    """True for the third of documents that are not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, docs_per_lang: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionaries by language from (doc_id, text, lang) rows, all of them open to learning."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("text").alias("n")).collect()}  # one row a language
    if not counts:
        return {}
    rate = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, 3.0 * docs_per_lang / max(n, 1)))) for lang, n in sorted(counts.items())])
    key = F.md5(F.col("doc_id").cast("string"))
    picked = rows.filter(F.col("text").isNotNull() & (F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / (1 << 32) < rate))
    size = dict_bytes // docs_per_lang
    first = Window.partitionBy("lang").orderBy("key", "text")
    picked = picked.select("lang", key.alias("key"), F.substring("text", 1, size).alias("text")).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= docs_per_lang)
    texts: dict[str, list[bytes]] = {}
    for row in picked.orderBy("lang", "rank").collect():  # at most docs_per_lang texts of `size` code points a language
        texts.setdefault(row["lang"], []).append(row["text"].encode()[:size])
    return {lang: normal(b"\n".join(parts).decode("utf-8", "ignore")) for lang, parts in texts.items()}


def normal(text: str) -> bytes:
    """What is compressed: the text in lower case, as capitals tell little of a language."""
    return text.lower().encode()


class Classifier:
    """Compressors by language; pickles as the dictionaries alone."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.dictionaries, self.level = dict(sorted(dictionaries.items())), level

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "level": self.level}

    @property
    def compressors(self) -> list:
        if "_made" not in self.__dict__:
            self._made = []
            for data in self.dictionaries.values():
                d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                self._made.append(zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return self._made

    def judge(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.dictionaries or not LETTER.search(text):
            return "und", 0.0
        raw = normal(text)
        sizes = [len(c.compress(raw)) for c in self.compressors]
        best = min(sizes)
        score = 1.0 / sum(2.0 ** (max(-60.0, (best - s) / SCALE)) for s in sizes)
        return list(self.dictionaries)[sizes.index(best)], score


def classified(docs: DataFrame, dictionaries: dict[str, bytes], narrow: float = NARROW, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected."""
    model = docs.sparkSession.sparkContext.broadcast(Classifier(dictionaries))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def judge(texts: pa.Array) -> pa.Array:
        found = [model.value.judge(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang_pred", "score"])

    out = docs.withColumn("_quillon_judged", judge(F.col(text)))
    out = out.withColumns({"lang_pred": F.col("_quillon_judged.lang_pred"), "score": F.col("_quillon_judged.score")}).drop("_quillon_judged")
    return out.withColumn("rejected", (F.col("lang_pred") == "und") | (F.col("score") < narrow))
