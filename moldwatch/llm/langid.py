"""Operator 4: language ID by compression.

Each language has a raw-content zstandard dictionary of training text.  A text is
encoded with every dictionary, in blocks so that the dictionary and not the text's own start
decides however long it is; the language whose dictionary gives the fewest bytes in
total wins.  If the runner-up needs hardly more, the text is rejected.

The dictionaries are fitted on a bounded, documented sample: per language the training texts
with the smallest digests of ``SHARDS`` shards, ``PIECE`` characters of each from a place that
its digest chooses, so at most SHARDS * PIECE characters a language reach the driver.  All texts are classified whole,
in one scan without a shuffle.

Defined results: null texts and texts without a letter are ``und``, score 0, rejected; so is
every text when nothing could be learned.  Null ids count as the empty string for the
training split; repeated rows are predicted each; an empty table gives no rows; other
columns are ignored.
"""
from __future__ import annotations

import math

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARDS = 64
PIECE = 2000
BLOCK = 2048
LEVEL = 6  # lower levels find no matches as short as syllables
MARGIN = 0.01  # a runner-up within this share of the winner's bytes is too near


def letters(text: Column) -> Column:
    """The lower-cased letters of a text, each run of anything else as one space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % folds


def fit_dictionaries(train: DataFrame, *, text_col: str = "text", lang_col: str = "lang", shards: int = SHARDS,
                     piece: int = PIECE) -> dict[str, bytes]:
    """Language -> raw dictionary content.  A text's piece begins at a place that its digest chooses, anywhere
    from its beginning to ``piece`` characters before its end."""
    t = train.filter(F.col(text_col).rlike(r"\p{L}") & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), letters(F.col(text_col)).alias("whole"))
    places = F.greatest(F.char_length("whole") - piece + 1, F.lit(1))
    t = t.select("lang", F.substring("whole", 1 + F.pmod(F.xxhash64("whole"), places), F.lit(piece)).alias("piece"))
    t = t.select("lang", "piece", F.xxhash64("piece").alias("digest"))
    rows = (t.groupBy("lang", F.pmod("digest", F.lit(shards)).alias("shard"))
            .agg(F.min(F.struct("digest", "piece")).alias("m")).select("lang", "shard", "m.piece").collect())
    found: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["shard"])):
        found.setdefault(r["lang"], []).append(r["piece"])
    return {lang: "\n".join(p).encode() for lang, p in found.items()}


class Compressors:
    """Bytes that a text takes with each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.tools = []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, dict_size=len(dictionaries[lang]), source_size=BLOCK, write_content_size=False, write_checksum=False,
                write_dict_id=False)
            content.precompute_compress(compression_params=settings)
            self.tools.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=content))

    def sizes(self, text: str) -> list[int]:
        data = text.encode("utf-8", "surrogatepass")
        blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(tool.compress(b)) for b in blocks) for tool in self.tools]

    def decide(self, text: str) -> tuple[str, float, float]:
        """Language of a text of ``letters``, score (0 to 1) and the runner-up's margin as a share of
        the winner's bytes."""
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = sizes[order[0]]
        scale = 1 + 0.01 * best
        score = 1 / sum(math.exp((best - s) / scale) for s in sizes)
        margin = (sizes[order[1]] - best) / best if len(order) > 1 else 1.0
        return self.langs[order[0]], score, margin


FOUND = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                      T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def annotate(docs: DataFrame, dictionaries: dict[str, bytes], *, text_col: str = "text", margin: float = MARGIN,
             keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (its columns ``keep``, or all) as a struct ``row``, with a struct
    ``found``: lang_pred, score, margin, rejected."""
    text = F.col(text_col)
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep or docs.columns)).alias("row"),
                    F.when(text.rlike(r"\p{L}"), letters(text)).alias("text"))

    def classify(batches):
        tools = Compressors(dictionaries) if dictionaries else None
        for b in batches:
            found = [tools.decide(t) if tools and t is not None else ("und", 0.0, 0.0)
                     for t in (x.as_py() for x in b.column("text"))]
            langs, scores, margins = zip(*found) if found else ((), (), ())
            own = pa.StructArray.from_arrays(
                [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()),
                 pa.array([x == "und" or m < margin for x, m in zip(langs, margins)], pa.bool_())], FOUND.names)
            yield pa.RecordBatch.from_arrays([b.column("row"), own], ["row", "found"])

    return d.mapInArrow(classify, T.StructType([d.schema["row"], T.StructField("found", FOUND)]))


def predict(docs: DataFrame, dictionaries: dict[str, bytes], *, id_col: str = "doc_id", text_col: str = "text",
            margin: float = MARGIN) -> DataFrame:
    """One row per document: ``id_col``, lang_pred, score, margin, rejected."""
    whole = annotate(docs, dictionaries, text_col=text_col, margin=margin, keep=[id_col])
    return whole.select(F.col("row")[id_col].alias(id_col), "found.*")


def op4_language(spark, sf_dir):
    """Contract query: the language of all ``documents``, learned from three of four folds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = fit_dictionaries(docs.filter(fold(F.col("doc_id"), 4) != 2))
    return predict(docs, learned).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score",
                                         "margin", "rejected")
