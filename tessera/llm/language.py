"""Language identification by compression: the dictionary that helps most names the language.

Each language has a Zstandard dictionary of raw content, text of that language.  A text is
compressed with every dictionary and the smallest result wins.  A text goes in pieces well inside the
compressor's window, which holds the dictionary only at first, and the sizes of all pieces add up: so every part
of a text counts alike, whatever its length.  Results are whole bytes, so languages less than `close` bytes apart
are told apart by smaller parts of their dictionaries, whose sizes add up to a finer measure.  The margin
between the best two gives a score; `min_margin` rejects.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

UNKNOWN = "und"


@dataclass(frozen=True)
class Profiles:
    """Raw dictionary content by language, the language with the most labelled rows first."""

    content: tuple[tuple[str, bytes], ...]
    level: int = 6
    close: float = 2.0
    parts: int = 16
    piece: int = 16 * 1024


def plain(text: str) -> bytes:
    """What is compressed: letters, lower-cased, with one space for all between them."""
    return " ".join(re.findall(r"[^\W\d_]+", text.lower())).encode("utf-8", "replace")


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows_per_lang: int = 300, chars_per_row: int = 2000, dict_bytes: int = 96 * 1024, spare: int = 8) -> Profiles:
    """Dictionaries from a bounded sample of labelled rows.

    Of each language the rows_per_lang rows with the least hash of their id and text are taken,
    chars_per_row characters of each; dict_bytes are kept.  So the driver gets a few hundred KB a
    language however many rows there are.  Hashes are first held against a rate that leaves about
    `spare` times as many rows, so what is sorted for a language doesn't grow with it either.
    Null languages and texts are left out.
    """
    spark, known = labelled.sparkSession, labelled.where(F.col(lang_col).isNotNull())
    often = {r["lang"]: r["count"] for r in known.groupBy(F.col(lang_col).alias("lang")).count().collect()}
    rates = spark.createDataFrame([(lang, min(1.0, spare * rows_per_lang / n)) for lang, n in often.items()], "lang string, rate double")
    place = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 53)).alias("h")
    rows = known.where(F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.substring(text_col, 1, chars_per_row).alias("text"), place)
    rows = rows.join(F.broadcast(rates), "lang").where(F.col("h") < F.col("rate") * F.lit(float(1 << 53)))
    first = Window.partitionBy("lang").orderBy("h", "text")
    sample = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= rows_per_lang).select("lang", "n", "text").collect()
    by_lang: dict[str, list[bytes]] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], r["n"])):
        by_lang.setdefault(r["lang"], []).append(plain(r["text"]))
    order = sorted(by_lang, key=lambda lang: (-often[lang], lang))
    return Profiles(tuple((lang, b" ".join(by_lang[lang])[:dict_bytes]) for lang in order))


class Measure:
    def __init__(self, profiles: Profiles):
        self.profiles = profiles
        self.whole = [(lang, [self._compressor(raw)]) for lang, raw in profiles.content]
        self.fine = [(lang, [self._compressor(raw[i * len(raw) // profiles.parts : (i + 1) * len(raw) // profiles.parts]) for i in range(profiles.parts)]) for lang, raw in profiles.content]

    def _compressor(self, raw: bytes) -> zstandard.ZstdCompressor:
        made = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(self.profiles.level, min_match=4, window_log=17, write_content_size=False, write_dict_id=False, write_checksum=False)
        made.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=made, compression_params=how)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): the margin in bytes between the best two languages."""
        if not text or not any(map(str.isalpha, text)) or not self.whole:
            return UNKNOWN, 0.0, 0.0
        data = plain(text)
        pieces = [data[i : i + self.profiles.piece] for i in range(0, len(data), self.profiles.piece)]
        total = lambda compressors: sum(len(c.compress(p)) for c in compressors for p in pieces) / len(compressors)
        sizes = [(total(compressors), lang) for lang, compressors in self.whole]
        least = min(size for size, _ in sizes)
        close = [lang for size, lang in sizes if size - least < self.profiles.close]
        over = {lang: size - least for size, lang in sizes}
        if len(close) > 1:
            finer = {lang: total(compressors) for lang, compressors in self.fine if lang in close}
            over |= {lang: size - min(finer.values()) for lang, size in finer.items()}
        sizes = sorted(((over[lang], lang) for _, lang in sizes), key=lambda s: s[0])  # stable: of equals, the language learned from most
        margin = sizes[1][0] if len(sizes) > 1 else float(len(data))
        score = 1 / sum(math.pow(2, -min(60.0, 8 * size / math.sqrt(len(data)))) for size, _ in sizes)
        return sizes[0][1], score, margin


@lru_cache(2)
def measure(profiles: Profiles) -> Measure:
    """Prepared dictionaries, once for each Python worker."""
    return Measure(profiles)


_PREDICTED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("best", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType())])


def identify(text: Column, profiles: Profiles, min_margin: float = 1.0) -> Column:
    """struct(lang, best, score, margin) of each whole text.

    best is the language with the smallest result, of equals the one with most labelled rows; lang is the same unless
    the margin is under min_margin bytes, then `und`.  Null, texts without a letter, and any text
    when nothing was learned are `und` with score 0.  Score is the share of the best language when every
    bit more, divided by the root of the text's bytes, halves a language's share: so a text of two languages in
    like parts scores low however long it is.  Repeated texts have equal rows; columns besides the text are not read.
    """

    @F.arrow_udf(_PREDICTED)
    def run(texts: pa.Array) -> pa.Array:
        use = measure(profiles)
        rows = [use.predict(t.as_py()) for t in texts]
        best, score, margin = ([r[k] for r in rows] for k in range(3))
        lang = [UNKNOWN if m < min_margin else b for b, m in zip(best, margin, strict=True)]
        kinds = (pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.StructArray.from_arrays([pa.array(v, type=k) for v, k in zip((lang, best, score, margin), kinds, strict=True)], names=["lang", "best", "score", "margin"])

    return run(text)
