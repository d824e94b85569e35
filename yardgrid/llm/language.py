"""Language of a text by compression with one dictionary per language.

A model is a raw-content dictionary of text for each language. A text, lower-cased and with
everything but letters as single spaces, is cut into windows; each window is compressed with each
dictionary, and the language with the smallest sum of sizes wins. Where the runner-up is nearly as
small the text is rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from yardgrid.llm.common import fresh, struct_udf

UNDETERMINED = "und"
LEVEL = 6
WINDOW = 2048
# The bounded sample behind a dictionary: texts per language, characters of each, bytes in all.
TEXTS, CHARACTERS, DICTIONARY = 400, 1_000, 128 * 1024
# Put before every window. A block that hardly shrinks is stored as it is, with the same size for every
# language; the run of zeros makes every block worth compressing, so that short matches count.
FILLER = bytes(64)
# Rejected below this relative difference between the two smallest sizes.
MARGIN = 0.002
# Bytes that make a runner-up less likely by the factor e.
SOFTNESS = 4.0

_OTHER = re.compile(r"[\W\d_]+")

FIELDS = {"lang": "string", "score": "double", "margin": "double", "rejected": "boolean"}


def letters(text: str) -> str:
    """Lower-case words with single spaces between them."""
    return _OTHER.sub(" ", text.lower()).strip()


def fit_dictionaries(
    df: DataFrame, usable: Column, text: str = "text", lang: str = "lang", key: str = "doc_id"
) -> dict[str, bytes]:
    """A dictionary for every language of the usable rows that have a language and a text.

    From each language at most ``TEXTS`` rows in hashed order of their keys are taken, of each
    ``CHARACTERS`` characters. The sample is a bounded number of rows per language; the limit
    is applied in every task before the rows move.
    """
    rows = df.filter(usable & F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).alias("lang"),
        F.xxhash64(F.col(key)).alias("order"),
        F.substring(text, 1, CHARACTERS).alias("part"),
    )
    ranked = rows.withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "part"))
    ).filter(F.col("rank") <= TEXTS)
    parts: dict[str, list[str]] = {}
    for row in sorted(ranked.collect(), key=lambda r: (r["lang"], -r["rank"])):
        parts.setdefault(row["lang"], []).append(letters(row["part"]))
    found = {k: " ".join(p for p in v if p).encode("utf-8", "ignore") for k, v in parts.items()}
    return {k: d[-DICTIONARY:] for k, d in found.items() if len(d) >= 8}


def classifier(
    dictionaries: dict[str, bytes], margin: float = MARGIN
) -> Callable[[str | None], tuple[str, float, float, bool]]:
    """A function from a text to the values of ``FIELDS``."""
    coders = {}
    for lang, content in sorted(dictionaries.items()):
        shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(level=LEVEL)
        coders[lang] = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=shared, write_content_size=False, write_dict_id=False
        ).compress

    def classify(text: str | None) -> tuple[str, float, float, bool]:
        data = letters(text or "").encode("utf-8", "ignore")
        if not data or not coders:
            return UNDETERMINED, 0.0, 0.0, True
        windows = [data[at : at + WINDOW] for at in range(0, len(data), WINDOW)]
        sizes = {lang: sum(len(code(FILLER + w)) for w in windows) for lang, code in coders.items()}
        best = min(sizes, key=lambda lang: (sizes[lang], lang))
        least = sizes[best]
        score = 1.0 / sum(math.exp((least - s) / SOFTNESS) for s in sizes.values())
        others = [s for lang, s in sizes.items() if lang != best]
        apart = (min(others) - least) / min(others) if others else 1.0
        return best, score, apart, apart < margin

    return classify


def identify(
    df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", out: str = "language",
    margin: float = MARGIN,
) -> DataFrame:
    """``df`` with a struct column of language, score (0 to 1), margin and whether it is rejected.

    Null texts and texts without letters are ``und`` with score 0 and rejected, as is everything
    when nothing was learned. Equal sizes go to the first language by name and are rejected.
    """
    label = struct_udf(FIELDS, lambda: classifier(dictionaries, margin))
    return df.withColumn(out, label(F.col(text)))


def keep_identified(
    df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = MARGIN
) -> DataFrame:
    """The rows of ``df`` whose language is clear, unchanged."""
    column = fresh(df, "_language")
    kept = identify(df, dictionaries, text, column, margin)
    return kept.filter(~F.col(f"{column}.rejected")).drop(column)
