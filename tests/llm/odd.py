"""Documents with what operators must bear: nulls, empty and very long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

KINDS = (
    "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, stats double, score double,"
    " component_id long, digest string, start long, words string, rid long, hid long, __key string, __id long, __text string"
)


def text_of(rng: random.Random, words: int, letters: str = "abcdefg") -> str:
    return " ".join("".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(words))


def rows(seed: int = 1) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    passage = text_of(rng, 60)
    out: list[tuple[int | None, str | None]] = [(i, text_of(rng, rng.randint(1, 120))) for i in range(30)]
    out += [(100 + i, f"{text_of(rng, 20)}\n{passage} {text_of(rng, 15)}") for i in range(4)]
    out += [(200, passage), (201, passage), (201, passage), (202, passage.upper())]
    out += [(300, None), (301, ""), (302, " \t\n\x0b\x0c\r "), (303, "x"), (304, "Ünï çödé\u00a0wörds \u2003 日本語 ß K")]
    out += [(305, "eron, " * 500), (306, text_of(rng, 20_000)), (None, "without an id at all"), (None, None)]
    out += [(307, "a b c d\x00e\x1cf <|endoftext|> <|ENDOFTEXT|>\n\n<|endoftext|> x  y   z")]
    return out


def documents(spark: SparkSession, data: list[tuple[int | None, str | None]]) -> DataFrame:
    full = [(i, t, "en", "s", None if t is None else len(t), 7, "k", 0.5, None, 3, "d", 1, "w", 2, 4, "x", 1, "y") for i, t in data]
    return spark.createDataFrame(full, KINDS).repartition(3)


def result(frame: DataFrame) -> list[tuple]:
    return sorted(map(tuple, frame.collect()), key=repr)
