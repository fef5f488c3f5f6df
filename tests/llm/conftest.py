from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # columns of the operators' own names, which must not disturb them
    T.StructField("row", T.StringType()), T.StructField("rid", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("size", T.StringType()),
    T.StructField("kept", T.IntegerType()), T.StructField("rank", T.StringType()), T.StructField("words", T.StringType()),
])

WORDS = {"en": "the of and to in that is was for with as on be at by this had not are but from or have an they which".split(), "de": "der die und das ist nicht mit für auf ein eine sich über größe schön weiß müssen hätte".split()}


def prose(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) + ("." if rng.random() < 0.05 else "") for _ in range(n))


def awkward() -> list[tuple]:
    """Rows (doc_id, text, lang, source) with nulls in every column, empty, repeated, tied and very long texts."""
    rng = random.Random(8)
    base = [prose(rng, "en" if i % 2 else "de", 60 + i) for i in range(12)]
    near = base[3].split()
    near[10:12] = ["altered", "words"]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [
        (20, "", "en", "s0"), (21, None, None, None), (22, "   \n\t ", None, "s1"), (23, "42 -- 17!", "en", None), (None, "without an id, but with a text", None, "s0"), (None, None, None, None),
        (24, base[1], "en", "s1"), (25, base[1].replace(" ", "\n\t", 3), "en", "s1"), (25, base[1].replace(" ", "\n\t", 3), "en", "s1"), (5, base[5], "en", "s2"),
        (26, " ".join(near), "en", "s0"), (27, (prose(rng, "en", 400) + "\n") * 100, "en", "s0"), (28, "x" * 200_000, None, "s2"), (29, "9" * 50_000 + "@" * 3, None, "s2"), (30, "<|endoftext|> <|ENDOFTEXT|>é́ …!", None, "s2"),
    ]
    line = "This very line stands in many of the documents here."
    rows += [(40 + i, f"{line if i % 2 else '  ' + line.upper() + chr(13)}\n{prose(rng, 'en', 8)} {i}\n{line}", "en", "s0") for i in range(6)]
    return rows


@pytest.fixture(scope="session")
def awkward_rows():
    return awkward()


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, None if t is None else len(t), "r", None, "d", None, 3, None, "w") for d, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, awkward_rows, tmp_path_factory):
    """The awkward rows in several files."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    frame(spark, awkward_rows).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
