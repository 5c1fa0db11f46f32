import random

import pytest

#: Documents with every awkward case, and extra columns whose names operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, shard int, kept boolean"
CLASHES = {"row": "string", "key": "long", "fp": "long", "hash": "long", "crc": "string", "parts": "int", "part": "int", "n": "long", "lang_pred": "int", "_found": "string", "_kept": "boolean", "_key": "string", "_part": "int", "_size": "double"}
SCHEMA += "".join(f", {name} {kind}" for name, kind in CLASHES.items())
EXTRA = {"string": "own", "long": 7, "int": 3, "boolean": False, "double": 0.25}


def prose(seed: int, words: int, stems: str = "lo mi ra ten gu sel vor pha kin dru") -> str:
    rng = random.Random(seed)
    parts = stems.split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(words))


def awkward_rows() -> list[tuple]:
    long_text = prose(1, 30_000)
    texts = [
        (1, prose(2, 120), "aa", "s1"),
        (2, prose(2, 120), "aa", "s1"),  # an equal text
        (3, prose(2, 119) + " changed", "aa", None),
        (4, None, "aa", "s2"),
        (5, "", None, "s2"),
        (6, " \n\t \n", "bb", "s3"),
        (None, prose(3, 60), "bb", "s3"),
        (None, None, None, None),
        (7, long_text, "bb", "s1"),
        (8, "one two", "bb", "s2"),
        (8, "one two", "bb", "s2"),  # a repeated row
        (9, "Ä ö # * $ % & | < > same same same same same same", "bb", "s4"),
        (10, "same line\nsame line\n\n\nother\nsame line", "aa", "s4"),
        (11, prose(11, 400, "che vos nir ael umb"), "bb", "s3"),
    ]
    own = [EXTRA[kind] for kind in CLASHES.values()]
    return [(i, t, lang, src, None if t is None else len(t), -1, 0.5, 99, True, *own) for i, t, lang, src in texts]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
