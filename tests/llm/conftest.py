"""Small tables with the cases every operator must stand: nulls, empty and very long texts, ties, repeats, extra columns."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from samples import sentence  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _text string, _row string, rep string"
def rows_of(items):
    return [(i, t, "en", "src0", None if t is None else len(t), "clash", "clash", None) for i, t in items]


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): copies, near copies, shared passages, odd rows."""
    rng = random.Random(11)
    out = [(k, sentence(rng, rng.randint(20, 120))) for k in range(1, 40)]
    passage = sentence(rng, 30)
    out += [(k, f"{sentence(rng, 15)}\n{passage}\t{sentence(rng, 15)}") for k in range(40, 48)]
    for k in range(48, 60):  # near copies of 3
        words = out[2][1].split()
        words[rng.randrange(len(words))] = f"changed{k}"
        out.append((k, " ".join(words)))
    out += [(60, out[4][1]), (61, out[4][1]), (61, out[4][1])]  # copies and a repeated row
    out += [(62, None), (63, ""), (64, " \n\t "), (65, "one"), (66, "one two"), (None, out[5][1]), (None, None)]
    out += [(67, "é🙂 " * 30_000), (68, "x" * 200_000), (69, "ÀÉ\u0085 mixed  blanks   here"), (70, "\x00 nul and % _ ' \" \\ \r\n signs")]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session", autouse=True)
def fallback_folders(spark):
    from kinetable.shipping import ship

    ship(spark)
