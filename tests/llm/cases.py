"""Small tables with awkward rows, and plain forms of what the operators compute."""

from __future__ import annotations

import random

WORDS = "the and river stone garden window yellow quiet morning letter paper house little walked under over bright of to in".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, pos string, w double, q_kept string"


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + r.choice(("", "", "", str(r.randint(0, 99)))) for _ in range(n))


def rows(seed: int = 3, n: int = 60) -> list[tuple]:
    """Prose with copies, near copies, shared passages, nulls, empty and long texts, repeated rows, clashing column names."""
    r = random.Random(seed)
    shared = prose(r, 45)
    texts = [prose(r, r.choice((3, 10, 60, 120, 300))) for _ in range(n)]
    texts[5] = texts[3]
    texts[8] = texts[3] + " once"
    texts[9] = texts[4].replace("the", "The", 1)
    texts[10:20] = [prose(r, 30) + " " + shared + "\n" + prose(r, 20) for _ in range(10)]
    texts[20] = " \t\n"
    texts[21] = ""
    texts[22] = None
    texts[23] = None
    texts[24] = prose(r, 6000)
    texts[25] = "a b"
    texts[26] = "same line\n" * 40
    texts[27] = "Übung ñandú \U0001f600 naïve#tag <b>&amp; $5 " * 20
    texts[28] = "x" * 50_000
    out = [(i, t, "en", None if i % 7 == 0 else "src" + str(i % 5), len(t or ""), i, str(i), 0.5, "no") for i, t in enumerate(texts)]
    out[30] = (None, *out[30][1:])
    out[31] = (None, *out[31][1:])
    out[32] = (None, None, *out[32][2:])
    out.append(out[12])
    out.append(out[12])
    return out


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split_words(text: str | None) -> list[str]:
    return [w.decode("utf-8") for w in (text or "").encode("utf-8").split()]
