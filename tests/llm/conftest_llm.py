"""Rows that the tests of this folder share."""

import random

from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"

#: Columns that operators could also make, to see that they never meet.
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("mark", T.LongType()),
    T.StructField("ids", T.StringType()), T.StructField("start", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("row", T.StringType()),
])


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("aeioustrnlm", k=draw.randint(1, 9))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls, empty and long texts, ties, repeated rows, copies, signs that white space and tokenizers differ on."""
    same = prose(1, 120)
    found = [
        (1, same), (2, same), (2, same), (3, None), (4, ""), (5, " \n\t "), (6, "word"), (7, prose(2, 30) + "\n" + same + "\n" + prose(3, 30)),
        (8, "a " * 3000), (9, "x" * 30000), (10, "Ünïcode   \x1c\x85 <|endoftext|> 日本語 😀\n\n\r\n'tis it's"), (11, prose(4, 20000)),
        (None, prose(5, 60)), (None, None), (12, prose(6, 200)), (12, prose(7, 200)), (13, "ab" * 400 + prose(8, 40) + "ab" * 300),
        (14, prose(1, 119) + " changed"), (-5, prose(9, 80)), (2**62, prose(9, 80)), (15, "!!! ??? ---\n" * 5),
    ]
    return [(i, t, None, "s", None, 7, "x", "y", "z", "r") for i, t in found]


def small_rows(spark, name="documents"):
    return [r.asDict() for r in spark.read.parquet(f"{SMALL}/{name}.parquet").collect()]
