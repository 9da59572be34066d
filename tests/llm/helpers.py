"""Small documents with every hard case, and brute-force components."""

import public_tokenizers
from pyspark.sql import types as T

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

LONG = "lorem ipsum dolor sit amet " * 8000
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use for themselves
    *[T.StructField(n, T.StringType()) for n in ("doc", "row", "digest", "size", "score", "draw", "bucket", "r", "fingerprint", "target", "start", "odd name, x")],
])
ROWS = [
    (1, "Hello World one two three", "en", "a", 1), (2, "hello world ONE two three", "en", "a", 1),
    (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \t\n ", None, "b", 3),
    (6, LONG, "la", "a", 2), (7, LONG, "la", None, 2), (8, "short", "en", "c", 5), (8, "short", "en", "c", 5),
    (None, "short", "en", "c", 5), (None, None, None, None, None), (9, "1234 5678 !!", None, "c", 1),
    (10, "één <|endoftext|> 日本 ’s it's", "nl", "d", 1),
]


def hard(spark):
    return spark.createDataFrame([r + tuple("x" * 12) for r in ROWS], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def components(items, linked):
    """Smallest item reachable from each by the links of all pairs."""
    label = {i: i for i in items}
    changed = True
    while changed:
        changed = False
        for a in items:
            for b in items:
                if a != b and linked(a, b) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label
