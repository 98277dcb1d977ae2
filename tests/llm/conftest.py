import random

import pytest
from pyspark.sql import types as T

# Names that operators use inside: none of them may matter.
EXTRA = ("body", "key", "row", "rows", "gram", "place", "copy", "kept", "prefix", "score", "bands", "size", "part")


def texts():
    """Small corpus with nulls, white space, ties, repeated rows, near copies and a long text."""
    rnd = random.Random(7)
    words = ["w%d" % i for i in range(400)] + ["Größe", "É", "naïve", "end."]

    def prose(n):
        return " ".join(rnd.choice(words) for _ in range(n))
    base, shared = prose(300), prose(70)
    near = base.split()
    near[150] = "changed"
    out = [None, "", " \n\t ", base, base, base + "  ", " ".join(near), base.replace(" ", "\n", 40), "one", "ONE", "one two",
           "spam " * 400, prose(20) + " " + shared + " " + prose(30), prose(90) + " " + shared, shared, prose(3000),
           "x" * 5000, base.upper(), "  lead and\t\ttrail  ", " em space  two", "<|endoftext|> a <|endoftext|>"]
    for k in range(12):
        w = base.split()
        for _ in range(k):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source) rows; the last repeats the one before it whole."""
    rows = [(3 * i % 101, t, None if i % 5 == 0 else "en", [None, "b", "a", "é"][i % 4]) for i, t in enumerate(texts())]
    return rows + rows[-1:]


def frame(spark, rows, extra=True):
    names = EXTRA if extra else ()
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
                          + [T.StructField(c, T.StringType()) for c in names])
    return spark.createDataFrame([(*r, *[None] * len(names)) for r in rows], schema)


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return frame(spark, corpus).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def no_ids(spark, corpus):
    """The corpus and some of its rows again without an id."""
    return frame(spark, corpus + [(None, *r[1:]) for r in corpus[:8]])
