"""Small inputs with everything that may go wrong in them."""

from __future__ import annotations

import random

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "lorem ipsum dolor sit amet " * 8000

ODD = [
    (1, "The quick brown fox jumps over the lazy dog again and again today"),
    (2, "the QUICK brown fox jumps over the lazy dog again and again today"),
    (3, None),
    (4, ""),
    (5, "   \n\t "),
    (6, "one"),
    (6, "one"),
    (7, "ÀÉÎ àéî ß 日本語 🙂"),
    (8, LONG),
    (9, LONG),
    (None, "a row without a number, but with a text"),
    (None, None),
    (10, "x" * 5000),
    (11, "<|endoftext|> don't stop\r\nnow  double  space"),
]


def frame(spark, rows=ODD, schema="doc_id long, text string"):
    """Documents with columns that clash with what operators name theirs."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, schema)
    for name in ("id", "rid", "fp", "n", "kind", "score", "kept", "component_id", "lang", "source", "cell", "word", "sha"):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(name))
    return docs.repartition(3)


def empty(spark, schema="doc_id long, text string, lang string"):
    return spark.createDataFrame([], schema)


def components(nodes, linked):
    """Smallest reachable node of each, by plain union-find."""
    root = {x: x for x in nodes}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}


def near_copies(seed=0, groups=6, copies=9, words=120, edits=3, lone=40):
    """Documents in groups of near copies, some of them chained, and others."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out, number = [], 0
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(copies * (4 if g == 0 else 1)):
            own = list(base)
            for _ in range(rng.randrange(edits + 1)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if g % 2:
                base = own
            out.append((number, " ".join(own)))
            number += 1
    for _ in range(lone):
        out.append((number, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60)))))
        number += 1
    rng.shuffle(out)
    return out
