"""Rows with everything that real tables have: nulls, empty and long texts, ties, repeats, clashing names."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    ]
    # Names that the operators use inside.
    + [T.StructField(n, T.StringType()) for n in ("key", "digest", "content", "set_id", "bin", "row", "span", "grams", "shard", "spans", "score", "token_ids", "of", "size", "copies", "__key", "__n", "__score", "row_key", "kinds", "n_tokens", "decoded", "paths", "tree", "bin_", "nth", "collided", "low")]
)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdeghiklmnoprstu") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def texts():
    rng = random.Random(4)
    base = sentence(rng, 160)
    words = base.split()
    out = [None, "", " ", "\n\t ", base, base, base.replace(" ", "  "), " " + base, base + " tail", " ".join(words[:80] + ["changed"] + words[81:]), " ".join(words[:-12])]
    out += [sentence(rng, rng.randrange(1, 60)) for _ in range(30)]
    out += [sentence(rng, 30) + " " + base[100:420] + " " + sentence(rng, 20) for _ in range(4)]
    out += ["x" * 700, "ab" * 500, "one two three", "one two three", "a b c d", sentence(rng, 9000)]
    out += ['my PassWord = "hunter2-abcdef" and token=token:abcdefgh', "key AKIA" + "A1B2" * 5 + " " + "0f" * 20, "-----BEGIN RSA PRIVATE KEY----- https://u:secretpw@host/", "é password: geheim99 日本"]
    out += ["Licensed under the Apache License, Version 2.0.", "Released under the MIT license. CC BY-NC 4.0 license", "licensed under a cc by nc sa 4 0 license; under the mit license under the mit license"]
    out += ["idiot trash you moron", "don't I'LL <|endoftext|> ΣΑΣ x\x1cy é \x85 日本"]
    return out


def rows():
    t = texts()
    out = [(i, x, "en", f"s{i % 4}" if i % 7 else None, None if x is None else len(x)) for i, x in enumerate(t)]
    out += [out[4], out[4], (None, t[4], None, "s0", 1), (None, None, None, None, None), (5000, t[20], "en", "s0", 3)]
    return out


#: No double is this number.
BIG = 2**53 + 1


def beside_null(spark):
    """One batch with an id that doubles can't hold beside a null one, and columns of types that pandas or Arrow can't hold."""
    text = sentence(random.Random(9), 120)
    rows = spark.createDataFrame([(BIG, text, "en", "s0", BIG), (None, text[:500], "en", "s0", None), (BIG + 2, text + " more", "en", "s1", 3), (4, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.coalesce(1).selectExpr(
        "*", "timestamp '9999-12-31 23:59:59' AS last", "interval '3' month AS months", "interval '3 4:05:06.789' day to second AS spell", "map('a', n_chars) AS numbers", "CAST(n_chars AS decimal(30, 5)) AS exact",
    )


def docs(spark, given=None):
    padded = [r + ("z",) * (len(SCHEMA) - 5) for r in (rows() if given is None else given)]
    return spark.createDataFrame(padded, SCHEMA).repartition(3)
