"""Small rows with the awkward cases: nulls, empty and very long texts, ties, equal rows, clashing column names."""

import random
import re

LICENSE = "Licensed under the Apache License, Version 2.0."


def texts(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["the", "of", "Être", "日本語", "it's", "don't", "a,b", "$$$", "1234", "naïve", " x"]
    rows = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    rows += [None, "", " \t\n", "x", rows[0], rows[0].upper(), rows[1] + "\n" + LICENSE, "A" * 70_000, " ".join(["long words here."] * 20_000)]
    rows += ["<|endoftext|> inside <|endoftext|>", "line\n\nline \r\n end", "All rights reserved. CC BY general public license\tv3"]
    return rows


def documents(spark, rows=None, extra=True):
    """doc_id, text, source and columns whose names operators use themselves; ids repeat, and one is null."""
    rows = texts() if rows is None else rows
    data = [(i, t, [None, "b", "a", "a", ""][i % 5], "own", i) for i, t in enumerate(rows)]
    data += [(3, rows[3], "b", "own", 3), (3, rows[3], "b", "own", 3), (None, "no id", "a", "own", -1)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, kept string, size int")
    return df if extra else df.drop("kept", "size")


def empty(spark):
    return documents(spark, ["", "", "", ""]).filter("false")


def lower_az(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
