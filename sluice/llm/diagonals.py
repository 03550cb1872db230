"""License scans by diagonal voting, in DataFrame functions only.

Rolling hashes of two and of three words of every text meet those of the templates; a hit of text position
p on template position t votes for the diagonal p - t. All votes for one diagonal are one place where the
template's words stand in order; where words were put in or left out, the template goes on on a neighbouring
diagonal. So each diagonal with votes counts by the share of the template's grams found on it and on those
near it, each gram's words compared as words, and the best of neighbours is a span.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import text_of

#: What no word holds: all of ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    base: bool = False


PHRASES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)
TEMPLATES = (
    Template("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("public-domain", "this is free and unencumbered software released into the public domain"),
)
#: The forms in which a single line states a license; those of four words need all of them.
STATEMENTS = (
    Template("apache", "under the apache license"),
    Template("apache", "under the apache 2 0 license"),
    Template("bsd", "under the bsd license"),
    Template("bsd", "under the bsd 2 clause license"),
    Template("bsd", "under the bsd 3 clause license"),
    Template("cc-by", "licensed under cc by 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("gpl", "under the gnu general public license"),
    Template("isc", "under the isc license"),
    Template("mit", "under the mit license"),
    Template("mpl", "under the mozilla public license"),
    Template("public-domain", "is released into the public domain"),
)
GRAM = {True: 2, False: 3}
STRETCH = 4096


def _lower_ascii(text):
    """Lower case of A-Z only, as far as words of ASCII letters go: the two letters whose lower case
    would become an ASCII letter take the slow way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    odd = F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212a"))
    return F.when(odd, F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def words_of(text):
    return F.array_remove(F.split(_lower_ascii(text), BETWEEN), "")


def template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """A row for each gram of each template: template, label, base, at (its position), of (how many), hash, gram."""
    rows = []
    for k, t in enumerate(templates):
        words, n = t.words.split(), GRAM[t.base]
        if len(words) < n:
            raise ValueError(f"a template has {n} words at least: {t.words}")
        rows += [(k, t.label, t.base, at, len(words) - n + 1, words[at : at + n]) for at in range(len(words) - n + 1)]
    frame = spark.createDataFrame(rows, "template int, label string, base boolean, at int, of int, gram array<string>")
    pair, triple = F.xxhash64(F.get("gram", 0), F.get("gram", 1)), F.xxhash64(F.get("gram", 0), F.get("gram", 1), F.get("gram", 2))
    return frame.withColumn("hash", F.when(F.size("gram") == 2, pair).otherwise(triple))


def scan(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + TEMPLATES + STATEMENTS, slack: int = 4, share: float = 0.6) -> DataFrame:
    """Spans: a row for each (row, doc_id, n_words, label, base, first, last, coverage), and with null label where
    there is none; row numbers docs' rows.

    slack: diagonals at most so far apart are neighbours. share: of the template's grams that a diagonal and its
    neighbours must hold together to be a span (a base phrase needs all, on one diagonal). Of spans on
    neighbouring diagonals the one of most grams counts, of equal ones that of the lower diagonal. A null text is
    empty, other columns aren't read, repeated rows stay apart, an empty table gives no rows. The templates are a
    parameter and broadcast; only hits are shuffled, and a very long text's are dealt out in stretches of
    STRETCH diagonals, with the few next to each.
    """
    spark = docs.sparkSession
    grams = template_grams(spark, templates)
    known = {n: sorted({r["hash"] for r in grams.where(F.size("gram") == n).select("hash").collect()}) for n in (2, 3)}
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words_of(text_of()).alias("words"))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))

    def hits(n: int):
        if not known[n]:
            return F.expr("cast(array() as array<struct<pos:int,hash:bigint,found:array<string>>>)")
        hash_ = f"xxhash64({', '.join(f'words[i + {k}]' for k in range(n))})"
        among = ", ".join(f"{h}L" if h >= 0 else f"-{-h}L" if h > -(1 << 63) else "bigint('-9223372036854775808')" for h in known[n])
        at = f"filter(sequence(0, n_words - {n}), i -> {hash_} in ({among}))"
        return F.expr(f"if(n_words < {n}, array(), transform({at}, i -> struct(int(i) as pos, {hash_} as hash, slice(words, i + 1, {n}) as found)))")

    exploded = rows.withColumn("words", F.when(F.col("n_words") > 0, F.col("words")).otherwise(F.array().cast("array<string>")))
    exploded = exploded.select("row", "doc_id", "n_words", F.explode_outer(F.concat(hits(2), hits(3))).alias("hit"))
    exploded = exploded.select("row", "doc_id", "n_words", "hit.*")
    met = exploded.join(F.broadcast(grams), (exploded["hash"] == grams["hash"]) & (exploded["found"] == grams["gram"]), "left")
    keys = ("row", "doc_id", "n_words", "template", "label", "base", "of", "stretch")
    diagonal = (F.col("pos") - F.col("at")).cast("long")
    votes = met.withColumn("diagonal", diagonal).withColumn("stretch", F.floor(F.col("diagonal") / STRETCH))
    votes = votes.groupBy(*keys, "diagonal").agg(F.collect_set("at").alias("found_at"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    # A diagonal's own stretch, and the one that it is within reach of: twice slack, as neighbours' neighbours decide.
    reach = F.sequence(F.floor((F.col("diagonal") - 2 * slack) / STRETCH), F.floor((F.col("diagonal") + 2 * slack) / STRETCH))
    own = F.col("stretch")
    dealt = votes.withColumn("home", own).withColumn("stretch", F.explode(F.when(F.coalesce("base", F.lit(True)), F.array(own)).otherwise(reach)))
    near = Window.partitionBy("row", "template", "stretch").orderBy("diagonal").rangeBetween(-slack, slack)
    alone = F.coalesce("base", F.lit(True))
    found = F.when(alone, F.size("found_at")).otherwise(F.size(F.array_distinct(F.flatten(F.collect_list("found_at").over(near)))))
    first, last = (F.when(alone, F.col(c)).otherwise(f(c).over(near)) for c, f in (("first", F.min), ("last", F.max)))
    merged = dealt.select(*keys, "diagonal", "home", found.alias("n"), first.alias("first"), last.alias("last"))
    best = F.max(F.struct(F.col("n"), (-F.col("diagonal")).alias("low"))).over(near)
    merged = merged.withColumn("best", alone | (best["low"] == -F.col("diagonal"))).where("template is null or stretch = home")
    coverage = F.col("n") / F.col("of")
    holds = F.col("template").isNotNull() & F.col("best") & F.when(F.col("base"), F.col("n") == F.col("of")).otherwise(coverage >= share)
    kept = lambda c: F.when(holds, c)
    size = F.when(F.col("base"), 2).otherwise(3)
    return merged.select(
        "row", "doc_id", "n_words", kept(F.col("label")).alias("label"), kept(F.col("base")).alias("base"), kept(F.col("first").cast("long")).alias("first"),
        kept((F.col("last") + size - 1).cast("long")).alias("last"), F.when(F.col("template").isNotNull(), coverage).otherwise(0.0).alias("coverage"),
    )


def summary(spans: DataFrame) -> DataFrame:
    """A row for each scanned row: how many base phrases, where the first and last begin, the labels, the best coverage."""
    base = F.col("base")
    label_list = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(F.coalesce(base, F.lit(False))).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        label_list(F.when(base, F.col("label"))).alias("base_labels"),
        label_list("label").alias("labels"),
        F.max("coverage").alias("score"),
    ).drop("row")
