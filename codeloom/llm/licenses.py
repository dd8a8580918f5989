"""Licence notices in documents, with DataFrame functions only.

Windows as long as a template slide over a text; a window's set is the template vocabulary's
five-word shingles in it. BANDS bands of ROWS minimum hashes retrieve templates: a window that holds
PERCENT of a template's shingles has a similarity of at least that share with it, so it misses all
bands with a probability of at most (1 - 0.8^2)^16, below one in ten million. Retrieved pairs are
checked exactly: distinct template shingles in the window over distinct shingles of the template.

A template of over passages.LONGEST words is compared whole, too, but not in each of its windows:
windows that overlap by 1 - 1 / STRIDES of their length retrieve it, one of which holds all but a
STRIDES-th of any match, and running sums over the places of its shingles check all windows.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import passages
from codeloom.llm.common import sent_if_small
from codeloom.session import materialise

BANDS, ROWS, PERCENT = 16, 2, 80
STRIDES = 32
WINDOW = ["id", "body", "n", "start"]

#: Licence notices (fixed values): name, notice.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL", "it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
)


def bands(h="h"):
    """Aggregate column: array of (band, value) from minimum hashes of a group's shingles."""
    low = [F.min(F.xxhash64(F.lit(i), F.col(h))) for i in range(BANDS * ROWS)]
    return F.array(
        *[F.struct(F.lit(b).alias("band"), F.xxhash64(*low[b * ROWS : (b + 1) * ROWS]).alias("value")) for b in range(BANDS)]
    )


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(license, text) of (name, notice) pairs."""
    return spark.createDataFrame(list(templates), "license string, text string")


def long_templates(found, rows, size):
    """(id, item, common, total) of the windows that match a template of over LONGEST words, from its hits."""
    rows = materialise(rows.where(F.col("n") > passages.LONGEST).drop("count"), "long")
    if rows.isEmpty():
        return None
    step = F.ceil(F.col("n") / STRIDES).cast("int")
    first = F.greatest(F.ceil((F.col("pos") - F.col("n") + passages.SHINGLE) / F.col("step")), F.lit(0)).cast("int")
    cut = found.select("id", "body", "pos", "h").join(sent_if_small(materialise(rows.select("h", "n").distinct(), "long")), "h")
    cut = cut.withColumn("step", step).withColumn("start", F.explode(F.sequence(first, F.floor(F.col("pos") / F.col("step")).cast("int"))))
    cut = cut.groupBy("id", "body", "n", "start").agg(bands().alias("bands")).select("id", "body", "n", F.inline("bands"))
    keyed = size.select("item", "piece", "n", "total", F.inline("bands"))
    pairs = materialise(cut.join(keyed, ["n", "band", "value"]).select("id", "body", "item", "piece", "n", "total").distinct(), "pairs")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("id", "body")]
    both = found.drop("n", "least").alias("l").join(pairs.alias("r"), same).select("l.*", "item", "piece", "n", "total")
    both = both.join(rows, ["item", "piece", "n", "h"]).withColumns({"count": F.lit(1), "items": F.lit(1)})
    sums = passages.sliding(both).where(F.col("common") * 100 >= F.col("total") * PERCENT)
    return sums.select("id", "item", "common", "total")


def licenses(docs: DataFrame, templates: DataFrame, key="doc_id", text="text") -> DataFrame:
    """(id, license, share) of every document that holds a notice, the best window of each licence.

    ``templates`` has columns license and text. ``share`` is the part of the template's shingles in
    the window. Null and empty texts and notices with fewer than five words match nothing; repeated
    rows give one row; documents without an id can match, with a null id.
    """
    named = templates.select(F.struct("license", "text").alias("item"), "text").where("license is not null").distinct()
    rows = materialise(passages.known(named, pieces=False), "templates")
    size = rows.groupBy("item", "piece", "n").agg(F.count("*").alias("total"), bands().alias("bands"))
    size = materialise(size, "templates")
    least = size.groupBy("n").agg(F.ceil(F.min("total") * PERCENT / 100).cast("bigint").alias("least"))
    one = F.lit(1).cast("bigint").alias("w")
    vocabulary = rows.where(F.col("n") <= passages.LONGEST).select("h", "n", one).distinct().join(least, "n")
    long = rows.where(F.col("n") > passages.LONGEST).select("h", F.lit(0).alias("n"), one, F.lit(0).cast("bigint").alias("least"))
    vocabulary = materialise(vocabulary.select("h", "n", "w", "least").unionByName(long.distinct()), "vocabulary")
    hits = materialise(passages.hits(docs, sent_if_small(vocabulary), key, text), "hits")
    whole = long_templates(hits.where("n = 0"), rows, size)
    found = hits.where("n > 0")
    inside = materialise(passages.windows(found).select(*WINDOW, "h").distinct(), "windows")
    cut = inside.groupBy(*WINDOW).agg(bands().alias("bands")).select(*WINDOW, F.inline("bands"))
    keyed = sent_if_small(size, 200_000 // BANDS).select("item", "piece", "n", "total", F.inline("bands"))
    pairs = cut.join(keyed, ["n", "band", "value"]).select(*WINDOW, "item", "piece", "total").distinct()
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in WINDOW]
    both = inside.alias("l").join(pairs.alias("r"), same).select("l.*", "item", "piece", "total")
    both = both.join(sent_if_small(rows).select("item", "piece", "n", "h"), ["item", "piece", "n", "h"])
    sums = both.groupBy(*WINDOW, "item", "piece", "total").agg(F.count("*").alias("common"))
    sums = sums.where(F.col("common") * 100 >= F.col("total") * PERCENT)
    sums = sums.select("id", "item", "common", "total")
    sums = sums if whole is None else sums.unionByName(whole)
    best = F.max(F.col("common") / F.col("total")).alias("share")
    return sums.groupBy("id", F.col("item.license").alias("license")).agg(best)
