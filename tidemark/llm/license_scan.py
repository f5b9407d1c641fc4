"""License scans: MinHash bands of overlapping text windows retrieve templates, exact shingle containment verifies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plain_words

#: Short notices and well-known paragraphs of public licenses, as (license, text).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
SHINGLE_WORDS, CONTAINMENT = 5, 0.8
#: Shingles of a document's window, and the step between windows: every three neighbouring shingles lie in one window.
WINDOW, STEP = 4, 2
#: Bands of one row each. A window that holds all of a template's piece of k = 1, 2 or 3 shingles has a Jaccard
#: similarity of k / 4 or more with it, so it misses every band with a probability of (1 - k / 4) ^ 32: below 1e-9
#: for two or three shingles. One shingle would be missed too often (0.0001 at the start of a text, where it lies in one
#: window), so the hashes of single shingles are keys too: a template of one shingle is found for certain.
BANDS = 32


def templates_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    return spark.createDataFrame([tuple(t) for t in templates], "license string, text string")


def _shingle(words: Column, at: Column) -> Column:
    """The hash of five words from ``at`` on (null where they end before)."""
    return F.when(at + (SHINGLE_WORDS - 1) < F.size(words), F.xxhash64(*[F.get(words, at + i) for i in range(SHINGLE_WORDS)]))


def _shingles(words: Column) -> Column:
    """All distinct shingle hashes of an array of words."""
    last = F.size(words) - SHINGLE_WORDS
    every = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: _shingle(words, i))
    return F.array_distinct(F.filter(every, lambda h: h.isNotNull()))


def _band_key(shingles: list[str], band: Column) -> Column:
    """A band's MinHash: the smallest rehash of the window's shingles."""
    return F.least(*[F.when(F.col(s).isNotNull(), F.xxhash64(F.col(s), band)) for s in shingles])


def _banded(windows: DataFrame, columns: list[str], shingles: list[str], single: list[Column]) -> DataFrame:
    """A row per key: one of each band, and one of each shingle in ``single`` (null: none)."""
    bands = F.explode(F.array(*[F.lit(b) for b in range(BANDS + len(single))])).alias("band")
    band = F.col("band")
    key = F.when(band < BANDS, _band_key(shingles, band))
    for k, _ in enumerate(single):
        one = F.col(f"single{k}")
        key = key.when((band == BANDS + k) & one.isNotNull(), F.xxhash64(one, F.lit(BANDS)))
    spread = windows.select(*columns, *shingles, *[c.alias(f"single{k}") for k, c in enumerate(single)], bands)
    return spread.select(*columns, "band", key.alias("key")).where("key is not null")


def _key_at(words: Column, at: Column, count: int, band: Column) -> Column:
    """The key of a band at another place of the words, from ``count`` shingles (null for keys of single shingles)."""
    hashes = [F.xxhash64(s, band) for s in (_shingle(words, at + i) for i in range(count))]
    return F.when(band < BANDS, F.least(*[F.when(_shingle(words, at + i).isNotNull(), h) for i, h in enumerate(hashes)]))


def scan(docs: DataFrame, templates: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT, broadcast_keys: int = 2_000_000) -> DataFrame:
    """One row per (doc_id, license) found: doc_id, license, containment, first_word.

    Words are lower-cased and stand between ASCII blanks and punctuation; shingles are five words. A document holds a
    license if, at some alignment with a template of it, the stretch beside the template (wider by a fifth at both
    sides) has at least ``containment`` of the template's distinct shingles. ``containment`` is the largest such share
    and ``first_word`` the position at which the earliest stretch with that share begins (a word number from 0).

    Every whole text is cut into overlapping windows of shingles, a window gives one key per band, and keys that equal
    a template piece's retrieve the template at an alignment; each shingle's hash is a key besides, which retrieves
    templates of one shingle. All steps are built-in expressions that run in one pass
    over the texts, and only hits are shuffled. A document with enough of a template holds an unbroken run of three of
    its shingles (all, if it has fewer), for which the bands are set. Template keys are broadcast where they number
    ``broadcast_keys`` at most; a larger collection is met by a shuffle join of (id, position, key) rows.

    Null texts, and texts or templates of fewer than five words, match nothing. Repeated rows give one result row, null
    ids are reported as null. Empty tables give an empty result.
    """
    cut = templates.select("license", plain_words(F.col("text")).alias("t_words")).where(F.size("t_words") >= SHINGLE_WORDS).distinct()
    known = cut.withColumn("t_shingles", _shingles(F.col("t_words"))).withColumn("template", F.xxhash64("license", "t_words")).withColumn("t_size", F.size("t_words"))
    count = F.size("t_words") - (SHINGLE_WORDS - 1)
    pieces = known.select("template", "t_size", "t_words", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), count - 3))).alias("t_at"))
    t_names = [f"t{i}" for i in range(3)]
    pieces = pieces.select("template", "t_size", "t_words", "t_at", *[_shingle(F.col("t_words"), F.col("t_at") + i).alias(n) for i, n in enumerate(t_names)])
    banded = _banded(pieces, ["template", "t_size", "t_words", "t_at"], t_names, [F.when(F.col("t_size") == SHINGLE_WORDS, F.col(t_names[0]))])
    before = F.when(F.col("t_at") >= STEP, _key_at(F.col("t_words"), F.col("t_at") - STEP, len(t_names), F.col("band")))
    # equal keys of a template are a row: what goes on from a step before is told apart
    keys = banded.withColumn("before", before).groupBy("key", "band", "before", "template", "t_size").agg(F.collect_set("t_at").alias("t_ats"))
    few = (keys.agg(F.sum(F.size("t_ats"))).first()[0] or 0) <= broadcast_keys

    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), plain_words(F.col(text_col)).alias("words"))
    last = F.size("words") - SHINGLE_WORDS
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(STEP)))
    names = [f"s{i}" for i in range(WINDOW)]
    placed = texts.select("doc_id", "text_key", "words", F.explode(starts).alias("at"))
    windows = placed.select("doc_id", "text_key", "words", "at", *[_shingle(F.col("words"), F.col("at") + i).alias(n) for i, n in enumerate(names)])

    own = [F.col(s) for s in names[:STEP]]  # those that the next window does not begin with

    slack = F.ceil(F.col("t_size") / 5).cast("int")
    # a window's position less the piece's is the alignment, give or take a step; a hit that goes on from the one a step
    # before, in its band, has the same alignment and is left to that one
    start = F.col("at") - F.col("t_at")
    goes_on = F.coalesce(F.col("before") == F.when(F.col("at") >= STEP, _key_at(F.col("words"), F.col("at") - STEP, WINDOW, F.col("band"))), F.lit(False))
    if few:
        hits = _banded(windows, ["doc_id", "words", "at"], names, own).join(F.broadcast(keys.withColumnRenamed("band", "_band")), "key").where(F.col("_band") == F.least("band", F.lit(BANDS)))
        hits = hits.where(~goes_on).select("doc_id", "words", "at", "template", "t_size", F.explode("t_ats").alias("t_at"))
        regions = hits.select("doc_id", "template", start.alias("start"), _region(F.col("words"), start, F.col("t_size"), slack).alias("region")).distinct()
    else:
        # by the text, so that rows without an id or with one that repeats meet their own text alone
        spread = _banded(windows, ["text_key", "words", "at"], names, own)
        prior = F.when(F.col("at") >= STEP, _key_at(F.col("words"), F.col("at") - STEP, WINDOW, F.col("band")))
        met = spread.select("text_key", "at", "band", "key", prior.alias("prior")).join(keys.withColumnRenamed("band", "_band"), "key").where(F.col("_band") == F.least("band", F.lit(BANDS)))
        met = met.where(~F.coalesce(F.col("before") == F.col("prior"), F.lit(False))).select("text_key", "template", "t_size", "at", F.explode("t_ats").alias("t_at"))
        met = met.select("text_key", "template", "t_size", start.alias("start")).distinct()
        regions = met.join(texts, "text_key").select(
            "doc_id", "template", "start", _region(F.col("words"), F.col("start"), F.col("t_size"), slack).alias("region")
        ).distinct()
    right = known.select("template", "license", "t_shingles")
    scored = regions.join(F.broadcast(right) if few else right, "template").withColumn(
        "share", F.size(F.array_intersect("t_shingles", _shingles(F.col("region")))) / F.size("t_shingles")
    )
    found = scored.where(F.col("share") >= containment)
    best = F.max(F.struct("share", -F.greatest(F.col("start"), F.lit(0)))).alias("best")
    return found.groupBy("doc_id", "license").agg(best).select("doc_id", "license", F.col("best.share").alias("containment"), (-F.col("best.col2")).cast("long").alias("first_word"))


def _region(words: Column, start: Column, size: Column, slack: Column) -> Column:
    """The words beside a template and ``slack`` plus one window more at both sides."""
    low = F.greatest(F.lit(0), start - slack - WINDOW)
    return F.slice(words, low + 1, F.greatest(F.lit(0), start + size + slack + WINDOW - low))
