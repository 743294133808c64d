"""Licence scans by a positional rare-token index.  DataFrame functions only.

Words are runs of a-z, digits and non-ASCII characters after A-Z are lowered.  Base labels come
from three phrases.  The method adds labels of its own from a list of templates (notices, headings
and SPDX tags):

1. The words of all templates are ranked by their inverse document frequency over all documents (a
   rank, so it holds however frequent a licence is).  The rarest mandatory word of each template looks
   up the files that may hold it (all that do have it).
2. Those files' words meet the postings (word -> template, position) of each template's rarest words
   and of its mandatory phrases.  Postings that agree on the offset text position - template position
   intersect there.
3. A template is found where, at one offset, every word of its mandatory phrases stands in its place
   and enough of its rarest words do.  So a version number counts within its own notice only, and a
   licence that is merely mentioned is none.

The templates are a fixed list, so postings and frequencies that are broadcast or inlined have
a fixed size.  Votes are counted per row, so rows that share an id or have none keep apart.

Defined results: null and empty texts have no words, no labels and score 0; very long texts are read
whole; rows without an id and repeated rows are scanned and reported each; of words equally rare the
first by name counts as rarer; an empty table yields no rows; further columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.llm._common import table, written

#: Phrases of the base result and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Template text (public licence wordings), label, phrases that must stand in the text.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "mit", ["permission is hereby granted free of charge"]),
    ("released under the mit license", "mit", ["mit license"]),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc", ["permission to use copy modify and or distribute this software"]),
    ("licensed under the apache license version 2 0", "apache-2", ["apache license version 2"]),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2", ["apache license version 2"]),
    ("this work is licensed under the gnu general public license version 3", "gpl-3", ["gnu general public license", "version 3"]),
    ("this work is licensed under the gnu general public license version 2", "gpl-2", ["gnu general public license", "version 2"]),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl-3", ["gnu general public license as published by", "version 3"]),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gpl-2", ["gnu general public license as published by", "version 2"]),
    ("licensed under the gnu lesser general public license", "lgpl", ["gnu lesser general public license"]),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl", ["gnu lesser general public license"]),
    ("licensed under the gnu affero general public license", "agpl", ["gnu affero general public license"]),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice", "bsd", ["redistribution and use in source and binary forms"]),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", ["redistribution and use in source and binary forms"]),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl-2", ["mozilla public license"]),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2", ["mozilla public license"]),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unlicense", ["free and unencumbered software released into the public domain"]),
    ("distributed under the boost software license version 1 0", "bsl-1", ["boost software license"]),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose", "zlib", ["in no event will the authors be held liable"]),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0", ["waived all copyright and related or neighboring rights"]),
    ("licensed under cc by nc 4 0", "cc-by-nc", ["cc by nc"]),
    ("licensed under cc by sa 4 0", "cc-by-sa", ["cc by sa"]),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by", ["creative commons attribution", "international license"]),
    ("gnu general public license version 3 29 june 2007", "gpl-3", ["gnu general public license version 3 29 june 2007"]),
    ("gnu general public license version 2 june 1991", "gpl-2", ["gnu general public license version 2 june 1991"]),
    ("gnu lesser general public license version 3 29 june 2007", "lgpl", ["gnu lesser general public license version 3 29 june 2007"]),
    ("gnu lesser general public license version 2 1 february 1999", "lgpl", ["gnu lesser general public license version 2 1 february 1999"]),
    ("gnu affero general public license version 3 19 november 2007", "agpl", ["gnu affero general public license version 3 19 november 2007"]),
    ("apache license version 2 0 january 2004", "apache-2", ["apache license version 2 0 january 2004"]),
    ("mozilla public license version 2 0 1 definitions", "mpl-2", ["mozilla public license version 2 0 1 definitions"]),
    ("mit license copyright c", "mit", ["mit license copyright c"]),
    ("isc license copyright c", "isc", ["isc license copyright c"]),
    ("boost software license version 1 0 august 17th 2003", "bsl-1", ["boost software license version 1 0 august 17th 2003"]),
]
#: Identifiers behind the SPDX tag, as words, and their labels.
SPDX = {
    "mit": "mit", "isc": "isc", "apache 2 0": "apache-2", "gpl 2 0": "gpl-2", "gpl 3 0": "gpl-3", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl", "agpl 3 0": "agpl", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "mpl 2 0": "mpl-2",
    "unlicense": "unlicense", "bsl 1 0": "bsl-1", "zlib": "zlib", "cc0 1 0": "cc0", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "cc by nc 4 0": "cc-by-nc",
}
TEMPLATES += [(f"spdx license identifier {name}", label, [f"spdx license identifier {name}"]) for name, label in SPDX.items()]
#: Words by which each template is known, its rarest; the share of them that must agree, of templates under ``SHORT`` words and of longer ones.
RARE_WORDS = 12
SHORT, AGREEMENT_SHORT, AGREEMENT = 16, 0.8, 0.6


def _padded(text: str) -> Column:
    """The words of a text, each preceded by one space, and one space at the end.

    ``lower`` also changes letters outside A-Z; no ASCII letter of a phrase comes from those,
    and they stay word characters, so places and counts are the same.
    """
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def _spaces(x: Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("long")


def _vocabulary() -> list[str]:
    return sorted({w for t, *_ in TEMPLATES for w in t.split(" ")})


def _marked(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Padded words and base results of every row, with a number of its own."""
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), _padded(text).alias("p"))
    base = base.withColumn("n_words", F.when(F.length("p") > 2, _spaces(F.col("p")) - 1).otherwise(F.lit(0).cast("long")))
    for k, phrase in enumerate(PHRASES):
        gaps = F.when(F.contains("p", F.lit(f" {phrase} ")), F.split("p", f" {phrase}(?= )", -1))
        base = base.withColumn(f"g{k}", gaps)
    size = lambda k: F.coalesce(F.size(f"g{k}") - 1, F.lit(0)).cast("long")
    first = lambda k: F.when(F.col(f"g{k}").isNotNull(), _spaces(F.get(f"g{k}", F.lit(0))))
    last = lambda k, phrase: F.when(F.col(f"g{k}").isNotNull(), F.col("n_words") - (_spaces(F.element_at(f"g{k}", -1)) - 1) - len(phrase.split(" ")))
    ks = range(len(PHRASES))
    found = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"g{k}").isNotNull(), F.lit(v)) for k, v in enumerate(PHRASES.values())])))
    return base.select(
        "row", "id", "p", "n_words", reduce(Column.__add__, map(size, ks)).alias("n_base"),
        F.least(*map(first, ks)).alias("first_word"), F.greatest(*[last(k, x) for k, x in enumerate(PHRASES)]).alias("last_word"), found.alias("base"),
    )


def _postings(df: dict[str, int]) -> tuple[list[tuple[str, int, int, bool, bool]], list[str]]:
    """Rows (word, template, position, rare, mandatory), and the words that look files up."""
    rows, looked_up = [], set()
    for t, (text, _, phrases) in enumerate(TEMPLATES):
        own = text.split(" ")
        rare = sorted(set(own), key=lambda w: (df.get(w, 0), w))[:RARE_WORDS]
        must = set()
        for phrase in phrases:
            x = phrase.split(" ")
            at = next(k for k in range(len(own)) if own[k : k + len(x)] == x)
            must.update(range(at, at + len(x)))
        rows += [(w, t, k, w in rare, k in must) for k, w in enumerate(own) if w in rare or k in must]
        looked_up.add(min((own[k] for k in must), key=lambda w: (df.get(w, 0), w)))
    return rows, sorted(looked_up)


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: words, base places and labels, all labels, and a score from 0 to 1."""
    spark = docs.sparkSession
    vocabulary = F.array(*map(F.lit, _vocabulary()))
    seen = docs.select(F.explode(F.array_intersect(F.split(F.trim(_padded(text)), " "), vocabulary)).alias("w"))
    df = {r.w: r.n for r in seen.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # template words at most
    rows, looked_up = _postings(df)
    posts = spark.createDataFrame(rows, "w string, t int, k int, rare boolean, must boolean")  # fixed size

    words = F.split(F.trim("p"), " ")
    marked = _marked(docs, id, text).withColumn("words", words)
    marked = written(marked.withColumn("words", F.when(F.arrays_overlap("words", F.array(*map(F.lit, looked_up))), F.col("words"))).drop("p"))
    placed = marked.where("words is not null").select("row", F.posexplode("words").alias("i", "w"))
    votes = placed.join(F.broadcast(posts), "w").groupBy("row", "t", (F.col("i") - F.col("k")).alias("offset")).agg(F.count_if("rare").alias("rare"), F.count_if("must").alias("must"))

    facts = []
    for t, (whole, label, _) in enumerate(TEMPLATES):
        mine = [r for r in rows if r[1] == t]
        facts.append((t, label, sum(r[3] for r in mine), sum(r[4] for r in mine), AGREEMENT_SHORT if len(whole.split(" ")) < SHORT else AGREEMENT))
    known = spark.createDataFrame(facts, "t int, label string, n_rare int, n_must int, least double")  # fixed size
    share = F.col("rare") / F.col("n_rare")
    found = votes.join(F.broadcast(known), "t").where((F.col("must") == F.col("n_must")) & (share >= F.col("least")))
    added = found.groupBy("row").agg(F.collect_set("label").alias("added"), F.max(share).alias("share"))
    out = marked.drop("words").join(added, "row", "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("added", F.array().cast("array<string>")))))
    return out.select(
        F.col("id").alias(id), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every whole text of ``documents``."""
    return scan(table(spark, sf_dir, "documents"))
