"""License scans by a positional index of rare words, in DataFrame functions only.

A template is a license's notice as words. A file holds it at an offset where ``share`` of its words or more stand at their
places and every mandatory key phrase stands whole within. Base phrases are templates that must stand whole.

1. Counts. How many files hold each template word, over all files, orders the words: the rarest have the highest IDF.
2. Index. A template of m words may miss m - ceil(share * m) of them, so of one more, its rarest places, one stands where it
   belongs in every match. Only those places are posted: word to (template, place). Words of a template that tie by count
   go by place. No match escapes, and frequent words are never looked up.
3. Lookup. A file's words that are in the index give (template, offset) candidates; postings that agree on the relative
   position meet in one candidate. The template's words are then compared with the file's at that offset, and key phrases
   are looked up in the window.

The index is as large as the templates, a parameter, so it travels in the plan; a file is scanned within its row: nothing is
shuffled but one count per template word, and no license that many files hold gathers anywhere.

Edge cases: A-Z are lower-cased and words are runs of letters, digits and characters beyond ASCII; null and empty texts have no
words; a template may begin before a file's first word or end after its last one, if enough of it is there; rows that share
an id, repeat or have none are scanned each alone; an empty table gives an empty result; other columns are carried along
untouched, and clashing names of new columns are refused.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    share: float = 0.8
    keys: tuple[str, ...] = field(default=())

    @property
    def split(self) -> list[str]:
        return self.words.split()

    @property
    def least(self) -> int:
        """Words that have to stand at their places."""
        return math.ceil(round(self.share * len(self.split), 9))


#: Base phrases, which must stand whole. Fixed values.
BASE = (Template("cc-by", "cc by", 1.0), Template("gpl", "general public license", 1.0), Template("reserved", "all rights reserved", 1.0))

#: Notices of common licenses. Fixed values.
NOTICES = (
    Template("agpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", 0.8, ("affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", 0.8, ("apache license",)),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", 0.8, ("apache org licenses license 2 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.8, ("source and binary forms",)),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", 0.8, ("creative commons attribution 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", 0.8, ("cc by nc",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", 0.8, ("cc by sa",)),
    Template("gpl-2.0-or-later", "either version 2 of the license or at your option any later version", 0.8, ("version 2",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", 0.8, ("general public license", "version 3")),
    Template("gpl-3.0-or-later", "either version 3 of the license or at your option any later version", 0.8, ("version 3",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.8, ("with or without fee",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", 0.8, ("free of charge", "without restriction")),
    Template("mit", "released under the mit license", 0.8, ("mit license",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", 0.8, ("mozilla public license",)),
)


def words_of(text: Column) -> Column:
    """Words of a text: a null or empty one has none."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    spaced = F.trim(F.regexp_replace(lower, GAP, " "))
    return F.when(spaced != "", F.split(spaced, " ")).otherwise(F.array().cast("array<string>"))


def document_counts(words: DataFrame, templates: tuple[Template, ...], name: str) -> dict[str, int]:
    """How many rows hold each word of the templates: at most as many numbers as the templates have words."""
    listed = F.array(*[F.lit(w) for w in sorted({w for t in templates for w in t.split})])
    held = words.select(F.explode(F.array_intersect(name, listed)).alias("w")).groupBy("w").count()
    return {r["w"]: r["count"] for r in held.collect()}


def rare_places(t: Template, counts: dict[str, int]) -> list[int]:
    """The rarest places of a template, of which every match holds one."""
    return sorted(range(len(t.split)), key=lambda i: (counts.get(t.split[i], 0), i))[: len(t.split) - t.least + 1]


def scan(docs: DataFrame, templates: tuple[Template, ...] = NOTICES, base: tuple[Template, ...] = BASE, text: str = "text") -> DataFrame:
    """``docs`` with n_words and matches: (start, n_words, share, label, base) of every place of a base phrase or template, by start.

    Neighbouring offsets at which one template matches are places of their own.
    """
    clash = {c.lower() for c in docs.columns} & {"n_words", "matches", "words_", "found_"}
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    every = tuple(base) + tuple(templates)
    counts = document_counts(docs.select(words_of(F.col(text)).alias("words_")), every, "words_")
    postings: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(every):
        for place in rare_places(t, counts):
            postings.setdefault(t.split[place], []).append((k, place))
    index = F.create_map(*[x for w, posted in sorted(postings.items()) for x in (F.lit(w), F.array(*[F.struct(F.lit(k).alias("t"), F.lit(i).alias("i")) for k, i in posted]))])
    known = F.array(*[F.struct(F.lit(t.label).alias("label"), F.array(*[F.lit(w) for w in t.split]).alias("words"), F.lit(t.least).alias("least"), F.array(*[F.lit(f" {k} ") for k in t.keys]).cast("array<string>").alias("keys"), F.lit(k < len(base)).alias("base")) for k, t in enumerate(every)])

    hit = lambda w, at: F.when(w.isin(*sorted(postings)), F.transform(F.element_at(index, w), lambda p: F.struct(p["t"].alias("t"), (at - p["i"]).alias("at"))))
    candidates = F.array_distinct(F.flatten(F.array_compact(F.transform("words_", hit))))
    found = docs.withColumn("words_", words_of(F.col(text))).withColumn("n_words", F.size("words_").cast("long")).withColumn("found_", candidates)

    def placed(c: Column) -> Column:
        """The template's words beside the file's: (start, template's size, words at their places, window between spaces, template)."""
        t = F.get(known, c["t"])
        size = F.size(t["words"])
        before = F.greatest(F.lit(0), -c["at"])  # words of the template before the file's first one
        window = F.slice("words_", F.greatest(F.lit(0), c["at"]) + 1, size - before)
        same = F.size(F.filter(F.zip_with(window, F.slice(t["words"], before + 1, size), lambda a, b: a == b), lambda x: x))
        return F.struct(F.greatest(F.lit(0), c["at"]).cast("long").alias("start"), size.alias("size"), same.alias("same"), F.concat(F.lit(" "), F.array_join(window, " "), F.lit(" ")).alias("window"), t.alias("t"))

    whole = lambda m: (m["same"] >= m["t"]["least"]) & F.forall(m["t"]["keys"], lambda k: F.contains(m["window"], k))
    out = lambda m: F.struct(m["start"].alias("start"), m["size"].cast("long").alias("n_words"), (m["same"] / m["size"]).alias("share"), m["t"]["label"].alias("label"), m["t"]["base"].alias("base"))
    matches = F.array_sort(F.transform(F.filter(F.transform("found_", placed), whole), out))
    return found.withColumn("matches", matches).drop("words_", "found_")


def labels(matches: Column, base_only: bool = False) -> Column:
    """Distinct labels of the matches, sorted and comma-joined."""
    of = F.filter(matches, lambda m: m["base"]) if base_only else matches
    return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda m: m["label"]))), ",")
