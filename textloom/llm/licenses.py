"""License scans with a positional index of rare words; DataFrame functions only.

The templates of known notices are short, so their index is a literal of the plan: postings (template, place) of their licence
words. These are ranked by how few documents of the corpus have them. The words of a mandatory phrase stand together in a file
or not at all, so a template is looked up by the rarest of its first phrase: of a file's words those with the highest rank among
a template's propose it, and a file without any of them is done with. A place p of a word that stands at q in template t proposes
the diagonal p - q. There the template's postings are intersected with the file's words by relative position: the first phrase
has to stand just where the diagonal puts it, every other mandatory phrase within DRIFT words of it, and of the licence words
enough on the diagonal (``Template.least``): a phrase alone, in other company, is no notice. What stands on the diagonal are the
template's votes. All proposals of all templates are looked at. Ranks change only how many proposals are made, never which
labels are given, so a text has the same labels in every corpus.

Beside it, ``phrases`` finds every place of fixed phrases, whatever the templates say.

Defined cases: a null or empty text has no words and score 0. Repeated rows get a row each; other columns of the input aren't
read. An empty table gives no rows. Any length of text is read whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what parts words, once letters are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that are reported wherever their words stand consecutively.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]

    @property
    def least(self) -> int:
        """Licence words that have to stand on a diagonal: three fifths of a short notice's, six of a long one's, which may be cut."""
        return min(6, -(-3 * len(counted(self)) // 5))


#: The usual wording of public licence notices, and what must stand in a document for the label.
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Template("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("in compliance with the license", "apache org licenses")),
    Template("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ("gnu general public license", "free software foundation")),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Template("lgpl", "under the terms of the gnu library general public license as published by the free software foundation", ("gnu library general public license",)),
    Template("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistribution and use in source and binary forms",)),
    Template("bsd", "licensed under the bsd 3 clause license", ("bsd 3 clause",)),
    Template("bsd", "licensed under the bsd 2 clause license", ("bsd 2 clause",)),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("mozilla public license",)),
    Template("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    Template("cddl", "the contents of this file are subject to the terms of the common development and distribution license", ("common development and distribution license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee is hereby granted",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("without any express or implied warranty", "permission is granted to anyone to use this software for any purpose")),
    Template("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    Template("artistic", "this program is free software you can redistribute it and or modify it under the terms of the artistic license 2 0", ("artistic license",)),
    Template("wtfpl", "do what the fuck you want to public license", ("do what the fuck you want to",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("released into the public domain",)),
    Template("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", ("to the extent possible under law", "related and neighboring rights")),
    Template("cc0", "released under the creative commons cc0 1 0 universal license", ("cc0 1 0 universal",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc-by", "creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
)

#: Words too common to be looked up, besides words of one character.
COMMON = frozenset("the and of to in is it or any this that with for from at as by you may not can are be was an use".split())

#: Words by which a phrase may stand off the diagonal of the first, for what was put in or left out between them.
DRIFT = 16


def words_of(text: Column) -> Column:
    """The words of a text, in lower case (A-Z)."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def counted(template: Template) -> list[tuple[int, str]]:
    """(position, word) of the template's licence words."""
    return [(q, word) for q, word in enumerate(template.text.split()) if len(word) > 1 and word not in COMMON]


def placed_phrases(template: Template) -> list[tuple[int, list[str]]]:
    """(position in the template, words) of its mandatory phrases."""
    text = template.text.split()
    cut = [phrase.split() for phrase in template.phrases]
    return [(next(q for q in range(len(text)) if text[q : q + len(words)] == words), words) for words in cut]


def rarest_first(words: DataFrame, vocabulary: list[str]) -> list[str]:
    """The licence words by the number of documents that have them: one row for each at most comes to the driver."""
    known = F.array(*map(F.lit, vocabulary))
    counts = words.select(F.explode(F.array_intersect("words", known)).alias("word")).groupBy("word").count().collect()
    n = {r.word: r["count"] for r in counts}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def base_places(words: Column, phrases: tuple[tuple[str, str], ...] = PHRASES) -> Column:
    """array<struct<start, label>> of every place of a phrase, by phrase and place."""

    def places(phrase: str, label: str) -> Column:
        parts = phrase.split()
        here = lambda i: reduce(Column.__and__, [F.coalesce(F.get(words, i + k) == p, F.lit(False)) for k, p in enumerate(parts)])
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
        found = F.transform(starts, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))
        return F.when(F.forall(F.array(*map(F.lit, sorted(set(parts)))), lambda p: F.array_contains(words, p)), found)

    none = F.expr("cast(array() as array<struct<start: bigint, label: string>>)")
    return F.flatten(F.array(*(F.coalesce(places(p, label), none) for p, label in phrases)))


def anchor(template: Template, ranked: list[str]) -> tuple[str, int]:
    """The rarest word of the template's first phrase, and where it stands in the template."""
    first, words = placed_phrases(template)[0]
    known = [w for w in ranked if w in words]
    return known[0], first + words.index(known[0])


def index(templates: tuple[Template, ...], ranked: list[str]) -> dict[str, list[tuple[int, int]]]:
    """Postings (template, place) by the words that templates are looked up by."""
    postings: dict[str, list[tuple[int, int]]] = {}
    for n, template in enumerate(templates):
        word, place = anchor(template, ranked)
        postings.setdefault(word, []).append((n, place))
    return postings


def known(templates: tuple[Template, ...]) -> Column:
    """The templates as an array: label, least, the licence words with their places, the first phrase, the other ones."""
    words = lambda ws: F.array(*map(F.lit, ws)) if ws else F.array().cast("array<string>")
    placed = lambda q, ws: F.struct(F.lit(q).alias("q"), words(ws).alias("words"))
    none = F.array().cast("array<struct<q:int,words:array<string>>>")

    def one(t: Template) -> Column:
        own = F.array(*(F.struct(F.lit(q).alias("q"), F.lit(w).alias("w")) for q, w in counted(t)))
        first, *others = placed_phrases(t)
        return F.struct(F.lit(t.label).alias("label"), F.lit(t.least).alias("least"), own.alias("own"), placed(*first).alias("first"), (F.array(*(placed(*x) for x in others)) if others else none).alias("others"))

    return F.array(*map(one, templates))


def notices(words: Column, templates: tuple[Template, ...], ranked: list[str]) -> Column:
    """array<struct<label, share>> of the diagonals that hold a template."""
    postings = index(templates, ranked)
    entries = lambda own: F.array(*(F.struct(F.lit(n).alias("t"), F.lit(q).alias("q")) for n, q in own))
    by_word = F.create_map(*(x for word, own in sorted(postings.items()) for x in (F.lit(word), entries(own))))
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda p: F.get(words, p).isin(sorted(postings)))
    proposed = F.flatten(F.transform(places, lambda p: F.transform(F.element_at(by_word, F.get(words, p)), lambda e: F.struct(e["t"].alias("t"), (p - e["q"]).alias("d")))))
    stands = lambda at, phrase: (at >= 0) & (F.slice(words, F.greatest(at, F.lit(0)) + 1, F.size(phrase)) == phrase)
    all_known = known(templates)
    shifts = F.sequence(F.lit(-DRIFT), F.lit(DRIFT))

    def phrased(x: Column) -> Column:
        t, d = F.get(all_known, x["t"]), x["d"]
        near = lambda other: F.exists(shifts, lambda k: stands(d + other["q"] + k, other["words"]))
        return stands(d + t["first"]["q"], t["first"]["words"]) & F.forall(t["others"], near)

    def voted(x: Column) -> Column:
        t = F.get(all_known, x["t"])
        votes = F.size(F.filter(t["own"], lambda e: F.coalesce(F.get(words, x["d"] + e["q"]) == e["w"], F.lit(False))))
        return F.struct(t["label"].alias("label"), (votes / F.size(t["own"])).alias("share"), (votes >= t["least"]).alias("enough"))

    return F.filter(F.transform(F.filter(proposed, phrased), voted), lambda v: v["enough"])


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """doc_id, n_words, base (places of phrases), labels (array, those of phrases included), score; two passes, no shuffle of texts."""
    words = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    ranked = rarest_first(words, sorted({w for t in templates for w in t.phrases[0].split()}))
    relevant = F.arrays_overlap("words", F.array(*map(F.lit, sorted(index(templates, ranked)))))
    none = F.expr("cast(array() as array<struct<label: string, share: double, enough: boolean>>)")
    found = words.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        base_places(F.col("words"), phrases).alias("base"),
        F.when(relevant, notices(F.col("words"), templates, ranked)).otherwise(none).alias("own"),
    )
    labels = F.array_sort(F.array_distinct(F.concat(F.col("base")["label"], F.col("own")["label"])))
    best = F.greatest(F.coalesce(F.array_max(F.col("own")["share"]), F.lit(0.0)), F.when(F.size("base") > 0, F.lit(0.5)).otherwise(0.0))
    return found.select("doc_id", "n_words", "base", labels.alias("labels"), best.alias("score"))


def digest(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    base = F.col("base")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["start"]).alias("first_word"),
        F.array_max(base["start"]).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base["label"])), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
