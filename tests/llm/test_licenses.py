import re

from pyspark.sql import functions as F

from textloom.llm import licenses


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = licenses.digest(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert ("cc-by-nc" in r.labels) == ("CC BY-NC" in (texts[r.doc_id] or ""))


def test_templates_and_odd_rows(spark):
    near = "Redistribution and use in source and binary forms, with or without modification, are permitted"
    texts = {
        0: (None, ""), 1: ("", ""), 2: ("MIT LICENSE mit-license", "mit"), 3: ("mit general apache license public license", "apache"),
        4: (f"x {near}", "bsd"), 5: ("binary source use forms redistribution and", ""), 6: ("Mİt license", ""),
        7: ("license " * 20000 + "released into the public domain", ""), 8: ("GNU Lesser General Public License as published by the Free Software Foundation", "gpl,lgpl"),
        9: ("free and unencumbered software released into the public domain", "unlicense"), 10: ("The poet took artistic license with the facts", ""), 11: ("this ring was released into the public domain", ""),
        12: ("see cc by nc", ""), 13: ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), 14: ("the terms of the Artistic License 2.0", ""), 15: ("redistribute it and/or modify it under the terms of the Artistic License 2.0", "artistic"),
        16: ("the bsd 3 clause license " * 3, "bsd"), 17: ("a bsd 3 clause dispute", ""), 18: ("to the extent possible under law he has kept all related and neighboring rights", ""),
    }
    docs = spark.createDataFrame([(k, t, "x") for k, (t, _) in texts.items()], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licenses.digest(docs.union(docs)).collect()}
    assert {k: got[k].labels for k in texts} == {k: label for k, (_, label) in texts.items()}
    assert got[2].n_base == 2 and got[2].last_word == 2
    assert licenses.digest(docs.limit(0)).count() == 0
    assert licenses.digest(docs.select("doc_id", F.lit(None).cast("string").alias("text"))).filter("n_words = 0").count() == len(texts)


def test_all_templates_in_one_text(spark):
    own = {i: t.text for i, t in enumerate(licenses.TEMPLATES)}
    whole = " lorem ipsum dolor sit amet ".join(own.values())
    drifted = "Permission is hereby granted, free of charge, to any person (natural or legal) obtaining a copy, to deal in the Software without restriction"
    apart = "permission is hereby granted free of charge " + "word " * 60 + "to deal in the software without restriction"
    texts = {**own, 100: whole, 101: " ".join([whole] * 3), 102: drifted, 103: apart}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.digest(docs).collect()}
    for i, t in enumerate(licenses.TEMPLATES):
        assert t.label in got[i].labels.split(",") and got[i].score == 1.0
    labels = ",".join(sorted({t.label for t in licenses.TEMPLATES}))
    assert got[100].labels == got[101].labels == labels
    assert got[102].labels == "mit" and got[103].labels == ""


def test_labels_do_not_depend_on_the_corpus(spark):
    """A header that very many documents have is as good a label as in a corpus of one document."""
    notices = [(i, t.text) for i, t in enumerate(licenses.TEMPLATES)]
    crowd = [(1000 + i, licenses.TEMPLATES[9].text) for i in range(300)]
    scan = lambda rows: {r.doc_id: r.labels for r in licenses.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    alone = scan(notices)
    assert {k: v for k, v in scan(notices + crowd).items() if k < 1000} == alone
