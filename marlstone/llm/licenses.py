"""License scan: exact containment join of text blocks with license templates, in DataFrame functions only.

A text block is any run of ``SPREAD`` times as many words as a template has, over line breaks or not: notices are wrapped
and interspersed. It matches a template T if at least ``THETA`` of T's distinct words stand in it. Words are ordered by
the number of texts that hold them, rarest first. Then, with need = ceil(THETA |T|),

* prefix filter: a text with a match holds one of the first |T| - need + 1 words of T;
* length filter: it holds at least ``need`` template words;
* positional filter: if T's word j is the text's i-th template word, at most min(|T| - j, words from i on) can be shared;
* and what is left is counted exactly, block by block: of all blocks that begin with a word of T, the most shared words.

Each text is read once: its template words and their places, a small table, serve the counts and the join, and all that
belongs to a row is found within the row. The templates are a parameter of bounded size (``MAX_TEMPLATES``), which bounds
the index that the plan holds and the word counts that come to the driver.

* null text: as empty text: no words, no labels, score 0; very long text: linear in its template words;
* ties: labels are sets, the score is a maximum, of equal blocks the first one counts; repeated rows: each is scanned alone;
* null id: scanned as any other; empty table: empty result; extra columns: only id and text are read, so clashing names
  do not matter.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.plans.rows import col
from marlstone.plans.storage import cut

WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
PHRASES = (("mit", ("mit", "license")), ("apache", ("apache", "license")), ("gpl", ("general", "public", "license")))
THETA = 0.9
SPREAD = 2  #: words of a block for each word of a template
MAX_TEMPLATES = 2000

#: Fixed values: (label, wording) of common notices and license texts.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "This project is licensed under the terms of the MIT license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "licensed under the Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "dedicated to the public domain under CC0 1.0 Universal"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def template_words(text: str) -> tuple[str, ...]:
    """All words of a template, repeats included."""
    return tuple(re.findall("[a-z0-9\u0080-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)))


def _lowered(text: Column) -> Column:
    """Lower case as far as the words of templates go: the Kelvin sign is the one other character that becomes a-z."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u212b")))


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def _places(label: str, phrase: tuple[str, ...]) -> Column:
    """Array of (label, at): places in ``hits`` (null: none) where the phrase's words stand consecutively."""

    def there(h, k):
        return _all([F.get("hits", k + m)["w"].eqNullSafe(p) & F.get("hits", k + m)["at"].eqNullSafe(h["at"] + m) for m, p in enumerate(phrase)])

    starts = F.transform("hits", lambda h, k: F.struct(h["at"].alias("at"), there(h, k).alias("ok")))
    return F.transform(F.filter(starts, lambda x: x["ok"]), lambda x: F.struct(F.lit(label).alias("label"), x["at"].cast("long").alias("at")))


def _constant(value, kind: str) -> Column:
    """A literal of the plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan(docs: DataFrame, templates=TEMPLATES, theta: float = THETA, spread: int = SPREAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row, and ``matches``.

    ``matches``: (label, containment, at, n) of each matching template: the block of n words from word ``at`` on.
    """
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates; scan larger sets in parts")
    sets = [(label, list(dict.fromkeys(ws)), spread * len(ws)) for label, ws in ((label, template_words(text)) for label, text in templates) if ws]
    vocabulary = sorted({w for _, ws, _ in sets for w in ws} | {w for _, p in PHRASES for w in p})
    words = F.regexp_extract_all(_lowered(col(text_col)), F.lit(WORD), F.lit(0))
    d = docs.select(col(id_col).alias("doc_id"), words.alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("w"))), lambda x: x["w"].isin(vocabulary))
    d = cut(d.select("doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits")), "license-words")
    held = F.array_distinct(F.transform("hits", lambda h: h["w"]))
    # At most len(vocabulary) rows come to the driver.
    counts = {r["w"]: r["n"] for r in d.select(F.explode(held).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    ranked = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(ranked)}
    index: dict[str, list[dict]] = {}
    for t, (_, ws, _) in enumerate(sets):
        need = math.ceil(theta * len(ws) - 1e-9)
        for j, w in enumerate(sorted(ws, key=rank.__getitem__)[: len(ws) - need + 1]):
            index.setdefault(w, []).append({"t": t, "most": len(ws) - j, "need": need})
    known = [{"label": label, "words": ws, "need": math.ceil(theta * len(ws) - 1e-9), "n": n} for label, ws, n in sets]
    by_word = _constant(index, "map<string,array<struct<t:int,most:int,need:int>>>")
    by_number = _constant(known, "array<struct<label:string,words:array<string>,need:int,n:int>>")
    d = d.withColumn("own", F.array_intersect(F.array(*[F.lit(w) for w in ranked]), held))  # rarest first
    first = F.filter(F.transform("own", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(sorted(index)))
    n_own = F.size("own")
    of_word = lambda x: F.filter(F.element_at(by_word, x["w"]), lambda e: F.least(e["most"], n_own - x["i"]) >= e["need"])
    possible = F.array_distinct(F.flatten(F.transform(first, lambda x: F.transform(of_word(x), lambda e: e["t"]))))
    possible = F.filter(F.transform(possible, lambda t: F.get(by_number, t)), lambda t: F.size(F.array_intersect(t["words"], F.col("own"))) >= t["need"])
    d = d.withColumn("possible", F.when(F.exists("own", lambda w: w.isin(sorted(index))), possible))
    mine = lambda t: F.filter("hits", lambda h: F.array_contains(t["words"], h["w"]))

    def shared(x):
        """For each of the template's words in the text, how many of them a block from there on holds."""
        after = lambda h, k: F.filter(F.slice(x["mine"], k + 1, x["t"]["n"]), lambda g: g["at"] < h["at"] + x["t"]["n"])
        return F.transform(x["mine"], lambda h, k: F.struct(F.size(F.array_distinct(F.transform(after(h, k), lambda g: g["w"]))).alias("n"), (-h["at"]).alias("at")))

    best = F.transform(F.transform("possible", lambda t: F.struct(t.alias("t"), mine(t).alias("mine"))), lambda x: F.struct(x["t"].alias("t"), F.array_max(shared(x)).alias("most")))
    match = lambda x: F.struct(x["t"]["label"].alias("label"), (x["most"]["n"] / F.size(x["t"]["words"])).alias("containment"), (-x["most"]["at"]).alias("at"), x["t"]["n"].alias("n"))
    d = d.withColumn("best", best).withColumn("matches", F.transform(F.filter("best", lambda x: x["most"]["n"] >= x["t"]["need"]), match))
    d = d.withColumn("base", F.when(F.array_contains("own", "license"), F.concat(*[_places(*p) for p in PHRASES])))
    at = F.transform("base", lambda x: x["at"])
    none = F.array().cast("array<string>")
    bl = F.coalesce(F.array_distinct(F.transform("base", lambda x: x["label"])), none)
    found = F.coalesce(F.transform("matches", lambda m: m["label"]), none)
    d = d.withColumn("bl", bl).withColumn("found", found)
    score = F.when(F.size("bl") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)))
    joined = lambda a: F.array_join(F.sort_array(a), ",")
    return d.select(
        "doc_id", "n_words", F.coalesce(F.size("base"), F.lit(0)).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        joined(F.col("bl")).alias("base_labels"), joined(F.array_union("bl", "found")).alias("labels"), score.alias("score"), "matches",
    )
