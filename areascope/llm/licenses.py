"""License scan by an exact set-similarity join between word windows and license templates.

A block is a window of consecutive words that begins at a word of the template and is a quarter longer than the
template; line ends play no part, so wrapped notices are found. Every such window is looked at, without a stride. A
template is found in a window that holds at least ``threshold`` of its distinct words (containment), all words
that tell it apart from its neighbours (``must``), and none that names a neighbour (``without``). The join is
exact and does not compare every window with every template:

* global order: the template words are ordered by the number of documents that hold them, rare first,
  counted over all documents;
* prefix filter: of a match, one of the template's first ``words - need + 1`` words is in the window, with
  ``need = ceil(threshold * words)``; a document without any of these few rare words is done, and only
  templates with one of theirs in the document are candidates;
* length filter: a document with fewer than ``need`` of the template's words cannot hold it;
* positional filter: a window that begins at the template's i-th occurrence of a word can match only if the
  (i + need - 1)-th still lies in it;
* verification counts the distinct common words of the windows that are left.

Templates are a parameter: rows of a table, scanned for in groups of at most ``GROUP_WORDS`` words, so any number
of them will do. They are literals, the scan over the documents has no shuffle and no join whose side grows.
The counts are one aggregation of the template words, combined before its shuffle.

Base phrases are found besides: places where the phrase's words stand consecutively.

Defined results: words are runs of [0-9a-z] and of characters above U+007F, after lower-casing A-Z only;
a null text is empty: no words, no labels, score 0; of several windows of a template the one with the largest
containment counts, then the first; repeated rows are scanned alike; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areascope.llm.common import LOWER, UPPER, numbered, renamed, text_or_empty

#: Characters that are no word characters; base phrases and their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Public license notices as (label, text, words that must be there, words that must not).
TEMPLATES = (
    ("agpl-3.0", "GNU Affero General Public License, version 3.", "gnu affero license 3", "lesser"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache license 2", ""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met", "redistribution source binary permitted", ""),
    ("bsd", "Released under the BSD License.", "bsd license", ""),
    ("cc-by-4.0", "Licensed under CC BY 4.0.", "cc by 4", "nc nd sa"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", "cc by nc 4", "nd sa"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0.", "cc by nd 4", "nc sa"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", "cc by sa 4", "nc nd"),
    ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0.", "cc by nc nd 4", "sa"),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0.", "cc by nc sa 4", "nd"),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International License", "creative commons attribution 4",
     "noderivatives noncommercial sharealike"),
    ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License",
     "creative commons attribution noncommercial 4", "noderivatives sharealike"),
    ("cc-by-nd-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License",
     "creative commons attribution noderivatives 4", "noncommercial sharealike"),
    ("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License",
     "creative commons attribution sharealike 4", "noderivatives noncommercial"),
    ("cc-by-nc-nd-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
     "creative commons attribution noncommercial noderivatives 4", "sharealike"),
    ("cc-by-nc-sa-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
     "creative commons attribution noncommercial sharealike 4", "noderivatives"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work.",
     "waived copyright related rights", ""),
    ("gpl-2.0", "GNU General Public License, version 2.", "gnu general public license 2", "affero lesser library"),
    ("gpl-3.0", "GNU General Public License, version 3.", "gnu general public license 3", "affero lesser"),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby "
            "granted", "permission software purpose fee granted", ""),
    ("lgpl-2.1", "GNU Lesser General Public License, version 2.1.", "gnu lesser license 2 1", ""),
    ("lgpl-3.0", "GNU Lesser General Public License, version 3.", "gnu lesser license 3", ""),
    ("mit", "Released under the MIT License.", "mit license", ""),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                  "associated documentation files, to deal in the software without restriction",
     "permission granted charge software restriction", ""),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "mozilla license 2", ""),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered software public domain", ""),
)
THRESHOLD = 0.8
#: A window has a quarter more words than the template; most template words in the literals of one scan.
ROOM, GROUP_WORDS = 1.25, 5000


#: Runs of characters that separate words, in text of both cases.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _strings(values) -> str:
    return "array(" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) + ")"


class Template(NamedTuple):
    """A template as sets of words, each sorted; ``span`` is the length of its windows, ``need`` the common words."""

    label: str
    words: list[str]
    must: list[str]
    without: list[str]
    need: int
    span: int


def parsed(templates: Iterable[tuple[str, str, str, str]], threshold: float = THRESHOLD) -> list[Template]:
    """The templates that have words. Words of ``must`` have to be words of the text."""
    def words(text: str) -> list[str]:
        return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))

    out = []
    for label, text, must, without in templates:
        whole = words(text)
        distinct = sorted(set(whole))
        if not set(words(must)) <= set(distinct):
            raise ValueError(f"{label}: a required word is not in the template")
        if distinct:
            out.append(Template(label, distinct, sorted(set(words(must))), sorted(set(words(without)) - set(distinct)),
                                math.ceil(threshold * len(distinct) - 1e-9), math.ceil(ROOM * len(whole) - 1e-9)))
    return out


def _groups(templates: list[Template]) -> list[list[Template]]:
    out, size = [], 0
    for t in templates:
        n = len(t.words) + len(t.without)
        if not out or size + n > GROUP_WORDS:
            out.append([])
            size = 0
        out[-1].append(t)
        size += n
    return out


def global_order(docs: DataFrame, text: str, words: list[str]) -> list[str]:
    """``words`` by the number of documents that hold them, rare first (ties by the word); a word in
    no document comes first. One row for each template word comes to the driver. (Any order gives the same matches, so
    the fast lower(), which also changes other letters, will do here.)"""
    held = docs.select(F.explode(F.array_intersect(F.split(F.lower(text_or_empty(text)), GAP), F.expr(_strings(words)))).alias("w"))
    counts = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def _prefix(t: Template, rank: Mapping[str, int]) -> list[str]:
    return sorted(t.words, key=rank.__getitem__)[:len(t.words) - t.need + 1]


def _matches(group: list[Template], rank: Mapping[str, int], words: str) -> str:
    """SQL for the templates of a group found in the array ``words``: (word, label, containment) of the best window."""
    table = "array(" + ", ".join(
        f"named_struct('label', {_strings([t.label])}[0], 'words', {_strings(t.words)}, 'must', {_strings(t.must)}, 'without', {_strings(t.without)},"
        f" 'any', {_strings(t.words + t.without)}, 'prefix', {_strings(_prefix(t, rank))}, 'need', {t.need}, 'span', {t.span})" for t in group) + ")"
    literals = ", ".join(_strings([w])[6:-1] for w in sorted({w for t in group for w in t.words + t.without}))
    hits = f"filter(transform({words}, (w, i) -> named_struct('w', w, 'i', i)), x -> x.w in ({literals}))"
    # candidates: prefix, required words and length; then each window by its first and its need-th word; then the count
    candidates = f"""filter({table}, t -> arrays_overlap(held, t.prefix) and size(array_intersect(held, t.must)) = size(t.must)
        and size(array_intersect(held, t.words)) >= t.need)"""
    windows = """transform(filter(transform(own, (x, a) -> named_struct('x', x, 'a', a)),
            s -> array_contains(t.words, s.x.w) and get(own, s.a + t.need - 1).i < s.x.i + t.span),
        s -> named_struct('word', s.x.i, 'ws', transform(filter(slice(own, s.a + 1, t.span), y -> y.i < s.x.i + t.span), y -> y.w)))"""
    common = f"""transform(filter({windows}, v -> arrays_overlap(v.ws, t.prefix) and not arrays_overlap(v.ws, t.without)
            and size(array_intersect(t.must, v.ws)) = size(t.must)),
        v -> named_struct('common', size(array_intersect(t.words, v.ws)), 'before', -v.word))"""
    best = f"array_max(filter(transform(array(filter(hits, x -> array_contains(t.any, x.w))), own -> {common})[0], v -> v.common >= t.need))"
    found = f"filter(transform({candidates}, t -> named_struct('t', t, 'v', {best})), m -> m.v is not null)"
    return (f"transform(array({hits}), hits -> transform(array(array_distinct(transform(hits, x -> x.w))), held ->"
            f" transform({found}, m -> named_struct('word', cast(-m.v.before as bigint), 'label', m.t.label,"
            f" 'containment', m.v.common / cast(size(m.t.words) as double))))[0])[0]")


def scan(docs: DataFrame, text: str = "text", templates: Iterable[tuple[str, str, str, str]] = TEMPLATES,
         threshold: float = THRESHOLD, phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """``docs`` with ``n_words``, ``places`` (array of (word, label) of base phrases), ``blocks`` (array of
    (word, label, containment): the first word of each found template's best window), ``base_labels``, ``labels`` and ``score`` (the largest
    containment, 1 with a base phrase) in a struct column ``license``."""
    parts = _groups(parsed(templates, threshold))
    order = global_order(docs, text, sorted({w for g in parts for t in g for w in t.words})) if parts else []
    rank = {w: i for i, w in enumerate(order)}
    prefix = sorted({w for g in parts for t in g for w in _prefix(t, rank)}, key=rank.__getitem__)

    # flags by which most documents are done: any base phrase, any word of the prefix index; lower() keeps
    # every A-Z match, so the flag is wide enough
    word_char = "[^" + GAP[1:-1]
    phrase = f"(?i)(?<!{word_char})(?:" + "|".join(GAP.join(p.split(" ")) for p in phrases) + f")(?!{word_char})"
    raw = text_or_empty(f"c{docs.columns.index(text)}")
    inner = numbered(docs)
    columns = inner.columns
    inner = inner.select(
        *columns, F.size(F.array_remove(F.split(raw, GAP), "")).cast("long").alias("_n"), raw.rlike(phrase).alias("_phrase"),
        F.arrays_overlap(F.split(F.lower(raw), GAP), F.expr(f"cast({_strings(prefix)} as array<string>)")).alias("_prefix"), raw.alias("_raw"))

    # what is used more than once is bound to a name by a transform over an array of one
    gap = GAP.replace("\\", "\\\\")
    low = f"translate(_raw, '{UPPER}', '{LOWER}')"
    at = " or ".join("(" + " and ".join(f"get(ws, i + {j}) = '{w}'" for j, w in enumerate(p.split(" "))) + ")" for p in phrases)
    label = "case " + " ".join(
        "when " + " and ".join(f"get(ws, i + {j}) = '{w}'" for j, w in enumerate(p.split(" "))) + f" then '{v}'"
        for p, v in phrases.items()) + " end"
    places = (f"transform(array(array_remove(split({low}, '{gap}'), '')), ws -> transform(filter(sequence(0, size(ws) - 1), i -> {at}),"
              f" i -> named_struct('word', cast(i as bigint), 'label', {label})))[0]")
    empty_places = "cast(array() as array<struct<word: bigint, label: string>>)"
    found = F.when(F.col("_phrase"), F.expr(places)).otherwise(F.expr(empty_places))

    empty_blocks = "cast(array() as array<struct<word: bigint, label: string, containment: double>>)"
    verified = "concat(" + ", ".join([empty_blocks, *(_matches(g, rank, "ws") for g in parts)]) + ")"
    blocks = F.when(F.col("_prefix"), F.expr(f"transform(array(array_remove(split({low}, '{gap}'), '')), ws -> {verified})[0]")) \
        .otherwise(F.expr(empty_blocks))

    out = inner.select(*columns, "_n", found.alias("_places"), blocks.alias("_blocks"))
    lic = F.expr("""named_struct('n_words', _n, 'places', _places, 'blocks', _blocks,
        'base_labels', array_join(array_sort(array_distinct(transform(_places, p -> p.label))), ','),
        'labels', array_join(array_sort(array_distinct(concat(transform(_places, p -> p.label), transform(_blocks, b -> b.label)))), ','),
        'score', if(size(_places) > 0, 1.0D, coalesce(array_max(transform(_blocks, b -> b.containment)), 0.0D)))""")
    return renamed(out.withColumn("license", lic), docs.columns, "license")
