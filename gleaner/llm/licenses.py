"""License scans: an exact set-similarity join of text blocks with templates.

Words are lower-case ASCII letters, digits and anything beyond ASCII. A text's
blocks are its runs of so many words, each starting half a block after the one
before, so any passage of up to half a block lies whole in some block. Blocks of
64 words are joined with templates of up to 32, blocks of 128 with those of up
to 64, and so on: templates may be whole license texts. A block matches a
template if it has at least THRESHOLD of the template's distinct words
(containment).

The join is exact. Template words are ordered by how many blocks of the whole
corpus have them, rarest first (one pass counts them). A template that needs c
of its n words must share one of its n - c + 1 rarest with any match (prefix
filter); a block needs c distinct words (length filter); and the words left in
both after the place of the first shared one must still make up c (positional
filter). What passes is verified on the full sets.

Besides, a text is searched for fixed phrases: places where a phrase's words
stand consecutively. Phrases are found by their first words in one pass.

Templates and phrases are parameters, bounded by MOST_TEMPLATES. Defined results:
null and empty texts have no words, labels are empty strings, score is 0.
Repeated rows each get their result; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import pieces, texts_of

#: LEAST_HALF: half the words of the smallest blocks.
THRESHOLD, LEAST_HALF, MOST_TEMPLATES = 0.8, 32, 10_000

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Labels and the sentences or whole texts that stand for them (public texts of the licenses).
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("all-rights-reserved", "All rights reserved"),
    ("public-domain", "This work has been dedicated to the public domain"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability "
        "and fitness for a particular purpose are disclaimed.",
    ),
]

#: A-Z lowered; ASCII other than letters and digits becomes a space.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_in(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_CLEAN).split()


def half_for(template: str) -> int:
    """Half the length of the blocks that a template is joined with."""
    half = LEAST_HALF
    while half < len(words_in(template)):
        half *= 2
    return half


def blocks_of(words: list, half: int = LEAST_HALF) -> Iterator[tuple[int, list]]:
    """(start, words) of all blocks; the last reaches the text's end."""
    start = 0
    while words:
        yield start, words[start : start + 2 * half]
        if start + 2 * half >= len(words):
            return
        start += half


class Phrases:
    """Phrases by their first words."""

    def __init__(self, phrases: dict[str, str]):
        self.by_first: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for phrase, label in phrases.items():
            if own := words_in(phrase):
                self.by_first.setdefault(own[0], []).append((own, label))

    def places(self, words: list[bytes], distinct: set[bytes]) -> list[tuple[int, str]]:
        """(first word's place, label) wherever a phrase stands."""
        if self.by_first.keys().isdisjoint(distinct):
            return []
        get = self.by_first.get
        return [(i, label) for i, w in enumerate(words) for own, label in get(w, ()) if words[i : i + len(own)] == own]


class Templates:
    """Templates of one block length (number, label, text) as sets over one
    order of their words, with a prefix index."""

    def __init__(self, templates: list[tuple[int, str, str]], frequency: dict[bytes, int], threshold: float = THRESHOLD):
        vocabulary = {w for *_, t in templates for w in words_in(t)}
        self.place = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
        self.sets, self.numbers, self.need = [], [], []
        self.prefixes: dict[int, list[tuple[int, int]]] = {}
        for number, _, text in templates:
            own = sorted({self.place[w] for w in words_in(text)})
            if not own:
                continue
            need = max(1, -int(-threshold * len(own) // 1))
            for j in range(len(own) - need + 1):
                self.prefixes.setdefault(own[j], []).append((len(self.sets), j))
            self.sets.append(own)
            self.numbers.append(number)
            self.need.append(need)

    def matches(self, block: set[bytes]) -> dict[int, float]:
        """Containment by template, for all that reach the threshold."""
        place = self.place
        own = sorted(place[w] for w in block & place.keys())
        seen, out = set(), {}
        for i, token in enumerate(own):
            for t, j in self.prefixes.get(token, ()):
                if t in seen:
                    continue
                seen.add(t)
                need = self.need[t]
                # before this pair neither side's smaller words are shared
                if len(own) < need or min(len(own) - i, len(self.sets[t]) - j) < need:
                    continue
                common = len(set(own) & set(self.sets[t]))
                if common >= need:
                    out[self.numbers[t]] = common / len(self.sets[t])
        return out


def frequencies(docs: DataFrame, templates: list[tuple[str, str]], text_column: str = "text") -> dict[bytes, int]:
    """In how many of the corpus's smallest blocks each template word stands: a
    row for each word of the templates, whatever the corpus's size."""
    vocabulary = {w for _, t in templates for w in words_in(t)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[bytes, int] = {}
        for batch in batches:
            for text in texts_of(batch, "text"):
                words = words_in(text)
                if vocabulary.isdisjoint(words):
                    continue
                for _, block in blocks_of(words):
                    for w in vocabulary.intersection(block):
                        count[w] = count.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["word", "n"])

    each = docs.select(F.col(text_column).alias("text")).mapInArrow(run, "word binary, n long")
    return {bytes(r.word): r.n for r in each.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """For every row: (id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, matches: block start, template and containment)."""
    if len(templates) > MOST_TEMPLATES or len(phrases) > MOST_TEMPLATES:
        raise ValueError(f"over {MOST_TEMPLATES} templates or phrases")
    frequency = frequencies(docs, templates, text_column)
    by_half: dict[int, list[tuple[int, str, str]]] = {}
    for number, (label, text) in enumerate(templates):
        by_half.setdefault(half_for(text), []).append((number, label, text))
    indexes = [(half, Templates(some, frequency, threshold)) for half, some in sorted(by_half.items())]
    sought = Phrases(phrases)

    def one(text: str) -> tuple:
        words = words_in(text)
        distinct = set(words)
        found = sought.places(words, distinct)
        places, base = [i for i, _ in found], {label for _, label in found}
        matches = []
        for half, index in indexes:
            if not index.prefixes.keys().isdisjoint(index.place[w] for w in distinct & index.place.keys()):
                for start, block in blocks_of(words, half):
                    matches += [{"start": start, "template": t, "containment": c} for t, c in index.matches(set(block)).items()]
        matches.sort(key=lambda m: (m["start"], m["template"]))
        labels = base | {templates[m["template"]][0] for m in matches}
        score = 1.0 if base else max((m["containment"] for m in matches), default=0.0)
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, matches

    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "matches": pa.list_(pa.struct([("start", pa.int64()), ("template", pa.int32()), ("containment", pa.float64())]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "text")
            for at, end in pieces(texts):
                columns = zip(*map(one, texts[at:end]), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, end - at), *(pa.array(list(c), k) for c, k in zip(columns, kinds.values(), strict=True))], ["id", *kinds])

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<start: long, template: int, containment: double>>"
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_column)


def oracle() -> str:
    """scan() in DuckDB, for tables with unique ids; without the matches."""
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
    sets = [(i, label, half_for(t), sorted(set(words_in(t)))) for i, (label, t) in enumerate(TEMPLATES)]
    words = ", ".join(f"({i}, '{label}', {half}, '{w.decode()}', {len(own)}, {max(1, -int(-THRESHOLD * len(own) // 1))})" for i, label, half, own in sets for w in own)
    return f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i, len(ws) AS n FROM w),
p(phrase, label) AS (VALUES {phrases}),
g AS (SELECT doc_id, i, label FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM w) JOIN p ON array_to_string(ws[i + 1:i + len(string_split(phrase, ' '))], ' ') = phrase),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM g GROUP BY doc_id),
t(template, label, half, word, size, need) AS (VALUES {words}),
k AS (SELECT doc_id, n, template, label, half, word, size, need, unnest([i // half - 1, i // half]) AS block FROM e JOIN t USING (word)),
m AS (SELECT doc_id, block, template, any_value(label) AS label, count(DISTINCT word) / any_value(size) AS containment FROM k
  WHERE block >= 0 AND (block = 0 OR (block + 1) * half < n) GROUP BY doc_id, block, template HAVING count(DISTINCT word) >= any_value(need)),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM m UNION SELECT doc_id, label FROM g) GROUP BY doc_id),
s AS (SELECT doc_id, max(containment) AS score FROM m GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(s.score, 0) END::DOUBLE AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN s USING (doc_id)"""
