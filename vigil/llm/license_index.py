"""Licence scan with a positional index of rare template words.

The index holds every word of the licence templates with its positions. A
word's weight is its inverse document frequency in the whole corpus. A file
is first asked for the rarest words of each template; for a template of which it holds enough of them, the
file's own highest-weight words of that template are looked up. Postings that agree
on the place where the template would start (file position less template
position) vote for it, and a candidate counts once its mandatory key phrases
stand at that place.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

RARE_WORDS = 6    # a file's words of a template, highest IDF first, that are looked up
MIN_AGREE = 2     # of them that must agree on a start

#: The base phrases and their labels (fixed values).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Licence templates (fixed values): label, text, mandatory key phrases.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the "
     "license at http www apache org licenses license 2 0", ("in compliance with the license", "apache org licenses")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
     "that the following conditions are met", ("source and binary forms", "following conditions are met")),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3",
     ("gnu general public license version 3",)),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as "
     "published by the free software foundation", ("terms of the gnu general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files", ("permission is hereby granted", "obtaining a copy of this software")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ("mozilla public license v 2 0",)),
    ("agpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero "
     "general public license as published by the free software foundation either version 3 of the license or at your option "
     "any later version", ("gnu affero general public license", "either version 3 of the license")),
    ("artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is "
     "not allowed preamble this license establishes the terms under which a given free software package may be copied modified "
     "distributed and or redistributed", ("this license establishes the terms under which a given free software package",)),
    ("bsd-2-clause", "redistributions of source code must retain the above copyright notice this list of conditions and the "
     "following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions "
     "and the following disclaimer in the documentation and or other materials provided with the distribution",
     ("redistributions of source code must retain the above copyright notice",
      "redistributions in binary form must reproduce the above copyright notice")),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
     "promote products derived from this software without specific prior written permission",
     ("names of its contributors may be used to endorse or promote products", "without specific prior written permission")),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and "
     "accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit "
     "the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished "
     "to do so", ("any person or organization obtaining a copy of the software", "accompanying documentation covered by this license")),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
     ("creative commons attribution 4 0 international",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
     ("creative commons attribution noncommercial 4 0",)),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
     ("attribution noncommercial noderivatives 4 0",)),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
     ("attribution noncommercial sharealike 4 0",)),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
     ("creative commons attribution noderivatives 4 0",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license",
     ("creative commons attribution sharealike 4 0",)),
    ("cc0-1.0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related "
     "or neighboring rights to this work", ("has waived all copyright and related or neighboring rights",)),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 "
     "which is available at https www eclipse org legal epl 2 0", ("eclipse public license 2 0",)),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation either version 2 of the license or at your option any later version",
     ("terms of the gnu general public license", "either version 2 of the license")),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation either version 3 of the license or at your option any later version",
     ("terms of the gnu general public license", "either version 3 of the license")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
     "provided that the above copyright notice and this permission notice appear in all copies",
     ("permission to use copy modify", "for any purpose with or without fee is hereby granted")),
    ("lgpl-2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
     "public license as published by the free software foundation either version 2 1 of the license or at your option any later "
     "version", ("gnu lesser general public license", "either version 2 1 of the license")),
    ("lgpl-3.0", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
     "public license as published by the free software foundation either version 3 of the license or at your option any later "
     "version", ("gnu lesser general public license", "either version 3 of the license")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
     "distributed with this file you can obtain one at https mozilla org mpl 2 0", ("mozilla public license v 2 0", "copy of the mpl")),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
     "compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or "
     "non commercial and by any means", ("free and unencumbered software released into the public domain",)),
    ("wtfpl", "do what the fuck you want to public license terms and conditions for copying distribution and modification",
     ("what the fuck you want to public license",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for "
     "any damages arising from the use of this software permission is granted to anyone to use this software for any purpose "
     "including commercial applications and to alter it and redistribute it freely",
     ("provided as is without any express or implied warranty", "including commercial applications and to alter it")),
)

# bytes that are no part of a word become spaces; A-Z become a-z
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


def _encode(phrase: str) -> list[bytes]:
    return phrase.encode().split()


class TemplateIndex:
    """Postings of all template words, and their weights for given document frequencies."""

    def __init__(self, frequency: dict[str, int], n_docs: int, rare_words: int = RARE_WORDS):
        self.rare_words = rare_words
        self.templates = [(label, _encode(text), [(_find(_encode(text), _encode(k)), _encode(k)) for k in keys])
                          for label, text, keys in TEMPLATES]
        vocabulary = {w for _, words, _ in self.templates for w in words}
        idf = {w: math.log((1 + n_docs) / (1 + frequency.get(w.decode(), 0))) for w in vocabulary}
        self.ahead = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (-idf[w], w)))}   # highest weight first
        self.places: list[dict[bytes, list[int]]] = []
        self.asked: dict[bytes, list[int]] = defaultdict(list)   # of which templates a word is one of the rarest
        self.least = []
        for t, (_, words, _) in enumerate(self.templates):
            at: dict[bytes, list[int]] = defaultdict(list)
            for p, w in enumerate(words):
                at[w].append(p)
            self.places.append(at)
            rare = sorted(at, key=self.ahead.__getitem__)[:rare_words]
            self.least.append(min(MIN_AGREE, len(rare)))
            for w in rare:
                self.asked[w].append(t)
        self.rare = frozenset(self.asked)

    def scan(self, words: list[bytes]) -> tuple[set[str], float, int]:
        """Labels of verified templates, best share of a template's words in place, verified places."""
        rare = self.rare.intersection(words)
        if not rare:
            return set(), 0.0, 0
        count = Counter(t for w in rare for t in self.asked[w])
        likely = [t for t, n in count.items() if n >= self.least[t]]
        if not likely:
            return set(), 0.0, 0
        present = set(words)
        wanted = {t: sorted(present.intersection(self.places[t]), key=self.ahead.__getitem__)[:self.rare_words] for t in likely}
        of: dict[bytes, list[int]] = defaultdict(list)
        for t, found in wanted.items():
            for w in found:
                of[w].append(t)
        votes: dict[tuple[int, int], set[bytes]] = defaultdict(set)
        for place, w in enumerate(words):
            if w in of:
                for t in of[w]:
                    for p in self.places[t][w]:
                        votes[t, place - p].add(w)
        labels, best, places = set(), 0.0, 0
        for (t, start), agree in votes.items():
            if len(agree) < min(MIN_AGREE, len(wanted[t])):
                continue
            label, template, keys = self.templates[t]
            hits = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(template))
            best = max(best, hits / len(template))
            if all(start + at >= 0 and words[start + at:start + at + len(k)] == k for at, k in keys):
                labels.add(label)
                places += 1
        return labels, best, places


def _find(words: list[bytes], phrase: list[bytes]) -> int:
    return next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of every place where a base phrase stands."""
    out, at = [], -1
    while True:
        try:
            at = words.index(b"license", at + 1)
        except ValueError:
            return out
        for phrase, label in BASE.items():
            p = _encode(phrase)
            start = at - len(p) + 1
            if start >= 0 and words[start:at + 1] == p:
                out.append((start, label))


def document_frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """Documents holding each licence word, and all documents: a row per template word
    and task is summed, and as many rows as the templates have words reach the driver."""
    vocabulary = sorted({w for _, text, _ in TEMPLATES for w in _encode(text)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n, known = Counter(), 0, frozenset(vocabulary)
        for batch in batches:
            n += batch.num_rows
            for t in texts_of(batch.column(0)):
                seen.update(known.intersection(words_of(t)))
        items = [(w.decode(), c) for w, c in seen.items()] + [(None, n)]
        yield pa.RecordBatch.from_arrays([pa.array([i[0] for i in items], pa.string()),
                                          pa.array([i[1] for i in items], pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in rows.collect()}
    return {w: c for w, c in found.items() if w is not None}, found.get(None, 0)


def scan_licenses(docs: DataFrame, rare_words: int = RARE_WORDS) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_places) of every row.

    ``score`` is the best share of a template's words found in place, 0 without a candidate;
    a null or empty text has no words, no labels and score 0; repeated rows are scanned each; very long texts
    are scanned whole; an empty table gives no rows. Only doc_id and text are read.
    """
    frequency, n_docs = document_frequencies(docs)
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(frequency, n_docs, rare_words)
        for batch in batches:
            rows = []
            for text in texts_of(batch.column(1)):
                words = words_of(text)
                base = base_places(words)
                found, score, places = index.scan(words)
                starts = [s for s, _ in base]
                labels = {label for _, label in base}
                rows.append((len(words), len(base), min(starts, default=None), max(starts, default=None),
                             ",".join(sorted(labels)), ",".join(sorted(labels | found)), score, places))
            cols = list(zip(*rows)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds[1:])]], names)

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, "
             "base_labels string, labels string, score double, n_places long")
