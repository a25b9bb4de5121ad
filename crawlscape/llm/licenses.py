"""License scans with a generalised suffix automaton over template words.

The automaton is built once from all templates and base phrases. Each document's
words stream through it, giving matching statistics: at every word, the longest
run ending there that occurs in some template. From the state of a word and its
suffix links follow all places of all templates that end there with MIN_RUN words
or more in common; those that don't go on at the next word are the long matches.
They are chained, in order, along their template, and what a chain covers decides
its score and, unless it lies in the span of a better one, its label. Base phrases
are read from the same states: a phrase ends at a word when its state lies on the
suffix path of the current one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, parquet

# Base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public notices, in the words of their licences, by (label, text).
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "This product includes software developed by the Apache Software Foundation (http://www.apache.org/)."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gfdl", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-4-clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mpl", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("epl", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("cddl", "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License."),
    ("eupl", "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications"),
    ("bsl", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("artistic", "This package is free software; you may redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("perl", "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself."),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."),
    ("ncsa", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal with the Software without restriction"),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is available with a FAQ at: http://scripts.sil.org/OFL"),
    ("ms-pl", "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software."),
    ("vim", "There are no restrictions on distributing unmodified copies except that they must include this license text."),
]
MIN_RUN, MAX_GAP, MIN_COVER = 3, 12, 0.6

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased. In UTF-8 every byte of a
    non-ASCII character is above 0x7F, so that bytes can be classed one at a time."""
    return (text or "").encode("utf-8").translate(_TABLE).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word ids."""

    def __init__(self, strings: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.final: list[int] = []
        for string in strings:
            last = 0
            for word in string:
                last = self._extend(last, word)
            self.final.append(last)

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs), self.length.append(length), self.link.append(link)
        return len(self.length) - 1

    def _split(self, parent: int, word: int, child: int) -> int:
        clone = self._state(self.length[parent] + 1, self.link[child], dict(self.next[child]))
        self.link[child] = clone
        while parent >= 0 and self.next[parent].get(word) == child:
            self.next[parent][word] = clone
            parent = self.link[parent]
        return clone

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new, at = self._state(self.length[last] + 1, 0, {}), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            child = self.next[at][word]
            self.link[new] = child if self.length[child] == self.length[at] + 1 else self._split(at, word, child)
        return new


class Scanner:
    def __init__(self, templates: Sequence[tuple[str, str]], phrases: dict[str, str]):
        self.names = [name for name, _ in templates]
        texts = [words_of(t) for _, t in templates]
        self.sizes = [len(t) for t in texts]
        bases = [words_of(p) for p in phrases]
        self.labels = [*phrases.values()]
        self.ids = {w: i for i, w in enumerate(sorted({w for t in [*texts, *bases] for w in t}))}
        code = lambda t: [self.ids[w] for w in t]
        self.coded = [code(t) for t in texts]
        self.sam = SuffixAutomaton([*self.coded, *map(code, bases)])
        own = {s: (i, len(bases[i])) for i, s in enumerate(self.sam.final[len(texts) :])}
        self.ends: list[list[tuple[int, int]]] = []
        for state in range(len(self.sam.link)):
            found, at = [], state
            while at > 0:
                if at in own:
                    found.append(own[at])
                at = self.sam.link[at]
            self.ends.append(found)
        # where the strings of a state, and of none below it, end: (template, end)
        self.places: list[set[tuple[int, int]]] = [set() for _ in self.sam.link]
        for k, text in enumerate(self.coded):
            at = 0
            for i, w in enumerate(text):
                at = self.sam.next[at][w]
                up = at
                while up > 0 and (k, i) not in self.places[up]:
                    self.places[up].add((k, i))
                    up = self.sam.link[up]
        self.matched: list[list[tuple[int, int, int]]] = []
        for state in range(len(self.sam.link)):
            seen: set[tuple[int, int]] = set()
            found3, at, most = [], state, 1 << 60
            while at > 0 and self.sam.length[at] >= MIN_RUN:
                for place in sorted(self.places[at] - seen):
                    found3.append((*place, min(most, self.sam.length[at])))
                seen |= self.places[at]
                at = self.sam.link[at]
            self.matched.append(found3)

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[list[tuple[int, int, int]]]]:
        """Base phrase places (phrase, start), and for each template its long matches (start, start in the template,
        size), which can't be extended on either side, in the order of their ends."""
        get, arcs, link, length = self.ids.get, self.sam.next, self.sam.link, self.sam.length
        state = run = 0
        places: list[tuple[int, int]] = []
        found: list[list[tuple[int, int, int]]] = [[] for _ in self.coded]
        codes = [*map(get, words), None]
        for i, w in enumerate(codes[:-1]):
            if w is None:
                state = run = 0
                continue
            if w not in arcs[state]:
                while state and w not in arcs[state]:
                    state = link[state]
                run = length[state]
            if w in arcs[state]:
                state, run = arcs[state][w], run + 1
            for phrase, size in self.ends[state]:
                if size <= run:
                    places.append((phrase, i - size + 1))
            if run >= MIN_RUN:
                after = codes[i + 1]
                for k, end, size in self.matched[state]:
                    size, text = min(size, run), self.coded[k]
                    if size >= MIN_RUN and (after is None or end + 1 == len(text) or text[end + 1] != after):
                        found[k].append((i - size + 1, end - size + 1, size))
        return places, found

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], dict[int, list[tuple[float, int, int]]]]:
        """Base phrase places, and per template its chains (coverage, first, last word), best first, of which none
        overlaps a better one of the template; the first is there for any long match, others cover MIN_COVER."""
        places, found = self.matches(words)
        return places, {k: self._chains(k, runs) for k, runs in enumerate(found) if runs}

    def _chains(self, k: int, runs: list[tuple[int, int, int]]) -> list[tuple[float, int, int]]:
        """Chains of runs, in order in both texts, with gaps up to MAX_GAP; where two runs overlap the later one
        counts from where the earlier one ends."""
        chains: list[tuple[int, int, int, int]] = []  # covered, first word, end in the document, end in the template
        for start, p, n in runs:
            best = (n, start, start + n, p + n)
            for c, first, de, te in reversed(chains):
                if de < start - MAX_GAP:
                    break
                lap = max(0, de - start, te - p)
                if lap < n and p - te <= MAX_GAP and c + n - lap > best[0]:
                    best = (c + n - lap, first, start + n, p + n)
            chains.append(best)
        taken: list[tuple[float, int, int]] = []
        for c, first, end, _ in sorted(chains, key=lambda x: (-x[0], x[1], x[2])):
            if taken and c < MIN_COVER * self.sizes[k]:
                break
            if all(end <= a or first > b for _, a, b in taken):
                taken.append((c / self.sizes[k], first, end - 1))
        return taken

    def attributed(self, chains: dict[int, list[tuple[float, int, int]]]) -> list[tuple[str, int, int]]:
        """(label, first, end) of all chains that cover MIN_COVER of their template, without those that lie for more
        than half in the span of one that covers more words."""
        good = [(c * self.sizes[k], c, a, b + 1, self.names[k]) for k, own in chains.items() for c, a, b in own if c >= MIN_COVER]
        kept: list[tuple[str, int, int]] = []
        for _, _, a, b, name in sorted(good, key=lambda x: (-x[0], -x[1], x[2], x[4])):
            if all(2 * (min(b, e) - max(a, s)) <= b - a for _, s, e in kept):
                kept.append((name, a, b))
        return sorted(kept, key=lambda x: (x[1], x[0]))


@lru_cache(maxsize=4)
def _scanner(templates: tuple, phrases: tuple) -> Scanner:
    return Scanner(templates, dict(phrases))


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]


def scan_licenses(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: Sequence[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row per input row. A null or empty text has no words, no labels and score 0; only ``keep``
    and ``text`` are read, so that clashing further columns do no harm."""
    given = (tuple(map(tuple, templates or TEMPLATES)), tuple((phrases or BASE_PHRASES).items()))
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*given)
        for batch in batches:
            rows = []
            for value in batch.column(batch.num_columns - 1):
                words = words_of(value.as_py())
                places, chains = scanner.scan(words)
                base = sorted({scanner.labels[p] for p, _ in places})
                kept = scanner.attributed(chains)
                own = {name for name, _, _ in kept}
                starts = [s for _, s in places]
                score = 1.0 if places else max((c[0][0] for c in chains.values()), default=0.0)
                spans = ",".join(f"{n}:{a}:{b}" for n, a, b in kept)
                rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted(own | set(base))), min(1.0, score), spans))
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            out = [pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], names=[*keep, *names])

    bounded_batches(df)
    kept = df.select(*keep, text)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{head}, {SCHEMA}")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License places, labels and covered spans of every document. A null or empty text has no words and score 0;
    rows are scanned each, repeated ones too; an empty table has no rows."""
    return scan_licenses(parquet(spark, sf_dir, "documents"))
