"""Licence scans: a trained classifier of paragraphs, confirmed by comparison with templates.

Paragraphs are runs of lines without a blank one between them; a wrapped notice is read across its lines. A multinomial logistic
regression over hashed word unigrams and bigrams, trained here from the templates below (whole, cut, embedded and perturbed)
and from lines that are no notices, gives a stretch of words a licence family or `unknown`. Its temperature and its confidence
floor are set on texts written by hand (`HELD`), which training never sees: a family counts only above one half, and above what those
unknown ones among them reach that a template would confirm.

A paragraph is judged as a whole, line by line, and in overlapping windows, a half (eight words at most) longer than each template. A
prediction is confirmed when the stretch holds a template of the family or, for whole lines and paragraphs, lies within one, by
shared word pairs; unconfirmed ones stay unknown. Stretches with too few word pairs of any template could not be confirmed and
are not scored. Predictions that rest on the same words, or on pieces of one template, are one notice: that with most word
pairs counts, and grows by those that add to its template.

Defined cases: null and empty texts have no paragraphs and no result; paragraphs without a word are skipped. Ties between
families go to the one listed first. Lines, paragraphs and texts of any length, with any number of notices, are read whole;
repeated rows are scanned one by one; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, carried, column_texts, fields_of, held, pieces, ranges, runs

# The notices by which licences are recognised.
TEMPLATES = {
    "apache": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Licensed under the Apache License, Version 2.0.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "mit": ("Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This library is free software under the GNU Lesser General Public License, version 2.1 or later."),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "cc-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."),
    "cc-open": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License."),
    "public-domain": ("This is free and unencumbered software released into the public domain.", "Dedicated to the public domain under CC0 1.0 Universal."),
    "reserved": ("All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher."),
}
# Further paragraphs of the licences' own texts.
MORE = {
    "apache": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "See the License for the specific language governing permissions and limitations under the License."),
    "mit": ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "gpl": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "You should have received a copy of the GNU General Public License along with this program.", "You should have received a copy of the GNU Affero General Public License along with this program.", "under the terms of the GNU Affero General Public License", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    "bsd": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    "mpl": ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    "eupl": ("Licensed under the EUPL, Version 1.2 or, as soon they will be approved by the European Commission, subsequent versions of the EUPL.", "You may not use this work except in compliance with the Licence.", "European Union Public Licence"),
    "public-domain": ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
}
# Names of licences, and how a short notice uses one.
NAMES = {
    "apache": ("Apache 2.0", "Apache-2.0", "Apache v2"), "mit": ("MIT", "Expat"), "gpl": ("GPL", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0", "GPL-2.0-or-later", "GPL-3.0-or-later", "GPL-3.0-only", "GNU GPL", "GNU GPL v3", "LGPL", "LGPLv3", "LGPL-2.1", "GNU LGPL", "AGPL", "AGPLv3", "AGPL-3.0", "GNU AGPL v3"),
    "bsd": ("BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD 2-Clause", "BSD 3-Clause", "New BSD"), "mpl": ("MPL", "MPL 2.0", "MPL-2.0", "MPLv2"), "isc": ("ISC",), "eupl": ("EUPL", "EUPL-1.2", "EUPL v1.2"), "cc-open": ("CC-BY-4.0", "CC-BY-SA-4.0"), "cc-nc": ("CC-BY-NC-4.0", "CC-BY-NC-SA-4.0"), "public-domain": ("CC0-1.0", "Unlicense"),
}
SHORT = ("SPDX-License-Identifier: {}", "{} licensed", "licensed under {}", "licensed under the {}", "available under the {} license", "licensed under the {} license", "distributed under the {} license")
TEMPLATES = {k: (*TEMPLATES.get(k, ()), *MORE.get(k, ()), *(form.format(name) for name in NAMES.get(k, ()) for form in SHORT)) for k in dict.fromkeys((*TEMPLATES, *MORE))}
# Lines that look a little like notices and are none.
OTHERS = (
    "Students of MIT and licensed drivers were asked.", "The GPL of the club was a popular game.", "Under the new licence the shop may sell beer.", "The software is provided by the school.", "He was licensed under the old law.", "The paper is available under the counter.", "Goods are distributed under the bridge.", "In no event was the train late.", "Taxis are licensed under the rules of the city.", "The pilot was licensed under the act of 1902.", "He is licensed under the name of his firm.", "The warranty of goods is a matter of law.", "Without a warranty of any kind of help they left.", "The hall was available under the terms of the gift.", "Milk is distributed under the care of the town.", "The inn was licensed for the sale of wine.",
    "The driver showed a valid license at the border and went on.", "A license to teach is required in most states.", "Version 2.0 of the report is under review.", "The terms of the agreement were published in May.", "Please see the file for further information.", "This work is based on earlier results of the group.",
    "The software was released in the spring of last year.", "The public was free to use the domain of the castle.", "All members reserved their seats early.", "The copy of the letter was granted to the museum without charge.", "He was licensed as a pilot in 1931.", "General public interest in the work is low.", "Rights and duties of the parties are listed below.",
    "Source and binary stars were observed in both forms.", "The conditions of use are explained on the first page.", "Attribution of the painting is uncertain.", "The creative commons of the village is a meadow.", "Apache helicopters were seen over the valley.", "The Mozilla browser opened the page.", "The students of MIT met in the hall.",
    "Distribution of the goods is organised by the town.", "Permission to enter was refused.", "The foundation published its yearly report.", "No warranty claims were made this year.", "Die Lizenz wurde im Mai verlängert.", "Tous les droits de douane ont été payés.", "La licencia de obras fue concedida ayer.",
)
# Texts written by hand as such notices are met, and as other texts are, to set temperature and floor on.
HELD = {
    "apache": ("Copyright 2019 The Authors. Licensed under the Apache License, Version 2.0; see the file LICENSE.", "This module is released under the Apache License, Version 2.0, a copy of which is enclosed.", "you may not use this file except in compliance with the License. You may obtain a copy of the License at the address below"),
    "mit": ("This package is licensed under the terms of the MIT license, see COPYING.", "(c) 2016 J. Doe. Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its documentation, to deal in the Software without restriction"),
    "gpl": ("This is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3, as published by the Free Software Foundation.", "The manual is licensed under the GNU General Public License, version 3.", "This library is free software under the GNU Lesser General Public License"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted", "Code released under the BSD 3-Clause License by its authors."),
    "mpl": ("This file is subject to the terms of the Mozilla Public License, v. 2.0. A copy is enclosed.", "Licensed under the Mozilla Public License, version 2.0, as of today."),
    "cc-nc": ("Photos are licensed under CC BY-NC 4.0.", "This article is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License, see there."),
    "cc-open": ("Content is licensed under CC BY 4.0.", "This page is licensed under a Creative Commons Attribution 4.0 International License.", "The text is available under the Creative Commons Attribution-ShareAlike License; more terms may apply."),
    "public-domain": ("This is free and unencumbered software released into the public domain by its author.", "The data are dedicated to the public domain under CC0 1.0 Universal."),
    "reserved": ("(c) 2001 The Daily News. All rights reserved.", "No part of this publication may be reproduced or sent without the prior written permission of the publisher."),
    "isc": ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the notice appears in all copies.", "This tool is ISC licensed."),
    "eupl": ("Licensed under the EUPL, Version 1.2 only.", "SPDX-License-Identifier: EUPL-1.2"),
    "unknown": (
        "Licensed under the counter, they said, and laughed.", "The MIT building was available under the old contract.", "Distributed under the trees, the seats were soon taken.", "The BSD of the school met on Monday.", "The new licensed shop sells wine.", "The software is provided by the teacher, with a book.", "Without any warranty of success she began to write.",
        "You need a licence to fish in the river, and it is sold in the village shop.", "The council reserved all rights of way along the shore.", "The software was written in the winter and released in the spring.", "She works at the public library, near the general hospital.", "Both versions of the file are kept in the source folder.",
        "Permission was granted by the owner of the land, free of charge.", "The terms of the peace were harsh, and few were content with them.", "Apache, a town of the south, has a licence office.", "They met at MIT and later at Berkeley.", "The commons were open to all who kept sheep.", "A copy of the letter is in the museum.", "No part of the bridge was left after the storm.",
        "Attribution is hard where the painter left no name.", "All members shall be given a copy of the rules.", "In no event was the race to be held on a Sunday.", "The work is in two parts, of which the first is lost.", "La obra fue publicada con permiso del autor.", "Das Werk ist in zwei Teilen erschienen.", "Le permis de conduire est valable dix ans.", "Universal rules do not hold in every domain.",
        "The warranty of the car ends after three years.", "She was licensed to practise law in 2004.", "Modified versions of the recipe are found along the coast.", "The notice was put up at the door of the church.", "Public interest in the case was low.", "The free press of the city was founded then.",
    ),
}
FAMILIES = ("unknown", *TEMPLATES)
BITS = 15
#: A template with fewer word pairs has to be there as a whole.
LEAST_PAIRS = 5
EDGE = ".,;:!?\"'()[]{}*_`<>|#/-="


WORD = re.compile(r"\S+")


def words(line: str) -> list[str]:
    return [w for x in line.lower().split() if (w := x.strip(EDGE))]


def word_id(word: str) -> int:
    """31-bit hash of a word in lower case without edges, -1 for nothing but marks."""
    w = word.lower().strip(EDGE)
    return xxhash.xxh32_intdigest(w) >> 1 if w else -1


def slots(ids: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of unigrams and bigrams, and the line of each."""
    with_next = line[1:] == line[:-1]
    pair = (ids[:-1] * 1_000_003 + ids[1:])[with_next]
    scatter = lambda x: (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate([scatter(ids), scatter(pair + 7)]), np.concatenate([line, line[:-1][with_next]])


class Classifier:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float, floor: float):
        self.weights, self.bias, self.temperature, self.floor = weights, bias, temperature, floor
        self.memo = Memo(word_id, 200_000)
        self.cores = {k: [(len(w), frozenset(zip(w, w[1:]))) for w in map(words, v)] for k, v in TEMPLATES.items()}
        sizes = {(n, len(t)) for v in self.cores.values() for n, t in v}
        self.lengths = {n: min(c for m, c in sizes if m == n) for n, _ in sizes}  # of templates in words, with the fewest pairs
        # slots of the templates' word pairs: a bit for each length of templates that have the pair
        self.marked = np.zeros(1 << BITS, np.uint64)
        self.bit = {n: np.uint64(1 << min(i, 62)) for i, n in enumerate(sorted(self.lengths))}
        for template in (words(t) for v in TEMPLATES.values() for t in v):
            ids = np.array([word_id(w) for w in template])
            self.marked[slots(ids, np.zeros(len(ids), int))[0][len(ids) :]] |= self.bit[len(template)]

    def probabilities(self, ids: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
        """Of the families, for each of n lines; ids and line: words and their lines, ascending."""
        slot, owner = slots(ids, line)
        total = np.zeros((n, len(FAMILIES)))
        hit = self.used[slot]
        slot, owner = slot[hit], owner[hit]
        for c in range(len(FAMILIES)):
            total[:, c] = np.bincount(owner, self.weights[slot, c], n)
        size = np.sqrt(np.maximum(np.bincount(line, minlength=n), 1))[:, None]
        z = (total / size + self.bias) / self.temperature
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(1, keepdims=True)

    @property
    def used(self) -> np.ndarray:
        if not hasattr(self, "_used"):
            self._used = np.abs(self.weights).max(1) > 0
        return self._used

    def confirmed(self, family: str, tokens: list[str], length: int | None = None) -> tuple[float, list[int]]:
        """How well words agree with the best template of a length, and where the common pairs begin: the share of the template's word
        pairs that they hold. Without a length (whole lines and paragraphs) all templates count, and also the share of the words' own
        pairs that lie within one."""
        own = list(zip(tokens, tokens[1:]))
        inner = frozenset(own)
        best, most, core = 0.0, 0, frozenset()
        for n, t in self.cores[family]:
            if length is not None and n != length:
                continue
            common = len(inner & t)
            match = common / max(1, len(t))
            if len(t) < LEAST_PAIRS:
                match = float(common == len(t) > 0)  # of a short form, every word counts
            elif length is None and len(own) >= 4:
                match = max(match, sum(p in t for p in own) / len(own))
            if (match, common) > (best, most):
                best, most, core = match, common, t
        return best, [i for i, p in enumerate(own) if p in core]

    def common(self, family: str, tokens: list[str]) -> int:
        """Word pairs that some words share with one template at most."""
        own = frozenset(zip(tokens, tokens[1:]))
        return max(len(own & t) for _, t in self.cores[family])

    def stretches(self, ids: np.ndarray, sizes: np.ndarray, lines: np.ndarray, agreement: float):
        """Yields begins, lengths and paragraphs of the stretches that hold enough marked pairs to be confirmed, and the length of the
        templates that they are for: windows of each template length, and None for lines and paragraphs of several lines. ids: words of
        paragraphs of the given sizes; lines: sizes of their lines."""
        first = runs(sizes)[:-1]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        slot = slots(ids, owner)[0][len(ids) :]
        inside = np.ones(len(ids), bool)
        inside[first[1:] - 1] = inside[-1] = False  # the last word of a paragraph begins no pair
        marks = np.zeros(len(ids), np.uint64)
        marks[inside] = self.marked[slot]
        hits = np.flatnonzero(marks)  # few, so what follows looks at these alone
        least = lambda pairs: pairs if pairs < LEAST_PAIRS else int(np.ceil(agreement * pairs - 1e-9))

        def enough(starts: np.ndarray, lengths: np.ndarray, n: int | None) -> np.ndarray:
            """Which stretches hold enough pairs for templates of a length, or (None) could lie within a template."""
            own = hits if n is None else hits[(marks[hits] & self.bit[n]) > 0]
            count = np.searchsorted(own, starts + lengths) - np.searchsorted(own, starts)
            return count >= (np.maximum(3, agreement * (lengths - 1) - 1e-9) if n is None else least(self.lengths[n]))

        begin, longest = runs(lines)[:-1], 2 * max(self.lengths)  # what is longer can't lie within a template
        fits = {n: enough(first, sizes, n) for n in self.lengths}
        whole = np.logical_or.reduce([enough(begin, lines, n) for n in (None, *self.lengths)])
        some = np.flatnonzero(whole & (lines <= longest))
        yield begin[some], lines[some], owner[begin[some]], None
        several = np.bincount(owner[begin], minlength=len(sizes)) > 1
        several = np.flatnonzero(several & (sizes <= longest) & np.logical_or.reduce([enough(first, sizes, None), *fits.values()]))
        yield first[several], sizes[several], several, None
        for n in sorted(self.lengths):
            width = n + max(2, min(n // 2, 8))
            stride = min(width - n, width // 2)
            long = np.flatnonzero(fits[n] & (sizes > width))
            count = -(-(sizes[long] - width) // stride) + 1
            paragraph = np.repeat(long, count)
            begin = first[paragraph] + stride * ranges(np.zeros(len(long), np.int64), count)
            length = np.minimum(width, first[paragraph] + sizes[paragraph] - begin)
            good = enough(begin, length, n)
            yield begin[good], length[good], paragraph[good], n


def labelled_lines(seed: int, copies: int) -> list[tuple[str, int]]:
    """Lines with the number of their family: templates whole, with words lost, embedded in other words, or wrapped; others as
    they are, shuffled, and strings of invented words."""
    rnd = random.Random(seed)
    syllables = [a + b for a in "bcdfghlmnprstvw" for b in ("a", "e", "i", "o", "u", "en", "er", "ion")]
    invent = lambda n: ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) if rnd.random() < 0.7 else rnd.choice(("the", "of", "and", "in", "to", "der", "und", "de", "la", "que", "is", "for", "with", "on", "by")) for _ in range(n)]
    out = []
    for _ in range(copies):
        for number, family in enumerate(FAMILIES[1:], 1):
            for template in [*TEMPLATES[family]] * max(1, 24 // len(TEMPLATES[family])):  # families of few templates count as much
                tokens = template.split()
                kind = rnd.random()
                if kind < 0.3 and len(tokens) > 7:
                    tokens = [t for t in tokens if rnd.random() > 0.08]
                elif kind < 0.5 and len(tokens) > 14:
                    a = rnd.randrange(0, len(tokens) - 9)
                    tokens = tokens[a : a + rnd.randint(9, 14)]
                elif kind < 0.8:
                    more = max(4, len(tokens) // 2)  # as much as a window holds beside a template
                    tokens = [*invent(rnd.randint(0, more)), *tokens, *invent(rnd.randint(0, more))]
                out.append((" ".join(tokens), number))
        for line in OTHERS:
            tokens = line.split()
            if rnd.random() < 0.4:
                rnd.shuffle(tokens)
            out.append((" ".join([*tokens, *invent(rnd.randint(0, 6))]), 0))
        out += [(" ".join(invent(rnd.randint(1, 60))), 0) for _ in range(20)]
    return out


def _arrays(lines: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    ids, owner = [], []
    for i, line in enumerate(lines):
        own = [w for w in map(word_id, line.split()) if w >= 0]
        ids += own
        owner += [i] * len(own)
    return np.array(ids, np.int64), np.array(owner, np.int64)


def train(seed: int = 5, copies: int = 12, rounds: int = 150, rate: float = 0.5, decay: float = 1e-4, agreement: float = 0.6) -> Classifier:
    """Gradient steps on the training lines, then temperature and confidence floor from texts written by hand; about two seconds."""
    lines = labelled_lines(seed, copies)
    ids, owner = _arrays([x for x, _ in lines])
    slot, line = slots(ids, owner)
    n, gold = len(lines), np.eye(len(FAMILIES))[[g for _, g in lines]]
    value = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))
    weights, bias = np.zeros((1 << BITS, len(FAMILIES))), np.zeros(len(FAMILIES))
    seen, inverse = np.unique(slot, return_inverse=True)
    w, squares, bias_squares = np.zeros((len(seen), len(FAMILIES))), 1e-8, 1e-8
    for _ in range(rounds):
        z = np.stack([np.bincount(line, w[inverse, c], n) for c in range(len(FAMILIES))], 1) * value[:, None] + bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        r = (gold - p) * value[:, None]
        g = np.stack([np.bincount(inverse, r[line, c], len(seen)) for c in range(len(FAMILIES))], 1) - decay * n * w
        b = (gold - p).sum(0)
        squares, bias_squares = squares + g * g, bias_squares + b * b
        w, bias = w + rate * g / np.sqrt(squares), bias + rate * b / np.sqrt(bias_squares)
    weights[seen] = w
    held = [(x, FAMILIES.index(family)) for family, texts in HELD.items() for x in texts]
    ids, owner = _arrays([x for x, _ in held])
    truth = np.array([g for _, g in held])
    best = None
    for t in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0):
        p = Classifier(weights, bias, t, 0).probabilities(ids, owner, len(held))
        loss = -np.log(p[np.arange(len(held)), truth] + 1e-12).mean()
        if best is None or loss < best[0]:
            best = loss, t, p
    # what unknown ones reach that a template would confirm; no others can become a notice
    model, p = Classifier(weights, bias, best[1], 0), best[2]
    reached = [p[i, c] for i in np.flatnonzero(truth == 0) for c in range(1, len(FAMILIES)) if model.confirmed(FAMILIES[c], words(held[i][0]))[0] >= agreement]
    model.floor = max(0.5, float(max(reached, default=0.0)))
    return model


def paragraphs_of(text: str, memo):
    """Paragraphs with a word: first line number, begin, end (code points), and the word ids of each of its lines."""
    at, now = 0, None
    for number, line in enumerate(text.split("\n")):
        if not line or line.isspace():
            if now:
                yield now
            now = None
        elif own := [w for w in map(memo, line.split()) if w >= 0]:
            if now is None:
                now = [number, at, 0, []]
            now[2] = at + len(line)
            now[3].append(own)
        at += len(line) + 1
    if now:
        yield now


def notices_of(found: list[tuple], tokens: list[str], model: Classifier) -> list[tuple[int, int, int, float, float]]:
    """The notices of a paragraph from its confirmed stretches (agreement, probability, family, places of the common pairs): family,
    first and last word, probability, agreement. Stretches with most pairs of one template come first, of those the shortest.

    Notices are looked up by where they stand, so that the work grows in proportion to them."""
    out: list[list] = []
    at: dict[int, list[int]] = {}
    step = 64

    def around(a: int, b: int) -> list[list]:
        """Notices that touch some words or stand close by, in the order in which they were found."""
        return [out[i] for i in sorted({i for k in range((a - 4) // step, (b + 4) // step + 1) for i in at.get(k, ())})]

    def place(i: int, a: int, b: int) -> None:
        for k in range(a // step, b // step + 1):
            if i not in at.setdefault(k, []):
                at[k].append(i)

    ranked = [(model.common(FAMILIES[f], tokens[w[0] : w[-1] + 2]), m, q, f, w) for m, q, f, w in found]
    for pairs, match, probability, family, where in sorted(ranked, key=lambda x: (-x[0], x[4][-1] - x[4][0], -x[1], -x[2], x[3], x[4])):
        a, b = where[0], where[-1] + 1  # the last pair's second word
        close = around(a, b)
        if any(2 * sum(n[1] <= x < n[2] for x in where) > len(where) for n in close if n[0] != family):
            continue
        near = [n for n in close if n[0] == family and a <= n[2] + 3 and n[1] <= b + 3]
        for n in near:
            lo, hi = min(a, n[1]), max(b, n[2])
            if (now := model.common(FAMILIES[family], tokens[lo : hi + 1])) > n[5]:  # pieces of one template
                n[1], n[2], n[5] = lo, hi, now
                place(n[6], lo, hi)
                break
        else:
            if not any(a < n[2] and n[1] < b for n in near):
                out.append([family, a, b, probability, match, pairs, len(out)])
                place(len(out) - 1, a, b)
    return [tuple(n[:5]) for n in sorted(out, key=lambda n: (n[1], n[2], n[0]))]


def scan_texts(texts: Sequence[str | None], model: Classifier, agreement: float = 0.6) -> list[list[tuple[int, int, int, str, float, float]]]:
    """For each text its notices: line number, begin and end (code points), family, probability, agreement with a template."""
    memo, ids, lines, spots = model.memo.__getitem__, [], [], []
    for i, text in enumerate(texts):
        for number, begin, end, own in paragraphs_of(text or "", memo):
            spots.append((i, begin, end))
            ids.append([w for line in own for w in line])
            lines += map(len, own)
    out: list[list] = [[] for _ in texts]
    if not spots:
        return out
    sizes = np.array([len(x) for x in ids], np.int64)
    flat = np.fromiter((w for x in ids for w in x), np.int64, int(sizes.sum()))
    first = runs(sizes)
    found: dict[int, list] = {}
    split: dict[int, tuple[list[str], list[tuple[int, int]]]] = {}
    for begin, length, paragraph, size in model.stretches(flat, sizes, np.array(lines, np.int64), agreement):
        if not len(begin):
            continue
        p = model.probabilities(flat[ranges(begin, length)], np.repeat(np.arange(len(begin)), length), len(begin))
        best = p.argmax(1)
        for j in np.flatnonzero((best > 0) & (p.max(1) >= model.floor)):
            at = int(paragraph[j])
            if at not in split:
                i, x, y = spots[at]
                spans = [(m.start(), m.end()) for m in WORD.finditer(texts[i][x:y]) if m[0].strip(EDGE)]
                split[at] = words(texts[i][x:y]), [(x + a, x + b) for a, b in spans]
            a = int(begin[j] - first[at])
            match, where = model.confirmed(FAMILIES[best[j]], split[at][0][a : a + int(length[j])], size)
            if match >= agreement:
                found.setdefault(at, []).append((match, float(p[j, best[j]]), int(best[j]), [a + x for x in where]))
    last = -1, 0, 0
    for at in sorted(found):
        i, x, _ = spots[at]
        tokens, spans = split[at]
        for family, a, b, probability, match in notices_of(found[at], tokens, model):
            start = spans[a][0]
            known, line = last[1:] if last[0] == i and last[1] <= start else (0, 0)
            line += texts[i].count("\n", known, start)
            last = i, start, line
            out[i].append((line, start, spans[b][1], FAMILIES[family], probability, match))
    return out


def scan_licenses(documents: DataFrame, model: Classifier | None = None, agreement: float = 0.6, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Returns a row per confirmed notice: keep, line (from 0) where it begins, start and end in code points, family, probability,
    agreement and notice (the text from the first word that agrees with the template to the last)."""
    shared = documents.sparkSession.sparkContext.broadcast(model or train())  # 2^15 slots a family
    taken, names, read = carried(documents, keep, text)
    fields = [*fields_of(taken, names), "line int", "start int", "end int", "family string", "probability double", "agreement double", "notice string"]

    def run(batches):
        own = shared.value
        held("licenses")  # frees what other operators have left
        for whole in batches:
            for batch in pieces(whole, read):
                texts = column_texts(batch.column(read))
                rows = [(i, *x) for i, found in enumerate(scan_texts(texts, own, agreement)) for x in found]
                if rows:
                    i, line, a, b, family, p, match = zip(*rows)
                    at = pa.array(i)
                    columns = [*(batch.column(n).take(at) for n in names), pa.array(line, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(family), pa.array(p), pa.array(match), pa.array([texts[j][x:y] for j, x, y in zip(i, a, b)])]
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, "line", "start", "end", "family", "probability", "agreement", "notice"])

    out = taken.mapInArrow(run, ", ".join(fields))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *out.columns[len(keep) :])
