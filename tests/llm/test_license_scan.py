from brevispark.llm import license_scan as op


def test_held_out_lines():
    model = op.train()
    lines = op.labelled_lines(99, 4)
    found = op.scan_texts([t for t, _ in lines], model)
    unknown = [f for f, (_, g) in zip(found, lines) if g == 0]
    known = [(f, g) for f, (_, g) in zip(found, lines) if g]
    assert sum(map(bool, unknown)) <= 0.01 * len(unknown)
    right = sum(any(x[3] == op.FAMILIES[g] for x in f) for f, g in known)
    assert right >= 0.85 * len(known)


def test_notices_inside_paragraphs():
    import random

    model, rnd = op.train(), random.Random(3)
    plain = "the report of the town was read in the hall and a group of people asked for more time to see what the river had done".split()
    for size in (50, 300, 5000):
        for family, templates in op.TEMPLATES.items():
            for template in templates:
                body = [rnd.choice(plain) for _ in range(size)]
                at = rnd.randint(0, size)
                line = " ".join([*body[:at], template, *body[at:]])
                assert [x[3] for x in op.scan_texts([line], model)[0]] == [family], (size, template)
    body = [" ".join(rnd.choice(plain) for _ in range(400)) for _ in range(3)]
    line = f"{body[0]} Released under the MIT License. {body[1]} All rights reserved. {body[2]}"
    found = op.scan_texts(["first\n\n" + line], model)[0]
    assert [(x[0], ("first\n\n" + line)[x[1] : x[2]], x[3]) for x in found] == [(2, "Released under the MIT License.", "mit"), (2, "All rights reserved.", "reserved")]
    assert [x[3] for x in op.scan_texts(["Released under the MIT License. All rights reserved."], model)[0]] == ["mit", "reserved"]
    assert op.scan_texts([" ".join(body)], model) == [[]]


GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
MIT = """/*
 * Permission is hereby granted, free of charge, to any person
 * obtaining a copy of this software and associated documentation
 * files (the "Software"), to deal in the Software without restriction,
 * including without limitation the rights to use, copy, modify, merge,
 * publish, distribute, sublicense, and/or sell copies of the Software.
 */"""
#: Texts written by hand, unlike the training lines and the texts that set the floor.
REAL = [
    (GPL, ["gpl"]), (MIT, ["mit"]), (f"import x\n\n{GPL}\n\ncode = 1\n{MIT}\nmore = 2", ["gpl", "mit"]),
    ("Copyright 2021 Someone\n\nLicensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.", ["apache"]),
    ("My holiday photos from the lake.\nLicensed under CC BY-NC 4.0.\nEnjoy!", ["cc-nc"]), ("Released under the MIT License.\nReleased under the MIT License.", ["mit", "mit"]), ("Page 12\nAll rights reserved.\nPage 13\nAll rights reserved.", ["reserved", "reserved"]),
    ("// This Source Code Form is subject to the terms of the Mozilla\n// Public License, v. 2.0.", ["mpl"]), ("Redistribution and use in source and binary forms, with or\nwithout modification, are permitted provided that the following\nconditions are met.", ["bsd"]),
    ("This is free and unencumbered\nsoftware released into the public domain.", ["public-domain"]), ("The lawyer had a licence,\nbut the public was not told.", []), ("He reserved all the rights\nto the film, and\nthe source was lost.", []),
    ("The terms and conditions of the contest are explained on the next page. Copies may be had from the publisher.", []), ("Free software is discussed in chapter 3; version 2 of the text is better.", []), ("This article is about the license plate of the Apache truck.", []),
]


def test_one_row_for_each_notice_of_real_texts():
    model = op.train()
    for text, want in REAL:
        assert [x[3] for x in op.scan_texts([text], model)[0]] == want, text
    (number, start, end, _, _, _), = op.scan_texts(["x = 1\n\n" + GPL], model)[0]
    assert number == 2 and ("x = 1\n\n" + GPL)[start:end] == GPL[2:]


def test_scores_equal_a_plain_scorer():
    import math

    model = op.train()
    for text in [x for x, _ in op.labelled_lines(3, 1)][:60]:
        ids = [op.word_id(w) for w in text.split() if op.word_id(w) >= 0]
        if not ids:
            continue
        slot = lambda x: (x * 0x9E3779B97F4A7C15 % 2**64) >> (64 - op.BITS)
        seen = [slot(x) for x in ids] + [slot(a * 1_000_003 + b + 7) for a, b in zip(ids, ids[1:])]
        z = [(sum(model.weights[s, c] for s in seen) / math.sqrt(len(ids)) + model.bias[c]) / model.temperature for c in range(len(op.FAMILIES))]
        total = sum(math.exp(v - max(z)) for v in z)
        import numpy as np

        got = model.probabilities(np.array(ids), np.zeros(len(ids), int), 1)[0]
        assert max(abs(g - math.exp(v - max(z)) / total) for g, v in zip(got, z)) < 1e-9


#: Short forms and paragraphs as they are met in files, and texts that only talk of such things; written apart from the templates.
MET = [
    ("# SPDX-License-Identifier: MIT", "mit"), ("// SPDX-License-Identifier: GPL-2.0-or-later", "gpl"), ("/* SPDX-License-Identifier: BSD-3-Clause */", "bsd"), ("# SPDX-License-Identifier: Apache-2.0", "apache"), ("This project is MIT licensed.", "mit"), ("Licensed under GPLv3", "gpl"), ("The server is distributed under the GNU AGPL v3 license.", "gpl"),
    ("The code is available under the Apache 2.0 license.", "apache"), ("All code here is licensed under the BSD license unless noted.", "bsd"), ("(c) 2014 M. Muster, ISC licensed", "isc"), ("This library is licensed under the LGPLv3, see COPYING.LESSER", "gpl"), ("Plugins are available under the MPL 2.0 license", "mpl"),
    ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE", "mit"),
    (" * This program is distributed in the hope that it will be useful,\n * but WITHOUT ANY WARRANTY; without even the implied warranty of\n * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "gpl"), ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS\n\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT\nLIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "isc"), ("Licensed under the EUPL, Version 1.2 or – as soon they will be approved by\nthe European Commission - subsequent versions of the EUPL (the \"Licence\");", "eupl"), ("You should have received a copy of the GNU Affero General Public License\nalong with this program.  If not, see the address below.", "gpl"),
]
TALK = ["MIT and Apache are names that most people know.", "The club is licensed for music until midnight.", "She studied at MIT, which licensed the patent in 1999.", "A GPL car needs gas.", "The BSD group of the hospital met under the old rules.", "Software is licensed, not sold, he said.", "The bridge is distributed under the load of trucks.", "Under the terms of the lease, the garden is free to use.", "The public domain was fenced.", "The kind of warranty that is implied by law differs.", "No license was needed, nor any fee.", "In the hope that it will be useful, she left a map.", "The authors were liable for the damages of the war.", "Copies are available under the counter of the shop."]


def test_forms_that_are_met():
    model = op.train()
    got = [[x[3] for x in op.scan_texts([text], model)[0]] for text, _ in MET]
    inside = [[x[3] for x in op.scan_texts([f"Our town has a river and a mill.\nMany came to see it. {text}\nThe rest is told below, in another place."], model)[0]] for text, _ in MET]
    for found in (got, inside):
        assert sum(family in f for f, (_, family) in zip(found, MET)) >= len(MET) - 1, [(t, f) for (t, k), f in zip(MET, found) if k not in f]
    assert sum(bool(op.scan_texts([t], model)[0]) for t in TALK) == 0


def test_notices_of_one_paragraph_are_found_in_proportion():
    import time

    model, took = op.train(), []
    for n in (1_000, 8_000):
        began = time.process_time()
        assert len(op.scan_texts([" ".join(["Some words of no importance stand here. All rights reserved."] * n)], model)[0]) == n
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.5


def test_the_prefilter_loses_nothing():
    """Stretches that are not scored could not be confirmed: with every line, paragraph and window scored the notices are the same."""
    import numpy as np

    model, every = op.train(), op.train()
    every.marked = np.full_like(every.marked, np.uint64(2**64 - 1))
    texts = [t for t, _ in REAL] + ["\n".join(x for x, _ in op.labelled_lines(11, 1)[i : i + 9]) for i in range(0, 60, 9)]
    assert op.scan_texts(texts, model) == op.scan_texts(texts, every)


def test_many_notices_in_a_long_text():
    import time

    model = op.train()
    text = "\n\n".join(["Some words of no importance stand here. All rights reserved."] * 5_000)
    began = time.perf_counter()
    found = op.scan_texts([text], model)[0]
    assert len(found) == 5_000 and time.perf_counter() - began < 30
    assert found[-1][0] == 9_998 and text[found[-1][1] : found[-1][2]] == "All rights reserved."


def test_notices_in_documents(spark, odd_documents):
    text = "Some words.\nReleased under the MIT License.\n\nThe driver has a license.\nAll rights reserved."
    df = odd_documents.unionByName(spark.createDataFrame([(99, text), (99, text)], "doc_id bigint, text string"), allowMissingColumns=True)
    got = sorted((r.doc_id, r.line, r.family, r.notice, text[r.start : r.end]) for r in op.scan_licenses(df).collect())
    rows = [(99, 1, "mit", "Released under the MIT License.", "Released under the MIT License."), (99, 4, "reserved", "All rights reserved.", "All rights reserved.")]
    assert got == sorted(rows * 2)


def test_empty_table(no_documents):
    assert op.scan_licenses(no_documents).count() == 0
