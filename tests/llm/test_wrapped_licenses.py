"""Notices broken over lines."""

import random
import textwrap

import pytest

from tidemark.llm import licenses


@pytest.mark.parametrize("mark", ["", "# ", " * "])
@pytest.mark.parametrize("width", [30, 45, 75])
def test_wrapped_notices_are_found(mark, width):
    join = licenses.Join({})
    for k, (label, text, _, _) in enumerate(licenses.TEMPLATES):
        for before in ("", "Some words of prose come first and then"):
            wrapped = "\n".join(mark + line for line in textwrap.wrap(f"{before} {text} and more words after it", width, break_long_words=False))
            assert label in {f[1] for f in licenses.scan_text(wrapped, join)[2]}, (k, wrapped)


def test_wrapped_runs_equal_brute_force():
    join, r = licenses.Join({}), random.Random(8)
    vocabulary = [w.decode() for _, s in licenses.template_sets() for w in s] + ["filler", "other", "lesser", "noncommercial", "sa"]
    for n in range(150):
        text = licenses.TEMPLATES[n % len(licenses.TEMPLATES)][1].split()
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 20))] + [w for w in text if r.random() > 0.1] + [r.choice(vocabulary) for _ in range(20)]
        text = "".join(w + r.choice(["\n", " ", " "]) for w in words)
        lines = [licenses.words(x) for x in text.split("\n")]
        flat = [w for x in lines for w in x]
        line_of = [n for n, x in enumerate(lines) for _ in x]
        want = set()
        for k, (label, held) in enumerate(licenses.template_sets()):
            need, bar = (set(licenses.words(x)) for x in licenses.TEMPLATES[k][2:])
            runs = [range(i, min(len(flat), i + join.spans[k])) for i in range(len(flat)) if flat[i] in held]
            runs = [[flat[j] for j in x] for x in runs if len({line_of[j] for j in x if flat[j] in held}) > 1]
            if any(len(held & set(b)) >= join.templates[k][3] and need <= set(b) and not bar & set(b) for b in lines + runs):
                want.add(label)
        assert {f[1] for f in licenses.scan_text(text, join)[2]} == want


def test_like_wording_gives_no_false_label():
    join = licenses.Join({})
    for text, labels in {
        "Released under the Apache License": set(),
        "released under the gpl license": set(),
        "Licensed under CC BY 4.0": set(),
        "Licensed under CC BY-NC-SA 4.0": set(),
        "This work is licensed under a Creative Commons Attribution 4.0 International License": {"cc-by"},
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": {"cc-by-sa"},
        "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0\nInternational License": {"cc-by-nc"},
        "it under the terms of the GNU Lesser General Public License": set(),
        "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public License": set(),
        "This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License": {"gpl-3"},
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/": set(),
        "Licensed under the Apache License, Version 1.1": set(),
        "Released under the MIT License": {"mit"},
    }.items():
        assert {label for _, label, _ in licenses.scan_text(text, join)[2]} == labels, text


def test_phrases_by_the_thousand_take_linear_time():
    import time

    began = time.time()
    n, places, _ = licenses.scan_text("under the mit license " * 100_000, licenses.Join({}))
    assert n == 400_000 and [p for p, _ in places[:3]] == [0, 4, 8] and places[-1][0] == 399_996 and time.time() - began < 10
