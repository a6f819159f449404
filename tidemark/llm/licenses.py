"""License scans: fixed phrases, and an exact set-similarity join of text lines and runs of words with license templates.

Every line is a block, the set of its words, and so is every run of words across line ends
that is as long as a template divided by ``THRESHOLD`` (runs around a line that meets the
template by itself are left to that line). A block meets a template if it holds at least
``THRESHOLD`` of the template's distinct words. Words are ordered by their count over all
documents, rarest first; a template is reached only from the words of its prefix, blocks
with too few template words are passed over (length), so are those whose later words cannot
reach the threshold (positional), and the rest are verified. No block is missed. Of the blocks
that meet a template those count that hold the words which tell its license from others of
like wording, and none that names another.

Defined results: null text counts as empty (no words, nothing found, score 0); repeated
rows are each judged; ties between templates all give their labels; other columns stay,
those named as an output are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_slice, table

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: License sentences as their publishers word them, the words that a block must hold to be told from
#: other licenses of like wording, and those that it must not hold.
_CC = "noncommercial nc noderivatives noderivs nd sharealike sa"
TEMPLATES = [
    ("apache-2", "Licensed under the Apache License, Version 2.0", "apache 2", ""),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache 2", ""),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "redistributions retain", ""),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution", _CC),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc", "sa nd"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "creative commons attribution noncommercial", "sharealike noderivatives noderivs"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike License", "creative commons attribution sharealike", "noncommercial"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", "gnu general public 3", "lesser affero"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gnu general public", "lesser affero"),
    ("mit", "Released under the MIT License", "mit", ""),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission granted free software", ""),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public 2", ""),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered public domain", ""),
]
THRESHOLD = 0.8
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LINES = bytes(c if c == 10 else _TABLE[c] for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def template_sets() -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(words(t))) for label, t, _, _ in TEMPLATES]


def word_counts(docs: DataFrame, text: str = "text") -> dict[bytes, int]:
    """Count of each template word over all documents (as many rows as the templates have words)."""
    vocabulary = frozenset().union(*(s for _, s in template_sets()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = dict.fromkeys(vocabulary, 0)
        for t in batch.column(text).to_pylist():
            for w in filter(vocabulary.__contains__, words(t or "")):
                seen[w] += 1
        return pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())})

    sums = docs.select(text).mapInArrow(per_slice(run, text), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in sums.collect()}


class Join:
    """The templates, indexed for one pass over blocks."""

    def __init__(self, counts: dict[bytes, int], threshold: float = THRESHOLD):
        self.rank = {w: i for i, w in enumerate(sorted(frozenset().union(*(s for _, s in template_sets())), key=lambda w: (counts.get(w, 0), w)))}
        self.templates, self.spans = [], []
        self.index: dict[bytes, list[tuple[int, int]]] = {}
        for k, (label, held) in enumerate(template_sets()):
            ordered = sorted(held, key=self.rank.__getitem__)
            least = math.ceil(threshold * len(ordered) - 1e-9)
            need, bar = (frozenset(words(x)) for x in TEMPLATES[k][2:])
            self.templates.append((label, held, len(ordered), least, need, bar))
            self.spans.append(math.ceil(len(words(TEMPLATES[k][1])) / threshold - 1e-9))
            for at, w in enumerate(ordered[: len(ordered) - least + 1]):
                self.index.setdefault(w, []).append((k, at))
        self.prefix = frozenset(self.index)

    def match(self, block: list[bytes]) -> dict[int, float]:
        """Containment of each template that ``block`` meets."""
        if self.prefix.isdisjoint(block):
            return {}
        whole = set(block)
        held = sorted(self.rank.keys() & whole, key=self.rank.__getitem__)
        out: dict[int, float] = {}
        seen: set[int] = set()
        for q, w in enumerate(held):
            for k, at in self.index.get(w, ()):
                _, words_, size, least, need, bar = self.templates[k]
                if k in seen or len(held) < least or 1 + min(size - at - 1, len(held) - q - 1) < least:
                    continue
                seen.add(k)
                both = len(words_.intersection(held))
                if both >= least and need <= whole and bar.isdisjoint(whole):
                    out[k] = both / size
        return out

    def wrapped(self, lines: list[list[bytes]], met: set[tuple[int, int]]) -> list[tuple[int, int, float]]:
        """Line, template and containment of runs of words across line ends; ``met`` are the (line, template) met by lines alone."""
        flat = [w for line in lines for w in line]
        held = self.rank.keys() & set(flat)
        out = []
        line_of = [n for n, line in enumerate(lines) for _ in line]
        for k in sorted({k for w in held & self.prefix for k, _ in self.index[w]}):
            _, words_, size, least, need, bar = self.templates[k]
            if len(words_ & held) < least or not need <= held:
                continue
            barred = [i for i, w in enumerate(flat) if w in bar]
            places = [i for i, w in enumerate(flat) if w in words_]
            count: dict[bytes, int] = {}
            end, best = 0, None
            for i in places:
                while end < len(places) and places[end] < i + self.spans[k]:
                    count[flat[places[end]]] = count.get(flat[places[end]], 0) + 1
                    end += 1
                if best and i >= best[1]:
                    out.append((line_of[best[2]], k, best[0] / size))
                    best = None
                first, last = line_of[i], line_of[places[end - 1]]
                clear = bisect_left(barred, i) == bisect_left(barred, i + self.spans[k])
                if len(count) >= least and need <= count.keys() and clear and first < last and (not best or len(count) > best[0]) and not any((n, k) in met for n in range(first, last + 1)):
                    best = (len(count), best[1] if best else places[end - 1] + 1, i)
                count[flat[i]] -= 1
                if not count[flat[i]]:
                    del count[flat[i]]
            if best:
                out.append((line_of[best[2]], k, best[0] / size))
        return out


def scan_text(text: str | None, join: Join) -> tuple:
    """n_words, places of phrases, their labels, blocks found (line they start in, label, containment)."""
    data = (text or "").encode()
    flat = data.translate(_TABLE).split()
    places: list[tuple[int, str]] = []
    joined = b" " + b" ".join(flat) + b" "
    for phrase, label in PHRASES.items():
        pattern = b" " + phrase.encode() + b" "
        at, before, n = joined.find(pattern), 0, 0
        while at >= 0:
            n += joined.count(b" ", before, at)
            before = at
            places.append((n, label))
            at = joined.find(pattern, at + 1)
    found = []
    if not join.prefix.isdisjoint(flat):
        lines = [line.split() for line in data.translate(_LINES).split(b"\n")]
        alone = [(n, k, c) for n, line in enumerate(lines) for k, c in join.match(line).items()]
        across = join.wrapped(lines, {(n, k) for n, k, _ in alone}) if len(lines) > 1 else []
        found = [(n, join.templates[k][0], c) for n, k, c in sorted(alone + across)]
    return len(flat), places, found


def scan(docs: DataFrame, counts: dict[bytes, int], text: str = "text") -> DataFrame:
    """``docs`` plus n_words, n_base, first_word, last_word, base_labels, labels, score and the blocks met, with the lines they start in."""
    new = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, blocks array<struct<line:bigint,label:string,containment:double>>"
    names = [x.split()[0] for x in new.split(", ")]
    docs = docs.drop(*names)
    join: list[Join] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not join:
            join.append(Join(counts))
        cols: dict[str, list] = {n: [] for n in names}
        for t in batch.column(text).to_pylist():
            n, places, found = scan_text(t, join[0])
            at = [p for p, _ in places]
            base = {label for _, label in places}
            row = (n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {f[1] for f in found})), max([float(bool(at)), *(f[2] for f in found)]), [{"line": a, "label": b, "containment": c} for a, b, c in found])
            for k, v in zip(names, row, strict=True):
                cols[k].append(v)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))]
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(cols[n], t) for n, t in zip(names, types, strict=True))], [*batch.schema.names, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), new])
    return docs.mapInArrow(per_slice(run, text), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, word_counts(docs)).drop("text", "blocks")


def oracle() -> str:
    """The same in DuckDB SQL, every line against every template."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = f"translate({{}}, '{upper}', '{upper.lower()}')"
    listed = lambda held: f"cast([{', '.join(repr(w.decode()) for w in sorted(set(held)))}] as varchar[])"
    sets = ", ".join(f"('{label}', {', '.join(listed(words(x)) for x in parts)})" for label, *parts in TEMPLATES)
    places = " union all ".join(f"""select rid, '{label}' as label, i from (select rid, ws, unnest(range(1, len(ws) + 1)) as i from w)
        where {" and ".join(f"ws[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))}""" for phrase, label in PHRASES.items())
    return f"""
with d as (select row_number() over () as rid, doc_id, {low.format("coalesce(text, '')")} as t from documents),
w as (select rid, doc_id, t, regexp_extract_all(t, '{_WORD}') as ws from d),
p as ({places}),
b as (select rid, count(*) as n_base, min(i) - 1 as first_word, max(i) - 1 as last_word from p group by rid),
l as (select rid, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), '{_WORD}')) as ws from d),
m as (select rid, label, len(list_intersect(l.ws, s.ws)) as n_both, len(s.ws) as size from l, (values {sets}) s(label, ws, need, bar)
    where len(list_intersect(l.ws, s.ws)) >= ceil({THRESHOLD} * len(s.ws) - 1e-9) and list_has_all(l.ws, s.need) and not list_has_any(l.ws, s.bar)),
a as (select rid, string_agg(distinct label, ',' order by label) as labels, string_agg(distinct label, ',' order by label) filter (where base) as base_labels
    from (select rid, label, true as base from p union all select rid, label, false from m) group by rid),
s as (select rid, max(n_both / size) as c from m group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word,
    cast(last_word as bigint) as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
    cast(greatest(case when n_base > 0 then 1.0 else 0.0 end, coalesce(c, 0)) as double) as score
from w left join b using (rid) left join a using (rid) left join s using (rid)"""
