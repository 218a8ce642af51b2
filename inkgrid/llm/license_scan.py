"""License scan: MinHash bands over overlapping text windows retrieve templates, shingle containment verifies.

Words are lower-cased runs of letters and digits. Windows of a few shingles slide over a whole text and over each
template; BANDS bands of ROWS minima make a key, and two windows of similarity s share one with probability
1 - (1 - s**ROWS)**BANDS: over 0.9998 from 0.8 on. Retrieved templates are compared exactly with the text around; where
related licenses fit the same place, what sets their texts apart decides.
"""

from __future__ import annotations

import pkgutil
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.words import SHINGLE, U, Words, mixed, plain_table, slices, splitmix

BANDS, ROWS = 8, 2
#: Shingles of a window; templates with fewer have windows of their own length.
WINDOW = 4
CONTAINED = 0.8
#: A place may be longer than its template by one part in so many, and a shingle.
SLACK = 4
#: Characters of templates that are sent to the tasks.
TEMPLATE_CHARS = 32_000_000
SCHEMA = "doc_id bigint, template string, license string, first_word int, last_word int, containment double, n_matches int"

# The texts of public license notices.
NOTICES = (
    ("apache-2.0-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-notice", "Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("mit-line", "MIT", "Released under the MIT License."),
    ("mit-grant", "MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("gpl-3-line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd-conditions", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc-grant", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
)


#: Phrases of a template, five words at least, that a text must have word for word: names and versions.
MARKS = {
    "gpl-3-line": ("General Public License, version 3",),
    "gpl-notice": ("of the GNU General Public License as published",),
    "mpl-2.0": ("Public License, v. 2.0",),
}
GNU = (("GPL", "General", "1.0", "1 February 1989"), ("GPL", "General", "2.0", "2 June 1991"), ("GPL", "General", "3.0", "3 29 June 2007"), ("LGPL", "Library General", "2.0", "2 June 1991"), ("LGPL", "Lesser General", "2.1", "2.1 February 1999"), ("LGPL", "Lesser General", "3.0", "3 29 June 2007"), ("AGPL", "Affero General", "3.0", "3 19 November 2007"))
CREATIVE = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
#: Whole texts in the folder `licenses`, and the words a whole text must have where others are nearly the same.
WHOLE = {
    "Apache-2.0": "Apache License Version 2.0, January 2004",
    "MPL-1.1": "Mozilla Public License Version 1.1",
    "MPL-2.0": "Mozilla Public License Version 2.0",
    "GFDL-1.2": "GNU Free Documentation License Version 1.2, November 2002",
    "GFDL-1.3": "GNU Free Documentation License Version 1.3, 3 November 2008",
    **{f"{short}-{v}": f"GNU {name} Public License Version {dated}" for short, name, v, dated in GNU if short != "AGPL"},
    **dict.fromkeys(("0BSD", "Artistic-1.0-Perl", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "ISC", "MIT", "OFL-1.1", "Unlicense", "WTFPL", "Zlib")),
}


def _gnu() -> Iterator[tuple[str, str, str, tuple[str, ...]]]:
    """Heads of the license texts, notices of a version only, of one or later, and of none, and short lines."""
    for short, name, full, dated in GNU:
        v, key = full.removesuffix(".0"), f"{short.lower()}-{full}"
        named, subject = f"the GNU {name} Public License", "library" if short == "LGPL" else "program"
        yield f"{key}-head", f"{short}-{full}", (head := f"GNU {name} Public License Version {dated}"), (head,)
        later = f"This {subject} is free software: you can redistribute it and/or modify it under the terms of {named} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
        yield f"{key}-or-later-notice", f"{short}-{full}-or-later", later, (f"of {named} as published", f"either version {v} of the License")
        ahead = f"This {subject} is free software: you can redistribute it and/or modify it under the terms of {named} version {v} as published by the Free Software Foundation"
        yield f"{key}-only-notice", f"{short}-{full}-only", ahead, (f"of {named} version {v} as published",)
        behind = f"This {subject} is free software: you can redistribute it and/or modify it under the terms of version {v} of {named} as published by the Free Software Foundation"
        yield f"{key}-only-notice-of", f"{short}-{full}-only", behind, (f"terms of version {v} of {named} as published",)
        only = f"This {subject} is free software: you can redistribute it and/or modify it under the terms of {named} as published by the Free Software Foundation, version {v} of the License."
        yield f"{key}-only-notice-end", f"{short}-{full}-only", only, (f"of {named} as published", f"Free Software Foundation, version {v} of the License")
        yield f"{key}-line", f"{short}-{full}", (line := f"under {named}, version {v}"), (line,)
        yield f"{key}-short-line", f"{short}-{full}", (line := f"under {named} v{full}"), (line,)
    for short, name, subject in (("LGPL", "Lesser General", "library"), ("AGPL", "Affero General", "program")):
        named = f"of the GNU {name} Public License as published"
        yield f"{short.lower()}-notice", short, f"This {subject} is free software: you can redistribute it and/or modify it under the terms {named} by the Free Software Foundation", (named,)


def _others() -> Iterator[tuple[str, str, str, tuple[str, ...]]]:
    for part, name in CREATIVE.items():
        for version, kind in (("4.0", "International"), ("3.0", "Unported")):
            key, license_ = f"cc-{part}-{version}", f"CC-{part.upper()}-{version}"
            yield f"{key}-named", license_, (named := f"Creative Commons {name} {version} {kind} License"), (named,)
            yield f"{key}-link", license_, (link := f"creativecommons.org/licenses/{part}/{version}"), (link,)
            if (part, version) != ("by-nc", "4.0"):
                yield f"{key}-line", license_, (line := f"Licensed under CC {part.upper()} {version}"), (line,)
        yield f"cc-{part}-4.0-head", f"CC-{part.upper()}-4.0", (head := f"Creative Commons {name} 4.0 International Public License"), (head,)
    yield "cc0-1.0-link", "CC0-1.0", (link := "creativecommons.org/publicdomain/zero/1.0"), (link,)
    yield "cc0-1.0-waiver", "CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ()
    granted = "This program and the accompanying materials are made available under the terms of the Eclipse Public License"
    for version in ("1.0", "2.0"):
        for k, written in enumerate((version, f"v{version}", f"v. {version}", f"version {version}")):
            yield f"epl-{version}-notice-{k}", f"EPL-{version}", f"{granted} {written}", (f"of the Eclipse Public License {written}",)
        yield f"epl-{version}-head", f"EPL-{version}", (head := f"Eclipse Public License - v {version}"), (head,)


def _whole() -> Iterator[tuple[str, str, str, tuple[str, ...]]]:
    for license_, mark in WHOLE.items():
        text = pkgutil.get_data("inkgrid.llm", f"licenses/{license_}.txt").decode()
        yield f"{license_.lower()}-text", license_, text, (mark,) if mark else ()


_made = [*_gnu(), *_others(), *_whole()]
MARKS |= {name: marks for name, _, _, marks in _made if marks}
TEMPLATES = NOTICES + tuple(t[:3] for t in _made)


def collision_probability(similarity: float) -> float:
    return 1 - (1 - similarity**ROWS) ** BANDS


def orders(shingles: np.ndarray) -> list[np.ndarray]:
    """The shingles under each MinHash order."""
    return [mixed(shingles * t) for t in splitmix(BANDS * ROWS, 5) | U(1)]


def band_keys(shingles: np.ndarray, ordered: list[np.ndarray], size: int) -> Iterator[np.ndarray]:
    """For each band the keys of all windows of `size` shingles, by first shingle."""
    if size == 1:
        yield shingles
        return
    for band in range(BANDS):
        key = np.zeros(len(shingles) - size + 1, U)
        for row in range(ROWS):
            least, span = ordered[band * ROWS + row], 1
            while span < size:
                step = min(span, size - span)
                least = np.minimum(least[:-step], least[step:])
                span += step
            with np.errstate(over="ignore"):
                key = mixed(key + least)
        yield key


def _parted(texts: list[str]) -> list[np.ndarray]:
    shingles, counts, _ = Words(pa.array(texts, pa.string()), plain_table()).shingles()
    return np.split(shingles, np.cumsum(counts)[:-1])


class Library:
    """Templates as shingles, their bands' keys by window size, and what sets related licenses apart."""

    SIEVE = 1 << 20

    def __init__(self, templates=TEMPLATES):
        self.templates = [t for t in templates if t[2].strip()]
        self.shingles = _parted([t[2] for t in self.templates])
        self.sets = [np.unique(s) for s in self.shingles]
        marks = [(k, m) for k, t in enumerate(self.templates) for m in MARKS.get(t[0], ())]
        self.marks: dict[int, list[np.ndarray]] = defaultdict(list)
        for (k, _), s in zip(marks, _parted([m for _, m in marks])):
            if np.isin(s, self.sets[k]).all():  # a template of the caller's with the same name may have another text
                self.marks[k].append(s)
        pairs: dict[int, list[list[tuple[np.ndarray, int]]]] = {}
        for k, s in enumerate(self.shingles):
            size = min(WINDOW, len(s))
            bands = pairs.setdefault(size, [[] for _ in range(1 if size == 1 else BANDS)])
            for at, keys in enumerate(band_keys(s, orders(s), size)):
                bands[at].append((np.unique(keys), k))
        self.keys = {size: [self._sorted(band) for band in bands] for size, bands in pairs.items()}
        self.apart: dict[tuple[int, int], np.ndarray | None] = {}

    def _sorted(self, band: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys in order, the template of each, and a sieve over the keys' low bits."""
        keys, owner = np.concatenate([k for k, _ in band]), np.concatenate([np.full(len(k), t) for k, t in band])
        order = np.argsort(keys, kind="stable")
        sieve = np.zeros(self.SIEVE, bool)
        sieve[keys & U(self.SIEVE - 1)] = True
        return keys[order], owner[order], sieve

    def retrieve(self, shingles: np.ndarray) -> set[tuple[int, int]]:
        """(first shingle of a window, template) of all windows that share a band's key with a template."""
        found, ordered = set(), orders(shingles)
        for size, bands in self.keys.items():
            if len(shingles) < size:
                continue
            for at, keys in enumerate(band_keys(shingles, ordered, size)):
                wanted, owner, sieve = bands[at]
                near = np.flatnonzero(sieve[keys & U(self.SIEVE - 1)])
                first, last = np.searchsorted(wanted, keys[near]), np.searchsorted(wanted, keys[near], "right")
                for p, a, b in zip(near.tolist(), first.tolist(), last.tolist()):
                    found.update((p, k) for k in owner[a:b].tolist())
        return found

    def own(self, k: int, other: int) -> np.ndarray | None:
        """Shingles of template k that the other lacks, if it is of another license and holds half of k; else None."""
        if (k, other) not in self.apart:
            mine = self.sets[k][~np.isin(self.sets[k], self.sets[other])]
            related = self.templates[k][1] != self.templates[other][1] and 2 * len(mine) <= len(self.sets[k])
            self.apart[k, other] = mine if related else None
        return self.apart[k, other]


def places(at: list[int], ids: list[int], need: float, lead: int, reach: int) -> Iterator[tuple[int, int]]:
    """(first, last hit) of separate places that hold `need` different ids within `reach`, from left to right.

    at and ids are the places and shingles of a template's hits. Of the starts within `lead` of the first that will do the best
    counts; a place ends with the hit that completes what its start can reach.
    """
    shares, ends, held, end = [], [], Counter(), 0
    for first in range(len(at)):
        while end < len(at) and at[end] < at[first] + reach:
            held[ids[end]] += 1
            end += 1
        shares.append(len(held))
        ends.append(end)
        held[ids[first]] -= 1
        if not held[ids[first]]:
            del held[ids[first]]
    k = 0
    while k < len(at):
        if shares[k] < need:
            k += 1
            continue
        near = range(k, bisect_left(at, at[k] + lead + 1))
        best = max(near, key=lambda j: (shares[j], -j))
        last, seen = best, {ids[best]}
        while len(seen) < shares[best]:
            last += 1
            seen.add(ids[last])
        yield best, last
        k = last + 1


def _matches(library: Library, found: Iterable[int], shingles: np.ndarray) -> Iterator[tuple[int, int, int, float, np.ndarray]]:
    """(template, first, last shingle, containment, shingles found) of all places that contain a template and its marks.

    A place is at most a SLACK-th longer than the template, so that parts of different places never add up to one.
    """
    for k in sorted(found):
        want, n = library.sets[k], len(library.shingles[k])
        at = np.flatnonzero(np.isin(shingles, want))
        lead = n // SLACK + SHINGLE
        for first, last in places(at.tolist(), np.searchsorted(want, shingles[at]).tolist(), CONTAINED * len(want), lead, n + lead):
            got = np.unique(shingles[at[first : last + 1]])
            if all(np.isin(m, got).all() for m in library.marks.get(k, ())):
                yield k, int(at[first]), int(at[last]), len(got) / len(want), got


def _outdone(library: Library, match: tuple, rival: tuple) -> bool:
    """Whether a related license's template fits the same place and has more of what sets the two apart."""
    k, a, b, _, got = match
    other, c, d, _, theirs = rival
    if c > b or a > d or (mine := library.own(k, other)) is None:
        return False
    if not len(mine):
        return True
    share = np.isin(mine, got).mean()
    rest = library.sets[other][~np.isin(library.sets[other], library.sets[k])]
    return bool(share < CONTAINED and len(rest) and np.isin(rest, theirs).mean() > share)


def _verify(library: Library, found: Iterable[int], shingles: np.ndarray) -> Iterator[tuple[int, int, int, float, int]]:
    """(template, first, last shingle, containment, matches) of the templates that the text around a window contains."""
    every = list(_matches(library, found, shingles))
    kept: dict[int, list[tuple]] = defaultdict(list)
    for match in every:
        if not any(_outdone(library, match, rival) for rival in every if rival[0] != match[0]):
            kept[match[0]].append(match)
    for k, matches in kept.items():
        best = max(matches, key=lambda m: m[3])
        yield k, best[1], best[2], best[3], len(matches)


def from_table(templates: DataFrame) -> tuple[tuple[str, str, str], ...]:
    """A table (template, license, text) as scan takes it; more than TEMPLATE_CHARS characters are refused, null texts left out."""
    rows = templates.select("template", "license", "text").filter("text is not null")
    size = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    if size > TEMPLATE_CHARS:
        raise ValueError(f"templates have {size} characters, of which a task holds {TEMPLATE_CHARS}")
    return tuple(tuple(r) for r in rows.orderBy("template", "license", "text").collect())


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """A row for each row of `docs` and template that its text contains (at least CONTAINED of its five-word shingles).

    Templates come as tuples, or as a table, of (template, license, text); tables are taken up to TEMPLATE_CHARS characters.
    first_word and last_word frame the best match (the first of equals), n_matches counts separate ones. Whole texts are
    scanned; texts shorter than five words are compared as they are; of related licenses that fit one place the nearer one
    stays; null and empty texts contain nothing; repeated rows repeat their matches; no documents or no templates give no
    rows; other columns are ignored.
    """
    if isinstance(templates, DataFrame):
        templates = from_table(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, table = Library(templates), plain_table()
        for batch in slices(batches, 1):
            words = Words(batch.column(1), table)
            shingles, counts, _ = words.shingles()
            ends = np.cumsum(counts)
            by_row: dict[int, set[int]] = defaultdict(set)
            # A window that spans two rows is retrieved in vain; verification looks at one row only.
            for p, k in library.retrieve(shingles) if library.templates and len(shingles) else ():
                by_row[int(np.searchsorted(ends, p, "right"))].add(k)
            out = []
            ids = batch.column(0)
            for row, found in sorted(by_row.items()):
                own = shingles[ends[row] - counts[row] : ends[row]]
                for k, a, b, share, n in _verify(library, found, own):
                    name, license_, _ = library.templates[k]
                    out.append((ids[row].as_py(), name, license_, a, min(b + SHINGLE, int(words.counts[row])) - 1, share, n))
            columns = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
