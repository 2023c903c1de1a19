"""License scans: MinHash bands over overlapping windows, then containment.

A text is read as windows of a template's size, each a quarter of it after the
last. A window whose MinHash agrees with the template's in at least one band is
a candidate; with the ``BANDS`` bands of one row used here that misses a window
of Jaccard similarity J with probability ``(1 - J) ** BANDS``, which is under
1e-6 for J of 0.6. A candidate is verified by the exact share of the template's
shingles that occur in the window and a step to either side of it.

A band can agree only where the window holds the shingle that gave the
template's minimum, so only windows around such shingles are hashed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm import kernels as K

BANDS = 16
_SALTS = K.mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

# Notices of public licenses, as their texts state them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}

#: Shingles that are verified in one step, and bytes that templates may have.
VERIFIED, MOST_BYTES = 2_000_000, 32_000_000
#: Notices that grant nothing; of fewer words than a shingle.
RESERVED: dict[str, tuple[str, ...]] = {"All-rights-reserved": ("All rights reserved.",)}


def minhashes(flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Least salted hash of each non-empty run, one column per band."""
    out = np.empty((len(begin) - 1, BANDS), dtype=np.uint64)
    for b in range(BANDS):
        out[:, b] = np.minimum.reduceat(flat * _SALTS[b], begin[:-1])
    return out


def grouped(names: list[str], texts: list[str], width: int) -> list[Templates]:
    """The templates that have words, in groups of one shingle width: a template
    of fewer words than ``width`` is one shingle of all of them."""
    _, first = K.word_hashes(pa.record_batch([pa.array(texts, pa.string())], names=["text"]))
    own = np.minimum(np.diff(first), width)
    return [Templates([names[i] for i in at], [texts[i] for i in at], w) for w in range(1, width + 1) if len(at := np.flatnonzero(own == w))]


class Templates:
    def __init__(self, names: list[str], texts: list[str], width: int):
        words, first = K.word_hashes(pa.record_batch([pa.array(texts, pa.string())], names=["text"]))
        flat, begin = K.shingles(words, first, width)
        keep = np.flatnonzero(np.diff(begin))
        self.names, self.width = [names[i] for i in keep], width
        runs = [flat[begin[i] : begin[i + 1]] for i in keep]
        self.size = np.array([len(r) for r in runs], dtype=np.int64)
        self.step = np.maximum(self.size // 4, 1)
        self.known = K.HashSet(np.concatenate(runs) if runs else np.zeros(0, np.uint64))
        # which template has which shingle, as numbers in order, and how many each has
        place = np.repeat(np.arange(len(runs)), self.size) * len(self.known.values) + np.searchsorted(self.known.values, flat) if runs else np.zeros(0, np.int64)
        self.has = np.unique(place)
        self.distinct = np.bincount(self.has // max(len(self.known.values), 1), minlength=len(runs))
        mins = set()
        for t, run in enumerate(runs):
            mins |= {(int(run[np.argmin(run * s)]), t) for s in _SALTS}
        self.bands = minhashes(np.concatenate(runs), np.concatenate([[0], np.cumsum(self.size)])) if runs else None
        pairs = sorted(mins)
        self.probe = K.HashSet(np.array([p[0] for p in pairs], dtype=np.uint64))
        _, self.count = np.unique(np.array([p[0] for p in pairs], dtype=np.uint64), return_counts=True)
        self.begin, self.of = np.cumsum(self.count) - self.count, np.array([p[1] for p in pairs], dtype=np.int64)

    def scan(self, words: np.ndarray, first: np.ndarray, containment: float) -> list[tuple[int, int, float, int]]:
        """``(text, template, containment, first word)``: best window of each."""
        flat, begin = K.shingles(words, first, self.width)
        at, value = self.probe.find(flat)
        if not len(at):
            return []
        hit, nth = K.ranges(self.count[value])
        at, t = at[hit], self.of[self.begin[value[hit]] + nth]
        doc = np.searchsorted(begin, at, side="right") - 1
        # windows start at multiples of the step; a text's tail is a shorter one
        step, n, head = self.step[t], self.size[t], begin[doc]
        low = np.maximum(-(-(at - head - n + 1) // step), 0)
        own, nth = K.ranges((at - head) // step - low + 1)
        cand = np.unique(np.stack([doc[own], t[own], head[own] + (low[own] + nth) * step[own]], axis=1), axis=0)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for part in _parts(self.size[cand[:, 1]] + 2 * self.step[cand[:, 1]]):
            doc, t, start = cand[part].T
            stop = np.minimum(start + self.size[t], begin[doc + 1])
            which, nth = K.ranges(stop - start)
            bands = minhashes(flat[start[which] + nth], np.concatenate([[0], np.cumsum(stop - start)]))
            same = (bands == self.bands[t]).any(axis=1)
            doc, t = doc[same], t[same]
            begin_at = np.maximum(start[same] - self.step[t], begin[doc])
            end_at = np.minimum(stop[same] + self.step[t], begin[doc + 1])
            which, nth = K.ranges(end_at - begin_at)
            if not len(which):
                continue
            place, shingle = self.known.find(flat[begin_at[which] + nth])
            code = t[which[place]] * len(self.known.values) + shingle
            inside = self.has[np.minimum(np.searchsorted(self.has, code), len(self.has) - 1)] == code
            seen = np.unique(which[place[inside]] * len(self.known.values) + shingle[inside])
            share = np.bincount(seen // len(self.known.values), minlength=len(doc)) / self.distinct[t]
            for i in np.flatnonzero(share >= containment - 1e-12).tolist():
                key = (int(doc[i]), int(t[i]))
                if share[i] > best.get(key, (0.0, 0))[0]:
                    best[key] = (float(share[i]), int(begin_at[i] - begin[doc[i]]))
        return [(d, k, c, s) for (d, k), (c, s) in sorted(best.items())]


def _parts(sizes: np.ndarray):
    """Slices of about ``VERIFIED`` shingles in sum; a larger one is a slice."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + VERIFIED, side="right")))
        yield slice(at, to)
        at = to


def from_table(templates: DataFrame) -> dict[str, tuple[str, ...]]:
    """Templates of a table ``(name, text)``, a name with several texts once;
    nulls are left out. Over ``MOST_BYTES`` of texts are an error: every task
    holds all of them."""
    rows = templates.where("name is not null and text is not null").select("name", "text").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of templates; {MOST_BYTES} at most")
    out: dict[str, list[str]] = {}
    for r in sorted(map(tuple, rows.collect())):
        out.setdefault(r[0], []).append(r[1])
    return {n: tuple(t) for n, t in out.items()}


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | DataFrame | None = None, width: int = 5, containment: float = 0.8) -> DataFrame:
    """``(doc_id, license, containment, first_word)``: each license of which a
    row of ``docs`` holds a notice, with its best window.

    Words are lower-cased runs of letters and digits, shingles have ``width``
    words; a notice is held if a window has at least ``containment`` of its
    distinct shingles. A template of fewer words is one shingle of them all, so
    it is held word for word; one without words is not held. Null, empty and
    shorter texts hold none; a license with several notices gives the best of
    them; repeated rows each give their rows. Other columns are ignored.

    Templates are a parameter, also as a table ``(name, text)``, of bounded size;
    of windows that hold as much the earliest counts. The texts are read once,
    without a shuffle.
    """
    if isinstance(templates, DataFrame):
        templates = from_table(templates)
    flat = [(name, text) for name, texts in (TEMPLATES | RESERVED if templates is None else templates).items() for text in texts]
    names, texts = [f[0] for f in flat], [f[1] for f in flat]

    def run(batches):
        groups = grouped(names, texts, width)
        for batch in batches:
            for part in K.slices(batch):
                words, first = K.word_hashes(part)
                best: dict[tuple[int, str], tuple[float, int]] = {}
                for known in groups:
                    for d, t, c, s in known.scan(words, first, containment):
                        key = (d, known.names[t])
                        best[key] = max(best.get(key, (0.0, 0)), (c, -s))
                doc = part.column("doc_id").take(pa.array([k[0] for k in best], pa.int64()))
                yield pa.record_batch(
                    [
                        doc, pa.array([k[1] for k in best], pa.string()),
                        pa.array([v[0] for v in best.values()], pa.float64()), pa.array([-v[1] for v in best.values()], pa.int64()),
                    ],
                    names=["doc_id", "license", "containment", "first_word"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, license string, containment double, first_word long")
