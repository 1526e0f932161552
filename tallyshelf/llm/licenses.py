"""License scans: which documents hold which license texts.

Documents and templates are cut to words (lower case, punctuation as space) and
five-word shingles.  Windows of 1, 4, 16 or 64 shingles, a quarter of their
length apart, get 16 MinHash bands of two rows; the templates' windows, one at
every place, are looked up by band.  A window that covers a template's window to
J = 0.78 or more, as the best of an unbroken copy does, is found with probability
1 - (1 - J^2)^16 > 0.9999997.  A retrieved template is a match if at least 80 % of
its distinct shingles occur in the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyshelf.llm.texthash import ordered_shingles, word_hashes

WORDS, CONTAINMENT = 5, 0.8
LEVELS = (1, 4, 16, 64)
BANDS = 16

#: Texts of public license statements and notices.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

_RNG = np.random.Generator(np.random.PCG64(31))
_FACTORS = (_RNG.integers(1, 2**63, 2 * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_BAND = (_RNG.integers(1, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_PUNCTUATION = bytes.maketrans(b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~""", b" " * 32)


def shingles(text: str | None) -> np.ndarray:
    """Five-word shingle hashes of a whole text in order."""
    data = (text or "").encode("utf-8", "surrogatepass").lower().translate(_PUNCTUATION)
    return ordered_shingles(word_hashes(data), WORDS)


def _keys(low: np.ndarray) -> np.ndarray:
    """Band keys (BANDS x windows) of signatures (2 * BANDS x windows)."""
    key = low[0::2] * _BAND + (low[1::2] >> np.uint64(7))
    key ^= key >> np.uint64(31)
    return key * _BAND


def window_keys(hashes: np.ndarray, level: int) -> np.ndarray:
    """Band keys of a document's windows of ``level`` shingles."""
    step = max(1, level // 4)
    low = np.minimum.reduceat(hashes, np.arange(0, hashes.shape[1], step), axis=1) if step > 1 else hashes
    parts = level // step
    n = max(1, low.shape[1] - parts + 1)
    out = low[:, :n].copy()
    for k in range(1, min(parts, low.shape[1])):
        np.minimum(out, low[:, k : k + n], out=out)
    return _keys(out)


class Index:
    """The templates' band keys by level, with a bitmap over their top bits."""

    def __init__(self, templates: dict[str, str]):
        self.sets: dict[str, np.ndarray] = {}
        self.keys: dict[int, dict[tuple[int, int], set[str]]] = {}
        self.bits: dict[int, np.ndarray] = {}
        for name, text in templates.items():
            s = shingles(text)
            if not len(s):
                continue
            self.sets[name] = np.unique(s)
            level = max(x for x in LEVELS if x <= len(s))
            table = self.keys.setdefault(level, {})
            for at in range(len(s) - level + 1):
                low = (s[None, at : at + level] * _FACTORS).min(axis=1, keepdims=True)
                for band, key in enumerate(_keys(low)[:, 0].tolist()):
                    table.setdefault((band, key), set()).add(name)
        for level, table in self.keys.items():
            bits = np.zeros(1 << 16, bool)
            bits[[key >> 48 for _, key in table]] = True
            self.bits[level] = bits

    def candidates(self, s: np.ndarray) -> set[str]:
        found: set[str] = set()
        if not len(s):
            return found
        for start in range(0, len(s), 1 << 15):  # long texts in overlapping stretches
            hashes = s[None, start : start + (1 << 15) + LEVELS[-1]] * _FACTORS
            for level, table in self.keys.items():
                # all rows of a one-shingle signature are functions of the shingle: one band says all
                keys = window_keys(hashes, level)[: 1 if level == 1 else BANDS]
                for band, at in zip(*np.nonzero(self.bits[level][(keys >> np.uint64(48)).astype(np.int64)]), strict=True):
                    found |= table.get((int(band), int(keys[band, at])), set())
        return found

    def matches(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, containment, first and last matching shingle) of a text."""
        s = shingles(text)
        out = []
        for name in sorted(self.candidates(s)):
            inside = np.isin(s, self.sets[name])
            share = len(np.unique(s[inside])) / len(self.sets[name])
            if share >= CONTAINMENT:
                at = np.flatnonzero(inside)
                out.append((name, share, int(at[0]), int(at[-1])))
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, containment, first_word and last_word of every match.

    ``docs`` needs doc_id and text.  The templates go to the tasks with the code;
    they are a list of license texts, not data that grows.  Null and empty texts
    match nothing; rows with equal or null doc_id are scanned each.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            rows = [(doc, *m) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for m in index.matches(text.as_py())]
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5
            columns[4] = [x + WORDS - 1 for x in columns[4]]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "license", "containment", "first_word", "last_word"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, containment double, first_word long, last_word long")


def op8(spark, sf_dir: str) -> DataFrame:
    """All documents against the built-in templates."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
