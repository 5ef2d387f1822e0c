"""Operator 10: licence scans by Dice coefficients over word bigrams.

A text's normalised words (letters and digits, lower case) are one sequence, whatever
its lines and sentences.  The Dice coefficient of the bigram sets of a window of it and
a template, ``2 |A & B| / (|A| + |B|)``, must reach ``least``; the coefficient of a
template is the best of all windows.  As the coefficient is at most
``2 min / (a + b)``, a template of b bigrams only meets windows of at most
``b * (2 - least) / least`` distinct bigrams that share ``b * least / (2 - least)`` with
it: texts that share fewer are pruned unread.  The best window starts with a bigram of
the template that does not come again in it (else dropping it is no worse), so only such
windows are tried and repeated text costs no more than its length for each bigram.

The templates are a parameter; those below are short public notices, the usual headers
of files, and the full licences in ``licence_texts``.

``n_segments`` counts the sentences, lines, paragraphs (blocks between blank lines) and
the whole, where these differ.

Very long texts are scanned whole.
Null and empty texts have no segments and no licence; repeated rows are each scanned;
ties between templates go to the first name; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.text import sliced, widened

#: The wording of public licence notices and headers, and of the licences themselves.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
TEMPLATES |= {f"{path.stem}-text": path.read_text(encoding="utf-8") for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
WORDS = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?:])\s+")
BLANK = re.compile(r"\n[^\S\n]*\n")


def bigrams(words: list[str]) -> frozenset[tuple[str, str]]:
    return frozenset(zip(words, words[1:], strict=False))


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        self.templates = [(name, bigrams(WORDS.findall(text.lower()))) for name, text in sorted(templates.items())]
        self.templates = [(name, grams) for name, grams in self.templates if grams]
        #: templates of each bigram
        self.owners: dict[tuple[str, str], list[int]] = {}
        for i, (_, template) in enumerate(self.templates):
            for gram in template:
                self.owners.setdefault(gram, []).append(i)

    def compare(self, words: list[str], found: dict[str, float]) -> None:
        """Best window of the words for each template that enough bigrams are shared with."""
        shared = Counter(i for gram in self.owners.keys() & set(zip(words, words[1:], strict=False)) for i in self.owners[gram])
        # a window has at least the bigrams that it shares
        likely = [i for i, n in shared.items() if 2 * n >= self.least * (n + len(self.templates[i][1]))]
        if not likely:
            return
        code: dict[tuple[str, str], int] = {}
        grams = np.array([code.setdefault(gram, len(code)) for gram in zip(words, words[1:], strict=False)])
        order = np.argsort(grams, kind="stable")
        same = np.flatnonzero(grams[order[1:]] == grams[order[:-1]])
        before, after = np.full(len(grams), -1), np.full(len(grams), len(grams))
        before[order[same + 1]], after[order[same]] = order[same], order[same + 1]
        for i in likely:
            name, template = self.templates[i]
            known = np.zeros(len(code), bool)
            known[[code[gram] for gram in template if gram in code]] = True
            dice = self.best(before, after, known[grams], len(template))
            if dice >= self.least:
                found[name] = dice

    def best(self, before: np.ndarray, after: np.ndarray, known: np.ndarray, size: int) -> float:
        """Best coefficient of a window with a template of ``size`` bigrams.

        ``before`` and ``after`` are the places where each bigram comes next, ``known`` those of the template.
        """
        top, most = 0.0, size * (2 - self.least) / self.least
        for start in np.flatnonzero(known).tolist():
            span = 2 * int(most) + 1
            while True:
                stop = min(start + span, int(after[start]))
                fresh = before[start:stop] < start
                distinct = np.cumsum(fresh)
                if distinct[-1] > most or stop == after[start]:
                    break
                span *= 2
            top = max(top, float((2 * np.cumsum(fresh & known[start:stop]) / (distinct + size)).max()))
            if top == 1.0:
                break
        return top

    def scan(self, text: str) -> tuple[dict[str, float], int]:
        """Best coefficient of each template found, and the number of segments."""
        found: dict[str, float] = {}
        text = text.lower()
        segments, paragraphs = 0, BLANK.split(text)
        for paragraph in paragraphs:
            lines = paragraph.split("\n")
            for line in lines:
                parts = len(SENTENCE.split(line))
                segments += parts + (parts > 1)
            segments += len(lines) > 1
        segments += len(paragraphs) > 1
        self.compare(WORDS.findall(text), found)
        return found, segments


def scan_licences(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """``docs`` with n_segments, licences (names by coefficient, then name), best_licence and best_dice, which replace columns of these names."""
    added = ["n_segments", "licences", "best_licence", "best_dice"]
    docs = docs.drop(*added)
    names = docs.columns
    templates = dict(templates or TEMPLATES)

    def run(batches):
        scanner = Scanner(templates, least)
        for batch in sliced(batches):
            segments, found = [], []
            for text in batch.column("text").to_pylist():
                hits, n = scanner.scan(text) if text else ({}, 0)
                segments.append(n)
                found.append(sorted(hits.items(), key=lambda x: (-x[1], x[0])))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in names),
                    pa.array(segments, pa.int64()),
                    pa.array([",".join(k for k, _ in f) for f in found], pa.string()),
                    pa.array([f[0][0] if f else None for f in found], pa.string()),
                    pa.array([f[0][1] if f else 0.0 for f in found], pa.float64()),
                ],
                [*names, *added],
            )

    return docs.mapInArrow(run, widened(docs, "n_segments long, licences string, best_licence string, best_dice double"))
