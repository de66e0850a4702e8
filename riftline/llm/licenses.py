"""License scans by conditional compression: windows over the words of the whole text, across line breaks and comment marks, are compressed
with each template as raw zstandard dictionary. A template that shrinks a window is a candidate there, and is confirmed at a place if the exact
wording differs in a few words only; of candidates that meet, that which saves most bytes of its place is named. A block around cues outside
such places is compressed alike, and the template that shrinks it most is named, with the exact wording differences."""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from riftline.llm.common import table

#: Fixed wording of license notices.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "BSD-3-Clause": ("Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
}
#: White space and comment marks, between words of one notice.
_GAP = r"[\s*/#;%>!-]+"
#: A stretch of text is a candidate if it has one of these words.
CUE = re.compile(rf"licen[sc]e|copyright|permission|redistribut|creative{_GAP}commons|all{_GAP}rights{_GAP}reserved|free{_GAP}software|\bcc{_GAP}by\b|\bcc0\b", re.I)
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
#: Of a template's words, at most this share may be changed, added or left out in a confirmed block.
MOST_CHANGED = 0.1
_CONTEXT = 96


class Scanner:
    def __init__(self, templates=TEMPLATES):
        self.plain = zstandard.ZstdCompressor(level=9, write_content_size=False)
        self.templates = []
        for name, texts in templates.items():
            for text in texts:
                words = _WORD.findall(text.lower())
                raw = zstandard.ZstdCompressionDict(_bytes(words), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                self.templates.append((name, words, zstandard.ZstdCompressor(level=9, write_content_size=False, dict_data=raw)))
        self.seeds = [self._seeds(words) for _, words, _ in self.templates]
        #: Words of the longest place. Windows are twice as long and overlap by half, so each place lies within one.
        self.reach = max(len(words) + int(MOST_CHANGED * len(words)) for _, words, _ in self.templates)

    @staticmethod
    def _seeds(words: list[str]) -> list[tuple[int, str]]:
        """Stretches of a template, one more than the changes that are allowed, so that a confirmed place has one of them unchanged."""
        parts = int(MOST_CHANGED * len(words)) + 1
        cuts = [len(words) * k // parts for k in range(parts + 1)]
        return [(a, f" {' '.join(words[a:b])} ") for a, b in zip(cuts, cuts[1:], strict=False)]

    def saved(self, words: list[str], i: int) -> tuple[int, float]:
        """Bytes of the compressed words that a template saves, and their share."""
        data = _bytes(words)
        alone = len(self.plain.compress(data))
        less = alone - len(self.templates[i][2].compress(data))
        return less, less / alone

    def rank(self, words: list[str]) -> list[tuple[float, int]]:
        """(share of the compressed size that a template saves, template), best first."""
        data = _bytes(words)
        alone = len(self.plain.compress(data))
        return sorted(((1 - len(c.compress(data)) / alone, -i) for i, (_, _, c) in enumerate(self.templates)), reverse=True)

    def differences(self, have: list[str], i: int) -> tuple[list[str], int, int, int]:
        """Word changes that turn the template into its counterpart in the words, how many words they concern, and where the counterpart begins and ends. Words around it don't count."""
        want = self.templates[i][1]
        ops = difflib.SequenceMatcher(None, want, have, autojunk=False).get_opcodes()
        if ops and ops[0][0] == "insert":
            ops = ops[1:]
        if ops and ops[-1][0] == "insert":
            ops = ops[:-1]
        changed = [(" ".join(want[a:b]), " ".join(have[c:d]), max(b - a, d - c)) for op, a, b, c, d in ops if op != "equal"]
        return [f"[{x}] -> [{y}]" for x, y, _ in changed], sum(n for _, _, n in changed), ops[0][3], ops[-1][4]

    def places(self, words: list[str]) -> list[tuple[int, int, int, float, list[str]]]:
        """(first word, end, template, share saved, differences) of all confirmed places of templates that shrink a window. Of places that overlap, that whose template saves most bytes of it stays, then that with fewer changes."""
        joined = f" {' '.join(words)} "
        starts = [0, *accumulate(len(w) + 1 for w in words)]
        begins: dict[int, set[int]] = {}
        for a in range(0, max(1, len(words) - self.reach), self.reach):
            b = min(len(words), a + 2 * self.reach)
            for share, i in self.rank(words[a:b]):
                if share <= 0:
                    break
                for offset, seed in self.seeds[-i]:
                    p = joined.find(seed, starts[a], starts[b] + 1)
                    while p >= 0:
                        begins.setdefault(-i, set()).add(bisect_left(starts, p) - offset)
                        p = joined.find(seed, p + 1, starts[b] + 1)
        found = {}
        for i, at in begins.items():
            want = self.templates[i][1]
            n, most = len(want), int(MOST_CHANGED * len(want))
            for begin in at:
                if begin >= 0 and words[begin : begin + n] == want:
                    found[begin, begin + n, i] = 0, []
                elif most:
                    low = max(0, begin - most)
                    diffs, changed, a, b = self.differences(words[low : begin + n + most], i)
                    if changed <= most:
                        found[low + a, low + b, i] = changed, diffs
        ranked = sorted((-less, changed, a, i, b, share, diffs) for (a, b, i), (changed, diffs) in found.items() for less, share in [self.saved(words[a:b], i)])
        taken: list[tuple[int, int, int, float, list[str]]] = []
        for _, _, a, i, b, share, diffs in ranked:
            k = bisect_left(taken, (a,))
            if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or b <= taken[k][0]):
                taken.insert(k, (a, b, i, share, diffs))
        return taken

    def scan(self, text: str | None):
        """(line, license, reduction, confirmed, differences) of each confirmed place of the whole text, and of each block of cues outside them.

        Cues of a line that stand less than a block's reach after its first are one block, which goes on over line breaks up to the next place.
        """
        if not text or not CUE.search(text):
            return
        breaks = [m.start() for m in re.finditer("\n", text)]
        spans = [m.span() for m in _WORD.finditer(text)]
        places = self.places([text[a:b].lower() for a, b in spans])
        taken = [(spans[a][0], spans[b - 1][1]) for a, b, *_ in places]
        rows = [(a, self.templates[i][0], share, True, diffs) for (a, _), (_, _, i, share, diffs) in zip(taken, places, strict=True)]
        blocks: list[list[int]] = []  # begin, end, first cue, its line, the place before it
        for m in CUE.finditer(text):
            k = bisect_right(taken, (m.start(), len(text)))
            if k and m.start() < taken[k - 1][1]:
                continue
            line, high = bisect_left(breaks, m.start()), taken[k][0] if k < len(taken) else len(text)
            b = min(high, m.end() + 6 * _CONTEXT)
            if blocks and blocks[-1][3:] == [line, k] and m.start() < blocks[-1][2] + 6 * _CONTEXT:
                blocks[-1][1] = b
            else:
                blocks.append([max(taken[k - 1][1] if k else 0, m.start() - _CONTEXT), b, m.start(), line, k])
        for a, b, first, _, _ in blocks:
            have = _WORD.findall(text[a:b].lower())
            share, i = self.rank(have)[0]
            diffs, n, _, _ = self.differences(have, -i)
            rows.append((first, self.templates[-i][0], share, n <= MOST_CHANGED * len(self.templates[-i][1]), diffs))
        for at, *row in sorted(rows, key=lambda r: r[0]):
            yield bisect_left(breaks, at), *row


def _bytes(words: list[str]) -> bytes:
    return " ".join(words).encode("utf-8", "replace")


SCHEMA = "line long, license string, reduction double, confirmed boolean, differences array<string>"


def scan(docs: DataFrame) -> DataFrame:
    """One row per confirmed place or candidate block: doc_id, its line, the license, its size reduction, whether wording confirms it, and the differences.

    Null and empty texts and texts without a cue give no rows. Repeated rows give repeated results. One pass, no shuffle.
    """

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            found = [(doc, *row) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for row in scanner.scan(text)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds)], names=["doc_id", "line", "license", "reduction", "confirmed", "differences"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, f"doc_id long, {SCHEMA}")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
