"""License scan by conditional compression.

Pieces of text (between line ends and sentence ends) with a word that license notices use are candidate
blocks. Each is compressed alone and with every template as raw zstandard dictionary; templates are
ranked by how much smaller they make it. The winner is confirmed by the exact differences in wording
between the block and the part of the template that it follows.
"""

import re
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrove.llm.common import text_or_empty

# Public license names and notices.
TEMPLATES = {
    "MIT": "Released under the MIT License. This project is licensed under the terms of the MIT license. "
           "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
           "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
           "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
           "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0. Licensed under the Apache License, Version 2.0 (the \"License\"); "
                  "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                  "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
                  "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                  "either express or implied.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3. This program is free software: you can "
               "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
               "Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2. This program is free software; you can "
               "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
               "Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License. Redistribution and use in source and binary forms, with or without "
                    "modification, are permitted provided that the following conditions are met: Neither the name of the copyright "
                    "holder nor the names of its contributors may be used to endorse or promote products derived from this software "
                    "without specific prior written permission.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0. This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
                    "International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0. This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
                    "International License.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0. This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 "
                    "International License.",
    "CC0-1.0": "Released under CC0 1.0. To the extent possible under law, the author has waived all copyright and related rights.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License. Redistribution and use in source and binary forms, with or without "
                    "modification, are permitted provided that the following conditions are met: Redistributions of source code must "
                    "retain the above copyright notice, this list of conditions and the following disclaimer.",
    "ISC": "Released under the ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or "
           "without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
# What each license is called; SPDX-License-Identifier lines are added by rule.
NAMES = {
    "MIT": ["MIT License", "MIT licence"], "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3", "GPLv3"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2", "GPLv2"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3", "AGPLv3"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License"], "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0"], "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0"], "CC0-1.0": ["CC0 1.0"],
    "ISC": ["ISC License"], "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0"], "Unlicense": ["the Unlicense"],
}
CUES = r"(?i)licen[cs]e|copyright|permission|permitted|creative commons|\bCC[ 0-]|free software|redistribut|warrant|public domain|spdx|gpl"
CUE_WORD = re.compile(r"licen[cs]e|copyright|permission|permitted|commons|^cc|redistribut|warrant|domain|spdx|gpl")
AROUND = (1, 4, 24)       # words on each side of a cue; in the narrowest window a name is too short to be ranked for certain
LEAST_WINDOW = 0.1        # reduction of a window
LEAST_SHARED = 12         # words in common that make a notice without the license's name
LEAST_WORDS = 3
LEAST_REDUCTION = 0.2
LEAST_LIKENESS = 0.8
LEVEL = 19


def blocks(docs: DataFrame) -> DataFrame:
    """``doc_id, place, block``: candidate pieces with their number in the text."""
    cut = F.split(F.regexp_replace(text_or_empty(), r"(?<=[.!?;:])(?<![Ii]dentifier:)[ \t]+", "\n"), "\n")
    numbered = F.transform(cut, lambda b, i: F.struct(i.alias("place"), b.alias("block")))
    return docs.select("doc_id", F.inline(F.filter(numbered, lambda s: s["block"].rlike(CUES))))


def words_of(text):
    return re.findall(r"\w+(?:[.-]\w+)*", text.lower())


def differences(block: str, template: str):
    """``(likeness, added, missing)`` of a block against the part of the template that it follows.

    The part is the one that gives the most words in common; likeness is twice these by all words of
    both. Words are compared in lower case, punctuation between them is not.
    """
    mine, all_of = words_of(block), words_of(template)
    best = (-1.0, [], [])
    starts = {max(0, j - i) for i, w in enumerate(mine) for j, v in enumerate(all_of) if v == w}
    for start in sorted(starts):
        part = all_of[start:start + len(mine)]
        found = SequenceMatcher(None, mine, part, autojunk=False)
        if found.ratio() > best[0]:
            added = [w for op, a, b, _, _ in found.get_opcodes() if op in ("delete", "replace") for w in mine[a:b]]
            missing = [w for op, _, _, a, b in found.get_opcodes() if op in ("insert", "replace") for w in part[a:b]]
            best = (found.ratio(), added, missing)
    return best if best[0] >= 0 else (0.0, mine, [])


def cue_windows(words, around):
    """Word ranges around the cues; a cue well inside the range before is in it already."""
    end = 0
    for i, w in enumerate(words):
        if CUE_WORD.search(w) and (not end or i >= end - around // 2):
            end = i + around + 1
            yield max(0, i - around), min(len(words), end)


def _holds(words, phrase):
    return any(words[i:i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))


def matching_part(words, template, names):
    """``(likeness, added, missing, shared)`` of the part of ``words`` that follows ``template``, or None.

    The part grows from the longest common run over gaps of one word. It is a notice if it holds one of
    the license's names, or shares LEAST_SHARED words.
    """
    found = SequenceMatcher(None, words, template, autojunk=False)
    runs = [r for r in found.get_matching_blocks() if r.size]
    if not runs:
        return None
    k = max(range(len(runs)), key=lambda r: runs[r].size)
    lo = hi = k
    while lo and max(runs[lo].a - runs[lo - 1].a, runs[lo].b - runs[lo - 1].b) - runs[lo - 1].size <= 1:
        lo -= 1
    while hi + 1 < len(runs) and max(runs[hi + 1].a - runs[hi].a, runs[hi + 1].b - runs[hi].b) - runs[hi].size <= 1:
        hi += 1
    mine = words[runs[lo].a:runs[hi].a + runs[hi].size]
    part = template[runs[lo].b:runs[hi].b + runs[hi].size]
    shared = sum(r.size for r in runs[lo:hi + 1])
    if shared < LEAST_SHARED and not any(_holds(mine, n) and _holds(part, n) for n in names):
        return None
    likeness, added, missing = differences(" ".join(mine), " ".join(part))
    return likeness, added, missing, shared


class Ranker:
    def __init__(self, templates):
        self.names = {k: [words_of(n) for n in (*NAMES.get(k, ()), f"SPDX-License-Identifier: {k}")] for k in templates}
        # One template per name and the notice, so that a name can be found wherever it stands.
        self.parts = {k: [words_of(t), *self.names[k]] for k, t in templates.items()}
        self.templates = templates
        self.lower = self._given({k: " ".join(w for part in [*self.names[k], words_of(t)] for w in part) for k, t in templates.items()})
        self.given = self._given({k: " " + t for k, t in templates.items()})
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)

    @staticmethod
    def _given(texts):
        return {k: zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(
            t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, t in texts.items()}

    def rank(self, block: str, given=None):
        """``(reduction, template)`` pairs, largest reduction first, ties by name."""
        raw = block.encode()
        size = len(self.alone.compress(raw))
        return sorted(((1 - len(c.compress(raw)) / size, k) for k, c in (given or self.given).items()), key=lambda x: (-x[0], x[1]))

    def scan(self, block: str):
        """The confirmed template of a block as ``(template, reduction, likeness, added, missing)``, or None."""
        if len(words_of(block)) < LEAST_WORDS:
            return self._inside(block)
        ranked = self.rank(block)
        # Templates that share a notice's wording compress alike: all that come near the best are read.
        near = [(r, k) for r, k in ranked if r >= LEAST_REDUCTION and r >= ranked[0][0] - 0.1]
        read = [(differences(block, self.templates[k]), r, k) for r, k in near]
        (likeness, added, missing), reduction, name = max(read, key=lambda x: (x[0][0], x[1], x[2]), default=((0.0, [], []), 0.0, ""))
        return (name, reduction, likeness, added, missing) if likeness >= LEAST_LIKENESS else self._inside(block)

    def _inside(self, block: str):
        """The notice inside a block, as scan gives it: of all windows the one with most words in common."""
        words, best = words_of(block), None
        for around in AROUND:
            for lo, hi in cue_windows(words, around):
                ranked = self.rank(" ".join(words[lo:hi]), self.lower)
                for reduction, name in ranked:
                    if reduction < ranked[0][0] - 0.1 or (around > 1 and reduction < LEAST_WINDOW):
                        break
                    for part in self.parts[name]:
                        got = matching_part(words[lo:hi], part, self.names[name])
                        if got and got[0] >= LEAST_LIKENESS:
                            key = (got[3], got[0], reduction, name)
                            if best is None or key > best[0]:
                                best = (key, (name, reduction, *got[:3]))
        return best and best[1]


def scan(docs: DataFrame, templates=None) -> DataFrame:
    """``doc_id, place, block, license, reduction, likeness, added, missing``: a row per confirmed block.

    Null and empty texts have no blocks; a block that
    fits several templates equally gets the one with the larger reduction, then the later name. Of a block
    with several notices the one with most words in common is given. A name counts as a notice.
    Repeated rows are scanned each; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(templates or TEMPLATES)
    found = blocks(docs)
    schema = found.withColumns({"license": F.lit(""), "reduction": F.lit(0.0), "likeness": F.lit(0.0),
                                "added": F.lit(None).cast("array<string>"), "missing": F.lit(None).cast("array<string>")}).schema
    types = [pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string())]

    def run(batches):
        ranker, cache = Ranker(sent.value), {}
        for batch in batches:
            got = []
            for block in batch.column("block").to_pylist():
                if block not in cache:
                    if len(cache) > 50_000:
                        cache.clear()
                    cache[block] = ranker.scan(block)
                got.append(cache[block])
            kept = batch.filter(pa.array([g is not None for g in got], pa.bool_()))
            columns = list(zip(*[g for g in got if g], strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], schema.names)
    return found.mapInArrow(run, schema)
