"""License notices by conditional compression.

A candidate block is the text around a word that notices use. It is compressed alone and with each template as raw
Zstandard dictionary; the bytes that the template saves, as a share of what the template itself compresses to, rank the
templates. All that save enough are then held against the block word by word, and the one with the fewest differences is reported
with its exact wording differences, if they are few and none of them is where the template names the license or version.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Notices by name.
TEMPLATES = {
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-notice": "Released under the BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT-notice": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "proprietary": "All rights reserved. No part of this publication may be reproduced without prior written permission.",
    "proprietary-notice": "All rights reserved.",
    "Unlicense-header": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
# Names that stand behind "Licensed under" and "Released under" in short notices.
SHORT = {
    "AGPL-3.0": "the GNU Affero General Public License, version 3",
    "Apache-2.0": "the Apache License, Version 2.0",
    "BSD": "the BSD License",
    "BSD-2-Clause": "the BSD 2-Clause License",
    "BSD-3-Clause": "the BSD 3-Clause License",
    "CC-BY-4.0": "CC BY 4.0",
    "CC-BY-NC-4.0": "CC BY-NC 4.0",
    "CC-BY-SA-4.0": "CC BY-SA 4.0",
    "CC0-1.0": "CC0 1.0",
    "EPL-2.0": "the Eclipse Public License, version 2.0",
    "GPL-2.0": "the GNU General Public License, version 2",
    "GPL-3.0": "the GNU General Public License, version 3",
    "ISC": "the ISC License",
    "LGPL-2.1": "the GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "the GNU Lesser General Public License, version 3",
    "MIT": "the MIT License",
    "MPL-2.0": "the Mozilla Public License, Version 2.0",
    "Unlicense": "the Unlicense",
}
# Licenses that tags of source files name.
TAGGED = (
    "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense",
)
# Names by which texts and headings speak of a license.
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD-3-Clause"),
    "BSD": ("BSD License",),
    "CC0-1.0": ("CC0 1.0",),
    "EPL-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "EPL-2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3", "GPL-3.0"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPLv2.1", "LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3", "LGPL-3.0"),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
}
TEMPLATES |= {f"{k}-name{i or ''}": t for k, names in NAMES.items() for i, t in enumerate(names)}
TEMPLATES |= {f"{k}-{verb.lower()}": t for k, v in SHORT.items() for verb in ("Licensed", "Released") if (t := f"{verb} under {v}.") not in TEMPLATES.values()}
TEMPLATES |= {f"{k}-tag": f"SPDX-License-Identifier: {k}" for k in TAGGED}
#: Words that candidate blocks are found by.
TRIGGER = r"licen[sc]|copyright|permission|redistribut|released under|public domain|free software|all rights reserved|\b[al]?gplv\d|\b(?:agpl|lgpl|gpl|mpl|epl|apache|bsd|cc0)[ -]\d"
#: A tag of a source file: an expression of names, which AND, OR and WITH join; what stands behind WITH is an exception.
TAG = re.compile(r"SPDX-License-Identifier:[ \t]*((?:\(\s*)*[\w.+-]+(?:\s*\)|\s+(?:AND|OR|WITH)\s+(?:\(\s*)*[\w.+-]+)*)", re.I)
TAG_NAME = re.compile(r"(?:(\bWITH)\s+)?(?!(?:AND|OR|WITH)\b)([\w.+-]+)", re.I)
#: What continues a name: the word that a template ends with is then another one, as in MIT-0.
GOES_ON = re.compile(r"[-+.]\w|\+")
#: Blocks of one text whose result is kept, as texts that are lists of notices repeat them.
KEPT_BLOCKS = 10_000
#: Words that name a license: where a template names one, a difference in them is another license.
NAMING = re.compile(r"v?\d+(\.\d+)*|mit|bsd|apache|gnu|gpl|lgpl|agpl|lesser|affero|mozilla|mpl|eclipse|epl|unlicense|isc|cc|by|sa|nc|nd|cc0|commons|attribution\w*|noncommercial|sharealike|noderiv\w*|not|no")
#: Share of a template's compressed bytes that it must save, share of words that may differ.
LEAST_SAVED, MOST_DIFFERENT = 0.3, 0.15
#: The level at which short matches are found wherever they lie.
LEVEL = 19
#: Follows a block, since Zstandard looks for no matches in the last bytes of its input.
PAD = b"\n" * 16
WORD = re.compile(r"\w+(?:\.\w+)*")
#: Words of NAMING that name a license only next to others; in prose they are common.
COMMON = {"by", "sa", "nc", "nd", "not", "no"}


def words_of(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), *m.span()) for m in WORD.finditer(text)]


def naming_places(words: list[str]) -> set[int]:
    """Places of the words by which a template names its license and version."""
    at = {i for i, w in enumerate(words) if NAMING.fullmatch(w) and w not in COMMON}
    for i, w in enumerate(words):
        if w in COMMON - {"not", "no"} and i - 1 in at and words[i - 1] in COMMON | {"cc"}:
            at.add(i)
    return at


def renames(want: list[str], named: set[int], got: list[str], match: list) -> bool:
    """Whether words between the matches change the license or version: a naming word is lacking, or one is put before
    another or, unless it is a number, behind it."""
    for m, n in zip(match, match[1:]):
        if any(i in named for i in range(m.a + m.size, n.a)):
            return True
        put = [w for w in got[m.b + m.size : n.b] if NAMING.fullmatch(w)]
        if put and n.a in named or m.a + m.size - 1 in named and any(not w[-1].isdigit() for w in put):
            return True
    return any(i in named for i in (*range(match[0].a), *range(match[-1].a + match[-1].size, len(want))))


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.words = {k: [w for w, _, _ in words_of(t)] for k, t in templates.items()}
        self.named = {k: naming_places(w) for k, w in self.words.items()}
        self.reach = max(map(len, self.words.values())) + 20
        self.tags = {k for k in templates if k.endswith("-tag")}
        self.trigger = re.compile(TRIGGER, re.I)
        self.alone = zstandard.ZstdCompressor(level=LEVEL)
        folded = {k: " ".join(w).encode() for k, w in self.words.items()}
        self.given = {k: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(PAD * 4 + t + PAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, t in folded.items()}
        empty = len(self.alone.compress(b""))
        self.size = {k: len(self.alone.compress(t)) - empty for k, t in folded.items()}

        # a template can fit where the text around a trigger has all its different words but so many
        self.asks: dict[str, list[str]] = {}
        for k, w in self.words.items():
            for x in set(w):
                self.asks.setdefault(x, []).append(k)
        self.least = {k: len(set(w)) - int(MOST_DIFFERENT * len(w)) for k, w in self.words.items()}

    def near(self, words: list[tuple[str, int, int]], places: list[int]) -> Iterator[list[str]]:
        """For each of the rising ``places`` the templates that can fit around it. The words within reach are counted as they
        come and go, so places that lie close share the work."""
        held, met = {}, dict.fromkeys(self.words, 0)
        low = high = 0

        def count(word: str, by: int) -> None:
            if word in self.asks:
                before = held.get(word, 0)
                held[word] = before + by
                if not before or not held[word]:
                    for k in self.asks[word]:
                        met[k] += by
                        if met[k] == self.least[k] - (by < 0):
                            (can.add if by > 0 else can.discard)(k)

        can = {k for k, n in self.least.items() if n <= 0}
        for p in places:
            while high < min(len(words), p + self.reach):
                count(words[high][0], 1)
                high += 1
            while low < p - self.reach:
                count(words[low][0], -1)
                low += 1
            yield sorted(can)

    def rank(self, block: list[str], at: int, names: list[str] | None = None) -> list[tuple[float, str]]:
        """Templates by the bytes they save on the block, as a share of their own; best first. Of the block each template
        gets as many words on either side of the trigger as it has itself, so that other text doesn't drown a short one."""
        ranked, alone = [], {}
        for name in self.given if names is None else names:
            given = self.given[name]
            reach = len(self.words[name]) + 3
            low, high = max(0, at - reach), at + reach
            raw = " ".join(block[low:high]).encode() + PAD
            if (low, high) not in alone:
                alone[low, high] = len(self.alone.compress(raw))
            saved = (alone[low, high] - len(given.compress(raw))) / self.size[name]
            if saved >= LEAST_SAVED or len(self.words[name]) == 1:  # one word is too short to save any
                ranked.append((saved, name))
        return sorted(ranked, reverse=True)

    def differences(self, name: str, block: list[str]) -> tuple[int, int, list[str], list[str], bool] | None:
        """Where the template fits best: first word, end, words missing and words added, and
        whether they name another license. A run of words is tried at each
        place whose votes
        can still mean few enough differences: so many words at most don't vote, and part the others' votes into one run more."""
        want = self.words[name]
        places: dict[int, int] = {}
        at = {w: i for i, w in reversed(list(enumerate(want)))}
        for j, w in enumerate(block):
            if w in at:
                places[j - at[w]] = places.get(j - at[w], 0) + 1
        most = int(MOST_DIFFERENT * len(want))
        least = -(-(len(at) - most) // (most + 1))
        best = None
        for start, votes in sorted(places.items(), key=lambda x: (-x[1], x[0])):
            if votes < least:
                break
            slack = 2 + len(want) // 10
            low, high = max(0, start - slack), min(len(block), start + len(want) + slack)
            match = [m for m in difflib.SequenceMatcher(None, want, block[low:high], False).get_matching_blocks() if m.size]
            if not match:
                continue
            a, z = low + match[0].b, low + match[-1].b + match[-1].size
            held = {i for m in match for i in range(m.a, m.a + m.size)}
            used = {low + j for m in match for j in range(m.b, m.b + m.size)}
            missing, added = [w for i, w in enumerate(want) if i not in held], [block[j] for j in range(a, z) if j not in used]
            if best is None or len(missing) + len(added) < len(best[2]) + len(best[3]):
                best = (a, z, missing, added, renames(want, self.named[name], block[low:high], match))
        return best

    def fit(self, block: list[str], at: int, names: list[str]) -> tuple | None:
        """``(name, saved, first, end, missing, added)`` of the template that fits the block best around ``at``."""
        fits = []
        for saved, name in self.rank(block, at, names):
            d = self.differences(name, block)
            if d is None or not d[0] <= at < d[1]:
                continue
            wrong = len(d[2]) + len(d[3])
            if wrong <= MOST_DIFFERENT * len(self.words[name]) and not d[4]:
                fits.append((wrong - len(self.words[name]), name, saved, d))
        if not fits:
            return None
        _, name, saved, (a, z, missing, added, _) = min(fits)
        return name, saved, a, z, missing, added

    def tagged(self, m: re.Match) -> list[tuple]:
        """Notices of a tag: one for each name of its expression that is a template's whole name."""
        out = []
        for n in TAG_NAME.finditer(m[1]):
            name, (start, end) = n[2].rstrip("."), n.span(2)
            known = next((k for k in self.tags if k.lower() == f"{name.lower()}-tag"), None)
            if n[1] or known is None:
                continue
            block = [w for w, _, _ in words_of(f"SPDX-License-Identifier: {name}")]
            for saved, k in self.rank(block, 0, [known]):
                out.append((k, m.start() if not out else m.start(1) + start, m.start(1) + start + len(name), saved, [], []))
        return out

    def scan(self, text: str) -> list[tuple]:
        """``(license, start, end, saved, missing, added)`` of each notice, in code points, in order of place."""
        tags = {m.start(): m for m in TAG.finditer(text)}
        triggers = [m.start() for m in self.trigger.finditer(text)]
        if not triggers:
            return []
        words, found, after, known = words_of(text), [], 0, {}
        ends = [w[2] for w in words]
        places = [bisect_right(ends, t) for t in triggers]  # first word that ends behind the trigger's start
        tag_at = sorted(tags)
        for t, low, names in zip(triggers, places, self.near(words, places)):
            if t < after:
                continue
            i = bisect_right(tag_at, t) - 1
            if i >= 0 and t < tags[tag_at[i]].end():
                found += self.tagged(tags[tag_at[i]])
                after = tags[tag_at[i]].end()
                continue
            names = [k for k in names if k not in self.tags]
            if not names:
                continue
            first = low
            while first > 0 and first > low - self.reach and words[first - 1][1] >= after:
                first -= 1
            part = words[first : low + self.reach]
            block = [w for w, _, _ in part]
            key = (low - first, *block)
            if key not in known:
                known = {} if len(known) >= KEPT_BLOCKS else known
                known[key] = self.fit(block, low - first, names)
            if known[key] is None:
                continue
            name, saved, a, z, missing, added = known[key]
            end = part[z - 1][2]
            if "-name" in name and GOES_ON.match(text, end):
                continue
            found.append((name, part[a][1], end, saved, missing, added))
            after = end
        return found


@lru_cache(maxsize=2)
def _scanner(items: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(dict(items))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """Notices in every whole text, one row each: ``(id, license, start, end, saved, missing, added)``.

    ``saved`` is the share of the template's compressed bytes that it saves on the block; ``missing`` and ``added`` are the
    words of the template that the text lacks, and the other way round. Of templates that fit one place the one with the most
    words that agree is reported, the first by name of equals. Of tags each name of the expression is a notice if it is a known one as
    a whole; a name that goes on, as in ``MIT-0``, is another license. Texts of any length are read whole. Null and empty texts have
    none; null ids stay; repeated rows each give their rows; an empty table gives no rows; other columns are left out.
    """
    items = tuple((templates or TEMPLATES).items())
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "license", "start", "end", "saved", "missing", "added"]
    words = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _scanner(items)
        for b in batches:
            rows = [(i, *x) for i, t in enumerate(b.column(1)) for x in s.scan(t.as_py())]
            if rows:
                c = list(zip(*rows))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), words, words)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(c[0])), *(pa.array(x, k) for x, k in zip(c[1:], kinds))], names=names)

    some = df.select(id_col, F.col(text_col).alias("__text")).where(F.col("__text").rlike(f"(?i){TRIGGER}"))
    return some.mapInArrow(run, f"`{id_col}` {kind}, license string, start long, end long, saved double, missing array<string>, added array<string>")
