"""Licence recognition: sentences to identifiers, identifier sequences to licences.

Known licence sentences are sequences of lower-case words (runs of a-z and 0-9, whatever
stands between them, so that line wraps, comment marks and punctuation inside do not
matter). A sentence is found where its words stand between two bounds: it starts at a
line's start or after a sentence mark, and ends at a line's end or before a mark. {} in a
sentence is a slot for one to ``SLOT`` words (a holder, a year). Of several that start at
one place the one of most words counts. Found sentences become their identifiers, in order of the
text; a rule of a licence is met where its identifiers occur in that order (others may
stand between). Rules exclude each other: the one of most identifiers takes its sentences,
and only rules of sentences that are left are met after it, so that a text shows the licence
that explains most of it. A reserved right shows a proprietary text only where no licence is
met; a sentence that puts a text under a licence and isn't known shows "unknown" there.

Only texts that hold one of a few anchor words, of which every known sentence has one,
are read word by word; the tables are small and fixed.

Defined cases: null, blank and empty texts have no identifiers; a sentence that repeats
gives its identifier each time; several licences can be found in one text, listed once
each; of rules of as many identifiers the first in the text is met, then the first by name; very
long texts are read whole; rows that repeat stay rows; an empty table gives an empty
result; other columns are kept but for those of the result's names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import any_columns, arrow, texts_as_bytes

#: SPDX identifiers whose "SPDX-License-Identifier:" lines are known. Fixed values.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "EPL-2.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)

#: Known licence sentences. Fixed values.
SENTENCES = {
    "mit-title": "MIT License",
    "mit-title-the": "The MIT License (MIT)",
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-project": "This project is licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-kept": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-title": "ISC License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-disclaims": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-advertise": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-endorse": "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-endorse-name": "The name of {} may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY {} \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-notice-you": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "apache-title": "Apache License",
    "apache-version": "Version 2.0, January 2004",
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "gpl-title": "GNU GENERAL PUBLIC LICENSE",
    "gpl-version-2": "Version 2, June 1991",
    "gpl-version-3": "Version 3, 29 June 2007",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE",
    "lgpl21-version": "Version 2.1, February 1999",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "agpl-version": "Version 3, 19 November 2007",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-if": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "epl-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "bsl-distributed": "Distributed under the Boost Software License, Version 1.0.",
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4": "Licensed under CC BY-ND 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-sa-4": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-extent": "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain worldwide.",
    "reserved": "All rights reserved.",
    **{f"spdx-{x.lower()}": f"SPDX-License-Identifier: {x}" for x in SPDX},
}

#: Licences and the identifier sequences that show them; SPDX lines show theirs besides. Fixed values.
RULES = {
    "0BSD": (("0bsd-grant", "isc-disclaims"),),
    "AGPL-3.0": (("agpl-free",), ("agpl-title", "agpl-version")),
    "Apache-2.0": (("apache-notice",), ("apache-notice-you",), ("apache-copy", "apache-unless"), ("apache-title", "apache-version", "apache-terms")),
    "BSD-2-Clause": (("bsd-redistribution", "bsd-source", "bsd-binary"), ("bsd-redistribution", "bsd-source"), ("bsd-redistribution", "bsd-binary")),
    "BSD-3-Clause": (("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"), ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse-name"), ("bsd-redistribution", "bsd-binary", "bsd-endorse"), ("bsd-redistribution", "bsd-endorse")),
    "BSD-4-Clause": (("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertise", "bsd-endorse"), ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertise", "bsd-endorse-name")),
    "BSL-1.0": (("bsl-title",), ("bsl-distributed",)),
    "CC-BY-4.0": (("cc-by-4",), ("cc-by-work",)),
    "CC-BY-NC-4.0": (("cc-by-nc-4",), ("cc-by-nc-work",)),
    "CC-BY-NC-SA-4.0": (("cc-by-nc-sa-4",),),
    "CC-BY-ND-4.0": (("cc-by-nd-4",),),
    "CC-BY-SA-4.0": (("cc-by-sa-4",), ("cc-by-sa-work",)),
    "CC0-1.0": (("cc0-extent",),),
    "EPL-2.0": (("epl-terms",),),
    "GPL-2.0": (("gpl2-notice",), ("gpl2-free",), ("gpl-title", "gpl-version-2")),
    "GPL-3.0": (("gpl3-notice",), ("gpl3-free",), ("gpl-title", "gpl-version-3")),
    "ISC": (("isc-grant",), ("isc-title", "isc-disclaims")),
    "LGPL-2.1": (("lgpl21-free",), ("lgpl21-title", "lgpl21-version")),
    "LGPL-3.0": (("lgpl3-free",), ("lgpl21-title", "gpl-version-3")),
    "MIT": (("mit-title", "mit-grant", "mit-kept", "mit-as-is", "mit-liable"), ("mit-title-the", "mit-grant", "mit-kept", "mit-as-is", "mit-liable"), ("mit-notice",), ("mit-licensed",), ("mit-project",), ("mit-title", "mit-grant"), ("mit-title-the", "mit-grant"), ("mit-grant", "mit-kept"), ("mit-grant", "mit-as-is")),
    "MPL-2.0": (("mpl-subject",), ("mpl-if",)),
    "Unlicense": (("unlicense-free",), ("unlicense-anyone",)),
    "WTFPL": (("wtfpl-title",),),
    "Zlib": (("zlib-as-is", "zlib-grant"),),
}
#: What is shown where no licence is met: by this sentence, or by a sentence that begins like one that grants a licence. Fixed values.
RESERVED, PROPRIETARY, UNKNOWN = "reserved", "proprietary", "unknown"
GRANTS = ("licensed under", "released under the", "distributed under the", "this work is licensed under", "this project is licensed under", "this program is licensed under", "this software is licensed under", "spdx license identifier")
#: Words that a slot takes at most.
SLOT = 12

#: Words of which every known sentence holds one. Fixed values.
ANCHORS = ("license", "licence", "licensed", "permission", "redistribution", "redistributions", "copyright", "warranty", "warranties", "liability", "redistribute", "cc", "version", "reserved", "software", "mpl", "reproduction")

_TOKEN = re.compile(rb"[a-z0-9]+|[.;:!?](?=\s|$)|\n")
_WORD = re.compile(rb"[a-z0-9]+")
_MARKS = frozenset((b".", b";", b":", b"!", b"?", b"\n"))


def normalised(sentence: str) -> tuple[bytes, ...]:
    return tuple(_WORD.findall(sentence.lower().encode()))


class Sentences:
    """Known sentences by their first two words, the longest first."""

    def __init__(self, sentences: dict[str, str]) -> None:
        self.by_start: dict[tuple[bytes, ...], list[tuple[list[tuple[bytes, ...]], str]]] = {}
        for name, text in sentences.items():
            parts = [normalised(x) for x in text.split("{}")]
            self.by_start.setdefault(parts[0][:2], []).append((parts, name))
        for known in self.by_start.values():
            known.sort(key=lambda x: -sum(map(len, x[0])))
        self.grants = tuple(normalised(g) for g in GRANTS)
        plain = {w for text in sentences.values() for w in normalised(text)}
        anchors = [a.encode() for a in ANCHORS if a.encode() in plain]
        # Sentences without an anchor bring their longest word.
        missing = {max(w, key=len) for w in map(normalised, sentences.values()) if not any(a in w for a in anchors)}
        self.anchors = [*anchors, *sorted(missing)]

    def find(self, text: bytes) -> tuple[list[str], bool]:
        """Identifiers in order of the text; whether an unknown sentence puts it under a licence."""
        low = text.lower()
        if not any(a in low for a in self.anchors):
            return [], False
        words: list[bytes] = []
        starts, ends = [0], set()
        for token in _TOKEN.findall(low):
            if token in _MARKS:
                ends.add(len(words))
                starts.append(len(words))
            else:
                words.append(token)
        ends.add(len(words))
        found: list[str] = []
        free, unknown = 0, False
        for p in dict.fromkeys(starts):
            if p < free:
                continue
            for key in (tuple(words[p : p + 2]), tuple(words[p : p + 1])):
                match = next(((end, name) for parts, name in self.by_start.get(key, ()) if (end := _end(words, p, parts)) in ends), None)
                if match:
                    found.append(match[1])
                    free = match[0]
                    break
            else:
                unknown |= any(tuple(words[p : p + len(g)]) == g for g in self.grants)
        return found, unknown


def _end(words: list[bytes], at: int, parts: list[tuple[bytes, ...]]) -> int:
    """Where a sentence that starts at a place ends; -1 if it isn't there. A slot takes as few words as it can."""
    for i, part in enumerate(parts):
        gaps = range(1, SLOT + 1) if i else (0,)
        at = next((at + g + len(part) for g in gaps if tuple(words[at + g : at + g + len(part)]) == part), -1)
        if at < 0:
            break
    return at


def met_licenses(ids: list[str], unknown: bool, rules: list[tuple[str, tuple[str, ...]]]) -> list[str]:
    """Licences of a text's identifiers by (licence, sequence) rules, the longest sequences first; each identifier serves one rule."""
    left: list[str | None] = list(ids)
    out = set()
    held = set(ids)
    for size in sorted({len(s) for _, s in rules}, reverse=True):
        while True:
            places = [(at, name) for name, s in rules if len(s) == size and held.issuperset(s) and (at := _subsequence(left, s))]
            if not places:
                break
            at, name = min(places)
            out.add(name)
            for p in at:
                left[p] = None
    if not out:
        return [PROPRIETARY] if RESERVED in held else [UNKNOWN] if unknown else []
    return sorted(out)


def _subsequence(ids: list[str | None], sequence: tuple[str, ...]) -> list[int]:
    """Places of the first occurrence in order, or none."""
    at, out = -1, []
    for s in sequence:
        at = next((i for i in range(at + 1, len(ids)) if ids[i] == s), -1)
        if at < 0:
            return []
        out.append(at)
    return out


@any_columns
def scan_licenses(docs: DataFrame, sentences: dict[str, str] | None = None, rules: dict[str, tuple[tuple[str, ...], ...]] | None = None) -> DataFrame:
    """``docs`` without its text, plus sentence_ids (in order of the text), n_sentences and licenses (sorted)."""
    known = sentences or SENTENCES
    named = dict(rules or RULES)
    if rules is None:
        for x in SPDX:
            family = x.removesuffix("-only").removesuffix("-or-later")
            named[family] = (*named.get(family, ()), (f"spdx-{x.lower()}",))
    names = [c for c in docs.columns if c != "text"]

    listed = [(name, s) for name, sequences in sorted(named.items()) for s in sequences]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Sentences(known)
        for batch in batches:
            found = [table.find(t) for t in texts_as_bytes(batch.column(batch.num_columns - 1))]
            ids = pa.array([f[0] for f in found], pa.list_(pa.string()))
            shown = pa.array([met_licenses(*f, listed) for f in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids, shown], names=[*batch.schema.names[:-1], "sentence_ids", "licenses"])

    strings = T.ArrayType(T.StringType())
    schema = T.StructType([*(docs.schema[c] for c in names if c not in ("sentence_ids", "licenses")), T.StructField("sentence_ids", strings), T.StructField("licenses", strings)])
    kept = [c for c in names if c not in ("sentence_ids", "licenses")]
    out = arrow(docs.select(*kept, "text"), find, schema)
    return out.withColumn("n_sentences", F.size("sentence_ids").cast("long"))
