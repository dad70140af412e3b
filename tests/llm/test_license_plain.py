"""License scan against a plain matcher that walks over the words of a text, and on whole licence notices."""

import pyarrow.parquet as pq
import pytest
import regex
from derivanta.llm.license_scan import RULES, SENTENCES, SPOKEN, TAGS, scan_licenses

WORD = regex.compile(r"[\p{L}\p{Nd}]+")


def gaps(text):
    """(words, gap before each and after the last): "." a full stop, mark before white space or blank line, ";" a
    line feed or semicolon, " " otherwise. Both ends of a text are full stops."""
    text = text.lower()
    found = [*WORD.finditer(text)]
    ends = [0, *[m.end() for m in found]]
    starts = [*[m.start() for m in found], len(text)]
    out = []
    for i, (a, b) in enumerate(zip(ends, starts, strict=True)):
        gap = text[a:b] + ("" if i < len(found) else "\n\n")
        gap = ("\n\n" if i == 0 else "") + gap
        if i in (0, len(found)) or regex.search(r"[.!?][\x20\x09-\x0D]", gap) or regex.search(r"\n[^\n]*\n", regex.sub(r"[.;!?](?![\x20\x09-\x0D])", "", gap)):
            out.append(".")
        else:
            out.append(";" if "\n" in gap or regex.search(r";[\x20\x09-\x0D]", gap) else " ")
    return [m[0] for m in found], out


def spelled(v):
    return gaps(regex.sub(r"\{(\d+)\}", r"slot\1slot", v))


KNOWN = sorted(((*spelled(v), k) for k, vs in SENTENCES.items() for v in ([vs] if isinstance(vs, str) else vs)), key=lambda x: (-len(" ".join(x[0])), x[2]))
SLOT = regex.compile(r"slot(\d+)slot")
VERBS = [["licensed"], ["licenced"], ["released"], ["distributed"], ["available"], ["made", "available"]]


def sentence_end(words, gap, at, known, breaks):
    """Where a known sentence that starts at a word ends; a slot takes as many words as it can."""

    def go(i, j):
        if j == len(known):
            return i if gap[i] in ".;" else None
        if j and i < len(words) and gap[i] == "." and breaks[j] != ".":
            return None
        if slot := SLOT.fullmatch(known[j]):
            for n in range(min(int(slot[1]), len(words) - i), 0, -1):
                if (end := go(i + n, j + 1)) is not None:
                    return end
            return None
        return go(i + 1, j + 1) if i < len(words) and words[i] == known[j] else None

    return go(at, 0)


def joined(gap, a, b):
    """No full stop between two words."""
    return all(g != "." for g in gap[a + 1 : b])


def under_end(words, gap, at):
    """(identifier, end) of "(a work is) licensed under (the terms of the) name (license) (see the file)"."""
    best = []
    for i in range(at, min(at + 9, len(words))):
        if any(w in ("not", "never", "nor", "t", "without") for w in words[at:i]):
            break
        for verb in VERBS:
            j = i + len(verb)
            if words[i:j] == verb and words[j : j + 1] == ["under"]:
                starts = {j + 1}
                starts |= {k + 1 for k in starts if words[k : k + 1] in (["the"], ["a"], ["an"])}
                starts |= {k + 2 for k in starts if words[k : k + 2] == ["terms", "of"]}
                starts |= {k + 1 for k in starts if words[k - 2 : k + 1] == ["terms", "of", "the"]}
                for k in starts:
                    for name, spdx in SPOKEN.items():
                        n = k + len(name.split())
                        if words[k:n] == name.split():
                            ends = {n, n + (words[n : n + 1] in (["license"], ["licence"]))}
                            ends |= {e + 1 + m for e in ends if words[e : e + 1] == ["see"] for m in range(1, 9) if e + 1 + m <= len(words)}
                            for end in ends:
                                stops = [x for x in range(at + 1, end) if gap[x] == "." and not (k < x < n and words[x - 1] == "v")]
                                if gap[end] in ".;" and not stops:
                                    best.append((i == at, end, len(name), spdx))
    if best:
        _, end, _, spdx = max(best)
        return f"under.{spdx}", end
    return None


def tag_end(words, gap, at):
    """(identifiers, end) of an SPDX tag."""
    if words[at : at + 3] != ["spdx", "license", "identifier"]:
        return None

    def go(i):
        for name in sorted(TAGS, key=len, reverse=True):
            n = i + len(name.split())
            if words[i:n] == name.split():
                if words[n : n + 1] and words[n] in ("and", "or", "with") and (more := go(n + 1)):
                    return [f"spdx.{TAGS[name]}", *more[0]], more[1]
                if gap[n] in ".;":
                    return [f"spdx.{TAGS[name]}"], n
        return None

    found = go(at + 3)
    return found if found and joined(gap, at, found[1]) else None


def plain_scan(text):
    words, gap = gaps(text or "")
    ids, at = [], 0
    third = regex.search(r"(^|[ .;])neither[ ;]the[ ;]names?[ ;]of[ .;]|[ ;]not[ ;]be[ ;]used[ ;]to[ ;]endorse[ ;]", "".join(g + w for g, w in zip(gap, words, strict=False)) + gap[-1]) is not None
    while at < len(words):
        hit = None
        if gap[at] in ".;":
            for known, breaks, name in KNOWN:
                if (end := sentence_end(words, gap, at, known, breaks)) is not None:
                    hit = [name], end
                    break
            hit = hit or tag_end(words, gap, at)
            if not hit and (one := under_end(words, gap, at)):
                hit = [one[0]], one[1]
        if hit:
            ids += hit[0]
        at = hit[1] if hit else at + 1
    left, rules, names = [[x] for x in ids], [], []
    for rule, name, seq in sorted(RULES, key=lambda r: -len(r[2])):
        i, used = 0, False
        while i + len(seq) <= len(left):
            if [x for x in left[i : i + len(seq)]] == [[s] for s in seq]:
                left[i : i + len(seq)] = [[None]]
                used = True
            i += 1
        if used:
            instead = third and rule == "bsd2-whole"
            rules.append("bsd3-other" if instead else rule)
            names.append("BSD-3-Clause" if instead else name)
    return ids, rules, [*dict.fromkeys(names)]


def test_documents(spark):
    """Every whole text of the table."""
    path = "/root/testdata/sf0.01/documents.parquet"
    want = {r["doc_id"]: plain_scan(r["text"]) for r in pq.read_table(path, columns=["doc_id", "text"]).to_pylist()}
    got = {r.doc_id: (r.sentence_ids, r.rule_ids, r.licenses) for r in scan_licenses(spark.read.parquet(path)).collect()}
    assert got == want and sum(bool(x[0]) for x in want.values()) > 10


BSD = """Copyright (c) 2024, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{0} Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

{1} Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES = """
{2} Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
NOTICES = {
    "BSD-3-Clause": [BSD.format("1.", "2.") + NAMES.format(0, 0, "3."), BSD.format("*", "*") + NAMES.format(0, 0, "*")],
    "BSD-2-Clause": [BSD.format("1.", "2.")],
    "ISC": [ISC, " ".join(ISC.split())],
    "MPL-2.0": [MPL, " ".join(MPL.split())],
    "GPL-2.0": [GPL2, " ".join(GPL2.split())],
    "LGPL-3.0": [GPL2.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 2", "version 3")],
    "AGPL-3.0": [GPL2.replace("GNU General", "GNU Affero General").replace("version 2", "version 3")],
    "Unlicense": ["This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy."],
}


@pytest.mark.parametrize("license", sorted(NOTICES))
def test_notices(spark, license):
    texts = [f"{before}{t}{after}" for t in NOTICES[license] for before, after in (("", ""), ("Some words.\n\n", "\nint main() {}\n"))]
    got = scan_licenses(spark.createDataFrame([*enumerate(texts)], "doc_id int, text string")).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert (r.sentence_ids, r.rule_ids, r.licenses) == plain_scan(t)
        assert r.license == license


def test_odd_rows(spark):
    rows = [(1, None, 1), (None, "Licensed under the MIT License.", 1), (2, "", 1), (3, "x " * 200_000 + "\n\nMIT License\n", 1), (3, "All rights reserved", 2), (3, "All rights reserved", 2)]
    frame = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id int, text string, licenses int, _left string, _m string")
    got = scan_licenses(frame).collect()
    assert sorted((repr((r.doc_id, r.sentence_ids, r.rule_ids, r.licenses)) for r in got)) == sorted(repr((i, *plain_scan(t))) for i, t, _ in rows)
    assert scan_licenses(frame.limit(0)).count() == 0
