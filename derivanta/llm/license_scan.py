"""License recognition by sentence rules, with DataFrame functions only.

A text is normalised to words, with its breaks marked, and known licence sentences are replaced by
identifiers. Licence texts are wrapped, so a sentence may run over a line feed or a semicolon, but
not over a blank line or a full stop; it begins and ends at a break of any kind. A rule is an ordered list of identifiers; it matches where these
appear in the text in that order, with nothing but unknown sentences between them. Rules are
tried from the longest to the shortest, so that a full licence text counts as such and not as
its first line.

Sentences may have slots for a name of so many words; what a work "is licensed under" may be any of the
licences' names, and an SPDX tag any expression of their identifiers, which gives one identifier each.
"""

from __future__ import annotations

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences by identifier, one or several wordings of each, as the
#: texts have them but for case, punctuation and wrapping. A blank line in one may be any break.
SENTENCES = {
    "mit.release": "released under the mit license",
    "mit.license": "licensed under the mit license",
    "mit.title": [
        "mit license",
        "the mit license",
        "the mit license (mit)",
    ],
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "apache2.license": [
        "licensed under the apache license version 2 0",
        'licensed under the apache license, version 2.0 (the "license")',
    ],
    "apache2.title": [
        "apache license version 2 0",
        "apache license\nversion 2.0, january 2004",
    ],
    "apache2.use": "you may not use this file except in compliance with the license",
    "apache2.copy": [
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
        "you may obtain a copy of the license at\n\nhttp://www.apache.org/licenses/license-2.0",
        "you may obtain a copy of the license at\n\nhttps://www.apache.org/licenses/license-2.0",
    ],
    "gpl3.license": "this work is licensed under the gnu general public license version 3",
    "gpl3.title": [
        "gnu general public license version 3",
        "gnu general public license\nversion 3, 29 june 2007",
    ],
    "gpl2.license": "this work is licensed under the gnu general public license version 2",
    "gpl.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl.warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "ccbync4.license": "licensed under cc by nc 4 0",
    "ccby4.license": "licensed under cc by 4 0",
    "ccbysa4.license": "licensed under cc by sa 4 0",
    "cc0.dedication": "licensed under cc0 1 0",
    "bsd.redistribute": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd.names": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the name of {12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the name of {12} nor the names of other contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the names of {12} nor the names of their contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "the name of {12} may not be used to endorse or promote products derived from this software without specific prior written permission",
        "the names of {12} may not be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "bsd.license": "licensed under the bsd license",
    "isc.grant": [
        "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "mpl2.subject": "this source code form is subject to the terms of the mozilla public license, v. 2.0",
    "mpl2.copy": [
        "if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0/",
        "if a copy of the mpl was not distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/",
    ],
    "unlicense.domain": "this is free and unencumbered software released into the public domain",
    "gpl2.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl3.free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl.warranty": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "agpl3.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "asis.mit": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "lgpl21.free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "gpl2.only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl3.only": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3",
    ],
    "epl.terms": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which {12}",
        "this program and the accompanying materials are made available under the terms of the eclipse public license v. 2.0 which {12}",
        "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 which {12}",
    ],
    "epl1.terms": "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which {12}",
    "zlib.grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost.grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "wtfpl.title": "do what the fuck you want to public license",
    "rights.reserved": "all rights reserved",
}

#: Identifiers of the SPDX list, and of exceptions to licences.
SPDX = [
    "0BSD", "AFL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-1.0", "Artistic-2.0", "BlueOak-1.0.0", "BSD-1-Clause", "BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause-Clear", "BSD-4-Clause", "BSL-1.0",
    "CC0-1.0", "CC-BY-2.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-SA-2.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC-BY-ND-3.0", "CC-BY-ND-4.0", "CC-BY-NC-3.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-3.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-3.0", "CC-BY-NC-ND-4.0",
    "CDDL-1.0", "CDDL-1.1", "CECILL-2.1", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2", "GFDL-1.3-only", "GFDL-1.3-or-later", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC",
    "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "LPPL-1.3c", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "MS-RL", "MulanPSL-2.0", "NCSA", "ODbL-1.0", "OFL-1.1",
    "OpenSSL", "OSL-3.0", "PDDL-1.0", "PHP-3.01", "PostgreSQL", "PSF-2.0", "Python-2.0", "Ruby", "Unicode-DFS-2016", "Unlicense", "UPL-1.0", "Vim", "W3C", "WTFPL", "X11", "Zlib", "ZPL-2.1",
]
EXCEPTIONS = ["Autoconf-exception-3.0", "Bison-exception-2.2", "Classpath-exception-2.0", "Font-exception-2.0", "GCC-exception-3.1", "LLVM-exception", "Linux-syscall-note", "OpenSSL-exception"]
#: Names by which a work is said to be licensed, beside the SPDX identifiers.
NAMES = {
    "MIT": ["mit license", "mit licence", "expat license"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 license", "apache license v2 0", "apache license 2"],
    "BSD-2-Clause": ["2 clause bsd license", "simplified bsd license", "two clause bsd license", "freebsd license"],
    "BSD-3-Clause": ["3 clause bsd license", "new bsd license", "modified bsd license", "revised bsd license", "three clause bsd license"],
    "0BSD": ["zero clause bsd license", "bsd zero clause license"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0", "mozilla public license v2 0", "mpl v2 0"],
    "EPL-1.0": ["eclipse public license version 1 0", "eclipse public license 1 0", "eclipse public license v1 0", "eclipse public license v 1 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v2 0", "eclipse public license v 2 0"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0", "boost software license"],
    "Artistic-2.0": ["artistic license 2 0", "artistic license version 2 0"],
    "OFL-1.1": ["sil open font license version 1 1", "sil open font license 1 1", "open font license 1 1"],
    "PSF-2.0": ["python software foundation license", "psf license"],
    "EUPL-1.2": ["european union public licence version 1 2", "european union public license version 1 2", "eupl 1 2"],
    "CDDL-1.0": ["common development and distribution license version 1 0", "common development and distribution license 1 0"],
    "ODbL-1.0": ["open database license", "open data commons open database license"],
    "CC0-1.0": ["cc0", "cc0 1 0 universal", "creative commons zero", "creative commons cc0 1 0", "creative commons zero v1 0 universal", "cc0 1 0 universal public domain dedication"],
    "WTFPL": ["do what the fuck you want to public license"],
}
#: The parts of Creative Commons names, and what may follow the version.
CREATIVE = {"BY": "attribution", "BY-SA": "attribution sharealike", "BY-ND": "attribution noderivatives", "BY-NC": "attribution noncommercial", "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives"}
GNU = {"GPL": ("general public license", "2", "3"), "LGPL": ("lesser general public license", "2.1", "3"), "AGPL": ("affero general public license", "3")}
_TAILS = {"2.0": ["", " generic"], "3.0": ["", " unported"], "4.0": ["", " international"]}


def _spoken() -> dict[str, str]:
    """Each name, in normalised words, and the SPDX identifier that it stands for."""
    plain = lambda x: regex.sub(r"[^\p{L}\p{Nd}]+", " ", x.lower()).strip()
    out = {plain(i): i for i in SPDX}
    for i, names in NAMES.items():
        out |= dict.fromkeys(map(plain, names), i)
    for short, (long, *versions) in GNU.items():
        for v in versions:
            number = plain(v)
            forms = {f"{mark}{n}" for mark in ("version ", "v", "v ", "") for n in {number, number if "." in v else f"{number} 0"}}
            for name in (long, f"gnu {long}", short.lower(), f"gnu {short.lower()}"):
                out |= dict.fromkeys((f"{name} {form}" for form in forms), f"{short}-{v if '.' in v else v + '.0'}-only")
            out |= {f"{gnu}{short.lower()}v{number}": f"{short}-{v if '.' in v else v + '.0'}-only" for gnu in ("", "gnu ")}
    for code, words in CREATIVE.items():
        apart = words.replace("sharealike", "share alike").replace("noncommercial", "non commercial").replace("noderivatives", "no derivatives")
        for version, tails in _TAILS.items():
            if f"CC-{code}-{version}" in SPDX:
                for w in {words, apart}:
                    for tail in tails:
                        out[f"creative commons {w} {plain(version)}{tail}"] = f"CC-{code}-{version}"
                out[f"cc {plain(code)} {plain(version)} international"] = f"CC-{code}-{version}"
    return out


SPOKEN = _spoken()
#: Identifiers as words, without the names.
TAGS = {regex.sub(r"[^\p{L}\p{Nd}]+", " ", i.lower()): i for i in [*SPDX, *EXCEPTIONS]}

#: Fixed values: (rule, licence, identifiers in order).
RULES = [
    ("mit-whole", "MIT", ["mit.title", "mit.grant", "mit.notice", "asis.mit"]),
    ("bsd3-whole", "BSD-3-Clause", ["bsd.redistribute", "bsd.source", "bsd.binary", "bsd.names"]),
    ("mit-full", "MIT", ["mit.title", "mit.grant", "mit.notice"]),
    ("bsd2-whole", "BSD-2-Clause", ["bsd.redistribute", "bsd.source", "bsd.binary"]),
    ("apache2-header", "Apache-2.0", ["apache2.license", "apache2.use", "apache2.copy"]),
    ("gpl3-header", "GPL-3.0", ["gpl.free", "gpl.warranty"]),
    ("agpl3-header", "AGPL-3.0", ["agpl3.free", "gpl.warranty"]),
    ("gpl2-header", "GPL-2.0", ["gpl2.free", "gpl.warranty"]),
    ("lgpl3-header", "LGPL-3.0", ["lgpl3.free", "lgpl.warranty"]),
    ("mpl2-header", "MPL-2.0", ["mpl2.subject", "mpl2.copy"]),
    ("mit-grant", "MIT", ["mit.grant", "mit.notice"]),
    ("mit-release", "MIT", ["mit.release"]),
    ("mit-license", "MIT", ["mit.license"]),
    ("mit-title", "MIT", ["mit.title"]),
    ("apache2-license", "Apache-2.0", ["apache2.license"]),
    ("apache2-title", "Apache-2.0", ["apache2.title"]),
    ("gpl3-license", "GPL-3.0", ["gpl3.license"]),
    ("gpl3-title", "GPL-3.0", ["gpl3.title"]),
    ("gpl2-license", "GPL-2.0", ["gpl2.license"]),
    ("gpl3-free", "GPL-3.0", ["gpl.free"]),
    ("ccbync4-license", "CC-BY-NC-4.0", ["ccbync4.license"]),
    ("ccby4-license", "CC-BY-4.0", ["ccby4.license"]),
    ("ccbysa4-license", "CC-BY-SA-4.0", ["ccbysa4.license"]),
    ("cc0-dedication", "CC0-1.0", ["cc0.dedication"]),
    ("bsd-redistribute", "BSD", ["bsd.redistribute"]),
    ("bsd-license", "BSD", ["bsd.license"]),
    ("isc-grant", "ISC", ["isc.grant"]),
    ("mpl2-subject", "MPL-2.0", ["mpl2.subject"]),
    ("unlicense-domain", "Unlicense", ["unlicense.domain"]),
    ("gpl2-free", "GPL-2.0", ["gpl2.free"]),
    ("lgpl3-free", "LGPL-3.0", ["lgpl3.free"]),
    ("agpl3-free", "AGPL-3.0", ["agpl3.free"]),
    ("lgpl21-free", "LGPL-2.1", ["lgpl21.free"]),
    ("gpl2-only", "GPL-2.0", ["gpl2.only"]),
    ("gpl3-only", "GPL-3.0", ["gpl3.only"]),
    ("epl2-terms", "EPL-2.0", ["epl.terms"]),
    ("epl1-terms", "EPL-1.0", ["epl1.terms"]),
    ("zlib-grant", "Zlib", ["zlib.grant"]),
    ("boost-grant", "BSL-1.0", ["boost.grant"]),
    ("wtfpl-title", "WTFPL", ["wtfpl.title"]),
    ("rights-reserved", "all-rights-reserved", ["rights.reserved"]),
]


def _family(spdx: str) -> str:
    """Later versions allowed or not: one licence."""
    return spdx.removesuffix("-only").removesuffix("-or-later")


RULES += [(f"{kind}-{i}", _family(i), [f"{kind}.{i}"]) for kind in ("under", "spdx") for i in SPDX]
#: A third clause, in whatever words, which a rule of two clauses has not: (rule in question, pattern, the rule that holds in its place).
UNLESS = ("bsd2-whole", r"[ ;.]neither[ ;]the[ ;]names?[ ;]of[ ;.]|[ ;]not[ ;]be[ ;]used[ ;]to[ ;]endorse[ ;]", ("bsd3-other", "BSD-3-Clause"))

#: In order: what makes one break mark of each gap between words. ; . ! ? count before white space
#: only; a line without letters and digits is blank. A mark . is a full stop or a blank line, a
#: mark ; a line feed or a semicolon. Each pattern takes time linear in the text.
STEPS = [
    (r"[.;!?](?![\x20\x09-\x0D])", ","),
    (r"[^\p{L}\p{Nd}\n.;!?]+", " "),
    (r";[ ;]*", ";"),
    (r"[ ;]*(?:[.!?]|\n[ ;]*\n)[ \n.;!?]*", "."),
    (r" ?[\n;][ \n;]*", ";"),
]
#: Where every known sentence holds one of the trigger words, a text without them needs no search.
TRIGGER = r"(?i)licen|copyright|permission|redistribut|warranty|reserved|unencumbered|\bmpl\b|(?:released|distributed|available)\s+under"

_GAP, _WORD = "[ ;]", r"[\p{L}\p{Nd}]+"


def _any_of(words) -> str:
    """A pattern for the longest of some word sequences; a v before a version may have a full stop."""
    gaps = lambda w: regex.sub(" ", lambda m: "[ ;.]" if w[: m.start()].endswith(" v") else _GAP, w)
    return "(?:" + "|".join(gaps(w) for w in sorted(words, key=lambda w: (-len(w), w))) + ")"


#: "(a work is) licensed under the terms of the (name)", its part before the name, in which nothing is denied, and what may follow.
_LEAD = f"(?:(?!(?:not|never|nor|t|without){_GAP}){_WORD}{_GAP}){{0,8}}(?:licensed|licenced|released|distributed|(?:made{_GAP})?available){_GAP}under{_GAP}(?:(?:the|a|an){_GAP})?(?:terms{_GAP}of{_GAP}(?:the{_GAP})?)?"
_UNDER = f"{_LEAD}{_any_of(SPOKEN)}(?:{_GAP}(?:license|licence))?(?:{_GAP}see(?:{_GAP}{_WORD}){{1,8}})?"
_TAG = f"spdx{_GAP}license{_GAP}identifier{_GAP}"
_EXPRESSION = f"{_TAG}{_any_of(TAGS)}(?:{_GAP}(?:and|or|with){_GAP}{_any_of(TAGS)})*"


def marked(text: Column) -> Column:
    """Lower-cased words of letters and digits, between any two a space or a break mark, and one
    mark at each end."""
    out = F.concat(F.lit("\n\n"), F.lower(text), F.lit("\n\n"))
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to)
    return out


def known_words(sentence: str) -> tuple[str, str]:
    """A known sentence as words with spaces between, and as a pattern for marked texts. A slot {n} stands for one
    to n words, with any breaks between them."""
    out = "\n\n" + regex.sub(r"\{(\d+)\}", r"slot\1slot", sentence.lower()) + "\n\n"
    for pattern, to in STEPS:
        out = regex.sub(pattern, to, out)
    out = out.strip(".;")
    gaps = regex.sub("[ ;.]", lambda m: "[ ;.]" if m[0] == "." else _GAP, out)
    slot = lambda m: f"{_WORD}(?:[ ;.]{_WORD}){{0,{int(m[1]) - 1}}}"
    return regex.sub("[;.]", " ", out), regex.sub(r"slot(\d+)slot", slot, gaps)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known=None, rules=None) -> DataFrame:
    """One row per input row: the id, sentence_ids (known sentences in text order), rule_ids and
    licenses (both in order of rule length, then of the rule list), n_known and license
    (the first, or null).

    known: a sentence, or a list of wordings, for each identifier, which may have slots (known_words). Of several
    that begin at one place the longest wording counts, and the next begins where it ends. Without known, sentences by which a work is licensed under a name of SPOKEN give
    under.(SPDX identifier), and SPDX tags spdx.(identifier) for each one of their expression, in order.
    A rule of two BSD clauses gives way where the text has a third (UNLESS).

    Where a rule's sequence matches, its sentences are used up: shorter rules match only
    in what is left, so one sentence never counts twice. Repeated sentences repeat in
    sentence_ids; a rule is named once. Null or empty texts, and texts without a known
    sentence, give empty lists and a null license. Other columns are ignored, whatever
    their names; repeated rows give repeated rows; an empty table gives none.

    All steps are expressions over one row, so nothing is shuffled and a hot source or a long
    text costs only its own task. Known sentences and rules are plan constants.
    """
    general = known is None
    known, rules = dict(SENTENCES if known is None else known), list(RULES if rules is None else rules)
    spelled = {known_words(v): k for k, vs in known.items() for v in ([vs] if isinstance(vs, str) else vs)}
    slotted = {x: k for x, k in spelled.items() if "slot" in x[0]}
    by_text = {words: k for (words, _), k in spelled.items() if (words, _) not in slotted}
    constant = lambda d: F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, v)])
    # Longest first, and of one length that with most breaks.
    choice = "|".join([p for _, p in sorted(spelled, key=lambda x: (-len(x[0]), -len(x[1])))] + ([_EXPRESSION, _UNDER] if general else []))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # Worked out once for each text that may hold a sentence.
    likely = text.rlike(TRIGGER) if all(regex.search(TRIGGER, x) for x, _ in spelled) else F.lit(True)
    plain = lambda s: F.translate(s, ";.", "  ")

    def named(s: Column) -> Column:
        """The identifiers of one found sentence."""
        of = [F.try_element_at(constant(by_text), plain(s))] if by_text else []
        of += [F.when(s.rlike(f"^{p}$"), k) for (_, p), k in slotted.items()]
        if general:
            whole = F.regexp_replace(plain(F.regexp_replace(s, f"^{_LEAD}", "")), " see .*$", "")
            spoken = F.regexp_replace(whole, " (?:license|licence)$", "")  # a name may end in the word itself
            of.append(F.concat(F.lit("under."), F.coalesce(F.try_element_at(constant(SPOKEN), whole), F.try_element_at(constant(SPOKEN), spoken))))
            tags = F.regexp_extract_all(plain(F.regexp_replace(s, f"^{_TAG}", "")), F.lit(f"({_any_of(TAGS).replace(_GAP, ' ')})(?= (?:and|or|with) |$)"), F.lit(1))
            listed = F.transform(tags, lambda t: F.concat(F.lit("spdx."), F.element_at(constant(TAGS), t)))
            return F.when(s.rlike(f"^{_TAG}"), listed).otherwise(F.array(F.coalesce(*of)))
        return F.array(F.coalesce(*of))

    def scanned(m: Column) -> Column:
        cut = F.regexp_extract_all(m, F.lit(f"[.;]({choice})(?=[.;])"), F.lit(1))
        return F.struct(F.flatten(F.transform(cut, named)).alias("ids"), m.rlike(UNLESS[1]).alias("third"))

    empty = F.array().cast("array<string>")
    nothing = F.struct(empty.alias("ids"), F.lit(False).alias("third"))
    once = F.get(F.transform(F.array(marked(text)), scanned), F.lit(0))
    out = docs.select(F.col(f"`{id_col}`").alias(id_col), F.when(likely, once).otherwise(nothing).alias("_found"))
    out = out.select(id_col, F.col("_found.ids").alias("sentence_ids"), F.col("_found.third").alias("_third"))
    # The identifiers as one string, each between bars; a matched sequence becomes one bar.
    left = F.concat(F.lit("|"), F.array_join("sentence_ids", "||"), F.lit("|"))
    out = out.withColumn("_left", left).withColumn("_rules", empty).withColumn("_names", empty)
    tried = sorted(rules, key=lambda r: -len(r[2]))
    step = F.struct(F.col("_left").alias("left"), empty.alias("rules"), empty.alias("names"))
    specs = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(name).alias("name"), F.lit("".join(f"|{x}|" for x in seq)).alias("seq")) for r, name, seq in tried])

    def match(acc, spec):
        hit = F.contains(acc["left"], spec["seq"])
        instead = F.col("_third") & (spec["rule"] == UNLESS[0])
        one = lambda c, i: F.array(F.when(instead, UNLESS[2][i]).otherwise(spec[c]))
        return F.struct(
            F.when(hit, F.replace(acc["left"], spec["seq"], F.lit("|"))).otherwise(acc["left"]).alias("left"),
            F.when(hit, F.concat(acc["rules"], one("rule", 0))).otherwise(acc["rules"]).alias("rules"),
            F.when(hit, F.concat(acc["names"], one("name", 1))).otherwise(acc["names"]).alias("names"),
        )

    matched = F.when(F.size("sentence_ids") > 0, F.aggregate(specs, step, match))
    out = out.withColumn("_m", matched)
    return out.select(
        id_col,
        "sentence_ids",
        F.coalesce(F.col("_m.rules"), empty).alias("rule_ids"),
        F.array_distinct(F.coalesce(F.col("_m.names"), empty)).alias("licenses"),
        F.size("sentence_ids").alias("n_known"),
        F.try_element_at(F.col("_m.names"), F.lit(1)).alias("license"),
    )
