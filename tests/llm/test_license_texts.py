"""Licence notices as they stand in real files, hard-wrapped, also inside comments."""

import pytest
from derivanta.llm import license_scan

MIT = """MIT License

Copyright (c) 2024 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.
"""
APACHE = """Copyright 2024 Some Body

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
BSD = """Copyright (c) 2024, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.
"""


def comment(text, mark):
    return "".join(f"{mark} {x}".rstrip() + "\n" for x in text.split("\n"))


CASES = [
    (MIT, ["mit.title", "mit.grant", "mit.notice"], ["mit-full"]),
    (MIT[MIT.index("Permission") :], ["mit.grant", "mit.notice"], ["mit-grant"]),
    (APACHE, ["apache2.license", "apache2.use", "apache2.copy"], ["apache2-header"]),
    (GPL, ["gpl.free", "gpl.warranty"], ["gpl3-header"]),
    (BSD, ["rights.reserved", "bsd.redistribute"], ["bsd-redistribute", "rights-reserved"]),
    (MIT[MIT.index("Permission") :] + APACHE, ["mit.grant", "mit.notice", "apache2.license", "apache2.use", "apache2.copy"], ["apache2-header", "mit-grant"]),
    ("                                 Apache License\n                           Version 2.0, January 2004\n", ["apache2.title"], ["apache2-title"]),
    ("  GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n Copyright (C) 2007", ["gpl3.title"], ["gpl3-title"]),
    ("The MIT License (MIT)\nCopyright", ["mit.title"], ["mit-title"]),
    # One line a sentence, without full stops, and licences side by side.
    ("MIT License\nAll rights reserved\nLicensed under CC BY 4.0; licensed under the BSD License!", ["mit.title", "rights.reserved", "ccby4.license", "bsd.license"], ["mit-title", "ccby4-license", "bsd-license", "rights-reserved"]),
    # Nothing is joined over a blank line or a full stop, and no part of a sentence counts.
    ("MIT\n\nLicense\n", [], []),
    ("We are at MIT. License: see below. All rights are reserved.", [], []),
    ("not released under the MIT License", [], []),
]


@pytest.mark.parametrize("mark", ["", "//", " *", "#"])
def test_wrapped_notices(spark, mark):
    rows = [(i, comment(t, mark) if mark else t) for i, (t, _, _) in enumerate(CASES)]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (_, ids, rules) in enumerate(CASES):
        assert (got[i].sentence_ids, sorted(got[i].rule_ids)) == (ids, sorted(rules)), i


def test_every_wording_is_found(spark):
    """Each as it stands, wrapped at each space, and in a text of long gaps."""
    words = [(k, v) for k, vs in license_scan.SENTENCES.items() for v in ([vs] if isinstance(vs, str) else vs)]
    gap = " ; " * 20_000 + "\t" * 50_000
    rows = [(i, t) for i, (_, v) in enumerate(words) for t in (v.upper(), v.replace(" ", "\n"), f"Before.{gap}{v}.{gap}after")]
    out = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 3 * len(words) and all(r.sentence_ids == [words[r.doc_id][0]] for r in out)
