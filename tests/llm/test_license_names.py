"""Licence statements written without a look at the known sentences."""

import pytest
from derivanta.llm.license_scan import RULES, scan_licenses

CLAUSES = """Redistribution and use in source and binary forms, with or without modification,
are permitted provided that the following conditions are met:

    * Redistributions of source code must retain the above copyright notice,
      this list of conditions and the following disclaimer.
    * Redistributions in binary form must reproduce the above copyright notice,
      this list of conditions and the following disclaimer in the documentation
      and/or other materials provided with the distribution.
"""
THIRD = "    * Neither the name of {} nor the names of its\n      contributors may be used to endorse or promote products derived from this\n      software without specific prior written permission.\n"
TEXTS = {
    "BSD-2-Clause": [CLAUSES, "The 2-Clause BSD License\n\n" + CLAUSES, "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": [
        CLAUSES + THIRD.format("Google Inc."),
        CLAUSES + THIRD.format("the University"),
        CLAUSES + THIRD.format("the University of California, Berkeley"),
        CLAUSES + "\nThe name of the author may not be used to endorse or promote products\nderived from this software without specific prior written permission.\n",
        CLAUSES + "\nNeither the name of Some Very Long Company nor that of anybody else at all may be used in advertising.\n",
        "This module is distributed under the New BSD License.",
    ],
    "CC-BY-4.0": ["This work is licensed under CC BY 4.0.", "Text licensed under CC-BY-4.0\n", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "This work is licensed under the Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-3.0": ["All articles are available under the Creative Commons Attribution-ShareAlike 3.0 Unported License.", "Photos are licensed under a Creative Commons Attribution-Share Alike 3.0 license."],
    "CC-BY-NC-ND-4.0": ["The figures are licensed under CC BY-NC-ND 4.0 International.", "This book is released under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International license."],
    "CC0-1.0": ["The data is released under CC0.", "This dataset is made available under the CC0 1.0 Universal license."],
    "GPL-2.0": ["SPDX-License-Identifier: GPL-2.0-only", "// SPDX-License-Identifier: GPL-2.0-or-later\n#include <x.h>\n", "/* SPDX-License-Identifier: GPL-2.0+ */", "The kernel is distributed under the terms of the GNU General Public License version 2."],
    "GPL-3.0": ["This program is licensed under the GPLv3.", "This plugin is released under the GNU GPL v3 license."],
    "LGPL-2.1": [
        """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
""",
        "Qt bindings are available under the terms of the LGPL version 2.1.",
    ],
    "MIT": ["This project is licensed under the MIT License - see the LICENSE file.\n", "The code is licensed under the terms of the MIT license.", "# SPDX-License-Identifier: MIT", "Everything here is available under the MIT licence."],
    "Apache-2.0": ["The client is licensed under the Apache License, Version 2.0.", "Dual licensed under Apache 2.0", "It is released under the Apache-2.0 license."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the\nterms of the Eclipse Public License v. 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0.\n", "Licensed under EPL-2.0."],
    "MPL-2.0": ["The extension is distributed under the Mozilla Public License, v. 2.0."],
    "AGPL-3.0": ["The server is licensed under the GNU Affero General Public License v3.0."],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1.\n"],
    "Zlib": ["Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n"],
    None: ["I have not released it under the MIT License yet and won't.", "This work is not licensed under CC BY 4.0.", "They talked about the license.", "SPDX-License-Identifier: NOT-A-LICENSE", "Sold under the counter.", "It is licensed under a permit of the city."],
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"{name}/{i}", t) for name, texts in TEXTS.items() for i, t in enumerate(texts)]
    rows += [("both", "SPDX-License-Identifier: MIT OR Apache-2.0"), ("all", "// SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) AND BSD-3-Clause OR CC0-1.0\n")]
    return {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}


@pytest.mark.parametrize("name", sorted(TEXTS, key=str))
def test_statements(found, name):
    for i, t in enumerate(TEXTS[name]):
        r = found[f"{name}/{i}"]
        assert (r.license if name is None else name in r.licenses) == (None if name is None else True), (t, r)
        if name == "BSD-3-Clause":
            assert "BSD-2-Clause" not in r.licenses, (t, r)


def test_expressions_give_each_licence(found):
    assert found["both"].sentence_ids == ["spdx.MIT", "spdx.Apache-2.0"] and sorted(found["both"].licenses) == ["Apache-2.0", "MIT"]
    assert found["all"].sentence_ids == ["spdx.GPL-2.0-only", "spdx.Linux-syscall-note", "spdx.BSD-3-Clause", "spdx.CC0-1.0"]
    assert sorted(found["all"].licenses) == ["BSD-3-Clause", "CC0-1.0", "GPL-2.0"]


def test_there_are_many():
    assert len({name for _, name, _ in RULES}) >= 40
