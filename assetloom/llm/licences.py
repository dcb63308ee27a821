"""Licence recognition by sentences and rules (after German, Manabe and Inoue, 2010).  DataFrame functions only.

A text is cut into sentences, each is normalised, known sentences become identifiers, and the
identifiers of a text, in order, are matched against an ordered list of rules; what a rule has
matched is taken away before the next.  All of it happens within the row: no shuffle, no copy of
the text, whatever a source's or a licence's share of the rows.

A sentence is known in one of three ways: it stands in the table of licence sentences; it says that
something is licensed under a licence's name; or it is an SPDX line, whose identifiers are read one
by one, so expressions with AND, OR, WITH and brackets give each of their licences.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FSF = "as published by the Free Software Foundation"
_LATER = "or (at your option) any later version"


def _gnu(licence: str, version: str, later: bool) -> list[str]:
    """The grant of a GNU licence's notice, for whatever is licensed."""
    out = []
    for what in ("program", "library", "software", "file"):
        start = f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {licence}"
        if later:
            out.append(f"{start} {_FSF}, either version {version} of the License, {_LATER}")
        else:
            out += [f"{start} {_FSF}, version {version} of the License", f"{start} version {version} {_FSF}", f"{start}, version {version}, {_FSF}"]
    return out


def _hope(what: str) -> str:
    return f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"


_COMMON_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_FOR_ANY = "distribute this software for any purpose with or without fee is hereby granted"

#: Sentences of public licences (SPDX licence texts and their usual notices), by identifier.
SENTENCES = {
    "ApacheUse": ["you may not use this file except in compliance with the License", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"],
    "ApacheCopy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"],
    "ApacheAsIs": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "ApacheSee": ["See the License for the specific language governing permissions and limitations under the License"],
    "MitGrant": [_COMMON_GRANT + ", subject to the following conditions", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "Mit0Grant": [_COMMON_GRANT],
    "MitNotice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "MitAsIs": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "MitLiable": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "IscGrant": [f"Permission to use, copy, modify, {x} {_FOR_ANY}, provided that the above copyright notice and this permission notice appear in all copies" for x in ("and/or", "and")],
    "ZeroGrant": [f"Permission to use, copy, modify, {x} {_FOR_ANY}" for x in ("and/or", "and")],
    "IscAsIs": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"],
    "BsdGrant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BsdSource": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "BsdBinary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "BsdAdvert": ["All advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "BsdEndorse": [f"Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without {x}specific prior written permission" for x in ("", "the ")],
    "BsdAsIs": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"],
    "Gpl3Later": _gnu("General Public License", "3", True),
    "Gpl3Only": _gnu("General Public License", "3", False),
    "Gpl2Later": _gnu("General Public License", "2", True),
    "Gpl2Only": _gnu("General Public License", "2", False),
    "Lgpl3Later": _gnu("Lesser General Public License", "3", True),
    "Lgpl3Only": _gnu("Lesser General Public License", "3", False),
    "Lgpl21Later": _gnu("Lesser General Public License", "2.1", True),
    "Lgpl21Only": _gnu("Lesser General Public License", "2.1", False),
    "Lgpl2Later": _gnu("Library General Public License", "2", True),
    "Agpl3Later": _gnu("Affero General Public License", "3", True),
    "Agpl3Only": _gnu("Affero General Public License", "3", False),
    "GnuHope": [_hope(what) for what in ("program", "library", "software", "file")],
    "GplSee": ["See the GNU General Public License for more details"],
    "LgplSee": ["See the GNU Lesser General Public License for more details", "See the GNU Library General Public License for more details"],
    "AgplSee": ["See the GNU Affero General Public License for more details"],
    "MplNotice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "MplCopy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "Epl2Notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-2.0/"],
    "Epl1Notice": ["All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "UnlicenseFree": ["This is free and unencumbered software released into the public domain"],
    "UnlicenseAnyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "BoostGrant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"],
    "BoostNotice": ["Distributed under the Boost Software License, Version 1.0"],
    "ZlibAsIs": ["This software is provided 'as-is', without any express or implied warranty"],
    "ZlibGrant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "WtfplDo": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"],
    "Cc0Waive": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"],
    "OflNotice": ["This Font Software is licensed under the SIL Open Font License, Version 1.1"],
    "PostgresGrant": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"],
    "Rights": ["All rights reserved"],
}

_SEVERAL = [
    ("Apache-2.0", ["ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["Name-Apache-2.0", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["Name-Apache-2.0", "ApacheUse", "ApacheCopy"]),
    ("Apache-2.0", ["Name-Apache-2.0", "ApacheUse"]),
    ("MIT", ["Name-MIT", "MitGrant", "MitNotice", "MitAsIs", "MitLiable"]),
    ("MIT", ["MitGrant", "MitNotice", "MitAsIs", "MitLiable"]),
    ("MIT", ["MitGrant", "MitNotice", "MitAsIs"]),
    ("MIT", ["Name-MIT", "MitGrant", "MitNotice", "MitAsIs"]),
    ("MIT-0", ["Mit0Grant", "MitAsIs", "MitLiable"]),
    ("MIT-0", ["Mit0Grant", "MitAsIs"]),
    ("ISC", ["IscGrant", "IscAsIs"]),
    ("0BSD", ["ZeroGrant", "IscAsIs"]),
    ("BSD-4-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdAdvert", "BsdEndorse"]),
    ("BSD-4-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdAdvert", "BsdEndorse", "BsdAsIs"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("BSD-1-Clause", ["BsdGrant", "BsdSource", "BsdAsIs"]),
    ("MPL-2.0", ["MplNotice", "MplCopy"]),
    ("Unlicense", ["UnlicenseFree", "UnlicenseAnyone"]),
    ("Zlib", ["ZlibAsIs", "ZlibGrant"]),
    *[(licence, [grant, "GnuHope", see]) for licence, grant, see in (
        ("GPL-3.0-or-later", "Gpl3Later", "GplSee"), ("GPL-3.0-only", "Gpl3Only", "GplSee"), ("GPL-2.0-or-later", "Gpl2Later", "GplSee"), ("GPL-2.0-only", "Gpl2Only", "GplSee"),
        ("LGPL-3.0-or-later", "Lgpl3Later", "LgplSee"), ("LGPL-3.0-only", "Lgpl3Only", "LgplSee"), ("LGPL-2.1-or-later", "Lgpl21Later", "LgplSee"), ("LGPL-2.1-only", "Lgpl21Only", "LgplSee"),
        ("LGPL-2.0-or-later", "Lgpl2Later", "LgplSee"), ("AGPL-3.0-or-later", "Agpl3Later", "AgplSee"), ("AGPL-3.0-only", "Agpl3Only", "AgplSee"),
    )],
]

#: Ordered rules of several sentences: the identifiers in a row that make a licence.  A rule that holds another is longer, so the longest come first.
RULES = sorted(_SEVERAL, key=lambda r: -len(r[1]))

#: Rules of one sentence, tried on what is left.  Name-X and Spdx-X make X.
SINGLE = {
    "ApacheUse": "Apache-2.0", "MitGrant": "MIT", "Mit0Grant": "MIT-0", "IscGrant": "ISC", "ZeroGrant": "0BSD", "BsdGrant": "BSD", "Gpl3Later": "GPL-3.0-or-later", "Gpl3Only": "GPL-3.0-only",
    "Gpl2Later": "GPL-2.0-or-later", "Gpl2Only": "GPL-2.0-only", "Lgpl3Later": "LGPL-3.0-or-later", "Lgpl3Only": "LGPL-3.0-only", "Lgpl21Later": "LGPL-2.1-or-later", "Lgpl21Only": "LGPL-2.1-only",
    "Lgpl2Later": "LGPL-2.0-or-later", "Agpl3Later": "AGPL-3.0-or-later", "Agpl3Only": "AGPL-3.0-only", "MplNotice": "MPL-2.0", "Epl2Notice": "EPL-2.0", "Epl1Notice": "EPL-1.0", "UnlicenseFree": "Unlicense",
    "BoostGrant": "BSL-1.0", "BoostNotice": "BSL-1.0", "ZlibGrant": "Zlib", "WtfplDo": "WTFPL", "Cc0Waive": "CC0-1.0", "OflNotice": "OFL-1.1", "PostgresGrant": "PostgreSQL",
}

#: Names that licences go by, by SPDX identifier; "license" at the end may be left out.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0", "Apache-2.0", "Apache Software License, Version 2.0", "Apache License, Version 2.0 (the"],
    "MIT": ["MIT", "MIT/X11", "Expat"],
    "ISC": ["ISC"],
    "BSD": ["BSD", "BSD-style"],
    "BSD-2-Clause": ["BSD 2-Clause", "2-Clause BSD", "Simplified BSD"],
    "BSD-3-Clause": ["BSD 3-Clause", "3-Clause BSD", "New BSD", "Revised BSD", "Modified BSD"],
    "GPL-2.0-only": ["GNU General Public License v2.0", "GNU General Public License, version 2", "GPLv2", "GPL v2", "GPL-2.0"],
    "GPL-3.0-only": ["GNU General Public License v3.0", "GNU General Public License, version 3", "GPLv3", "GPL v3", "GPL-3.0"],
    "GPL-2.0-or-later": ["GNU General Public License v2.0 or later", "GPLv2+", "GPL v2 or later"],
    "GPL-3.0-or-later": ["GNU General Public License v3.0 or later", "GPLv3+", "GPL v3 or later"],
    "LGPL-2.1-only": ["GNU Lesser General Public License v2.1", "GNU Lesser General Public License, version 2.1", "LGPLv2.1", "LGPL-2.1"],
    "LGPL-3.0-only": ["GNU Lesser General Public License v3.0", "GNU Lesser General Public License, version 3", "LGPLv3", "LGPL-3.0"],
    "AGPL-3.0-only": ["GNU Affero General Public License v3.0", "GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL 2.0"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License"],
    "Zlib": ["zlib"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0", "CC0 1.0", "Creative Commons Zero v1.0 Universal"],
    **{f"CC-BY{part}-4.0": [f"CC BY{part} 4.0", f"CC-BY{part}-4.0", f"Creative Commons {long} 4.0 International"] for part, long in (
        ("", "Attribution"), ("-SA", "Attribution-ShareAlike"), ("-NC", "Attribution-NonCommercial"), ("-ND", "Attribution-NoDerivatives"), ("-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    )},
}
#: Sentences that are a name alone.
_TITLES = {"MIT License": "MIT", "The MIT License": "MIT", "The MIT License (MIT)": "MIT", "ISC License": "ISC", "BSD License": "BSD", "BSD 2-Clause License": "BSD-2-Clause", "BSD 3-Clause License": "BSD-3-Clause", "zlib License": "Zlib", "Boost Software License - Version 1.0": "BSL-1.0"}

_GNU = [f"{name}-{version}" for name, versions in (("GPL", ("1.0", "2.0", "3.0")), ("LGPL", ("2.0", "2.1", "3.0")), ("AGPL", ("1.0", "3.0"))) for version in versions]
#: SPDX identifiers of common licences and exceptions.
SPDX = [
    *"0BSD AFL-3.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 bzip2-1.0.6 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 curl ECL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FTL".split(),
    *"GFDL-1.3-only GFDL-1.3-or-later HPND ICU IJG ImageMagick IPL-1.0 ISC JSON libpng-2.0 Libpng MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 Ruby SSPL-1.0 Unicode-3.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Xnet Zlib ZPL-2.1".split(),
    *[f"CC-BY{part}-{version}" for part in ("", "-SA", "-NC", "-ND", "-NC-SA", "-NC-ND") for version in ("3.0", "4.0")],
    *[f"{x}-{kind}" for x in _GNU for kind in ("only", "or-later")],
    *"Classpath-exception-2.0 GCC-exception-3.1 LLVM-exception Linux-syscall-note OpenSSL-exception".split(),
]

#: Sentences end at . ! ? before white space, at a colon that ends a line, and at empty lines.  One that isn't known is tried line by line.
_ENDS = r"[.!?]+[ \t\r\n]+|:[ \t\r]*\n|\n[ \t\r]*\n"
_NOISE = "[^a-z0-9+/]+"
#: The number of the next item of a list, where a sentence was cut after it.
_ITEM = " [0-9]{1,2}$"
#: Comment marks where a line starts or ends; a mark at a line's start may follow white space.
_MARKS = r"(?m)^[ \t]*(?://+[!/]*|/\*+!?|\*+/)|(?://+|/\*+|\*+/)[ \t\r]*$"
#: What says that something is under a licence; the group is the licence's name.
_UNDER = "^(?:(?:this|the) (?:work|project|software|file|program|code|library|package|document|source code) is )?(?:also )?(?:licensed|released|distributed|published|available|made available) under (?:the )?(?:terms of (?:the )?)?(.+?)(?: licen[cs]e)?$"
#: An SPDX line; the group is its expression.  Identifiers are the words of that.
_LINE, _WORD = "(?i)spdx-license-identifier:(.*)$", "[A-Za-z0-9.+-]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every known sentence holds one of these, so a text without any has none (checked when the tables are built);
#: what says that something is under a licence without that word holds one of the others.
_SIGNS = ("licen", "rights", "copyright", "permi", "redistribut", "warrant", "advertising", "unencumbered", "free to copy", "mozilla")
_VERBS = ("released", "distributed", "published", "available")
#: Stands for what a rule has taken.
_TAKEN = "|"


def normalised(sentence: str) -> str:
    """Lower-case words of ASCII letters, digits, + and /, with one space between."""
    return re.sub(_NOISE, " ", sentence.translate(str.maketrans(_UPPER, _LOWER))).strip(" ")


def known() -> dict[str, str]:
    """Normalised known sentence -> identifier.  Of a sentence that the cutter would cut, the first part."""
    found = {normalised(re.split(_ENDS, s)[0]): name for name, group in SENTENCES.items() for s in group}
    found |= {normalised(s): f"Name-{name}" for s, name in _TITLES.items()}
    found[normalised("All rights reserved")] = "Rights"
    if missed := [s for s in found if not any(x in s for x in _SIGNS)]:
        raise ValueError(f"no sign word in: {missed}")
    return found


def names() -> dict[str, str]:
    """Normalised name without a final "license" -> identifier."""
    return {re.sub(" licen[cs]e$", "", normalised(x)): f"Name-{licence}" for licence, group in NAMES.items() for x in group}


def identifiers() -> dict[str, str]:
    """SPDX identifier in lower case -> identifier.  GNU ones without "only" and "or later", and those with +, are the older spelling."""
    found = {x.lower() + "+": f"Spdx-{x}" for x in SPDX} | {x.lower(): f"Spdx-{x}" for x in SPDX}
    found |= {x.lower(): f"Spdx-{x}-only" for x in _GNU} | {x.lower() + "+": f"Spdx-{x}-or-later" for x in _GNU}
    return found


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def recognise(text: Column) -> Column:
    """Struct (licences, sentences, unmatched) of a whole text, each a comma-joined string.

    licences: the names whose rules matched, each once, those of several sentences first and in rule
    order, then those of one in text order; sentences: identifiers of the known sentences in text
    order, repeats included; unmatched: those that no rule took.  Null and empty texts, and texts
    without a known sentence, give three empty strings.  A text is read whole, however long; a row
    is judged by its text alone, so repeated rows and other columns, whatever their names, play no
    part, and an empty table gives no row.
    """
    none = F.array().cast("array<string>")
    sentences, licences, spdx = _map(known()), _map(names()), _map(identifiers())
    plain = lambda s: F.trim(F.regexp_replace(F.translate(s, _UPPER, _LOWER), _NOISE, " "))
    under = lambda s: F.when(s.contains(" under ") | s.startswith("licensed") | s.startswith("released") | s.startswith("distributed"), F.element_at(licences, F.regexp_extract(s, _UNDER, 1)))
    look = lambda s: F.coalesce(F.element_at(sentences, s), under(s), F.element_at(sentences, F.regexp_replace(s, _ITEM, "")))
    one = lambda s: F.get(F.transform(F.array(plain(s)), look), F.lit(0))  # noqa: E731  bound once
    marked = lambda line: F.transform(F.regexp_extract_all(F.regexp_extract(line, _LINE, 1), F.lit(_WORD), F.lit(0)), lambda x: F.element_at(spdx, F.lower(x)))
    by_line = lambda s: F.flatten(F.transform(F.split(s, "\n", -1), lambda x: F.when(F.translate(x, _UPPER, _LOWER).contains("spdx-license-identifier:"), marked(x)).otherwise(F.array(one(x)))))
    sentence = lambda s: F.flatten(F.transform(F.array(one(s)), lambda x: F.when(x.isNotNull(), F.array(x)).otherwise(by_line(s))))
    bare = F.regexp_replace(text, _MARKS.replace("(?m)", "(?md)"), "")
    found = F.filter(F.flatten(F.transform(F.split(bare, _ENDS, -1), sentence)), lambda x: x.isNotNull())
    has = lambda low, words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    maybe = F.get(F.transform(F.array(F.lower(text)), lambda low: has(low, _SIGNS) | (low.contains("under") & has(low, _VERBS))), F.lit(0))
    ids = F.coalesce(F.when(maybe, found), none)
    return F.get(F.transform(F.array(ids), _matched), F.lit(0))


def _matched(ids: Column) -> Column:
    """The struct of ``recognise`` for a text's identifiers."""
    none = F.array().cast("array<string>")
    left = F.concat(F.lit(""), F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), ""))
    steps = [F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in rule)).alias("ids")) for name, rule in RULES]
    start = F.struct(left.alias("left"), none.alias("names"))
    step = lambda a, r: F.struct(F.replace(a["left"], r["ids"], F.lit(_TAKEN)).alias("left"), F.when(a["left"].contains(r["ids"]), F.array_union(a["names"], F.array(r["name"]))).otherwise(a["names"]).alias("names"))
    state = F.when(F.size(ids) > 1, F.aggregate(F.array(*steps), start, step)).otherwise(start)
    single = lambda x: F.when(x.startswith("Name-") | x.startswith("Spdx-"), F.substring(x, 6, 100)).otherwise(F.element_at(_map(SINGLE), x))

    def out(a: Column) -> Column:
        rest = F.filter(F.split(F.translate(a["left"], "<", ""), "[|>]+", -1), lambda x: x != "")
        return F.struct(
            F.array_join(F.array_union(a["names"], F.filter(F.transform(rest, single), lambda x: x.isNotNull())), ",").alias("licences"),
            F.array_join(ids, ",").alias("sentences"),
            F.array_join(F.filter(rest, lambda x: single(x).isNull()), ",").alias("unmatched"),
        )

    return F.get(F.transform(F.array(state), out), F.lit(0))


def op5_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", recognise(F.col("text")).alias("r")).select("doc_id", "r.*")


QUERIES = {"op5_licence_rules": op5_licence_rules}

#: Shown where a text has no known sentence.
_NONE = "CAST([] AS VARCHAR[])"


def _sql() -> str:
    """The same over rows instead of within them: sentences, lines and SPDX words are rows, and the tables are joined."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    values = lambda table: "(VALUES " + ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in table.items()) + ")"
    plain = lambda x: f"trim(regexp_replace(translate({x}, '{_UPPER}', '{_LOWER}'), '{_NOISE}', ' ', 'g'), ' ')"
    look = lambda rows: f"""SELECT r.*, coalesce(k.id, m.id, i.id) AS id FROM {rows} r LEFT JOIN known k ON k.s = r.n
        LEFT JOIN names m ON m.s = regexp_extract(r.n, '{_UNDER}', 1) LEFT JOIN known i ON i.s = regexp_replace(r.n, '{_ITEM}', '')"""  # noqa: E731
    query = f"SELECT row, doc_id, ids, array_to_string(list_transform(ids, lambda x: '<' || x || '>'), '') AS l0, {_NONE} AS n0 FROM texts_ids"
    for k, (name, rule) in enumerate(RULES, 1):
        marks = quoted("".join(f"<{i}>" for i in rule))
        query = f"SELECT row, doc_id, ids, replace(l{k - 1}, {marks}, '{_TAKEN}') AS l{k}, CASE WHEN contains(l{k - 1}, {marks}) AND NOT list_contains(n{k - 1}, {quoted(name)}) THEN list_append(n{k - 1}, {quoted(name)}) ELSE n{k - 1} END AS n{k} FROM ({query})"
    k = len(RULES)
    return f"""
        WITH known(s, id) AS {values(known())}, names(s, id) AS {values(names())}, spdx(s, id) AS {values(identifiers())}, single(s, id) AS {values(SINGLE)},
        docs AS (SELECT row_number() OVER () AS row, doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '{_MARKS}', '', 'g'), '{_ENDS}') AS parts FROM documents),
        sentences AS (SELECT row, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM docs),
        looked AS ({look(f"(SELECT *, {plain('s')} AS n FROM sentences)")}),
        lines AS (SELECT row, i, unnest(string_split(s, chr(10))) AS line, generate_subscripts(string_split(s, chr(10)), 1) AS j FROM looked WHERE id IS NULL),
        words AS (SELECT row, i, j, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM (SELECT *, regexp_extract_all(regexp_extract(line, '{_LINE}', 1), '{_WORD}') AS w FROM lines WHERE contains(lower(line), 'spdx-license-identifier:'))),
        others AS ({look(f"(SELECT *, {plain('line')} AS n FROM lines WHERE NOT contains(lower(line), 'spdx-license-identifier:'))")}),
        found AS (SELECT row, i, 0 AS j, 0 AS p, id FROM looked WHERE id IS NOT NULL UNION ALL SELECT row, i, j, 0, id FROM others WHERE id IS NOT NULL
            UNION ALL SELECT row, i, j, p, id FROM words JOIN spdx ON s = lower(word)),
        texts_ids AS (SELECT d.row, doc_id, coalesce(ids, {_NONE}) AS ids FROM docs d LEFT JOIN (SELECT row, list(id ORDER BY i, j, p) AS ids FROM found GROUP BY row) f ON f.row = d.row),
        ruled AS ({query}),
        rest AS (SELECT row, unnest(x) AS id, generate_subscripts(x, 1) AS p FROM (SELECT row, list_filter(string_split_regex(replace(l{k}, '<', ''), '[|>]+'), lambda y: y <> '') AS x FROM ruled)),
        judged AS (SELECT r.row, r.p, r.id, CASE WHEN r.id LIKE 'Name-%' OR r.id LIKE 'Spdx-%' THEN substr(r.id, 6) ELSE s.id END AS name FROM rest r LEFT JOIN single s ON s.s = r.id),
        firsts AS (SELECT row, list(name ORDER BY p) AS names FROM (SELECT row, name, min(p) AS p FROM judged WHERE name IS NOT NULL GROUP BY row, name) GROUP BY row),
        lefts AS (SELECT row, list(id ORDER BY p) AS ids FROM judged WHERE name IS NULL GROUP BY row)
        SELECT doc_id, array_to_string(list_concat(n{k}, list_filter(coalesce(f.names, {_NONE}), lambda x: NOT list_contains(n{k}, x))), ',') AS licences, array_to_string(r.ids, ',') AS sentences, array_to_string(coalesce(u.ids, {_NONE}), ',') AS unmatched
        FROM ruled r LEFT JOIN firsts f ON f.row = r.row LEFT JOIN lefts u ON u.row = r.row
    """


ORACLE_SQL = {"op5_licence_rules": _sql()}
