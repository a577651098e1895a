from itertools import product
from re import _parser

from fixtures import frame

from hushlog.llm.license_rules import FAMILIES, NOTICES
from hushlog.llm.license_scan import GATES, with_licenses


def spelled(parsed):
    """Texts of a pattern: each alternative, and each optional part with and without."""
    parts = []
    for kind, value in parsed:
        match str(kind):
            case "LITERAL":
                parts.append([chr(value)])
            case "BRANCH":
                parts.append([t for branch in value[1] for t in spelled(branch)])
            case "SUBPATTERN":
                parts.append(spelled(value[-1]))
            case "MAX_REPEAT":
                low, _, inner = value
                once = spelled(inner)
                parts.append(once if low else ["", *once])
            case "IN":
                first, at = value[0]
                parts.append(["1" if "CATEGORY" in str(first) else chr(at if isinstance(at, int) else at[0])])
            case _:
                raise ValueError(kind)
    return ["".join(p) for p in product(*parts)]


def test_every_name_holds_its_keyword_and_opens_the_gate():
    rules = [(k, p) for _, k, p in FAMILIES] + [(k, p) for _, _, k, p in NOTICES]
    for keyword, pattern in rules:
        pattern = pattern.replace(r"\S", "u").replace(r"\w", "e")
        for text in spelled(_parser.parse(pattern)):
            assert f" {keyword}" in f" {text} ", (keyword, text)
            assert any(g in text for g in GATES) or "cc by" in text, (keyword, text)


def test_abbreviations_and_identifiers(spark):
    want = {
        "lgpl v2": "lgpl-2.0",
        "LGPL-2.1-or-later": "lgpl-2.1-or-later",
        "LGPL 3 or later": "lgpl-3.0-or-later",
        "GFDL 1.3": "gfdl-1.3",
        "AGPL 3.0 or later": "agpl-3.0-or-later",
        "AGPL v1": "agpl-1.0",
        "CC Attribution 4.0": "cc-by-4.0",
        "Creative Commons BY 4.0": "cc-by-4.0",
        "PSF license": "python-2.0",
        "the FreeBSD license": "bsd-2-clause",
        "it may not be copied in any form without leave": "proprietary",
        "SPDX-License-Identifier: MIT": "mit",
        "SPDX-License-Identifier: ISC": "isc",
        "SPDX-License-Identifier: Zlib": "zlib",
        "SPDX-License-Identifier: EPL-2.0": "epl-2.0",
        "SPDX-License-Identifier: Unlicense": "unlicense",
        "SPDX-License-Identifier: 0BSD": "bsd-0-clause",
    }
    docs = frame(spark, list(enumerate(want)), "doc_id long, text string")
    got = {r.text: {d.label for d in r.licenses} for r in with_licenses(docs).collect()}
    assert got == {text: {label} for text, label in want.items()}
