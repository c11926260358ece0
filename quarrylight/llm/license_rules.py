"""Signature rules of the license scan, in order.

A rule's pattern stands for whole words of a text whose words are joined by single
spaces, so "Apache License, Version 2.0" reads "apache license version 2 0". Letters match
in either case. A rule is tried only where its keyword stands in the text.
"""

from __future__ import annotations

from dataclasses import dataclass

# Priority classes: identifiers and names with a version, names, passages of license texts, hints.
EXACT, NAME, PASSAGE, HINT = 1, 2, 3, 4
CONFIDENCE = {EXACT: 1.0, NAME: 0.9, PASSAGE: 0.75, HINT: 0.4}

# The phrases whose places are counted, and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


@dataclass(frozen=True)
class Rule:
    number: int
    label: str
    keyword: str
    pattern: str
    grade: int

    @property
    def regex(self) -> str:
        return f"(?i)(?<![^ ])(?:{self.pattern})(?![^ ])"


def _words(version: str) -> str:
    return version.replace(".", " ")


def _creative_commons():
    kinds = {
        "by": "attribution",
        "by-sa": "attribution share ?alike",
        "by-nc": "attribution non ?commercial",
        "by-nd": "attribution no ?deriv(?:ative)?s(?: works)?",
        "by-nc-sa": "attribution non ?commercial share ?alike",
        "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s(?: works)?",
    }
    area = "(?: international| unported| generic)?"
    for kind, name in kinds.items():
        short = kind.replace("-", " ")
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            v = _words(version)
            yield f"cc-{kind}-{version}", "cc", f"cc {short}(?: license)?(?: version)? {v}{area}", EXACT
            yield f"cc-{kind}-{version}", "creative", f"creative commons {name}(?: license)? (?:version )?{v}{area}(?: license)?", EXACT
            yield f"cc-{kind}-{version}", "creativecommons", f"creativecommons org licenses {short} {v}", EXACT
        yield f"cc-{kind}", "cc", f"cc {short}", NAME
        yield f"cc-{kind}", "creative", f"creative commons {name}(?: license)?", NAME
    yield "cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", EXACT
    yield "cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0", EXACT
    yield "cc0-1.0", "creative", "creative commons zero(?: 1 0)?(?: universal)?", NAME
    yield "creative-commons", "creative", "(?:licensed )?under a creative commons licen[sc]e", HINT


def _gnu():
    names = {
        "gpl": ("general public licen[sc]e", ("1.0", "2.0", "3.0")),
        "lgpl": ("(?:lesser|library) general public licen[sc]e", ("2.0", "2.1", "3.0")),
        "agpl": ("affero general public licen[sc]e", ("1.0", "3.0")),
        "gfdl": ("free documentation licen[sc]e", ("1.1", "1.2", "1.3")),
    }
    for short, (name, versions) in names.items():
        for version in versions:
            v = _words(version)
            v = f"{v[0]}(?: 0)?" if version.endswith(".0") else v
            later = "(?: or(?: at your option)? (?:any )?later(?: version)?| plus)"
            yield f"{short}-{version}-or-later", short, f"{short} ?v?(?:ersion )?{v}{later}", EXACT
            yield f"{short}-{version}", short, f"{short} ?v?(?:ersion )?{v}(?: only)?", EXACT
            yield f"{short}-{version}-or-later", "gnu", f"gnu {name} (?:v|version )?{v}(?: of the licen[sc]e)?{later}", EXACT
            yield f"{short}-{version}", "gnu", f"gnu {name} (?:v|version )?{v}(?: only)?", EXACT
        yield short, "gnu", f"(?:the )?gnu {name}", NAME
        yield short, short, short, HINT
    yield "gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", PASSAGE
    yield "lgpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e", PASSAGE


def _permissive():
    for version in ("1.0", "1.1", "2.0"):
        v = _words(version)
        yield f"apache-{version}", "apache", f"apache (?:software )?licen[sc]e (?:v|version )?{v}", EXACT
        yield f"apache-{version}", "apache", f"apache {v}(?: licen[sc]e)?", EXACT
        yield f"apache-{version}", "apache", f"apache org licenses licen[sc]e {v}", EXACT
    yield "apache", "apache", "apache (?:software )?licen[sc]e", NAME
    yield "apache", "compliance", "you may not use this file except in compliance with the licen[sc]e", PASSAGE
    yield "apache", "warranties", "distributed on an as is basis without warranties or conditions of any kind", PASSAGE
    clauses = {"0": "zero", "1": "one", "2": "two", "3": "three", "4": "four"}
    for digit, word in clauses.items():
        yield f"bsd-{digit}-clause", "bsd", f"(?:{digit}|{word}) clause bsd(?: licen[sc]e)?", EXACT
        yield f"bsd-{digit}-clause", "bsd", f"bsd (?:{digit}|{word}) clause(?: licen[sc]e)?", EXACT
    for kind, digit in (("original", 4), ("new", 3), ("modified", 3), ("revised", 3), ("simplified", 2)):
        yield f"bsd-{digit}-clause", "bsd", f"{kind} bsd licen[sc]e", EXACT
    yield "bsd-2-clause", "freebsd", "freebsd licen[sc]e", EXACT
    yield "bsd", "bsd", "bsd(?: style)? licen[sc]e", NAME
    yield "bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", PASSAGE
    yield "bsd", "endorse", "may be used to endorse or promote products derived from this software", PASSAGE
    yield "mit-0", "mit", "mit no attribution(?: licen[sc]e)?", EXACT
    yield "mit", "mit", "(?:the )?mit(?: x11| style| expat)? licen[sc]e", NAME
    yield "mit", "expat", "expat licen[sc]e", NAME
    yield "mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", PASSAGE
    yield "mit", "merchantability", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", PASSAGE
    yield "isc", "isc", "isc licen[sc]e", NAME
    yield "isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", PASSAGE
    yield "zlib", "zlib", "zlib(?: libpng)? licen[sc]e", NAME
    yield "zlib", "misrepresented", "the origin of this software must not be misrepresented", PASSAGE
    yield "bsl-1.0", "boost", "boost software licen[sc]e(?: version)?(?: 1 0)?", EXACT
    yield "unlicense", "unlicense", "(?:the )?unlicense", NAME
    yield "unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", PASSAGE
    yield "wtfpl", "wtfpl", "wtfpl(?: version)?(?: 2)?", NAME
    yield "public-domain", "domain", "(?:dedicated to|released into|in|under) the public domain", NAME


def _named():
    """Names with the versions of each."""
    families = (
        ("mpl", "mozilla", "mozilla public licen[sc]e", ("1.0", "1.1", "2.0")),
        ("epl", "eclipse", "eclipse public licen[sc]e", ("1.0", "2.0")),
        ("edl", "eclipse", "eclipse distribution licen[sc]e", ("1.0",)),
        ("eupl", "european", "european union public licen[sc]e", ("1.0", "1.1", "1.2")),
        ("cddl", "cddl", "cddl", ("1.0", "1.1")),
        ("cddl", "common", "common development and distribution licen[sc]e", ("1.0", "1.1")),
        ("cpl", "common", "common public licen[sc]e", ("1.0",)),
        ("cpal", "common", "common public attribution licen[sc]e", ("1.0",)),
        ("osl", "open", "open software licen[sc]e", ("1.0", "2.0", "2.1", "3.0")),
        ("afl", "academic", "academic free licen[sc]e", ("1.1", "1.2", "2.0", "2.1", "3.0")),
        ("artistic", "artistic", "artistic licen[sc]e", ("1.0", "2.0")),
        ("ofl", "ofl", "(?:sil )?ofl", ("1.0", "1.1")),
        ("ofl", "font", "(?:sil )?open font licen[sc]e", ("1.0", "1.1")),
        ("odbl", "odbl", "odbl", ("1.0",)),
        ("odbl", "database", "open database licen[sc]e", ("1.0",)),
        ("odc-by", "commons", "open data commons attribution licen[sc]e", ("1.0",)),
        ("pddl", "commons", "open data commons public domain dedication and licen[sc]e", ("1.0",)),
        ("cdla-permissive", "community", "community data licen[sc]e agreement permissive", ("1.0", "2.0")),
        ("cdla-sharing", "community", "community data licen[sc]e agreement sharing", ("1.0",)),
        ("cecill", "cecill", "cecill(?: free software licen[sc]e)?", ("1.0", "1.1", "2.0", "2.1")),
        ("zpl", "zope", "zope public licen[sc]e", ("1.1", "2.0", "2.1")),
        ("lppl", "latex", "latex project public licen[sc]e", ("1.0", "1.1", "1.2", "1.3")),
        ("ecl", "educational", "educational community licen[sc]e", ("1.0", "2.0")),
        ("efl", "eiffel", "eiffel forum licen[sc]e", ("1.0", "2.0")),
        ("psf", "python", "python software foundation licen[sc]e", ("2.0",)),
        ("php", "php", "php licen[sc]e", ("3.0", "3.01")),
        ("w3c", "w3c", "w3c software(?: notice and)? licen[sc]e", ("1.0",)),
        ("upl", "universal", "universal permissive licen[sc]e", ("1.0",)),
        ("mulanpsl", "mulan", "mulan permissive software licen[sc]e", ("1.0", "2.0")),
        ("blueoak", "oak", "blue oak model licen[sc]e", ("1.0.0",)),
        ("apsl", "apple", "apple public source licen[sc]e", ("1.0", "1.1", "1.2", "2.0")),
        ("npl", "netscape", "netscape public licen[sc]e", ("1.0", "1.1")),
        ("spl", "sun", "sun public licen[sc]e", ("1.0",)),
        ("ipl", "ibm", "ibm public licen[sc]e", ("1.0",)),
        ("qpl", "q public", "q public licen[sc]e", ("1.0",)),
        ("qpl", "qpl", "qpl", ("1.0",)),
        ("rpl", "reciprocal", "reciprocal public licen[sc]e", ("1.1", "1.5")),
        ("sspl", "server", "server side public licen[sc]e", ("1.0",)),
        ("busl", "business", "business source licen[sc]e", ("1.1",)),
        ("elastic", "elastic", "elastic licen[sc]e", ("1.0", "2.0")),
        ("openrail", "rail", "open rail(?: m)?(?: licen[sc]e)?", ("1.0",)),
        ("etalab", "ouverte", "(?:etalab )?licence ouverte(?: etalab)?", ("1.0", "2.0")),
        ("etalab", "etalab", "etalab", ("1.0", "2.0")),
        ("ogl-uk", "government", "open government licen[sc]e", ("1.0", "2.0", "3.0")),
    )
    for label, keyword, name, versions in families:
        for version in versions:
            v = _words(version)
            yield f"{label}-{version}", keyword, f"(?:{name}) (?:v|version )?{v}", EXACT
        yield label, keyword, name, NAME
    single = (
        ("ms-pl", "microsoft", "microsoft public licen[sc]e"),
        ("ms-rl", "microsoft", "microsoft reciprocal licen[sc]e"),
        ("ncsa", "illinois", "university of illinois(?: ncsa)? open source licen[sc]e"),
        ("postgresql", "postgresql", "postgresql licen[sc]e"),
        ("openssl", "openssl", "openssl licen[sc]e"),
        ("ruby", "ruby", "ruby licen[sc]e"),
        ("vim", "vim", "vim licen[sc]e"),
        ("curl", "curl", "curl licen[sc]e"),
        ("ijg", "jpeg", "independent jpeg group licen[sc]e"),
        ("beerware", "beerware", "beerware(?: licen[sc]e)?"),
        ("unicode", "unicode", "unicode(?: data files and software| inc)? licen[sc]e(?: agreement)?"),
        ("all-rights-reserved", "reserved", "all rights reserved"),
        ("proprietary", "proprietary", "proprietary(?: and confidential)?(?: licen[sc]e)?"),
        ("proprietary", "licensor", "may not be (?:copied|reproduced|distributed) without(?: the)?(?: prior)?(?: written)? (?:consent|permission) of the licensor"),
    )
    for label, keyword, name in single:
        yield label, keyword, name, NAME
    hints = (
        ("unknown-license", "licensed", "(?:is |are )?licensed under(?: the)?(?: terms of)?(?: the)?(?: [^ ]+){1,4} licen[sc]e"),
        ("unknown-license", "terms", "subject to the terms of (?:the|this) licen[sc]e"),
        ("unknown-license", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)?[0-9]{2})?"),
        ("unknown-license", "license", "see (?:the )?(?:file )?license(?: txt| md| file)? for(?: more)? (?:details|information)"),
        ("unknown-license", "licence", "see (?:the )?(?:file )?licence(?: txt| md| file)? for(?: more)? (?:details|information)"),
    )
    for label, keyword, pattern in hints:
        yield label, keyword, pattern, HINT


def _identifiers(labels):
    """A tag line with each label that has a version or is a short name."""
    for label in labels:
        words = label.replace("-", " ").replace(".", " ")
        yield label, "spdx", f"spdx license identifier {words}", EXACT


def rules() -> list[Rule]:
    """All rules in order; where two equal detections have the same class, the earlier rule stays."""
    rows = [*_creative_commons(), *_gnu(), *_permissive(), *_named()]
    labels = dict.fromkeys(label for label, *_ in rows if label != "unknown-license")
    rows = [*_identifiers(labels), *rows]
    return [Rule(n, label, keyword, pattern, grade) for n, (label, keyword, pattern, grade) in enumerate(rows)]
