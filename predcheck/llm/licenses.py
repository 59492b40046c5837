"""License scans: ordered signature rules behind a keyword prefilter.

A text becomes its words (ASCII letters, digits and everything beyond ASCII, A-Z lower-cased) with one space between
them. One pass of an Aho-Corasick automaton finds the rules' keywords; only rules whose keyword occurs run their
regular expression. Rules are ordered: a rule's priority is its kind's, then its place. Overlapping detections are
resolved by interval containment: a detection inside another of at least its priority, or inside a longer one of the
same label, is suppressed. Base phrases are always reported.

Defined cases: a null text is empty; a text without words has no label and score 0; a null doc_id stays null; equal
rows are scanned alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import batch, text_of
from .text import ALNUM, LOWER, chunks, word_spans

#: The base phrases and their labels (fixed values of the result's definition).
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Kinds of rules from strongest to weakest, with the score of a detection.
KINDS = {"tag": 1.0, "url": 0.95, "text": 0.9, "grant": 0.85, "name": 0.7, "short": 0.5, "notice": 0.3}


class Rule(NamedTuple):
    label: str
    kind: str
    keyword: str
    pattern: str


def _rules() -> list[Rule]:
    """All signature rules, strongest kinds first. Patterns are over lower-case words with single spaces."""
    found: list[Rule] = []

    # every match of a pattern contains its keyword
    def add(label: str, kind: str, keyword: str, *patterns: str) -> None:
        found.extend(Rule(label, kind, keyword, p) for p in patterns)

    granted = r"(?:licensed|released|distributed|available|provided|published|shared|covered) (?:to you )?under (?:the )?(?:terms of )?(?:the )?"

    # permissive licenses: grants, titles and sentences of their texts
    add("mit", "grant", "mit", granted + r"mit(?: license| licence)?\b", r"\bmit licensed\b", r"under the mit licen[sc]e\b")
    add("mit", "name", "mit", r"\bthe mit licen[sc]e\b", r"\bmit licen[sc]e(?: mit)?\b", r"\bmit x11 licen[sc]e\b")
    add("mit", "name", "expat", r"\bexpat licen[sc]e\b")
    add("mit", "text", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files")
    add("mit", "text", "substantial portions", r"shall be included in all copies or substantial portions of the software")
    add("mit-0", "name", "mit no attribution", r"\bmit no attribution(?: licen[sc]e)?\b")
    add("x11", "name", "x11", r"\bx11 licen[sc]e\b")
    add("x11", "name", "x consortium", r"\bx consortium licen[sc]e\b")
    add("apache-2", "grant", "apache", granted + r"apache(?: software)? licen[sc]e(?: version)? 2(?: 0)?\b", granted + r"apache 2(?: 0)?(?: licen[sc]e)?\b")
    add("apache-2", "name", "apache", r"\bapache(?: software)? licen[sc]e(?: version| v)? 2(?: 0)?\b", r"\bapache licen[sc]e v2(?: 0)?\b", r"\bapache 2 0\b")
    add("apache-2", "name", "asl 2 0", r"\basl 2 0\b")
    add("apache-2", "text", "apache", r"you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0")
    add("apache-1.1", "name", "apache", r"\bapache(?: software)? licen[sc]e(?: version| v)? 1 1\b")
    add("apache-1.0", "name", "apache", r"\bapache(?: software)? licen[sc]e(?: version| v)? 1 0\b")
    add("apache", "short", "apache", r"\bapache licen[sc]e\b", r"\bapache licensed\b")
    for words, n in ((r"(?:zero|0)", 0), (r"(?:one|1)", 1), (r"(?:two|2)", 2), (r"(?:three|3)", 3), (r"(?:four|4)", 4)):
        add(f"bsd-{n}-clause", "name", "bsd", rf"\bbsd {words} clause(?: licen[sc]e)?\b", rf"\b{words} clause bsd(?: licen[sc]e)?\b")
    add("bsd-2-clause", "name", "bsd", r"\bsimplified bsd(?: licen[sc]e)?\b", r"\bfreebsd licen[sc]e\b")
    add("bsd-3-clause", "name", "bsd", r"\b(?:new|modified|revised) bsd(?: licen[sc]e)?\b")
    add("bsd-4-clause", "name", "bsd", r"\b(?:original|old) bsd(?: licen[sc]e)?\b")
    add("bsd-3-clause", "text", "endorse or promote", r"neither the names? of .{1,120}? (?:nor the names of its contributors )?may be used to endorse or promote products")
    add("bsd-4-clause", "text", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment")
    add("bsd", "text", "redistribution", r"redistributions? (?:and use )?(?:in|of) source (?:and binary forms|code must retain the above copyright notice)", r"redistributions in binary form must reproduce the above copyright notice")
    add("bsd", "short", "bsd", r"\bbsd(?: style)? licen[sc]ed?\b", granted + r"bsd\b")
    add("isc", "name", "isc", r"\bisc licen[sc]e\b", granted + r"isc\b")
    add("isc", "text", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted")
    add("0bsd", "text", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is")
    add("zlib", "name", "zlib", r"\bzlib(?: libpng)? licen[sc]e\b")
    add("zlib", "text", "misrepresented", r"the origin of this software must not be misrepresented", r"altered source versions must be plainly marked as such and must not be misrepresented")
    add("unlicense", "name", "unlicense", r"\bthe unlicense\b", granted + r"unlicense\b")
    add("unlicense", "text", "unencumbered", r"this is free and unencumbered software released into the public domain")
    add("wtfpl", "name", "what the fuck", r"do what the fuck you want to public licen[sc]e")
    add("wtfpl", "short", "wtfpl", r"\bwtfpl\b")
    add("bsl-1.0", "name", "boost", r"\bboost software licen[sc]e(?: version)?(?: 1 0)?\b")
    add("postgresql", "name", "postgresql", r"\bpostgresql licen[sc]e\b")
    add("ncsa", "name", "ncsa", r"\b(?:university of illinois )?ncsa open source licen[sc]e\b")
    add("psf-2.0", "name", "python", r"\bpython software foundation licen[sc]e(?: version 2)?\b")
    add("psf-2.0", "name", "psf", r"\bpsf licen[sc]e(?: agreement)?\b")
    add("python-2.0", "name", "python", r"\bpython licen[sc]e(?: 2 0)?\b")
    add("ruby", "name", "ruby", r"\bruby licen[sc]e\b")
    add("php-3.01", "name", "php", r"\b(?:the )?php licen[sc]e(?: version)? 3 01\b")
    add("php-3.0", "name", "php", r"\b(?:the )?php licen[sc]e(?: version)? 3 0\b")
    add("openssl", "name", "openssl", r"\bopenssl(?: ssleay)? licen[sc]e\b")
    add("curl", "name", "curl", r"\bcurl licen[sc]e\b")
    add("ijg", "name", "independent jpeg", r"\bindependent jpeg group licen[sc]e\b")
    add("vim", "name", "vim", r"\bvim licen[sc]e\b")
    add("artistic-2.0", "name", "artistic", r"\bartistic licen[sc]e(?: version)? 2(?: 0)?\b")
    add("artistic-1.0", "name", "artistic", r"\bartistic licen[sc]e(?: version)? 1(?: 0)?\b")
    add("artistic", "short", "artistic", r"\bartistic licen[sc]e\b")
    add("afl-3.0", "name", "academic free", r"\bacademic free licen[sc]e(?: version| v)?(?: 3 0)?\b")
    add("ecl-2.0", "name", "educational community", r"\beducational community licen[sc]e(?: version)?(?: 2 0)?\b")
    add("upl-1.0", "name", "universal permissive", r"\buniversal permissive licen[sc]e\b")
    add("mulanpsl-2.0", "name", "mulan", r"\bmulan psl v?2\b", r"\bmulan permissive software licen[sc]e(?: version 2)?\b")
    add("blueoak-1.0.0", "name", "blue oak", r"\bblue oak model licen[sc]e(?: 1 0 0)?\b")

    # copyleft families: name and abbreviation by version, "or later" and "only"
    families = (("gpl", r"gnu (?:general public licen[sc]e|gpl)", ("1", "2", "3")),
                ("lgpl", r"gnu (?:lesser|library) (?:general public licen[sc]e|gpl)", ("2", "2.1", "3")),
                ("agpl", r"gnu affero (?:general public licen[sc]e|gpl)", ("1", "3")),
                ("fdl", r"gnu free documentation licen[sc]e", ("1.1", "1.2", "1.3")))
    for short, full, versions in families:
        for v in versions:
            number = v.replace(".", " ") + r"(?: 0)?" * ("." not in v)
            add(f"{short}-{v}-or-later", "grant", "gnu", rf"\b{full}.{{0,80}}?\b(?:version|v) {number} (?:of the licen[sc]e )?or (?:at your option )?any later version")
            add(f"{short}-{v}-only", "grant", "gnu", rf"\b{full}(?: as published by the free software foundation)? (?:version|v) {number} only\b")
            add(f"{short}-{v}", "name", "gnu", rf"\b{full}(?: {short})?(?: version| v)? {number}\b")
            add(f"{short}-{v}", "name", short, rf"\b{short} ?v?{number}\b", rf"\b{short} version {number}\b")
        add(short, "short", "gnu", rf"\b{full}\b")
        add(short, "short", short, rf"\b(?:gnu )?{short} licen[sc]e[sd]?\b", rf"{granted}{short}\b")
    add("gpl", "text", "any later version", r"either version \d of the license or at your option any later version")
    add("gpl", "text", "gnu", r"you should have received a copy of the gnu general public license")
    add("gpl-with-classpath-exception", "name", "classpath", r"\bclasspath exception\b")
    add("gpl-with-gcc-exception", "name", "gcc runtime", r"\bgcc runtime library exception\b")
    for v in ("1.0", "1.1", "2.0"):
        number = v.replace(".", " ")
        add(f"mpl-{v}", "name", "mozilla", rf"\bmozilla public licen[sc]e(?: version| v)? {number}\b")
        add(f"mpl-{v}", "short", "mpl", rf"\bmpl ?v? ?{number}\b")
    add("mpl-2.0", "text", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0")
    add("mpl", "short", "mozilla", r"\bmozilla public licen[sc]e\b")
    for v in ("1.0", "2.0"):
        number = v.replace(".", " ")
        add(f"epl-{v}", "name", "eclipse", rf"\beclipse public licen[sc]e(?: version| v)? {number}\b")
        add(f"epl-{v}", "short", "epl", rf"\bepl ?v?{number}\b")
        add(f"osl-{v}", "name", "open software", rf"\bopen software licen[sc]e(?: version| v)? {number}\b")
    add("edl-1.0", "name", "eclipse", r"\beclipse distribution licen[sc]e(?: version| v)? 1 0\b")
    add("cddl-1.0", "name", "common development", r"\bcommon development and distribution licen[sc]e(?: version)?(?: 1 0)?\b")
    add("cddl-1.1", "name", "cddl", r"\bcddl(?: version)? 1 1\b")
    add("cpl-1.0", "name", "common public", r"\bcommon public licen[sc]e(?: version)?(?: 1 0)?\b")
    add("ipl-1.0", "name", "ibm public", r"\bibm public licen[sc]e(?: version)?(?: 1 0)?\b")
    add("osl-3.0", "name", "open software", r"\bopen software licen[sc]e(?: version| v)? 3 0\b")
    add("eupl-1.2", "name", "european union public", r"\beuropean union public licen[sc]e(?: version| v)?(?: 1 2)?\b")
    add("eupl-1.2", "name", "eupl", r"\beupl ?v?1 2\b")
    add("cecill-2.1", "name", "cecill", r"\bcecill(?: free software licen[sc]e agreement)?(?: version| v)? ?2 1\b")
    add("qpl-1.0", "name", "q public", r"\bq public licen[sc]e(?: version)?(?: 1 0)?\b")
    add("ms-pl", "name", "microsoft", r"\bmicrosoft public licen[sc]e\b")
    add("ms-rl", "name", "microsoft", r"\bmicrosoft reciprocal licen[sc]e\b")

    # source-available and commercial terms
    add("sspl-1.0", "name", "server side public", r"\bserver side public licen[sc]e(?: version)?(?: 1)?\b")
    add("busl-1.1", "name", "business source", r"\bbusiness source licen[sc]e(?: version)?(?: 1 1)?\b")
    add("elastic-2.0", "name", "elastic", r"\belastic licen[sc]e(?: version)? 2(?: 0)?\b")
    add("polyform-noncommercial", "name", "polyform", r"\bpolyform noncommercial licen[sc]e\b")
    add("commons-clause", "name", "commons clause", r"\bcommons clause licen[sc]e condition\b", r"\bcommons clause\b")
    add("proprietary", "grant", "proprietary", r"\bproprietary and confidential\b", r"\bproprietary licen[sc]e\b")
    add("proprietary", "text", "strictly prohibited", r"unauthori[sz]ed (?:copying|reproduction|use|distribution)(?: \w+){0,8} is strictly prohibited")
    add("evaluation", "grant", "evaluation", r"\bfor evaluation purposes only\b")
    add("non-commercial", "grant", "commercial", r"\bfor non ?commercial (?:use|purposes) only\b", r"\bnot for commercial use\b")
    add("non-commercial", "grant", "personal use only", r"\bpersonal use only\b")
    add("all-rights-reserved", "notice", "all rights reserved", r"\ball rights reserved\b")
    add("copyright", "notice", "copyright", r"\bcopyright (?:c |© )?(?:19|20)\d\d\b")

    # Creative Commons: abbreviation, title and address of each variant and version
    variants = (("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
                ("by-nc", "attribution non ?commercial"), ("by-nc-sa", "attribution non ?commercial share ?alike"),
                ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"))
    for code, title in variants:
        short = code.replace("-", " ")
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            number = v.replace(".", " ")
            add(f"cc-{code}-{v}", "name", f"cc {short}", rf"\bcc {short} {number}\b")
            add(f"cc-{code}-{v}", "name", "creative commons", rf"\bcreative commons {title}(?: (?:international|unported|generic|public licen[sc]e))? {number}\b")
            add(f"cc-{code}-{v}", "url", "creativecommons", rf"\bcreativecommons org licenses {short} {number}\b")
        add(f"cc-{code}", "short", f"cc {short}", rf"\bcc {short}\b")
        add(f"cc-{code}", "short", "creative commons", rf"\bcreative commons {title}(?: licen[sc]e)?\b")
    add("cc0-1.0", "name", "cc0", r"\bcc0(?: 1 0)?(?: universal)?\b")
    add("cc0-1.0", "url", "creativecommons", r"\bcreativecommons org publicdomain zero 1 0\b")
    add("cc-pdm", "url", "creativecommons", r"\bcreativecommons org publicdomain mark 1 0\b")
    add("cc", "short", "creative commons", r"\bcreative commons(?: licen[sc]ed?)?\b")
    add("public-domain", "grant", "public domain", r"\b(?:released|dedicated|placed|put) (?:in|into|to) the public domain\b", r"\bpublic domain dedication\b")
    add("public-domain", "short", "public domain", r"\b(?:in|is) (?:the )?public domain\b")

    # data, content and font licenses
    add("odbl-1.0", "name", "open database", r"\bopen database licen[sc]e(?: odbl)?(?: v?1 0)?\b")
    add("odc-by-1.0", "name", "open data commons", r"\bopen data commons attribution licen[sc]e(?: v?1 0)?\b")
    add("pddl-1.0", "name", "public domain dedication", r"\b(?:open data commons )?public domain dedication and licen[sc]e\b")
    add("cdla-permissive-2.0", "name", "community data", r"\bcommunity data licen[sc]e agreement permissive(?: version)? 2 0\b")
    add("cdla-permissive-1.0", "name", "community data", r"\bcommunity data licen[sc]e agreement permissive(?: version)? 1 0\b")
    add("cdla-sharing-1.0", "name", "community data", r"\bcommunity data licen[sc]e agreement sharing(?: version)? 1 0\b")
    add("ogl-uk-3.0", "name", "open government", r"\bopen government licen[sc]e(?: version| v)? ?3 0\b")
    add("ogl", "short", "open government", r"\bopen government licen[sc]e\b")
    add("ofl-1.1", "name", "open font", r"\b(?:sil )?open font licen[sc]e(?: version)?(?: 1 1)?\b")
    add("ufl-1.0", "name", "ubuntu font", r"\bubuntu font licen[sc]e(?: version)?(?: 1 0)?\b")
    add("cern-ohl", "name", "cern", r"\bcern open hardware licen[sc]e\b")
    add("openrail", "name", "rail", r"\b(?:creativeml )?open ?rail(?: \+?\+? ?m| m)?(?: licen[sc]e)?\b")
    add("openrail", "name", "responsible ai", r"\bresponsible ai licen[sc]e\b")
    add("community-model", "name", "community licen", r"\b\w+ \d community licen[sc]e agreement\b")

    # addresses and machine-readable tags
    for label, words in (("apache-2", "apache org licenses license 2 0"), ("mit", "opensource org licenses mit"),
                         ("bsd-3-clause", "opensource org licenses bsd 3 clause"), ("bsd-2-clause", "opensource org licenses bsd 2 clause"),
                         ("isc", "opensource org licenses isc"), ("gpl-3", "gnu org licenses gpl 3 0"), ("gpl-2", "gnu org licenses gpl 2 0"),
                         ("lgpl-3", "gnu org licenses lgpl 3 0"), ("lgpl-2.1", "gnu org licenses lgpl 2 1"), ("agpl-3", "gnu org licenses agpl 3 0"),
                         ("mpl-2.0", "mozilla org mpl 2 0"), ("epl-2.0", "eclipse org legal epl 2 0"), ("bsl-1.0", "boost org license 1 0"),
                         ("unlicense", "unlicense org"), ("ofl-1.1", "scripts sil org ofl"), ("odbl-1.0", "opendatacommons org licenses odbl")):
        add(label, "url", words.split()[0] if words.split()[0] != "scripts" else "sil org", rf"\b{words}\b")
    tags = {"apache-2": "apache 2 0", "mit": "mit", "bsd-2-clause": "bsd 2 clause", "bsd-3-clause": "bsd 3 clause", "isc": "isc", "zlib": "zlib",
            "gpl-2-only": "gpl 2 0 only", "gpl-2-or-later": "gpl 2 0 or later", "gpl-3-only": "gpl 3 0 only", "gpl-3-or-later": "gpl 3 0 or later",
            "lgpl-2.1-only": "lgpl 2 1 only", "lgpl-2.1-or-later": "lgpl 2 1 or later", "lgpl-3-only": "lgpl 3 0 only", "agpl-3-only": "agpl 3 0 only",
            "agpl-3-or-later": "agpl 3 0 or later", "mpl-2.0": "mpl 2 0", "epl-2.0": "epl 2 0", "cc0-1.0": "cc0 1 0", "unlicense": "unlicense",
            "cc-by-4.0": "cc by 4 0", "cc-by-sa-4.0": "cc by sa 4 0", "cc-by-nc-4.0": "cc by nc 4 0", "bsl-1.0": "bsl 1 0", "0bsd": "0bsd"}
    for label, words in tags.items():
        add(label, "tag", "spdx", rf"\bspdx license identifier {words}\b")

    order = list(KINDS)
    return sorted(found, key=lambda r: order.index(r.kind))


RULES = _rules()


class Detection(NamedTuple):
    """Words first..last (inclusive) of a text, and the rule that found them."""
    first: int
    last: int
    rule: int


class Scanner:
    """The rules with their automaton and compiled patterns, built once per worker."""

    def __init__(self, rules=tuple(RULES)):
        self.rules, self.patterns = rules, [re.compile(r.pattern) for r in rules]
        by_word: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            by_word.setdefault(r.keyword, []).append(i)
        self.keywords = ahocorasick.Automaton()
        for word, which in by_word.items():
            self.keywords.add_word(word, which)
        self.keywords.make_automaton()
        kinds = list(KINDS)
        self.priority = [kinds.index(r.kind) for r in rules]
        self.score = [KINDS[r.kind] for r in rules]

    def candidates(self, text: str) -> list[int]:
        """Rules whose keyword occurs, in order."""
        words: dict[int, list[int]] = {}
        for _, which in self.keywords.iter(text):
            words[id(which)] = which
        return sorted(i for which in words.values() for i in which)

    def detect(self, text: str) -> list[Detection]:
        found = []
        for i in self.candidates(text):
            for m in self.patterns[i].finditer(text):
                found.append((m.start(), m.end(), i))
        if not found:
            return []
        spaces = _spaces(text)
        starts, ends = np.searchsorted(spaces, [f[0] for f in found], side="left"), np.searchsorted(spaces, [f[1] - 1 for f in found], side="left")
        return self.resolve([Detection(int(a), int(b), f[2]) for a, b, f in zip(starts, ends, found)])

    def resolve(self, found: list[Detection]) -> list[Detection]:
        """Drop detections contained in another of at least their priority or, for one label, in a longer one.

        In order of start and descending length, only an earlier one can contain a later one; per priority and per
        label it is enough to keep the farthest end so far."""
        kept, farthest, by_label = [], [-1] * len(KINDS), {}
        for d in sorted(set(found), key=lambda d: (d.first, -d.last, self.priority[d.rule], d.rule)):
            rank, label = self.priority[d.rule], self.rules[d.rule].label
            if max(farthest[:rank + 1]) >= d.last or by_label.get(label, -1) >= d.last:
                continue
            # a stronger one over exactly the same words has come first; a weaker, longer one doesn't suppress
            kept.append(d)
            farthest[rank] = max(farthest[rank], d.last)
            by_label[label] = max(by_label.get(label, -1), d.last)
        return kept


def _spaces(text: str) -> np.ndarray:
    """Places of the spaces, in code points."""
    return np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)


def base_places(text: str) -> list[tuple[int, int]]:
    """(first word, phrase) of every place where a base phrase's words stand, in a text with a space at both ends."""
    found = []
    for i, (phrase, _) in enumerate(BASE):
        at = text.find(f" {phrase} ")
        while at >= 0:
            found.append((text.count(" ", 0, at), i))
            at = text.find(f" {phrase} ", at + 1)
    return found


SEPARATED = bytes(int(LOWER[b]) if ALNUM[b] else 32 for b in range(256))
COLUMNS = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
           "n_detections long")
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64())
_scanner: list[Scanner] = []  # built once by a task


def scan(docs: DataFrame) -> DataFrame:
    """Per document: words, base places, distinct labels of base phrases and of all detections, and the best score."""
    def run(batches):
        if not _scanner:
            _scanner.append(Scanner())
        scanner = _scanner[0]
        for rows in batches:
            for part, data, offsets in chunks(rows):
                n_words = np.diff(word_spans(data, offsets, ALNUM)[2])
                raw, found = data.tobytes().translate(SEPARATED), []
                for doc, n, lo, hi in zip(part.column(0).to_pylist(), n_words.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    text = b" ".join(raw[lo:hi].split()).decode()
                    places, detected = base_places(f" {text} "), scanner.detect(text)
                    base = {BASE[i][1] for _, i in places}
                    labels = base | {scanner.rules[d.rule].label for d in detected}
                    score = max([0.0, *(scanner.score[d.rule] for d in detected), *(0.7 for _ in places[:1])])
                    found.append((doc, n, len(places), min(places)[0] if places else None, max(places)[0] if places else None,
                                  ",".join(sorted(base)), ",".join(sorted(labels)), score, len(detected)))
                if found:
                    yield batch(_NAMES, *(pa.array(c, t) for c, t in zip(zip(*found), _TYPES)))

    return text_of(docs, "doc_id").mapInArrow(run, COLUMNS)


def detections(docs: DataFrame) -> DataFrame:
    """One row per detection that is kept: doc_id, label, kind, first and last word, and the words themselves."""
    def run(batches):
        scanner = Scanner()
        for rows in batches:
            found = []
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                words = (text or "").encode().translate(SEPARATED).split()
                for d in scanner.detect(b" ".join(words).decode()):
                    rule = scanner.rules[d.rule]
                    found.append((doc, rule.label, rule.kind, d.first, d.last, b" ".join(words[d.first:d.last + 1]).decode()))
            if found:
                types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield batch(["doc_id", "label", "kind", "first_word", "last_word", "words"], *(pa.array(c, t) for c, t in zip(zip(*found), types)))

    return text_of(docs, "doc_id").mapInArrow(run, "doc_id long, label string, kind string, first_word long, last_word long, words string")
