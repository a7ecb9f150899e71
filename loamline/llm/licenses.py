"""License scans by ordered signature rules.

Hundreds of regular expressions over a text's words (in lower case, joined by one space) say what marks a license: short
identifiers, references by name, headers, notices, exceptions, denials and sentences of the licenses' own texts. Those of
SENTENCES are written one by one; references are made from a table of licenses and of the ways in which people refer to
one. A rule runs only if what it needs (its license's name or identifier, or a
piece of its sentence) occurs in the words at all; most texts have nothing of it and are left after one pass.

Detections overlap: "apache license version 2.0" also holds "apache license". They are settled in order of the rules'
priority, then of length, then of place: a detection inside of one that is kept is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import pieces, text_of

#: What becomes of each byte: A-Z become lower case, and all of ASCII but letters and digits parts words.
PLAIN = bytes(32 if b < 128 and not chr(b).isalnum() else ord(chr(b).lower()) if b < 128 else b for b in range(256))
#: The base: phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Licenses by label, how their names are written (words in lower case, digits
#: apart as white space and signs part them), and their short identifiers.
LICENSES: list[tuple[str, str, str]] = [
    ("mit", r"mit(?: x11)?|expat", r"mit"),
    ("apache-2", r"apache(?: software)?(?: license)?(?: version)? ?v?2(?: 0)?", r"apache 2 0"),
    ("apache-1.1", r"apache(?: software)?(?: license)?(?: version)? 1 1", r"apache 1 1"),
    ("bsd-2-clause", r"(?:bsd 2(?: clause)?|2 clause bsd|simplified bsd|freebsd)", r"bsd 2 clause"),
    ("bsd-3-clause", r"(?:bsd 3(?: clause)?|3 clause bsd)", r"bsd 3 clause"),
    ("bsd-3-clause", r"(?:new|modified|revised) bsd", r"bsd 3 clause"),
    ("bsd-4-clause", r"(?:bsd 4 clause|4 clause bsd|original bsd)", r"bsd 4 clause"),
    ("0bsd", r"(?:0bsd|zero clause bsd|bsd zero clause)", r"0bsd"),
    ("gpl-1", r"(?:gpl|gnu general public license|gnu gpl)(?: version)? ?v?1(?: 0)?", r"gpl 1 0(?: only| or later)?"),
    ("gpl-2", r"(?:gpl|gnu general public license|gnu gpl)(?: version)? ?v?2(?: 0)?", r"gpl 2 0(?: only| or later)?"),
    ("gpl-3", r"(?:gpl|gnu general public license|gnu gpl)(?: version)? ?v?3(?: 0)?", r"gpl 3 0(?: only| or later)?"),
    ("lgpl-2", r"(?:lgpl|gnu (?:library|lesser) general public license|gnu lgpl|gnu lesser gpl|lesser gpl)(?: version)? ?v?2(?: 0)?", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", r"(?:lgpl|gnu (?:library|lesser) general public license|gnu lgpl|gnu lesser gpl|lesser gpl)(?: version)? ?v?2 1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", r"(?:lgpl|gnu lesser general public license|gnu lgpl|gnu lesser gpl|lesser gpl)(?: version)? ?v?3(?: 0)?", r"lgpl 3 0(?: only| or later)?"),
    ("agpl-3", r"(?:agpl|gnu affero general public license|gnu agpl|gnu affero gpl|affero gpl)(?: version)? ?v?3(?: 0)?", r"agpl 3 0(?: only| or later)?"),
    ("gfdl-1.3", r"gnu free documentation license(?: version)? 1 3", r"gfdl 1 3"),
    ("mpl-1.1", r"(?:mozilla public license|mpl)(?: version)? ?v?1 1", r"mpl 1 1"),
    ("mpl-2", r"(?:mozilla public license|mpl)(?: version)? ?v?2(?: 0)?", r"mpl 2 0"),
    ("epl-1", r"(?:eclipse public license|epl)(?: version)? ?v?1(?: 0)?", r"epl 1 0"),
    ("epl-2", r"(?:eclipse public license|epl)(?: version)? ?v?2(?: 0)?", r"epl 2 0"),
    ("eupl-1.2", r"(?:european union public licen[cs]e|eupl)(?: version)? ?v?1 2", r"eupl 1 2"),
    ("cddl-1", r"common development and distribution license(?: version)?(?: 1 0)?|cddl(?: 1 0)?", r"cddl 1 0"),
    ("cpl-1", r"common public license(?: version)?(?: 1 0)?", r"cpl 1 0"),
    ("artistic-1", r"artistic license(?: version)? 1(?: 0)?", r"artistic 1 0"),
    ("artistic-2", r"artistic license(?: version)? 2(?: 0)?", r"artistic 2 0"),
    ("isc", r"isc", r"isc"),
    ("zlib", r"zlib(?: libpng)?", r"zlib"),
    ("unlicense", r"unlicense", r"unlicense"),
    ("wtfpl", r"wtfpl", r"wtfpl"),
    ("bsl-1", r"boost software license(?: version)?(?: 1 0)?", r"bsl 1 0"),
    ("python-2", r"(?:python software foundation|psf) license(?: version)?(?: 2)?", r"python 2 0"),
    ("php-3", r"php license(?: version)?(?: 3 01?)?", r"php 3 01?"),
    ("openssl", r"openssl(?: toolkit)?", r"openssl"),
    ("ms-pl", r"microsoft public license(?: ms pl)?", r"ms pl"),
    ("ms-rl", r"microsoft reciprocal license(?: ms rl)?", r"ms rl"),
    ("osl-3", r"open software license(?: version)?(?: 3 0)?", r"osl 3 0"),
    ("afl-3", r"academic free license(?: version)?(?: 3 0)?", r"afl 3 0"),
    ("ncsa", r"(?:university of illinois )?ncsa(?: open source)?", r"ncsa"),
    ("postgresql", r"postgresql", r"postgresql"),
    ("ofl-1.1", r"(?:sil )?open font license(?: version)?(?: 1 1)?", r"ofl 1 1"),
    ("odbl-1", r"(?:odc )?open database license(?: odbl)?(?: v?1 0)?", r"odbl 1 0"),
    ("odc-by-1", r"open data commons attribution license", r"odc by 1 0"),
    ("pddl-1", r"public domain dedication and license", r"pddl 1 0"),
    ("cc0-1", r"cc0(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    ("cc-by", r"(?:creative commons attribution|cc by)(?: [1-4] [05])?(?: international| unported)?", r"cc by [1-4] [05]"),
    ("cc-by-sa", r"(?:creative commons attribution share ?alike|cc by sa)(?: [1-4] [05])?(?: international| unported)?", r"cc by sa [1-4] [05]"),
    ("cc-by-nd", r"(?:creative commons attribution no ?deriv\w*|cc by nd)(?: [1-4] [05])?(?: international| unported)?", r"cc by nd [1-4] [05]"),
    ("cc-by-nc", r"(?:creative commons attribution non ?commercial|cc by nc)(?: [1-4] [05])?(?: international| unported)?", r"cc by nc [1-4] [05]"),
    ("cc-by-nc-sa", r"(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: [1-4] [05])?(?: international| unported)?", r"cc by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", r"(?:creative commons attribution non ?commercial no ?deriv\w*|cc by nc nd)(?: [1-4] [05])?(?: international| unported)?", r"cc by nc nd [1-4] [05]"),
    ("gpl", r"(?:gpl|gnu gpl|gnu general public license)", r"gpl"),
    ("lgpl", r"(?:lgpl|gnu lgpl|gnu lesser gpl|lesser gpl|gnu (?:lesser|library) general public license)", r"lgpl"),
    ("agpl", r"(?:agpl|gnu agpl|gnu affero gpl|affero gpl|gnu affero general public license)", r"agpl"),
    ("mpl", r"mozilla public license", r"mpl"),
    ("epl", r"eclipse public license", r"epl"),
    ("bsd", r"bsd", r"bsd"),
    ("apache", r"apache software license|apache license", r"apache"),
]
#: Labels of families whose version isn't told: with a label of a version of the family they go.
FAMILIES = ("gpl", "lgpl", "agpl", "mpl", "epl", "bsd", "apache")
#: Ways to refer to a license: a kind, the pattern with the name (or the identifier) in it, its confidence.
REFERENCES: list[tuple[str, str, float]] = [
    ("tag", r"spdx license identifier {id}", 1.0),
    ("grant", r"(?:is |are |be )?(?:licen[sc]ed|released|distributed|available|published|provided|covered|redistributed|dual licen[sc]ed)(?: to you)? (?:under|by|with)(?: the)?(?: terms of(?: the)?| conditions of(?: the)?)? {name}(?: licen[sc]e)?", 0.95),
    ("terms", r"(?:under|subject to|accordance with)(?: the)? (?:terms|conditions|terms and conditions|provisions) of(?: the)? {name}(?: licen[sc]e)?", 0.9),
    ("field", r"licen[sc]e (?:is |name |id |type )?{name}", 0.8),
    ("see", r"(?:see|read|refer to)(?: the)? {name} licen[sc]e", 0.7),
    ("name", r"(?:the )?{name} licen[sc]e", 0.75),
    ("family", r"licen[sc]e (?:version )?{id}", 0.8),
    ("bare", r"{name}(?= or later| or any later| only|$| )", 0.5),
]
#: Sentences of the licenses' own texts, headers, notices and exceptions, each written for itself. The empty
#: label is for what denies a license: it labels nothing, and what stands inside of it doesn't either.
SENTENCES: list[tuple[str, str]] = [
    ("", r"(?:not|never|no longer) (?:be )?(?:licen[sc]ed|released|distributed|available|published|provided|covered)(?: to you)? (?:under|by|with)(?: \S+){1,8}? licen[sc]es?"),
    ("", r"(?:incompatible|not compatible) with(?: the)?(?: \S+){1,6}? licen[sc]e"),
    ("", r"(?:instead of|rather than|other than)(?: the)?(?: \S+){1,4}? licen[sc]e"),
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", r"use of this source code is governed by an mit style license"),
    ("mit-0", r"mit no attribution(?: license)?"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("apache-2", r"you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2", r"https? www apache org licenses license 2 0(?: txt| html)?"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation"),
    ("bsd-3-clause", r"redistribution and use in source and binary forms with or without modification are permitted(?: \S+){1,120}? neither the name of"),
    ("bsd-3-clause", r"use of this source code is governed by a bsd style license"),
    ("bsd-2-clause", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("gpl-2", r"under the terms of the gnu general public license as published by the free software foundation either version 2"),
    ("gpl-2", r"under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gpl-3", r"under the terms of the gnu general public license as published by the free software foundation either version 3"),
    ("gpl-3", r"gnu general public license version 3 29 june 2007"),
    ("gpl-2", r"gnu general public license version 2 june 1991"),
    ("lgpl-2.1", r"gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-2", r"under the terms of the gnu (?:library|lesser) general public license as published by the free software foundation either version 2(?! 1)"),
    ("lgpl-2.1", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1"),
    ("lgpl-3", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 3"),
    ("agpl-3", r"under the terms of the gnu affero general public license as published by the free software foundation either version 3"),
    ("gfdl-1.3", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gpl-classpath-exception", r"linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gpl-classpath-exception", r"gpl(?: v?2(?: 0)?)? with(?: the)? classpath exception"),
    ("gpl-gcc-exception", r"gcc runtime library exception"),
    ("gpl-bison-exception", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("apache-llvm-exception", r"apache(?: license)?(?: version)? v?2(?: 0)? with llvm exceptions?"),
    ("gpl-font-exception", r"if you create a document which uses this font and embed this font"),
    ("mpl-2", r"subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2", r"made available under the terms of the eclipse public license 2 0"),
    ("epl-1", r"made available under the terms of the eclipse public license v1 0"),
    ("cddl-1", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("artistic-2", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed the artistic license 2 0"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", r"https? unlicense org"),
    ("wtfpl", r"do what the f\w+ you want to public license"),
    ("wtfpl", r"you just do what the f\w+ you want to"),
    ("zlib", r"the origin of this software must not be misrepresented"),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("bsl-1", r"boost software license version 1 0"),
    ("bsl-1", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("ncsa", r"redistributions of source code must retain the above copyright notice(?: \S+){1,60}? university of illinois"),
    ("python-2", r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ofl-1.1", r"this font software is licensed under the sil open font license"),
    ("ms-pl", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("cc0-1", r"to the extent possible under law(?: \S+){1,16}? waived all copyright and related or neighboring rights"),
    ("cc-by", r"https? creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", r"https? creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nd", r"https? creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc", r"https? creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nc-sa", r"https? creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", r"https? creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc0-1", r"https? creativecommons org publicdomain zero 1 0"),
    ("public-domain", r"(?:placed|released|dedicated)(?: \w+)? (?:in|into|to) the public domain"),
    ("public-domain", r"this work is in the public domain"),
    ("commons-clause", r"commons clause license condition"),
    ("sspl-1", r"server side public license(?: version)?(?: v?1)?"),
    ("busl-1.1", r"business source license(?: version)?(?: 1 1)?"),
    ("elastic-2", r"elastic license(?: version)? (?:v?2)(?: 0)?"),
    ("proprietary", r"copyright(?: \S+){1,12}? all rights reserved"),
    ("proprietary", r"(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", r"unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: \S+){1,12}? (?:is )?strictly prohibited"),
    ("proprietary", r"(?:may not|not to) be (?:reproduced|copied|redistributed)(?: \S+){1,12}? without(?: the)?(?: express| prior)* written (?:permission|consent)"),
]
#: Names that are words of their own: they tell a license only in company.
WEAK = frozenset((r"mit(?: x11)?|expat", r"isc", r"zlib(?: libpng)?", r"openssl(?: toolkit)?", r"postgresql", r"(?:university of illinois )?ncsa(?: open source)?", r"unlicense", r"(?:new|modified|revised) bsd", r"bsd"))


@dataclass(frozen=True)
class Need:
    """What a rule can't do without: a piece of text, or a pattern and the words one of which each of its matches begins with."""

    piece: str
    pattern: re.Pattern[str]
    words: frozenset[str]

    def met(self, joined: str, words: set[str]) -> bool:
        if self.piece:
            return self.piece in joined
        return (not self.words or not self.words.isdisjoint(words)) and self.pattern.search(joined) is not None


@dataclass(frozen=True)
class Rule:
    label: str
    needs: Need
    pattern: re.Pattern[str]
    priority: int
    score: float


#: A word with a version right behind it, as in "gplv2"; words as they stand in a text, and what ends a clause between two.
GLUED = re.compile(r"([a-z]+?)v?[0-9]")
AS_WRITTEN = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
CLAUSE_END = re.compile(r"[,;:!?]|\.(?:\s|$)|\n\s*\n")
#: What isn't a literal in a sentence: groups, classes and escapes with what repeats them, and single letters that may miss.
LOOSE = re.compile(r"(?:\(\?[:!=][^()]*\)|\[[^\]]*\]|\\\w)(?:\{[\d,]+\}|[?*+])?\??|.[?*]")


def needed(sentence: str) -> Need:
    """A sentence's longest literal piece; the sentence itself if there is no long one."""
    piece = max(LOOSE.sub("\0", sentence).split("\0"), key=len)
    return Need(piece if len(piece) > 8 else "", re.compile(sentence), frozenset())


def alternatives(pattern: str) -> list[str]:
    out, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def first_words(pattern: str) -> set[str]:
    """The words with which the matches of a name may begin: names are words and groups of them, and begin with either."""
    out = set()
    for own in alternatives(pattern):
        if own.startswith("(?:"):
            depth = end = 0
            for end, c in enumerate(own):
                depth += (c == "(") - (c == ")")
                if not depth:
                    break
            out |= first_words(own[3:end])
            if own[end + 1 : end + 2] == "?":
                out |= first_words(own[end + 2 :])
        else:
            out.add(re.split(r"[ (]", own)[0])
    return {w.strip() for w in out}


def rules() -> list[Rule]:
    """All rules in order of priority: sentences first, then references by their kind. A reference holds its license's name
    or identifier, at the start of a word."""
    denied = Need("licen", re.compile("licen"), frozenset())
    out = [Rule(label, needed(pattern) if label else denied, re.compile(rf"(?<!\S){pattern}(?!\S)"), 0, 1.0) for label, pattern in SENTENCES]
    for label, name, short in LICENSES:
        needs = Need("", re.compile(rf"(?<!\S)(?:{name}|{short})"), frozenset(first_words(f"{name}|{short}")))
        for k, (kind, pattern, score) in enumerate(REFERENCES):
            if kind == "bare" and name in WEAK or kind == "family" and short == name:
                continue
            full = pattern.replace("{name}", f"(?:{name})").replace("{id}", f"(?:{short})")
            out.append(Rule(label, needs, re.compile(rf"(?<!\S){full}(?!\S)"), k + 1, score))
    return sorted(out, key=lambda r: r.priority)


RULES = rules()
#: The needs of rules that give a label; a text that meets none has no license.
GATES = tuple({r.needs: None for r in RULES if r.label})


@dataclass
class Detection:
    start: int
    end: int
    label: str
    priority: int
    score: float


def settled(found: list[Detection]) -> list[Detection]:
    """What stays: detections by priority, length and place, without those inside of a kept one.

    Of the kept ones that no other holds, starts and ends both ascend, so the last to start before a detection tells
    whether one holds it."""
    kept: list[Detection] = []
    starts: list[int] = []
    ends: list[int] = []
    for d in sorted(found, key=lambda d: (d.priority, d.start - d.end, d.start, d.label)):
        at = bisect_right(starts, d.start)
        if at and ends[at - 1] >= d.end:
            continue
        kept.append(d)
        first = bisect_left(starts, d.start)
        last = bisect_right(ends, d.end)
        if first < last:  # those inside of it
            del starts[first:last], ends[first:last]
        starts.insert(first, d.start)
        ends.insert(first, d.end)
    return kept


def clause_ends(text: str) -> list[int]:
    """The places, in the words joined by one space, of the spaces where a clause ends in the text."""
    out, at, before = [], 0, 0
    for m in AS_WRITTEN.finditer(text):
        if at and CLAUSE_END.search(text, before, m.start()):
            out.append(at - 1)
        at += m.end() - m.start() + 1
        before = m.end()
    return out


def detections(joined: str, gated: bool = True, text: str | None = None) -> list[Detection]:
    """Kept detections of a license, by places in the words joined by one space. text: that the words are from, so that
    denials end with their clauses."""
    words = set(joined.split(" "))
    # a name is looked for by its first word, which a version may stand right behind
    words |= {m[1] for m in map(GLUED.match, words) if m}
    met = {need for need in GATES if need.met(joined, words)} if gated else set()
    if gated and not met:
        return []
    found, ends = [], None
    for r in RULES:
        if not gated or r.needs in met or not r.label:
            for m in r.pattern.finditer(joined):
                if not r.label and text is not None:
                    ends = clause_ends(text) if ends is None else ends
                    if bisect_left(ends, m.start()) < bisect_left(ends, m.end()):
                        continue
                found.append(Detection(m.start(), m.end(), r.label, r.priority, r.score))
    kept = [d for d in settled(found) if d.label]
    versions = {f for f in FAMILIES if any(d.label.startswith(f"{f}-") for d in kept)}
    return [d for d in kept if d.label not in versions]


def base_places(joined: str) -> list[tuple[int, str]]:
    """The characters at which base phrases start, overlapping ones too, and their labels."""
    out = []
    for phrase, label in BASE:
        if phrase in joined:
            whole = f" {joined} "
            at = whole.find(f" {phrase} ")
            while at >= 0:
                out.append((at, label))
                at = whole.find(f" {phrase} ", at + 1)
    return out


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in pieces(whole, "text"):
            rows: list[tuple] = []
            for text in pc.cast(b["text"], pa.large_binary()).to_pylist():
                words = (text or b"").translate(PLAIN).split(b" ")
                words = [w for w in words if w]
                n, joined = len(words), b" ".join(words).decode()
                base = base_places(joined)
                kept = detections(joined, text=(text or b"").decode())
                spaces = [m.start() for m in re.finditer(" ", joined)] if base or kept else []
                word = lambda at: bisect_left(spaces, at)
                firsts = [word(at) for at, _ in base]
                own = {label for _, label in base}
                spans = [{"label": d.label, "first": word(d.start), "last": word(d.end - 1) if d.end > d.start else word(d.start), "score": d.score} for d in sorted(kept, key=lambda d: (d.start, d.end))]
                score = max([d.score for d in kept] + [1.0] * bool(base), default=0.0)
                rows.append((n, len(base), min(firsts, default=None), max(firsts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {d.label for d in kept})), score, spans))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *columns], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])


def license_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    A-Z become lower case; words are runs of letters, digits and all that is not ASCII. n_base: places where a base
    phrase's words stand in a row; first_word, last_word: the least and the greatest word, from 0, at which one starts,
    null without any. labels: those of the base and of kept detections; score: the greatest confidence, 0 without any,
    1 with a base phrase. detections: label, first and last word, score. Null is an empty text. Texts are scanned whole.
    Repeated rows, null ids and further columns of any name change nothing; an empty table gives an empty result.
    """
    texts = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    return texts.mapInArrow(scanned, f"doc_id {dict(texts.dtypes)['doc_id']}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, detections array<struct<label: string, first: bigint, last: bigint, score: double>>")
