"""License scans by ordered signature rules.

A scan has two layers. The base layer finds the places where the words of a phrase stand
consecutively. The rule layer runs regular expressions in the order of their priority, each only
where its keywords occur in the text. Of detections that overlap or lie within one another, the
one with the higher priority stays, then the longer, then the earlier.

Some 190 rules are sentences of licence headers and texts, written one by one
(``license_signatures`` and ``TEXTS``); the others are made from licence names, versions and
identifiers times the forms in which notices are written, see ``default_rules``. They can be
replaced by rules of one's own.

Words are runs of digits, a-z and non-ASCII characters after A-Z are lower-cased. Null and empty
texts have no words. Nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opportunity.llm.common import beside_texts
from opportunity.llm.license_signatures import CLAUSES, HEADERS

#: Phrases of the base layer and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_TO_SPACE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

#: Runs of white space, and the comment marks that open the next line.
_FOLDED = re.compile(r"[ \t\f\v]*+[\r\n][ \t\f\v\r\n]*+(?:(?:[/*#;%!]++|--)[ \t\f\v\r\n]++)*+|[ \t\f\v]{2,}+|[\t\f\v]")

#: Families: label, names as they are written in notices (regular expressions), versions, identifiers.
FAMILIES = (
    ("gpl", r"gnu (?:general public|gpl) licen[cs]e", ("1", "2", "3"), ("gpl-1.0", "gpl-2.0", "gpl-3.0")),
    ("lgpl", r"gnu (?:lesser|library) general public licen[cs]e", ("2", "2.1", "3"), ("lgpl-2.0", "lgpl-2.1", "lgpl-3.0")),
    ("agpl", r"gnu affero general public licen[cs]e", ("3",), ("agpl-1.0", "agpl-3.0")),
    ("gfdl", r"gnu free documentation licen[cs]e", ("1.1", "1.2", "1.3"), ("gfdl-1.1", "gfdl-1.2", "gfdl-1.3")),
    ("apache", r"apache (?:software )?licen[cs]e", ("1.0", "1.1", "2.0"), ("apache-1.0", "apache-1.1", "apache-2.0")),
    ("mit", r"(?:mit|expat|x11) licen[cs]e", (), ("mit", "mit-0", "x11")),
    ("bsd", r"(?:new |revised |simplified |modified )?bsd(?: [234]-clause)? licen[cs]e", (), ("bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "0bsd")),
    ("mpl", r"mozilla public licen[cs]e", ("1.0", "1.1", "2.0"), ("mpl-1.0", "mpl-1.1", "mpl-2.0")),
    ("epl", r"eclipse public licen[cs]e", ("1.0", "2.0"), ("epl-1.0", "epl-2.0")),
    ("cddl", r"common development and distribution licen[cs]e", ("1.0", "1.1"), ("cddl-1.0", "cddl-1.1")),
    ("artistic", r"artistic licen[cs]e", ("1.0", "2.0"), ("artistic-1.0", "artistic-2.0")),
    ("isc", r"isc licen[cs]e", (), ("isc",)),
    ("zlib", r"zlib(?:/libpng)? licen[cs]e", (), ("zlib",)),
    ("boost", r"boost software licen[cs]e", ("1.0",), ("bsl-1.0",)),
    ("unlicense", r"the unlicen[cs]e", (), ("unlicense",)),
    ("wtfpl", r"do what the fuck you want to public licen[cs]e", ("2",), ("wtfpl",)),
    ("eupl", r"european union public licen[cs]e", ("1.1", "1.2"), ("eupl-1.1", "eupl-1.2")),
    ("osl", r"open software licen[cs]e", ("2.1", "3.0"), ("osl-2.1", "osl-3.0")),
    ("ofl", r"(?:sil )?open font licen[cs]e", ("1.0", "1.1"), ("ofl-1.0", "ofl-1.1")),
    ("odbl", r"open database licen[cs]e", ("1.0",), ("odbl-1.0",)),
)

#: Creative Commons parts, as they are written in full, and versions.
CC_PARTS = {"by": "attribution", "nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s"}
CC_KINDS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Sentences that stand for a licence text itself: label, keyword, pattern.
TEXTS = (
    ("mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("isc", "permission to use", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms,? with or without\s+modification"),
    ("bsd", "neither the name", r"neither the name of .{1,80}? nor the names of its contributors"),
    ("zlib", "as-is", r"this software is provided 'as-is', without any express or implied warranty"),
    ("gpl", "free software", r"you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", "no warranty", r"comes with absolutely no warranty"),
    ("apache", "apache.org", r"https?://(?:www\.)?apache\.org/licenses/license-[\d.]+"),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated) (?:in)?to the public domain"),
    ("boost", "boost software", r"distributed under the boost software licen[cs]e"),
    ("cc0", "publicdomain", r"https?://creativecommons\.org/publicdomain/zero/[\d.]+"),
    ("proprietary", "all rights reserved", r"\ball rights reserved\b"),
    ("proprietary", "proprietary", r"\bproprietary and confidential\b"),
    ("proprietary", "may not", r"may not be (?:copied|reproduced|distributed) without (?:the )?(?:prior )?(?:written )?permission"),
)


@dataclass(frozen=True)
class Rule:
    """A pattern for lower-cased text. A text is tried only if it holds all keywords."""

    label: str
    priority: int
    keywords: tuple[str, ...]
    pattern: str
    weight: float
    compiled: re.Pattern = field(init=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "compiled", re.compile(self.pattern))


GRANT = r"\b(?:licen[cs]ed|released|distributed|available|published) under (?:the |an? )?(?:terms of (?:the )?)?"


def default_rules() -> tuple[Rule, ...]:
    """Rules of every family in every form of notice, the most telling first."""
    families = [(label, name, "licen", versions, identifiers) for label, name, versions, identifiers in FAMILIES]
    for kind in CC_KINDS:
        label, full = f"cc-{kind}", "-".join(CC_PARTS[part] for part in kind.split("-"))
        identifiers = tuple(f"{label}-{version}" for version in CC_VERSIONS)
        families.append((label, f"cc[ -]{kind}(?: licen[cs]e)?", "cc", CC_VERSIONS, identifiers))
        families.append((label, f"creative commons {full}(?: licen[cs]e)?", "creative commons", CC_VERSIONS, ()))
    families += [("cc0", "cc0", "cc0", ("1.0",), ("cc0-1.0",)), ("cc0", "creative commons zero", "creative commons", ("1.0",), ())]
    rules = []
    for label, name, keyword, versions, identifiers in families:
        for identifier in identifiers:
            end = r"(?:-only|-or-later|\+)?(?![\w.-])"
            rules.append(Rule(label, 100, ("spdx-license-identifier", identifier), rf"spdx-license-identifier:\s*\(?{re.escape(identifier)}{end}", 1.0))
            rules.append(Rule(label, 60, ("licen", identifier), rf"\blicen[cs]e[d:=\"' ]+(?:under )?(?:the )?[\"']?{re.escape(identifier)}{end}", 0.9))
        for version in versions:
            number = rf"(?:,? (?:version|v\.?) ?| )v?{re.escape(version)}(?:\.0)?(?![\d.]*\d)"
            rules.append(Rule(label, 90, ("under", keyword, version), rf"{GRANT}{name}{number}", 1.0))
            rules.append(Rule(label, 80, (keyword, version), rf"\b{name}{number}", 0.9))
            later = rf"\b{name}.{{0,40}}?{re.escape(version)}.{{0,40}}?or (?:\(at your option\) )?any later version"
            rules.append(Rule(label, 92, ("any later version", keyword, version), later, 1.0))
        rules.append(Rule(label, 70, ("under", keyword), rf"{GRANT}{name}(?![\w-])", 0.8))
        rules.append(Rule(label, 40, (keyword,), rf"\b{name}(?![\w-])", 0.6))
    for kind in CC_KINDS:
        rules.append(Rule(f"cc-{kind}", 95, ("creativecommons.org",), rf"https?://creativecommons\.org/licenses/{kind}/[\d.]+", 1.0))
    for label, keyword, pattern in HEADERS:
        rules.append(Rule(label, 85, (keyword,), pattern, 1.0))
    for label, keyword, pattern in (*TEXTS, *CLAUSES):
        rules.append(Rule(label, 50, (keyword,), pattern, 0.7))
    return tuple(sorted(rules, key=lambda r: (-r.priority, r.label, r.pattern)))


@lru_cache(maxsize=1)
def shared_rules() -> tuple[Rule, ...]:
    return default_rules()


def folded(text: str) -> tuple[str, list[int], list[int]]:
    """``text`` with each run as one space; places from ``starts[k - 1]`` on were ``shifts[k]`` further on."""
    parts, starts, shifts = [], [], [0]
    at, size = 0, 0
    for m in _FOLDED.finditer(text):
        parts += [text[at : m.start()], " "]
        size += m.start() - at + 1
        at = m.end()
        if at - size != shifts[-1]:
            starts.append(size)
            shifts.append(at - size)
    parts.append(text[at:])
    return "".join(parts), starts, shifts


def detections(text: str, rules: tuple[Rule, ...] | None = None) -> list[tuple[int, int, Rule]]:
    """Spans (start, end, rule) that are left after suppression, in order of their start."""
    rules = shared_rules() if rules is None else rules
    lower = text.lower()
    if len(lower) != len(text):  # then places would move
        lower = text.translate(_ASCII_LOWER)
    lower, starts_at, shifts = folded(lower)
    known: dict[str, bool] = {}
    found: list[tuple[int, int, Rule, int]] = []
    for order, rule in enumerate(rules):
        for keyword in rule.keywords:
            if keyword not in known:
                known[keyword] = keyword in lower
            if not known[keyword]:
                break
        else:
            for m in rule.compiled.finditer(lower):
                start, last = (k + shifts[bisect_right(starts_at, k)] for k in (m.start(), m.end() - 1))
                found.append((start, last + 1, rule, order))
    found.sort(key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[3]))
    starts: list[int] = []
    kept: list[tuple[int, int, Rule]] = []
    for start, end, rule, _ in found:  # those kept never overlap, so only the neighbours matter
        at = bisect_left(starts, start)
        if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or kept[at][0] >= end):
            starts.insert(at, start)
            kept.insert(at, (start, end, rule))
    return kept


def base_places(text: str, phrases: dict[str, str] = BASE_PHRASES) -> tuple[int, list[tuple[int, str]]]:
    """Number of words, and (word index, label) of every place of every phrase."""
    raw = text.encode().lower()
    words = raw.translate(_TO_SPACE).split()
    hits = []
    joined = None
    for phrase, label in phrases.items():
        wanted = phrase.encode()
        if not all(part in raw for part in wanted.split()):
            continue
        if joined is None:
            joined = b" " + b" ".join(words) + b" "
        probe = b" " + wanted + b" "
        at = joined.find(probe)
        word, before = 0, 0
        while at >= 0:
            word += joined.count(b" ", before, at)
            before = at
            hits.append((word, label))
            at = joined.find(probe, at + 1)
    return len(words), hits


SCAN_SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, start: int, end: int, weight: double>>"
)


def scan(docs: DataFrame, phrases: dict[str, str] = BASE_PHRASES, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """Base places, labels, score and spans of every row.

    ``spans`` has label, start, end (characters of the text) and weight of each detection that is
    left. ``score`` is 1 - prod(1 - weight) over the spans, with 0.5 for a base place alone.
    """

    def scanned(texts: list[str]) -> dict[str, list]:
        found: dict[str, list] = {name: [] for name in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for text in texts:
            n_words, hits = base_places(text, phrases)
            spans = detections(text, rules)
            base = {label for _, label in hits}
            places = [word for word, _ in hits]
            rest = 0.5 if hits else 1.0
            for _, _, rule in spans:
                rest *= 1 - rule.weight
            row = (
                n_words,
                len(hits),
                min(places, default=None),
                max(places, default=None),
                ",".join(sorted(base)),
                ",".join(sorted(base | {rule.label for _, _, rule in spans})),
                1 - rest,
                [{"label": r.label, "start": a, "end": b, "weight": r.weight} for a, b, r in spans],
            )
            for values, value in zip(found.values(), row):
                values.append(value)
        return found

    return beside_texts(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), lambda: scanned, SCAN_SCHEMA)
