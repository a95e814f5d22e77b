"""The rule layer against plain search and plain suppression."""

import random

from opportunity.llm import license_rules
from opportunity.llm.license_rules import Rule, default_rules, detections, folded
from opportunity.llm.license_signatures import CLAUSES, HEADERS


def plain(text, rules):
    """All matches of all rules, without keywords; kept one by one if none that goes before overlaps."""
    lower, starts, shifts = folded(text.lower())
    found = []
    for order, rule in enumerate(rules):
        for m in rule.compiled.finditer(lower):
            at = [k + shifts[sum(s <= k for s in starts)] for k in (m.start(), m.end() - 1)]
            found.append((-rule.priority, -(at[1] + 1 - at[0]), at[0], order, at[1] + 1, rule))
    kept = []
    for _, _, start, _, end, rule in sorted(found, key=lambda x: x[:4]):
        if all(end <= a or start >= b for a, b, _ in kept):
            kept.append((start, end, rule))
    return sorted(kept, key=lambda x: x[0])


PIECES = [
    "Licensed under the Apache License, Version 2.0 (the \"License\")", "GNU General Public License, version 3", "or any later version", "MIT License", "SPDX-License-Identifier: LGPL-2.1-only",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published", "by the Free Software Foundation", "\n * ", "CC BY-NC 4.0", "All rights reserved.", "BSD 3-Clause License",
    "https://creativecommons.org/licenses/by-sa/4.0", "Redistribution and use in source and binary forms, with or without modification", "Redistributions of source code must retain the above copyright notice", "plain words of a text", "\r\n# ", "license",
]


def test_detections_equal_plain_suppression():
    rng, rules = random.Random(8), default_rules()
    for _ in range(120):
        text = " ".join(rng.choices(PIECES, k=rng.randrange(1, 9)))
        assert detections(text, rules) == plain(text, rules)
    few = (Rule("a", 2, ("aa",), "aa+", 1.0), Rule("b", 1, ("a",), "a", 1.0), Rule("c", 2, ("ab",), "ab+", 1.0))
    for _ in range(300):
        text = "".join(rng.choices("abc ", k=rng.randrange(20)))
        assert detections(text, few) == plain(text, few)


def test_signatures_are_found_and_gated():
    assert len(HEADERS) + len(CLAUSES) + len(license_rules.TEXTS) > 170 and len(default_rules()) > 600
    assert len({pattern for _, _, pattern in (*HEADERS, *CLAUSES)}) == len(HEADERS) + len(CLAUSES)
    for text, label in (
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl"), ("Use of this source code is governed by a BSD-style license", "bsd"),
        ("Business Source License 1.1", "busl"), ("The Software shall be used for Good, not Evil.", "json"), ("This software is in the public domain", "public-domain"), ("governed by the CeCILL-B license under French law", "cecill"),
    ):
        assert label in {r.label for _, _, r in detections(text)}, text
