"""Token counts of every code point in three surroundings, against the library."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from opportunity.llm import token_transducer
from opportunity.llm.queries import tokenizer_file


@pytest.mark.parametrize("template", ["{}'re", "a{}'ll b", "3{}3 {}"])
def test_every_code_point_counts_as_in_the_library(template):
    path = tokenizer_file("byte_bpe_50k.json")
    library, counter = Tokenizer.from_file(path), token_transducer.TokenCounter(path)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    texts = ["\n".join(template.replace("{}", chr(c)) for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    for start in range(0, len(texts), 100):
        part = texts[start : start + 100]
        want = [len(e.ids) for e in library.encode_batch(part, add_special_tokens=False)]
        assert counter.count(part) == want


def test_classes_are_those_of_the_splitter():
    path = tokenizer_file("byte_bpe_50k.json")
    classes = token_transducer._classes(Tokenizer.from_file(path)) // 16
    letters, numbers, white = (np.isin(classes, kinds) for kinds in ([token_transducer.LETTER, *range(1, 6)], [token_transducer.NUMBER], [token_transducer.SPACE, token_transducer.OTHER_WHITE]))
    for text, flags in (("aZéßøЖ中ª", letters), ("0٣²Ⅷ", numbers), (" \t\n\x85\xa0    　", white)):
        assert flags[[ord(c) for c in text]].all()
    assert not (letters | numbers | white)[[ord(c) for c in "!_'\x1c​﻿€"]].any()
