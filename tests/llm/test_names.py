"""Names of the surrogate operator: titles, several words, second mentions, what is no name."""

import pytest

from opportunity.llm import pii_surrogates

TEXTS = {
    1: "Dear Mr Smith",
    2: "Mr Smith and Mr SMITH",
    3: "Mr John Paul Smith",
    4: "Prof Dr Anna Müller",
    5: "Mrs Anne-Marie Smith",
    6: "Mr O'Brien's dog",
    7: "Dear Customer Service, Dear Sir or Madam",
    8: "Contact: Anna Schmidt\nAnna Schmidt was here, then Schmidt left",
    9: "Mr. van Gogh, Dr. J.R.R. Tolkien, signed by Ludwig van Beethoven",
    10: "Frau Anna Schmidt, Anna Schmidt",
    11: "Anna Schmidt without a cue",
    12: "Mr Smith The house",
    13: None,
    14: "",
}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    return {r.doc_id: r for r in pii_surrogates.replaced(docs, "k").collect()}


def test_titles_after_an_introduction(found):
    smith = found[2].text.split(" ")[1]
    assert found[1].text == f"Dear Mr {smith}" and smith != "Smith"
    assert found[2].text == f"Mr {smith} and Mr {smith.upper()}"


def test_no_word_of_a_name_is_left(found):
    smith = found[2].text.split(" ")[1]
    three, four, five, six, nine = (found[k].text for k in (3, 4, 5, 6, 9))
    assert three.endswith(f" {smith}") and len(three.split(" ")) == 4 and not {"John", "Paul"} & set(three.split(" "))
    assert four.startswith("Prof Dr ") and "Anna" not in four and "Müller" not in four
    assert "Anne" not in five and "Marie" not in five and five.split(" ")[1].count("-") == 1 and five.endswith(smith)
    assert six.startswith("Mr O'") and six.endswith("'s dog") and "Brien" not in six
    assert nine.startswith("Mr. van ") and " van " in nine.split("signed by ")[1] and not [w for w in ("Gogh", "J.R.R.", "Tolkien", "Ludwig", "Beethoven") if w in nine]
    assert nine.split("Dr. ")[1][1::2][:3] == "..."


def test_second_mentions_read_alike(found):
    first, second = found[8].text.removeprefix("Contact: ").split("\n")
    assert first != "Anna Schmidt" and second == f"{first} was here, then {first.split(' ')[1]} left" and found[8].n_entities == 3
    titled, plain = found[10].text.split(", ")
    assert titled == f"Frau {plain}" and plain != "Anna Schmidt"


def test_what_is_no_name_stays(found):
    assert all(found[k].text == TEXTS[k] and found[k].n_entities == 0 for k in (7, 11, 13, 14))
    assert found[12].text == f"Mr {found[2].text.split(' ')[1]} The house"


def test_rows_without_id_keep_their_own_exceptions(spark):
    # 60 of 81 addresses, so some are drawn again; all rows share a null id.
    rows = [(None, f"from {1 + i % 9}.{1 + i // 9}.1.1 on") for i in range(60)]
    new = [r.text.split()[1] for r in pii_surrogates.replaced(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()]
    assert len(set(new)) == 60 and not set(new) & {t.split()[1] for _, t in rows}
