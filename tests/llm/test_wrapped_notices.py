import pytest

from opportunity.llm.license_rules import detections


@pytest.mark.parametrize(
    "notice,label",
    [("GNU Lesser General\n * Public License", "lgpl"), ("Mozilla\r\n   Public License", "mpl"), ("Eclipse\n# Public  License", "epl"), ("BSD\n// License", "bsd")],
)
def test_wrapped_notices(notice, label):
    text = f"/*\r\n * Some  words\n * {notice}, and more"
    spans = [(text[a:b], rule.label) for a, b, rule in detections(text)]
    assert spans == [(notice, label)]
