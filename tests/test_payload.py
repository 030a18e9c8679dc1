import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from codeledger import schemas
from codeledger.functions.payload import extract_json, typed, usable_json


def rule(text):
    """From the last opening brace to the end: one JSON value, or nothing."""
    place = text.rfind("{")
    try:
        json.loads(text[place:] if place >= 0 else "")
    except ValueError:
        return None
    return text[place:]


EDGES = {
    '{"a":1} trailing': False,
    '{"a":1}\n```': False,
    '{"a":1} }': False,
    '{"a":{"b":1}}': False,
    "{'a':1}": False,
    '{"a":1': False,
    '{"a":[1,2,]}': False,
    'text {"a":1}': True,
    '{"a":"}"}': True,
    '{"a":1}\n  ': True,
    '{"a":1}{"b":2}': True,
    "no object": False,
    "": False,
    "{}": True,
    '{"a":1,"a":2}': True,
    '{"a":NaN,"b":-Infinity}': True,
    '{"a":INF}': False,
    '{"a":+Infinity}': False,
    '{"a":1e+5}': True,
    '{"a":+5}': False,
    '{"I":"I + NaN"}': True,
    '{"a":"x\ny"}': False,
    '{"a":"\\q"}': False,
    '{"a":"\\"}': False,
    '{"a":"\\\\"}': True,
    '{"a":01}': False,
    '{"a":tru}': False,
    '{a:1}': False,
    '{"a":1}\x0c': False,
    '{"a":1}\u0085': False,
    '{"a":[1,[2,"]"]]}': True,
    '{"a":"\\u00e9é—"}\r\n': True,
}


def test_edges(each):
    texts = list(EDGES)
    assert [rule(text) is not None for text in texts] == list(EDGES.values())
    assert each(extract_json, texts) == [rule(text) for text in texts]


PIECES = st.sampled_from(
    ['{', '}', '"a"', '"b\\"', '"', ':', ',', '[', ']', '1', '-', '+', 'e', '.5', ' ', '\n', 'true', 'null', 'NaN',
     'Infinity', '-Infinity', 'INF', '\\', '\\n', "'", 'x', '{"a":1}', '{"b":["x"]}', '```', '\t', 'é']
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=300, max_size=300))
def test_agrees_with_the_rule(each, texts):
    assert each(extract_json, texts) == [rule(text) for text in texts]


def test_long_text(each):
    long = "x{" * 200_000 + '{"a": "' + "y" * 2_000_000 + '"}'
    [found] = each(extract_json, [long])
    assert found == rule(long)


def test_empty_object_counts_as_absent(each):
    assert each(usable_json, ["{}", "{ \n}", '{"a":1}']) == [None, None, '{"a":1}']


def test_types(each):
    text = '{"cn_code": 84137080, "taric_code": "0413708000", "warnings": "none", "manual_review_recommended": "true"}'
    [step] = each(lambda t: typed(usable_json(t), schemas.STEP2), [text])
    assert step.cn_code == "84137080"
    assert step.taric_code == "0413708000"
    assert step.warnings is None
    assert step.manual_review_recommended is None


def test_last_of_repeated_keys_counts(each):
    [step] = each(lambda t: typed(usable_json(t), schemas.STEP2), ['{"cn_code": "1", "cn_code": "2"}'])
    assert step.cn_code == "2"
