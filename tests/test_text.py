import re
import sys

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from codeledger.functions import text


def rule(description):
    words = re.sub(r"[^a-z0-9 ]", " ", description.lower().strip()).split()
    return " ".join(sorted(set(words)))


def test_fingerprint_edges(each):
    cases = {
        "": "",
        "!!": "",
        "ÉCOLE": "cole",
        "a\tb  c": "a b c",
        "İstanbul KK ŞAß": "a i kk stanbul",
        "pump, PUMP pump": "pump",
        " ".join(f"w{n:02}" for n in range(40, 0, -1)): " ".join(f"w{n:02}" for n in range(1, 41)),
    }
    assert each(text.fingerprint, list(cases)) == list(cases.values())
    cut = {key: " ".join(value.split()[:30]) for key, value in cases.items()}
    assert each(lambda value: text.fingerprint(value, text.FINGERPRINT_WORDS), list(cut)) == list(cut.values())


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=60), min_size=200, max_size=200))
def test_fingerprint_agrees_with_the_rule(each, texts):
    texts = [item.replace("\0", "") for item in texts]
    assert each(text.fingerprint, texts) == [rule(item) for item in texts]


def test_fingerprint_ignores_order_and_repetition(each):
    one, other, again = each(text.fingerprint, ["steel pump 40 mm", "40 MM pump; pump steel", "40 mm pump steel"])
    assert one == other == again


def test_strip_removes_all_white_space(each):
    blanks = [chr(code) for code in range(sys.maxunicode + 1) if chr(code).isspace()]
    assert set(blanks) == set(text.WHITESPACE)
    assert each(text.strip, [f"{blank}a{blank}b{blank}" for blank in blanks]) == [f"a{blank}b" for blank in blanks]


def test_lines_split_where_text_lines_end(each):
    raw = "a\nb\r\nc\rd\x0be\x0cf\x1cg\x1dh\x1ei\x85j\u2028k\u2029l m"
    [found] = each(text.lines, [raw])
    assert [line for line in found if line] == raw.splitlines()


def test_reasoning_excerpts(each):
    raw = "Step 1\n  Heading 8413 " + "x" * 200 + "\nnothing\n\nGirl\nSTEP 3 a\n" + "section\n" * 30
    [found] = each(text.reasoning_excerpts, [raw])
    assert found == ["Heading 8413 " + "x" * 200, "Girl", "STEP 3 a"] + ["section"] * 30
    [brief] = each(lambda value: text.reasoning_excerpts(value, text.EXCERPT_LINES, text.EXCERPT_WIDTH), [raw])
    assert brief == [line[:120] for line in found[:20]]
