"""Properties of the pure functions over generated inputs."""

import json

from hypothesis import given, settings, strategies as st

from mendframe.functions import jsontext as J, patches as P

line = st.text(alphabet="ab {}\"\\=<>-+@ é\t", max_size=8).filter(lambda x: x.rstrip() not in (P.SEARCH, P.DIVIDER, P.REPLACE))
body = st.lists(line, max_size=4).map("\n".join)
block = st.builds(P.Block, st.sampled_from(["a.py", "src/m.rs"]), body, body)
value = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8)


def written(blocks):
    return "\n".join(f"file: {b.file}\n{P.SEARCH}\n{b.search}\n{P.DIVIDER}\n{b.replace}\n{P.REPLACE}" for b in blocks)


@given(st.lists(block, min_size=1, max_size=3))
@settings(max_examples=150, deadline=None)
def test_blocks_come_back_as_they_were_written(blocks):
    got = P.parse_edit_blocks(written(blocks))
    assert got == [P.Block(b.file, b.search, b.replace) for b in blocks]
    assert P.parse_edit_blocks(P.canonical_patch(written(blocks))) == got


@given(st.text(alphabet="ab", max_size=12), st.text(alphabet="ab", max_size=3))
def test_occurrences_overlap(text, part):
    assert P.occurrences(text, part) == [i for i in range(len(text)) if part and text.startswith(part, i)]


@given(st.text(alphabet="ab \n", max_size=20), block)
@settings(max_examples=200, deadline=None)
def test_an_applied_block_changes_one_place_or_raises(text, b):
    try:
        new, loose = P.apply_block(text, b)
    except P.PatchError as e:
        assert e.kind in ("no_op", "ambiguous", "not_found", "too_large")
    else:
        assert loose or new == text.replace(b.search, b.replace, 1) and text.count(b.search) == 1


@given(st.text(alphabet="ab{} \"", max_size=6), value, st.text(alphabet="xy}\" ", max_size=5))
@settings(max_examples=200, deadline=None)
def test_the_first_object_is_found_in_any_prose(before, v, after):
    before = before.replace("{", "").replace('"', "")
    raw = json.dumps({"v": v})
    assert J.first_object(before + raw + after) == raw
    assert J.any_action(before + json.dumps({"action": "patch", "v": v}) + after) == "patch"


@given(value, value)
def test_strict_equality(a, b):
    assert J.strict_equal(a, json.loads(json.dumps(a)))
    assert J.strict_equal(a, b) == (json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)) or a == b == 0
