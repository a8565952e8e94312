import json

import pytest

from palimpsest.functions.errors import HistoryError
from palimpsest.functions.jsonexact import ABSENT, decode, diff, encode, parse_pointer, value_at

LEAVES = ["null", "true", '"1"', "1", "2", '"a b"', "[]", "{}", "[1]", '{"k":1}', "-0.5", "31415926535897932384626433"]
# Texts of one number.
SPELLINGS = [["10", "1e1", "10.0", "1E+1", "100e-1"], ["0", "-0", "0.00", "0e9"], ["-0.125", "-125e-3", "-1.25E-1"]]


@pytest.mark.parametrize("old", LEAVES)
def test_a_leaf_against_every_other(old):
    for new in LEAVES:
        got = list(diff(decode(f'{{"q":{{"w":{old}}}}}'), decode(f'{{"w":0,"q":{{"w":{new}}}}}')))
        assert got.pop()[:2] == ("/w", "added")  # the keys of the outer object come in order: /q before /w
        if old == new:
            assert got == []
        elif {old[0], new[0]} == {"{"}:
            assert [x[:2] for x in got] == [("/q/w/k", "added" if old == "{}" else "removed")]
        elif {old[0], new[0]} == {"["}:
            assert [x[:2] for x in got] == [("/q/w/0", "added" if old == "[]" else "removed")]
        else:
            assert [x[:2] for x in got] == [("/q/w", "modified")]  # a change of shape is one change


def test_numbers_are_equal_however_they_are_written():
    for spellings in SPELLINGS:
        for x in spellings:
            for y in spellings:
                assert not list(diff(decode(f'{{"v":[{x}]}}'), decode(f'{{"v":[{y}]}}')))
            (change,) = diff(decode('{"v":7}'), decode(f'{{"v":{x}}}'))
            assert encode(change[3]) == x  # and stay as they were written
    assert list(diff(decode('{"v":123456789012345678901}'), decode('{"v":123456789012345678902}')))


def test_keys_with_marks_of_pointers():
    for key in ("", "/", "~", "~1", "a/b~c", "é"):
        doc = decode(json.dumps({key: 1}))
        ((path, op, *_),) = diff({}, doc)
        assert op == "added" and parse_pointer(path) == [key] and value_at(doc, parse_pointer(path)) == "1"


def test_order_is_by_raw_key_and_position():
    old, new = '{"a":{"x":1},"a!":1,"t":[0,0,0,0,0,0,0,0,0,0,0]}', '{"a":{"x":2},"a!":2,"t":[0,0,1,0,0,0,0,0,0,0,1]}'
    assert [x[0] for x in diff(decode(old), decode(new))] == ["/a/x", "/a!", "/t/2", "/t/10"]


def test_pointers_and_decoding():
    doc = decode('{"a":{"b":[1,null]},"":5}')
    assert value_at(doc, parse_pointer("/a/b/1")) is None and value_at(doc, parse_pointer("/a/b/-")) is ABSENT
    assert value_at(doc, parse_pointer("/")) == "5" and value_at(doc, parse_pointer("/a/b/0/x")) is ABSENT and value_at(doc, []) is doc
    assert decode("null") == {}
    for bad in ("", " ", "[1]", '{"a":1}}', '{"a":NaN}'):
        with pytest.raises(HistoryError, match="codec"):
            decode(bad)
    for bad in ("a", "/~2"):
        with pytest.raises(HistoryError, match="invalid_path"):
            parse_pointer(bad)
