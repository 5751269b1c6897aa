import base64

import pytest
from hypothesis import given
from hypothesis import strategies as st

from vigil.errors import ValueTypeError
from vigil.functions import modifiers as m
from vigil.functions.values import (
    Compare,
    DatePart,
    Exists,
    Expansion,
    FieldRef,
    Flag,
    Network,
    Null,
    Number,
    Operator,
    PartOfTime,
    Placeholder,
    Regex,
    RegexFlag,
    Text,
    Wild,
    from_yaml,
)

P = Text.parse


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("", ()),
        ("a*b?c", ("a", Wild.ANY, "b", Wild.ONE, "c")),
        (r"a\*b\?c\\d", ("a*b?c\\d",)),
        (r"C:\Windows\x", (r"C:\Windows\x",)),
        ("end\\", ("end\\",)),
        (r"\\*", ("\\", Wild.ANY)),
    ],
)
def test_parsing(text, parts):
    assert P(text).parts == parts


@given(st.text(alphabet="ab*?", max_size=12))
def test_plain_parses_back(text):
    assert P(P(text).plain()) == P(text)


def test_algebra():
    t = P("ab*c?")
    assert len(t) == 5 and t[1:4].parts == ("b", Wild.ANY, "c") and t[-1].parts == (Wild.ONE,)
    assert (t + "x" + Wild.ANY).parts == ("ab", Wild.ANY, "c", Wild.ONE, "x", Wild.ANY)
    assert ("y" + t).startswith("yab") and t.endswith(Wild.ONE) and not t.startswith(Wild.ANY)
    assert P("").startswith("") and not P("").endswith("x")
    assert t.upper().parts == ("AB", Wild.ANY, "C", Wild.ONE) and P("HelloWorld-Foo").snake_case().plain() == "hello_world_foo"
    assert t.regex() == "ab.*c." and t.like() == "ab%c_" and Text.raw("50%_~").like() == "50~%~_~~"


def test_placeholders():
    t = P("a%x%b%y%").with_placeholders()
    assert t.placeholders == ("x", "y") and t.has_placeholder(include=["y"]) and not t.has_placeholder(exclude=["x", "y"])
    assert {f.plain() for f in t.fill(lambda p: [p.name + "1", p.name + "2"])} == {"ax1by1", "ax1by2", "ax2by1", "ax2by2"}
    with pytest.raises(ValueTypeError):
        t.like()
    assert P(r"100\%x%").with_placeholders().placeholders == ()


def test_scalars():
    assert from_yaml(True) == Flag(True) and from_yaml(2.0) == Number(2) and from_yaml(None) == Null()
    with pytest.raises(ValueTypeError):
        Number(float("nan"))
    with pytest.raises(ValueTypeError):
        from_yaml(b"x")


@pytest.mark.parametrize(
    ("cidr", "patterns"),
    [
        ("192.168.0.0/16", ["192.168.*"]),
        ("10.0.0.0/7", ["10.*", "11.*"]),
        ("10.1.2.0/23", ["10.1.2.*", "10.1.3.*"]),
        ("1.2.3.4/32", ["1.2.3.4"]),
        ("1.2.3.4/31", ["1.2.3.4", "1.2.3.5"]),
        ("0.0.0.0/0", ["*"]),
        ("2001:db8::/32", ["2001:0db8:*"]),
        ("2001:db8::/30", ["2001:0db8:*", "2001:0db9:*", "2001:0dba:*", "2001:0dbb:*"]),
        ("2001:d00::/24", ["2001:0d*"]),
    ],
)
def test_network_wildcards(cidr, patterns):
    assert Network(cidr).wildcards() == patterns


def test_bad_network():
    with pytest.raises(ValueTypeError):
        Network("10.0.0.1/8")


def apply(value, *names, field="f"):
    values, every, negated = m.apply_all(list(names), [from_yaml(value)], field)
    return values[0]


def test_text_modifiers():
    assert apply("x", "contains") == P("*x*") and apply("*x", "contains") == P("*x*")
    assert apply("x", "startswith") == P("x*") and apply("x", "endswith") == P("*x")
    assert apply("x", "cased").cased
    assert apply("foo", "base64") == P("Zm9v") and apply(r"a\*", "base64") == Text.raw(base64.b64encode(b"a*").decode())
    assert apply("ab", "wide").literal() == "a\0b\0" and apply("ab", "utf16be").literal() == "\0a\0b" and apply("a", "utf16").literal() == "\xff\xfea\0"


@given(st.binary(min_size=4, max_size=40), st.binary(max_size=5), st.binary(max_size=5))
def test_base64offset_is_found_in_any_alignment(data, before, after):
    text = data.decode("latin-1")
    values = m.apply("base64offset", Text.raw(text), m.Context("f", ())).values
    assert len(values) == 3
    encoded = base64.b64encode(before + text.encode() + after).decode()
    assert any(v.literal() in encoded for v in values)


def test_windash():
    found = apply("cmd -x /y a-b", "windash")
    assert isinstance(found, Expansion) and len(found.values) == 25
    assert P("cmd —x -y a-b") in found.values
    assert len(apply("-x", "windash", "contains").values) == 5 and apply("-x", "windash", "contains").values[0] == P("*-x*")


def test_other_modifiers():
    assert str(apply("a.*b", "re")) == "a.*b"
    assert apply("a", "re", "i", "m", "s").flags == frozenset(RegexFlag)
    assert str(m.apply("contains", Regex.of("ab"), m.Context("f", ("re",)))) == ".*ab.*"
    assert str(m.apply("contains", Regex.of("^ab$"), m.Context("f", ("re",)))) == "^ab$"
    assert m.apply("contains", Regex.of(""), m.Context("f", ("re",))) == Regex.of("")
    assert apply(5, "gte") == Compare(Operator.GTE, Number(5))
    assert apply(5, "hour") == PartOfTime(DatePart.HOUR, Number(5)) and apply(5, "week", "lt") == Compare(Operator.LT, PartOfTime(DatePart.WEEK, Number(5)))
    assert apply("other", "fieldref", "startswith") == FieldRef("other", starts=True)
    assert apply("other", "fieldref", "contains") == FieldRef("other", True, True)
    assert apply(True, "exists") == Exists(True)
    assert apply("%a%", "expand").parts == (Placeholder("a"),)
    assert apply("10.0.0.0/8", "cidr") == Network("10.0.0.0/8")
    assert m.apply_all(["contains", "all", "neq"], [P("a")], "f")[1:] == (True, True)


@pytest.mark.parametrize(
    ("value", "names"),
    [("a*", ("base64",)), (1, ("contains",)), ("x", ("gt",)), ("x", ("contains", "re")), ("(", ("re",)), ("é", ("wide",)), ("x", ("cidr",)), (True, ("contains", "exists")), ("x", ("nope",)), ("x", ("i",))],
)
def test_misuse(value, names):
    with pytest.raises(ValueTypeError):
        apply(value, *names)


def test_exists_needs_a_field():
    with pytest.raises(ValueTypeError):
        apply(True, "exists", field=None)
