import pytest

from quillgrid.functions.terms import least_variants, parse, variants


def test_fields_phrases_and_repeats():
    q = parse('title:Auth "Exact Order" the THE a type:md')
    assert q.fields == (("title", "auth"), ("type", "md"))
    assert q.plain == ("exact order", "the")
    assert not q.long and parse("aa bb cc dd ee ff").long


def test_errors():
    with pytest.raises(ValueError):
        parse('""')
    with pytest.raises(ValueError):
        parse("type:doc")


def test_variants():
    assert variants("word7") == ["word7"]
    assert set(variants("req-02")) == {"req-02", "req-0", "req-", "req", "02"}
    assert set(least_variants("req-02")) == {"req", "02"}
    assert set(variants("über")) == {"über", "übe", "üb", "ber"}
    assert variants("two words") == ["two words"]
