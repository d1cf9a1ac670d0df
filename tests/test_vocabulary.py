from lanewise.schema import FIELD_TYPES
from lanewise.vocabulary import header_names


def test_every_field_has_names_and_no_name_has_two_fields():
    names = header_names()
    assert set(names) == set(FIELD_TYPES)
    every = [n for known in names.values() for n in known]
    assert len(every) == len(set(every))
    assert all(known for known in names.values())


def test_names_are_in_normalised_form():
    assert all(n.isalnum() and n == n.lower() for known in header_names().values() for n in known)


def test_specific_fields_keep_their_names():
    names = header_names()
    assert "carrier" not in names["vendor"]
    assert not {"sku", "brand", "category"} & set(names["product"])


def test_callers_can_add_names():
    assert "lieferant" in header_names({"vendor": ["lieferant"]})["vendor"]
