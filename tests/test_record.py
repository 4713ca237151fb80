"""Changes to one record."""

import pytest

from tessera import Field, Schema
from tessera.errors import InvalidChangesetError, QueryError
from tessera.operators.record import RecordChange

USER = Schema("User", "users", {"id": Field("integer", primary_key=True), "name": "string", "age": "integer"})


def test_changes():
    c = RecordChange(USER, {"id": 1, "name": "ann", "age": 3})
    d = c.cast({"name": "ann", "age": "4", "id": 9}, ["name", "age"])
    assert d.changes == {"age": 4} and d.valid and d.fetch_field("age") == ("changes", 4) and d.fetch_field("name") == ("data", "ann")
    assert d.force_change("name", "ann").changes == {"age": 4, "name": "ann"} and d.put_change("age", 3).changes == {}
    assert d.update_change("age", lambda x: x + 1).get_field("age") == 5 and d.update_change("name", str.upper) is d
    assert d.get_change("name", "none") == "none" and d.apply_changes() == {"id": 1, "name": "ann", "age": 4}
    bad = c.cast({"age": "x"}, ["age"])
    assert bad.errors == (("age", "is invalid"),)
    assert d.merge(bad).changes == {"age": 4}
    with pytest.raises(InvalidChangesetError):
        bad.apply_action()
    with pytest.raises(QueryError):
        c.put_change("nope", 1)
    with pytest.raises(QueryError):
        c.merge(RecordChange(USER, {"id": 2}))
