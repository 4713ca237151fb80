"""tessera: a composable, typed query and data-mapping layer for Spark DataFrames."""

from tessera.operators.changeset import Changeset
from tessera.operators.multi import Multi
from tessera.operators.record import RecordChange, change
from tessera.operators.repo import Engine
from tessera.plans.query import assoc, dynamic, from_, subquery, values
from tessera.plans.schema import Embed, Field, Schema, belongs_to, check, foreign_key, has_many, has_one, many_to_many, through, unique

__all__ = [
    "Changeset", "Embed", "Engine", "Field", "Multi", "RecordChange", "Schema", "assoc", "belongs_to", "change", "check", "dynamic", "foreign_key",
    "from_", "has_many", "has_one", "many_to_many", "subquery", "through", "unique", "values",
]
