"""Metadata predicates compiled from a dictionary to one column: every key must exist and agree."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = {"eq", "gt", "gte", "lt", "lte"}


def _value(meta: Column, key: str) -> Column:
    """The value under a top-level key as a variant, null if there is none or the text is no JSON object."""
    v = F.try_parse_json(meta)
    if "'" in key and '"' in key:
        return F.try_element_at(v.try_cast("map<string,variant>"), F.lit(key))
    return F.try_variant_get(v, f'$["{key}"]' if "'" in key else f"$['{key}']", "variant")


def _number(meta: Column, key: str) -> Column:
    """The value as a double, null if it isn't a JSON number."""
    v = _value(meta, key)
    numeric = F.schema_of_variant(v).rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL.*|DOUBLE|FLOAT)$")
    return F.when(numeric, F.try_variant_get(v, "$", "double"))


def matches(meta: Column, conditions: dict) -> Column:
    """True where the JSON object ``meta`` meets all conditions.

    A value that is an object with any of eq, gt, gte, lt, lte is a range over numbers: what isn't a number fails, and
    bounds that are no numbers are ignored except under eq.  Any other value must be equal, with its type: 1 is not 1.0
    nor "1".  An object with none of these names is compared as an object.  Null metadata never match a condition.
    """
    out = F.lit(True)
    for key, wanted in conditions.items():
        if isinstance(wanted, dict) and RANGE & wanted.keys():
            x = _number(meta, key)
            ok = x.isNotNull()
            for op, bound in wanted.items():
                if op not in RANGE:
                    continue
                if isinstance(bound, bool) or not isinstance(bound, (int, float)):
                    ok = ok & F.lit(False) if op == "eq" else ok
                    continue
                b = F.lit(float(bound))
                ok = ok & {"eq": x == b, "gt": x > b, "gte": x >= b, "lt": x < b, "lte": x <= b}[op]
        else:
            got = _value(meta, key)
            ref = F.parse_json(F.lit(json.dumps(wanted)))
            whole = r"^(BIGINT|INT|SMALLINT|TINYINT)$"
            same_kind = F.schema_of_variant(got).rlike(whole) == F.schema_of_variant(ref).rlike(whole)
            ok = (F.to_json(got) == F.to_json(ref)) & same_kind
        out = out & F.coalesce(ok, F.lit(False))
    return out & meta.isNotNull() if conditions else out
