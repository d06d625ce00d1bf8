"""Features defined as expressions over raw columns and other features."""

from __future__ import annotations

import re
import warnings
from itertools import product

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"`([^`]+)`|\b([A-Za-z_]\w*)\b(?!\s*\()")


def references(expression: str, known: set[str]) -> set[str]:
    """Names of known columns or features that an expression reads."""
    plain = re.sub(r"'[^']*'", "", expression)
    return {a or b for a, b in _NAME.findall(plain)} & known


def order_features(features: dict[str, str], columns: list[str]) -> list[list[str]]:
    """Features in levels: a level reads columns and earlier levels alone. Features on a cycle are left out."""
    have, rest, out = set(columns), dict(features), []
    known = have | set(features)
    while level := [n for n, e in rest.items() if references(e, known) - {n} <= have]:
        out.append(level)
        have |= set(level)
        for n in level:
            del rest[n]
    return out


def _typed(name: str, value: Column) -> Column:
    return value.cast("boolean") if name.startswith(("is_", "has_")) else value


_PRIMARY = re.compile(r"\s*[-+]?\s*(?:\d+(?:\.\d*)?(?:[eE][-+]?\d+)?|(?:`[^`]+`|[A-Za-z_]\w*)(?:\.(?:`[^`]+`|\w+))*\s*)?")


def _closing(text: str, at: int) -> int:
    """The place after the bracket that closes the one at `at`; brackets inside strings do not count."""
    depth, quote = 0, ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if not depth:
                return i + 1
    raise ValueError(f"a bracket is not closed: {text}")


def safe_division(expression: str) -> str:
    """expression with each divisor x of / and % as nullif(x, 0), so that a division by zero gives null. A divisor is what binds closest: a number, a name,
    a call or a bracket, with its sign."""
    out, i, quote = "", 0, ""
    while i < len(expression):
        c = expression[i]
        i += 1
        out += c
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "/%":
            end = _PRIMARY.match(expression, i).end()
            while end < len(expression) and expression[end] in "([":
                end = _closing(expression, end)
            out += f" nullif({safe_division(expression[i:end].strip())}, 0)"
            i = end
            if i < len(expression) and not expression[i].isspace():
                out += " "
    return out


def derive(df: DataFrame, features: dict[str, str], keep: list[str] | None = None, only_boolean: bool = False, fail: str = "error") -> DataFrame:
    """df with the features added, one projection for each level; a division by zero gives null. keep: the features to
    return (helpers drop out); only_boolean: those named is_ or has_. fail: what a feature does that Spark cannot resolve: 'error' raises, 'warning'
    warns and leaves it null, 'continue' leaves it out."""
    if fail not in ("error", "warning", "continue"):
        raise ValueError(fail)
    columns = df.columns
    for level in order_features(features, columns):
        made = {}
        for n in level:
            value = _typed(n, F.expr(safe_division(features[n])))
            if fail != "error":
                try:
                    df.select(value)
                except AnalysisException as e:
                    if fail == "continue":
                        continue
                    warnings.warn(f"{n}: {e.getCondition()}", stacklevel=2)
                    value = _typed(n, F.lit(None).cast("double"))
            made[n] = value
        df = df.withColumns(made) if made else df
    names = [n for n in df.columns if n not in columns and (keep is None or n in keep)]
    return df.select(*columns, *(n for n in names if not only_boolean or n.startswith(("is_", "has_"))))


def expand_templates(templates: dict[str, str], values: dict[str, list]) -> dict[str, str]:
    """Features from templates: {name} fields of name and expression take every combination of the values."""
    out = {}
    for name, expression in templates.items():
        fields = [f for f in values if "{" + f + "}" in name]
        for combination in product(*(values[f] for f in fields)):
            bound = dict(zip(fields, combination, strict=True))
            fill = lambda text: re.sub(r"\{(\w+)\}", lambda m: str(bound[m[1]]), text)  # noqa: E731, B023
            out[fill(name)] = fill(expression)
    return out


def override(definitions: dict[str, str | None], fmt: str = "format", groups: dict[str, list[str]] | None = None) -> Column:
    """One feature with a definition for each format, group or 'All': the most specific one counts, None gives null."""
    groups = groups or {}
    out = None
    leaf = [(k, v) for k, v in definitions.items() if k not in groups and k != "All"]
    for k, v in leaf + [(k, v) for k, v in definitions.items() if k in groups]:
        test = F.col(fmt).isin(groups.get(k, [k]))
        value = F.lit(None) if v is None else F.expr(v)
        out = F.when(test, value) if out is None else out.when(test, value)
    rest = definitions.get("All")
    return out.otherwise(F.lit(None) if rest is None else F.expr(rest))
