"""Pipeline stages (documents in a feed's aggregation language) compiled to Columns.

A pipeline is a list of stage documents, a list of Column predicates, or a callable from DataFrame to DataFrame. It is compiled once
and used by scans and probes alike, so Catalyst pushes its filters and column choice into the scan.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Mapping, Sequence
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.envelope import LIFECYCLE

Pipeline = Sequence[Mapping[str, Any] | Column] | Callable[[DataFrame], DataFrame]

# Fixed: the feed's names of envelope fields.
FIELDS = {
    "_id": "resume_token", "_id._data": "resume_token", "operationType": "operation_type", "ns.db": "db", "ns.coll": "coll", "clusterTime": "cluster_time", "wallTime": "wall_time", "documentKey": "document_key",
    "documentKey._id": "document_key", "fullDocument": "full_document", "fullDocumentBeforeChange": "full_document_before_change", "updateDescription": "update_description", "lsid": "lsid", "txnNumber": "txn_number",
}
KEEP = ("seq", "resume_token")


class PipelineError(ValueError):
    """A pipeline that can't be compiled: the stream doesn't start."""


def located(df: DataFrame, path: str) -> tuple[Column, str]:
    """A (dotted) field and its type: an envelope column, a column that the feed has promoted, a variant's part or a struct's."""
    columns = dict(df.dtypes)

    def plain(name: str) -> tuple[Column, str]:
        return F.col(name), columns[name] if name in columns else df.select(F.col(name)).dtypes[0][1]

    if path in FIELDS and FIELDS[path] in columns:
        return plain(FIELDS[path])
    for head, column in (("fullDocument.", "full_document"), ("fullDocumentBeforeChange.", "full_document_before_change"), ("updateDescription.", "update_description")):
        if path.startswith(head):
            rest = path.removeprefix(head)
            if columns.get(column) == "variant":
                return F.try_variant_get(F.col(column), f"$.{rest}", "variant"), "variant"
            if column in columns:
                return plain(f"{column}.{rest}")
            top, _, inner = rest.partition(".")
            if top in columns:
                if not inner:
                    return plain(top)
                return (F.try_variant_get(F.try_parse_json(F.col(top)), f"$.{inner}", "variant"), "variant") if columns[top] == "string" else plain(f"{top}.{inner}")
    if path.split(".")[0] in columns:
        return plain(path)
    raise PipelineError(f"unknown field {path!r}")


def field(df: DataFrame, path: str) -> Column:
    """The field's value; of a variant, as a string."""
    at, kind = located(df, path)
    return F.try_variant_get(at, "$", "string") if kind == "variant" else at


NUMERIC = re.compile(r"tinyint|smallint|int|bigint|float|double|decimal.*")


def family(value: Any) -> str:
    """Values are only compared with values of their family."""
    return "boolean" if isinstance(value, bool) else "number" if isinstance(value, int | float | Decimal) else "string" if isinstance(value, str) else "other"


def compared(df: DataFrame, path: str, sample: Any, test: Callable[[Column], Column]) -> Column:
    """``test`` of the field where it is of the sample's family, whole and fractional numbers alike; not true where it isn't or is missing."""
    (at, kind), wanted = located(df, path), family(sample)
    if kind != "variant":
        found = "number" if NUMERIC.fullmatch(kind) else kind if kind in ("string", "boolean") else "other"  # dates and times take strings too
        return test(at) if found in (wanted, "other") else F.lit(False)
    held = F.schema_of_variant(at)
    if wanted == "number":
        whole = held.isin("BIGINT", "INT", "SMALLINT", "TINYINT")
        out = F.when(whole, test(F.try_variant_get(at, "$", "bigint"))).when(held.rlike("^(DECIMAL|DOUBLE|FLOAT)"), test(F.try_variant_get(at, "$", "double")))
    else:
        out = F.when(held == wanted.upper(), test(F.try_variant_get(at, "$", wanted if wanted != "other" else "string")))
    return F.coalesce(out, F.lit(False))


ORDER: dict[str, Callable[[Column, Column], Column]] = {"$gt": lambda at, to: at > to, "$gte": lambda at, to: at >= to, "$lt": lambda at, to: at < to, "$lte": lambda at, to: at <= to}


def missing(df: DataFrame, path: str) -> Column:
    """The field is absent or null."""
    at, kind = located(df, path)
    return F.coalesce(F.is_variant_null(at), F.lit(False)) | at.isNull() if kind == "variant" else at.isNull()


def is_in(df: DataFrame, path: str, values: Sequence[Any]) -> Column:
    """The field equals one of the values; null stands for a missing one."""
    kinds: dict[str, list[Any]] = {}
    for v in values:
        if v is not None:
            kinds.setdefault(family(v), []).append(v)
    out = missing(df, path) if any(v is None for v in values) else F.lit(False)
    for same in kinds.values():
        whole = all(isinstance(v, int) for v in same)
        fixed = same if whole else [float(v) if isinstance(v, int | Decimal) and not isinstance(v, bool) else v for v in same]
        out |= compared(df, path, same[0], lambda at, fixed=fixed: at.isin(*fixed))
    return out


def condition(df: DataFrame, path: str, test: Any) -> Column:
    """A field's test: a value, or a document of operators."""
    if not (isinstance(test, Mapping) and test and all(k.startswith("$") for k in test)):
        test = {"$eq": test}
    out = F.lit(True)
    for operator, value in test.items():
        if operator == "$exists":
            out &= located(df, path)[0].isNotNull() if value else located(df, path)[0].isNull()
        elif operator in ("$in", "$nin"):
            found = is_in(df, path, value)
            out &= found if operator == "$in" else ~F.coalesce(found, F.lit(False))
        elif operator in ("$eq", "$ne"):
            found = is_in(df, path, [value])
            out &= found if operator == "$eq" else ~F.coalesce(found, F.lit(False))
        elif operator in ORDER:
            out &= compared(df, path, value, lambda at, op=ORDER[operator], to=value: op(at, F.lit(to)))
        elif operator == "$not":
            out &= ~F.coalesce(condition(df, path, value), F.lit(False))
        elif operator == "$regex":
            out &= compared(df, path, "", lambda at, pattern=value: at.rlike(pattern))
        else:
            raise PipelineError(f"unknown operator {operator!r}")
    return out


def match(df: DataFrame, query: Mapping[str, Any]) -> Column:
    """$match as a predicate."""
    out = F.lit(True)
    for key, value in query.items():
        if key in ("$and", "$or", "$nor"):
            parts = [match(df, q) for q in value]
            if not parts:
                raise PipelineError(f"{key} needs at least one query")
            whole = parts[0]
            for p in parts[1:]:
                whole = whole & p if key == "$and" else whole | p
            out &= ~F.coalesce(whole, F.lit(False)) if key == "$nor" else whole
        elif key.startswith("$"):
            raise PipelineError(f"unknown operator {key!r}")
        else:
            out &= condition(df, key, value)
    return out


def project(df: DataFrame, shape: Mapping[str, Any]) -> DataFrame:
    """$project: inclusion of (dotted) fields, or exclusion; the token must stay, as a cursor can't go on without it."""
    if shape.get("_id", 1) in (0, False):
        raise PipelineError("$project must keep _id, the resume token")
    wanted = {k: v for k, v in shape.items() if k != "_id"}
    if all(v in (0, False) for v in wanted.values()):
        return unset(df, list(wanted))
    if any(v in (0, False) for v in wanted.values()):
        raise PipelineError("$project mixes inclusion and exclusion")
    kept = [F.col(c) for c in KEEP if c in df.columns]
    for path, value in wanted.items():
        name = FIELDS.get(path, path.split(".")[-1])
        if name in KEEP:
            continue
        kept.append((field(df, path) if value in (1, True) else expression(df, value)).alias(name))
    return df.select(*kept)


def expression(df: DataFrame, value: Any) -> Column:
    """A "$path", a Column or a literal."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str) and value.startswith("$"):
        return field(df, value[1:])
    if isinstance(value, Mapping):
        if set(value) == {"$literal"}:
            return F.lit(value["$literal"])
        raise PipelineError(f"unknown expression {value!r}")
    return F.lit(value)


def add_fields(df: DataFrame, fields: Mapping[str, Any]) -> DataFrame:
    return df.withColumns({FIELDS.get(p, p.split(".")[-1]): expression(df, v) for p, v in fields.items()})


def unset(df: DataFrame, paths: str | Sequence[str]) -> DataFrame:
    names = [FIELDS.get(p, p.split(".")[-1]) for p in ([paths] if isinstance(paths, str) else paths)]
    if set(names) & set(KEEP):
        raise PipelineError("the resume token can't be removed")
    return df.drop(*names)


def replace_root(df: DataFrame, new_root: Any) -> DataFrame:
    """$replaceRoot: the fields of a struct column become columns; the token stays."""
    if not (isinstance(new_root, str) and new_root.startswith("$")):
        raise PipelineError("$replaceRoot needs a path")
    name = FIELDS.get(new_root[1:], new_root[1:])
    kind = dict(zip(df.columns, (f.dataType for f in df.schema), strict=True)).get(name)
    if not isinstance(kind, T.StructType):
        raise PipelineError(f"{new_root} isn't a document with known fields")
    return df.select(*(c for c in KEEP if c in df.columns), f"{name}.*")


STAGES: dict[str, Callable[[DataFrame, Any], DataFrame]] = {
    "$match": lambda df, q: df.where(match(df, q)),
    "$project": project,
    "$addFields": add_fields,
    "$set": add_fields,
    "$unset": unset,
    "$replaceRoot": lambda df, v: replace_root(df, v.get("newRoot")),
    "$replaceWith": replace_root,
}


def compile_pipeline(pipeline: Pipeline | Callable[[], Pipeline] | None) -> Callable[[DataFrame], DataFrame]:
    """One function that applies the pipeline; resolved once, so that scan and probe agree."""
    if pipeline is None:
        return lambda df: df
    if callable(pipeline):
        return _checked(pipeline)
    stages = list(pipeline)
    for stage in stages:
        if not isinstance(stage, Column) and (not isinstance(stage, Mapping) or len(stage) != 1 or next(iter(stage)) not in STAGES):
            raise PipelineError(f"unsupported stage {stage!r}; known are {', '.join(STAGES)}")
        if isinstance(stage, Mapping) and "$match" in stage:
            warn_lifecycle(stage["$match"])

    def apply(df: DataFrame) -> DataFrame:
        for stage in stages:
            if isinstance(stage, Column):
                df = df.where(stage)
            else:
                (name, value), = stage.items()
                df = STAGES[name](df, value)
        return df

    return apply


def _checked(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    def apply(df: DataFrame) -> DataFrame:
        out = fn(df)
        if out is None:
            raise PipelineError("the pipeline returned nothing")
        if "resume_token" not in out.columns:
            raise PipelineError("the pipeline dropped the resume token")
        return out

    return apply


def resolve(source: Pipeline | Callable[[], Any] | None, supplier: bool = False) -> Callable[[DataFrame], DataFrame]:
    """Compile a pipeline, or the one a supplier gives; a supplier that fails or gives nothing stops the start."""
    if not supplier:
        return compile_pipeline(source)
    try:
        made = source()
    except Exception as error:
        raise PipelineError("the pipeline supplier failed") from error
    if made is None:
        raise PipelineError("the pipeline supplier returned nothing")
    return compile_pipeline(made)


def warn_lifecycle(query: Mapping[str, Any]) -> None:
    """Warn when a top-level test on operationType can't let lifecycle events through."""
    test = query.get("operationType")
    allowed = [test] if isinstance(test, str) else test.get("$in") if isinstance(test, Mapping) else None
    if allowed is not None and not set(LIFECYCLE) & {str(a) for a in allowed}:
        warnings.warn("this $match drops DROP, RENAME and INVALIDATE events, so the stream won't see that its collection went", stacklevel=3)
