"""Stream definitions: a builder, decorators for classes, validation, a registry and its snapshots."""

from __future__ import annotations

import inspect
import warnings
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from tidemark.functions.policies import RestartPolicy, RetryPolicy
from tidemark.functions.scalars import capitalise, decapitalise, kebab_case
from tidemark.operators.images import BEFORE_CHANGE, FULL_DOCUMENT
from tidemark.operators.resume import STRATEGIES
from tidemark.plans.stages import Pipeline, resolve
from tidemark.sources.envelope import DOCUMENT_OPERATIONS

START = ("RESUME", "LATEST")
DEPLOYMENT = ("ALL_INSTANCES", "SINGLE_LEADER")


class DefinitionError(ValueError):
    """A stream definition that can't run."""


class AlreadySetError(RuntimeError):
    """Something that a definition has once is set a second time."""


@dataclass(frozen=True)
class CheckpointPolicy:
    """The processed anchor is written every ``save_every`` settlements or after ``save_seconds``; idle streams are probed."""

    save_every: int = 1
    save_seconds: int = 5
    heartbeat_seconds: int = 300
    stuck_after_probes: int = 3
    start: str = "RESUME"
    on_history_lost: str = "FAIL"

    def validate(self) -> None:
        if self.save_every < 1:
            raise DefinitionError("checkpoint: save_every must be at least 1")
        for name in ("save_seconds", "heartbeat_seconds", "stuck_after_probes"):
            if getattr(self, name) < 0:
                raise DefinitionError(f"checkpoint: {name} must be at least 0")
        if self.start not in START or self.on_history_lost not in STRATEGIES:
            raise DefinitionError("checkpoint: unknown start position or history-lost strategy")
        if self.heartbeat_seconds == 0:
            warnings.warn("without an idle heartbeat a quiet stream's position can fall out of the feed's history", stacklevel=3)


@dataclass(frozen=True)
class DeadLetterPolicy:
    """``retention_days`` 0: letters are kept for ever. ``table`` None: the default table."""

    enabled: bool = True
    retention_days: int = 30
    include_document: bool = True
    include_stack: bool = True
    table: str | None = None

    def validate(self) -> None:
        if self.retention_days < 0:
            raise DefinitionError("dead letters: retention_days must be at least 0")


@dataclass(frozen=True)
class ErrorBinding:
    """Errors a handler takes; none: every error."""

    types: tuple[type[BaseException], ...]
    handler: Callable[..., str | None]

    def distance(self, error: BaseException) -> int | None:
        """Steps from the error's class to the nearest declared type; a catch-all is farthest; None: no match."""
        if not self.types:
            return 2**31 - 1
        order = type(error).__mro__
        steps = [order.index(t) if t in order else 2**31 - 2 for t in self.types if isinstance(error, t)]
        return min(steps, default=None)


def resolve_error(bindings: Iterable[ErrorBinding], error: BaseException, context: Any) -> str:
    """Action of the most specific binding, the first among equals. A handler that fails or gives nothing means RETHROW."""
    found = [(d, b) for b in bindings if (d := b.distance(error)) is not None]
    if not found:
        return "RETHROW"
    try:
        return min(found, key=lambda f: f[0])[1].handler(error, context) or "RETHROW"
    except Exception:
        return "RETHROW"


def takes(handler: Callable) -> str:
    """How a handler wants an event: "context", "document", or "document, context", by its parameters."""
    names = [p.name for p in inspect.signature(handler).parameters.values() if p.default is p.empty]
    if len(names) == 2:
        return "document, context"
    if len(names) == 1:
        return "context" if names[0] in ("ctx", "context", "event") else "document"
    raise DefinitionError(f"{getattr(handler, '__name__', handler)} must take a document, a context or both")


@dataclass(frozen=True)
class StreamSpec:
    name: str
    collection: str
    handlers: Mapping[str, Callable] = field(default_factory=dict)
    on_change: Callable | None = None
    pipeline: Pipeline | Callable[[], Any] | None = None
    pipeline_supplier: bool = False
    filter: Callable[[Any], bool] | Any = None
    errors: tuple[ErrorBinding, ...] = ()
    reconcile: Callable | None = None
    checkpoint: CheckpointPolicy | None = None
    retry: RetryPolicy | None = None
    restart: RestartPolicy | None = None
    dead_letters: DeadLetterPolicy | None = None
    database: str = ""
    description: str = ""
    zone: str = ""
    document_type: Any = dict
    full_document: str = "DEFAULT"
    before_change: str = "OFF"
    deployment: str = "ALL_INSTANCES"
    enabled: bool = True
    auto_start: bool = True
    source: str = ""

    def handler(self, operation: str) -> Callable | None:
        """The typed handler, else the catch-all."""
        return self.handlers.get(operation, self.on_change)

    def handler_names(self) -> list[str]:
        return sorted(f"on_{op.lower()}" for op in self.handlers) + (["ON_CHANGE"] if self.on_change else [])

    def compiled(self) -> Callable:
        return resolve(self.pipeline, self.pipeline_supplier)

    def validate(self) -> StreamSpec:
        if not self.name.strip():
            raise DefinitionError("a stream needs a name")
        if not self.handlers and self.on_change is None:
            raise DefinitionError(f"{self.name}: at least one handler is needed")
        if unknown := set(self.handlers) - set(DOCUMENT_OPERATIONS):
            raise DefinitionError(f"{self.name}: no typed handlers exist for {sorted(unknown)}")
        for value, known in ((self.full_document, FULL_DOCUMENT), (self.before_change, BEFORE_CHANGE), (self.deployment, DEPLOYMENT)):
            if value not in known:
                raise DefinitionError(f"{self.name}: {value} is none of {', '.join(known)}")
        if self.filter is not None and "DELETE" in self.handlers:
            raise DefinitionError(f"{self.name}: a filter can't be used with a handler for {capitalise('DELETE')}, which has no document")
        for policy in (self.checkpoint, self.retry, self.restart, self.dead_letters):
            if policy is not None:
                policy.validate()
        if self.reconcile is not None:
            if self.checkpoint is None:
                raise DefinitionError(f"{self.name}: reconcile needs a checkpoint")
            if self.checkpoint.on_history_lost == "FAIL":
                raise DefinitionError(f"{self.name}: reconcile never runs with the strategy FAIL")
            if self.checkpoint.start == "LATEST":
                raise DefinitionError(f"{self.name}: reconcile never runs with the start position LATEST")
        seen: set[type] = set()
        for binding in self.errors:
            if twice := seen & set(binding.types):
                raise DefinitionError(f"{self.name}: two error handlers for {', '.join(sorted(t.__name__ for t in twice))}")
            seen |= set(binding.types)
        if sum(not b.types for b in self.errors) > 1:
            raise DefinitionError(f"{self.name}: more than one catch-all error handler")
        for handler in [*self.handlers.values(), *([self.on_change] if self.on_change else [])]:
            takes(handler)
        if self.on_change is not None and takes(self.on_change) != "context":
            raise DefinitionError(f"{self.name}: the catch-all takes a context only")
        update = self.handlers.get("UPDATE")
        if update is not None and self.full_document == "DEFAULT" and "document" in takes(update):
            warnings.warn(f"{self.name}: updates carry no document in mode DEFAULT", stacklevel=2)
        if self.before_change != "OFF" and set(self.handlers) == {"INSERT"} and self.on_change is None:
            warnings.warn(f"{self.name}: inserts have no pre-image", stacklevel=2)
        return self

    def snapshot(self) -> dict[str, Any]:
        """Configuration for reports; ``database`` is only shown, never used to filter."""
        return {
            "name": self.name, "collection": self.collection, "database": self.database, "enabled": self.enabled, "auto_start": self.auto_start, "deployment": self.deployment, "full_document": self.full_document,
            "before_change": self.before_change, "handlers": self.handler_names(), "has_filter": self.filter is not None, "has_pipeline": self.pipeline is not None, "checkpoint": self.checkpoint, "retry": self.retry,
            "restart": self.restart, "dead_letters": self.dead_letters,
        }


class Builder:
    """Builds a StreamSpec; a handler, filter, pipeline or reconcile handler can be set once."""

    def __init__(self, name: str, document_type: Any = dict):
        if not name or not name.strip():
            raise DefinitionError("a stream needs a name")
        self._values: dict[str, Any] = {"name": name, "document_type": document_type}
        self._handlers: dict[str, Callable] = {}
        self._errors: list[ErrorBinding] = []

    def _once(self, key: str, value: Any) -> Builder:
        if key in self._values:
            raise AlreadySetError(f"{key} is already set")
        self._values[key] = value
        return self

    def options(self, **values: Any) -> Builder:
        """Plain settings: collection, database, zone, source, enabled, auto_start, full_document, before_change, deployment, and the policies."""
        known = {"collection", "database", "description", "zone", "source", "enabled", "auto_start", "full_document", "before_change", "deployment", "checkpoint", "retry", "restart", "dead_letters"}
        if unknown := set(values) - known:
            raise DefinitionError(f"unknown settings: {', '.join(sorted(unknown))}")
        self._values |= values
        return self

    def on(self, operation: str, handler: Callable) -> Builder:
        if operation in self._handlers:
            raise AlreadySetError(f"a handler for {operation} is already set")
        self._handlers[operation] = handler
        return self

    def on_insert(self, handler: Callable) -> Builder:
        return self.on("INSERT", handler)

    def on_update(self, handler: Callable) -> Builder:
        return self.on("UPDATE", handler)

    def on_replace(self, handler: Callable) -> Builder:
        return self.on("REPLACE", handler)

    def on_delete(self, handler: Callable) -> Builder:
        return self.on("DELETE", handler)

    def on_change(self, handler: Callable) -> Builder:
        return self._once("on_change", handler)

    def filter(self, predicate: Any) -> Builder:
        return self._once("filter", predicate)

    def pipeline(self, stages: Any, supplier: bool = False) -> Builder:
        self._values["pipeline_supplier"] = supplier
        return self._once("pipeline", stages)

    def reconcile(self, handler: Callable) -> Builder:
        return self._once("reconcile", handler)

    def on_error(self, handler: Callable, *types: type[BaseException]) -> Builder:
        self._errors.append(ErrorBinding(types, handler))
        return self

    def build(self) -> StreamSpec:
        values = dict(self._values)
        kind = values["document_type"]
        values.setdefault("collection", decapitalise(getattr(kind, "__collection__", None) or getattr(kind, "__name__", "document")))
        return StreamSpec(handlers=dict(self._handlers), errors=tuple(self._errors), **values).validate()


def stream(name: str, document_type: Any = dict) -> Builder:
    return Builder(name, document_type)


# Decorators: a class whose methods handle events.

_MARK = "_tidemark"


def _marking(kind: str, **more: Any) -> Callable:
    def mark(method: Callable) -> Callable:
        setattr(method, _MARK, {"kind": kind, **more})
        return method

    return mark


on_insert, on_update, on_replace, on_delete, on_change = (_marking(k) for k in ("INSERT", "UPDATE", "REPLACE", "DELETE", "on_change"))
event_filter, event_pipeline, reconcile = (_marking(k) for k in ("filter", "pipeline", "reconcile"))


def on_error(*types: type[BaseException]) -> Callable:
    return _marking("error", types=types)


def change_stream(value: str = "", *, name: str = "", document_type: Any = dict, **settings: Any) -> Callable[[type], type]:
    """Class decorator. The stream's name is ``name``, ``value`` or the class's in kebab case; ``define`` makes the spec from an instance."""

    def decorate(cls: type) -> type:
        @staticmethod
        def define(instance: Any) -> StreamSpec:
            builder = Builder(name or value or kebab_case(cls.__name__), document_type).options(**settings)
            for attribute, raw in vars(cls).items():
                mark = getattr(raw, _MARK, None)
                if mark is None:
                    continue
                method = getattr(instance, attribute)
                if mark["kind"] == "error":
                    builder.on_error(method, *mark["types"])
                elif mark["kind"] == "pipeline":
                    builder.pipeline(method, supplier=True)
                elif mark["kind"] in DOCUMENT_OPERATIONS:
                    builder.on(mark["kind"], method)
                else:
                    getattr(builder, mark["kind"])(method)
            return builder.build()

        cls.define = define
        return cls

    return decorate


class Registry:
    """Streams by name. ``contribute`` takes functions that add streams; their names must be new."""

    def __init__(self):
        self._streams: dict[str, StreamSpec] = {}

    def add(self, spec: StreamSpec) -> StreamSpec:
        if spec.name in self._streams:
            raise DefinitionError(f"two streams are named {spec.name!r}")
        self._streams[spec.name] = spec
        return spec

    def contribute(self, contributor: Callable[[Registry], None]) -> None:
        contributor(self)

    def find(self, name: str) -> StreamSpec | None:
        return self._streams.get(name)

    def all(self) -> list[StreamSpec]:
        return list(self._streams.values())

    def starting(self) -> list[StreamSpec]:
        """Streams that start with the program."""
        return [s for s in self.all() if s.enabled and s.auto_start]


@dataclass
class Sources:
    """Feeds by name; the empty name is the default one."""

    default: Any
    named: dict[str, Any] = field(default_factory=dict)

    def get(self, name: str = "") -> Any:
        if not name:
            return self.default
        if name not in self.named:
            raise DefinitionError(f"no source named {name!r}; known: {', '.join(sorted(self.named)) or 'none'}")
        return self.named[name]
