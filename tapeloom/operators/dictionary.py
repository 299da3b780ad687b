"""Dictionaries: read from XML or the built-in notation, kept in a catalog, and given as small tables to join with.

A dictionary is a few thousand rows at most and is read on the driver; what goes to the cluster is its tables, whose size
is that of the schema and not of the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tapeloom.sources import builtin

HEADER, TRAILER = "Header", "Trailer"
FIELD, COMPONENT, GROUP = "field", "component", "group"


@dataclass(frozen=True)
class Field:
    tag: int
    name: str
    type: str
    enums: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Entry:
    kind: str
    name: str
    required: bool
    entries: tuple[Entry, ...] = ()


@dataclass(frozen=True)
class Message:
    type: str
    name: str
    category: str
    entries: tuple[Entry, ...]


@dataclass
class Dictionary:
    """One version's schema. dict_id tells apart dictionaries that share a key, as a custom one and a built-in one may."""

    key: str
    service_pack: str
    source: str
    fields: dict[int, Field]
    messages: dict[str, Message]
    components: dict[str, tuple[Entry, ...]]
    dict_id: str = ""

    def __post_init__(self):
        self.dict_id = self.dict_id or f"{self.key}@{self.source}"
        self.by_name = {f.name: f for f in self.fields.values()}

    def field_named(self, name: str) -> Field | None:
        return self.by_name.get(name)

    def message(self, name_or_type: str | None) -> Message | None:
        """By MsgType, else by name."""
        return self.messages.get(name_or_type or "") or next((m for m in self.messages.values() if m.name == name_or_type), None)

    def shape(self, message: Message) -> list[tuple[int, int, bool, bool]]:
        """(tag, place, required, may repeat) of header, body and trailer with components and groups laid flat.

        The first place of a tag counts. A tag is required where it and all that it stands in are; it may repeat if it
        stands in a group anywhere. A component within itself is left out.
        """
        places: dict[int, int] = {}
        needed: set[int] = set()
        repeats: set[int] = set()
        for tag, required, in_group in self._flat((*self.components[HEADER], *message.entries, *self.components[TRAILER]), True, False, ()):
            places.setdefault(tag, len(places))
            needed |= {tag} if required else set()
            repeats |= {tag} if in_group else set()
        return [(tag, at, tag in needed, tag in repeats) for tag, at in places.items()]

    def _flat(self, entries, required: bool, in_group: bool, inside: tuple[str, ...]) -> Iterator[tuple[int, bool, bool]]:
        for e in entries:
            need = required and e.required
            if e.kind == COMPONENT:
                if e.name in self.components and e.name not in inside:
                    yield from self._flat(self.components[e.name], need, in_group, (*inside, e.name))
                continue
            if own := self.by_name.get(e.name):
                yield own.tag, need, in_group
            if e.kind == GROUP:
                yield from self._flat(e.entries, need, True, inside)


# --- reading -----------------------------------------------------------------------------------------------------------


def normal_version(value: str) -> str:
    """44, 4.4, FIX44, FIX.4.4 and the like as a key."""
    clean = value.strip().upper().replace(".", "")
    return clean if clean.startswith("FIX") else "FIX" + clean


def _key(kind: str, major: str, minor: str, pack: str) -> str:
    if kind.upper() == "FIXT":
        return f"FIXT{major}{minor}"
    return f"FIX{major}{minor}" + (f"SP{pack}" if pack.strip() not in ("", "0") else "")


def _ascii(x: str | None, fallback: str = "") -> str:
    """What is not ASCII becomes a question mark, one for each UTF-16 unit."""
    return fallback if x is None else "".join(c if ord(c) < 128 else "?" * (1 + (ord(c) > 0xFFFF)) for c in x)


def parse_xml(text: str | bytes, source: str) -> Dictionary:
    """A dictionary from XML. A document type is refused, so that no entity is ever expanded; the last of equal definitions counts."""
    raw = text.encode() if isinstance(text, str) else text

    def refuse(*_):
        raise ValueError(f"{source}: a document type is not allowed")

    first = expat.ParserCreate()  # the parser itself tells a document type, in whatever encoding the text is
    first.StartDoctypeDeclHandler = first.EntityDeclHandler = refuse
    first.Parse(raw, True)
    root = ElementTree.fromstring(raw)
    parts = {name: root.find(name) for name in ("header", "trailer", "messages", "components", "fields")}
    for name, part in parts.items():
        if part is None and name != "components":
            raise ValueError(f"{source}: missing section {name}")

    def entries(parent) -> tuple[Entry, ...]:
        return tuple(Entry(e.tag, _ascii(e.get("name")), (e.get("required") or "").upper() == "Y", entries(e) if e.tag == GROUP else ()) for e in parent if e.tag in (FIELD, COMPONENT, GROUP))

    fields = {}
    for f in parts["fields"].findall("field"):
        values = [*f.findall("value"), *f.findall("values/value")]
        fields[int(f.get("number"))] = Field(int(f.get("number")), _ascii(f.get("name")), _ascii(f.get("type"), "STRING"), {_ascii(v.get("enum")): _ascii(v.get("description")) for v in values})
    messages = {m.get("msgtype"): Message(_ascii(m.get("msgtype")), _ascii(m.get("name")), _ascii(m.get("msgcat")), entries(m)) for m in parts["messages"].findall("message")}
    components = {_ascii(c.get("name")): entries(c) for c in (parts["components"].findall("component") if parts["components"] is not None else ())}
    components |= {HEADER: entries(parts["header"]), TRAILER: entries(parts["trailer"])}
    pack = root.get("servicepack") or "0"
    return Dictionary(_key(root.get("type") or "FIX", root.get("major") or "", root.get("minor") or "", pack), pack, source, fields, messages, components)


def _entries(tokens: Iterator[str]) -> tuple[Entry, ...]:
    out = []
    for t in tokens:
        if t == ")":
            break
        group = t.endswith("(")
        name = t.rstrip("(")
        kind = GROUP if group else COMPONENT if name.startswith("@") else FIELD
        out.append(Entry(kind, name.strip("@!"), name.endswith("!"), _entries(tokens) if group else ()))
    return tuple(out)


def from_notation(spec: dict, source: str = "built-in") -> Dictionary:
    """A dictionary from the notation of sources.builtin."""
    read = lambda text: _entries(iter(text.split()))
    enums: dict[int, dict[str, str]] = {}
    for line in spec["enums"].split("\n"):
        if line:
            tag, value, description = line.split(" ", 2)
            enums.setdefault(int(tag), {})[value] = description
    fields = {int(t): Field(int(t), n, k, enums.get(int(t), {})) for t, n, k in (line.split() for line in spec["fields"].strip().split("\n"))}
    messages = {}
    for head, text in spec["messages"].items():
        kind, name, category = head.split()
        messages[kind] = Message(kind, name, category, read(text))
    components = {n: read(t) for n, t in spec["components"].items()} | {HEADER: read(spec["header"]), TRAILER: read(spec["trailer"])}
    return Dictionary(_key(spec["type"], spec["major"], spec["minor"], spec["servicepack"]), spec["servicepack"], source, fields, messages, components)


# --- the catalog -------------------------------------------------------------------------------------------------------


class Registry:
    """Dictionaries by key, in the order of the catalog. Versions that no file was given for are listed as unavailable."""

    def __init__(self, xml: list[tuple[str, str]] = ()):
        """xml: (text, source) of further dictionaries; one with a key that is there replaces it in its place."""
        self.entries: dict[str, Dictionary | None] = dict.fromkeys(builtin.CATALOG)
        for spec in (builtin.FIX44, builtin.FIXT11):
            own = from_notation(spec)
            self.entries[own.key] = own
        for text, source in xml:
            self.register(parse_xml(text, source))

    def register(self, own: Dictionary) -> None:
        """Replaces what has the key; an alias of the key follows a built-in dictionary only while it has none of its own."""
        self.entries[own.key] = own
        for alias, target in builtin.ALIASES.items():
            if target == own.key and self.entries.get(alias) is None:
                self.entries[alias] = own

    def get(self, key: str | None) -> Dictionary | None:
        return self.entries.get(key or "")

    def resolve(self, requested: str | None = None) -> Dictionary:
        """The dictionary that an option names, FIX44 by default."""
        key = normal_version(requested if requested and requested.strip() else "44")
        if (own := self.entries.get(key)) is None:
            raise ValueError(f"{'Unavailable' if key in self.entries else 'Unknown'} FIX dictionary: {requested}")
        return own

    def by_begin_string(self, begin: str | None, fallback: Dictionary) -> Dictionary:
        clean = (begin or "").strip()
        return (self.entries.get(clean.upper().replace(".", "")) or fallback) if clean.startswith("FIX") else fallback

    def by_application(self, version: str | None, fallback: Dictionary | None) -> Dictionary | None:
        clean = (version or "").strip().upper()
        return (self.entries.get(builtin.APPL_VERSIONS.get(clean) or normal_version(clean)) or fallback) if clean else fallback

    def distinct(self) -> list[Dictionary]:
        return list({d.dict_id: d for d in self.entries.values() if d}.values())

    def keys(self) -> list[str]:
        return list(self.entries)


def sensitive() -> dict[int, str]:
    return {int(t): p for t, p in (line.split() for line in builtin.SENSITIVE.strip().split("\n"))}


# --- tables ------------------------------------------------------------------------------------------------------------


@dataclass
class Tables:
    """The catalog's tables. All are bounded by the schemas read, not by data."""

    catalog: DataFrame
    fields: DataFrame
    enums: DataFrame
    messages: DataFrame
    shape: DataFrame
    applications: DataFrame
    sensitive: DataFrame
    shapes: DataFrame
    keys: DataFrame
    checks: DataFrame


def local(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small table that is part of the plan itself, so that no job runs to make it."""
    kind = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows, strict=True)) or [()] * len(kind)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind))


def tables(spark: SparkSession, registry: Registry) -> Tables:
    own = registry.distinct()
    make = lambda rows, schema: local(spark, list(rows), schema)
    catalog = [(k, i, d.dict_id, d.source, d.service_pack) for i, (k, d) in enumerate(registry.entries.items()) if d]
    messages = []
    for d in own:
        rows = {m.type: m for m in d.messages.values()}
        rows |= {m.name: m for m in d.messages.values() if m.name not in rows}
        messages += [(d.dict_id, lookup, m.type, m.name, m.category) for lookup, m in rows.items()]
    versions = {*builtin.APPL_VERSIONS, *registry.entries} | {k.removeprefix("FIX") for k in registry.entries}
    applications = [(v, d.dict_id) for v in sorted(versions) if (d := registry.by_application(v, None))]
    shapes = []
    for d in own:
        by_type = {m.type: d.shape(m) for m in d.messages.values()}
        for dict_id, lookup, kind, _, _ in messages:
            if dict_id == d.dict_id:
                own_shape = by_type[kind]
                shapes.append((dict_id, lookup, [t for t, *_ in own_shape], [{"tag": t, "name": d.fields[t].name} for t, _, need, _ in own_shape if need], [t for t, _, _, again in own_shape if again]))
    return Tables(
        make(catalog, "key string, ordinal int, dict_id string, source string, service_pack string"),
        make(((d.dict_id, f.tag, f.name, f.type, bool(f.enums)) for d in own for f in d.fields.values()), "dict_id string, tag int, name string, type string, has_enums boolean"),
        make(((d.dict_id, f.tag, v, text) for d in own for f in d.fields.values() for v, text in f.enums.items()), "dict_id string, tag int, value string, description string"),
        make(messages, "dict_id string, lookup string, msg_type string, name string, category string"),
        make(((d.dict_id, m.type, *s) for d in own for m in d.messages.values() for s in d.shape(m)), "dict_id string, msg_type string, tag int, ord int, required boolean, dup_ok boolean"),
        make(applications, "version string, dict_id string"),
        make(sensitive().items(), "tag int, prefix string"),
        make(shapes, "dict_id string, lookup string, order array<int>, required array<struct<tag:int,name:string>>, repeats array<int>"),
        make(((d.dict_id, d.key) for d in own), "dict_id string, key string"),
        make(((d.dict_id, f.tag, f.type, list(f.enums) or None) for d in own for f in d.fields.values()), "dict_id string, tag int, type string, listed array<string>"),
    )
