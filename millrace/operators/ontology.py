"""Ontologies: loading, effective domains, aliases and prompts. Small driver-side configuration."""

from __future__ import annotations

import hashlib
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

ATTRIBUTE_TYPES = ("string", "date", "number", "ref", "boolean", "unknown")


@dataclass(frozen=True)
class Entity:
    id: str
    name: str
    description: str = ""
    attributes: tuple[tuple[str, str, bool], ...] = ()
    synonyms: tuple[str, ...] = ()


@dataclass(frozen=True)
class Relation:
    predicate: str
    subject: str = ""
    object: str = ""
    description: str = ""


@dataclass(frozen=True)
class RegexRule:
    id: str
    type: str
    pattern: str
    confidence: float = 1.0


@dataclass
class Ontology:
    entities: dict[str, Entity] = field(default_factory=dict)
    relations: dict[str, Relation] = field(default_factory=dict)
    rules: dict[str, RegexRule] = field(default_factory=dict)
    auto_publish: float | None = None

    def effective(self, pool: Ontology) -> Ontology:
        """Own definitions, and those of the pool whose id, predicate or rule id is not taken."""
        return Ontology(pool.entities | self.entities, pool.relations | self.relations, pool.rules | self.rules, self.auto_publish if self.auto_publish is not None else pool.auto_publish)

    def problems(self) -> list[str]:
        """What is wrong: unknown ends of relations and types of rules, patterns that do not compile, values out of range."""
        out = [f"relation {r.predicate}: no entity {e}" for r in self.relations.values() for e in (r.subject, r.object) if e and e not in self.entities]
        for rule in self.rules.values():
            if rule.type not in self.entities:
                out.append(f"rule {rule.id}: no entity {rule.type}")
            if not 0 <= rule.confidence <= 1:
                out.append(f"rule {rule.id}: confidence {rule.confidence}")
            try:
                re.compile(rule.pattern)
            except re.error as e:
                out.append(f"rule {rule.id}: {e}")
        if self.auto_publish is not None and not 0 <= self.auto_publish <= 1:
            out.append(f"auto_publish {self.auto_publish}")
        return out


def load(xml: str) -> Ontology:
    """Entities, relations and regular-expression rules of a document; an id twice raises."""
    root, out = ET.fromstring(xml), Ontology()

    def add(table: dict, key: str, value: object) -> None:
        if not key or key in table:
            raise ValueError(f"missing or repeated id {key!r}")
        table[key] = value

    for e in root.iter("entity"):
        if e.get("id") is None:
            continue
        attributes = tuple((a.get("name", ""), t if (t := a.get("type", "string")) in ATTRIBUTE_TYPES else "unknown", a.get("required") == "true") for a in e.iter("attribute"))
        add(out.entities, e.get("id"), Entity(e.get("id"), e.get("name", e.get("id")), e.get("description", ""), attributes, tuple((s.text or "").strip() for s in e.iter("synonym"))))
    for r in root.iter("relation"):
        if r.get("predicate") or r.get("id"):
            key = r.get("predicate") or r.get("id")
            add(out.relations, key, Relation(key, r.get("subject", ""), r.get("object", ""), r.get("description", "")))
    for r in root.iter("rule"):
        if r.get("pattern"):
            add(out.rules, r.get("id", ""), RegexRule(r.get("id", ""), r.get("type", ""), r.get("pattern"), float(r.get("confidence", 1.0))))
    if root.get("auto_publish"):
        out.auto_publish = float(root.get("auto_publish"))
    return out


def alias_map(global_: dict[str, list[str]], domains: dict[str, dict[str, list[str]]]) -> dict[str, str]:
    """Alias to canonical name, of the global file and then the domains by name; a name twice is an error."""
    out: dict[str, str] = {}
    for where, table in [("global", global_), *sorted(domains.items())]:
        for canonical, names in table.items():
            for name in names:
                if name in out:
                    raise ValueError(f"alias {name!r} is repeated in {where}")
                out[name] = canonical
    return out


def section_path(breadcrumb: str) -> str:
    """`> A` and ` > B` lines as A > B."""
    return " > ".join(line.strip().removeprefix(">").strip() for line in breadcrumb.splitlines() if line.strip())


def render(template: str, values: dict[str, object]) -> str:
    """{{name}}, {{join name "sep"}} and {{truncate name n}}; an unknown name raises."""

    def put(m: re.Match) -> str:
        helper, name, argument = m["helper"], m["name"], m["arg"]
        value = values[name]
        if helper == "join":
            return (argument or ", ").strip('"').join(map(str, value))
        text = str(value)
        return text[: int(argument)] if helper == "truncate" else text

    return re.sub(r'\{\{\s*(?:(?P<helper>join|truncate)\s+)?(?P<name>\w+)(?:\s+(?P<arg>"[^"]*"|\d+))?\s*\}\}', put, template)


def template_hash(*templates: str) -> str:
    return hashlib.sha256("\x00".join(templates).encode()).hexdigest()
