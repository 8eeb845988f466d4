"""Ontologies: types with one parent each, relation types, checks, expansion and inference. Small, on the driver; tables for joins."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class OntologyError(ValueError):
    pass


@dataclass(frozen=True)
class Property:
    name: str
    kind: str = "String"
    required: bool = False
    cardinality: str = "ZeroOrOne"


@dataclass(frozen=True)
class Constraint:
    """ValueRange (min, max), Enum (values), StringLength (min, max); Pattern and Custom are kept and not run."""

    kind: str
    config: dict = field(default_factory=dict)


@dataclass(frozen=True)
class EntityType:
    id: str
    parent: str | None = None
    label: str = ""
    properties: tuple[Property, ...] = ()
    constraints: tuple[Constraint, ...] = ()


@dataclass(frozen=True)
class RelationType:
    id: str
    domain: str
    range: str
    inverse: str | None = None
    symmetric: bool = False
    transitive: bool = False
    functional: bool = False
    reflexive: bool = False


@dataclass(frozen=True)
class Ontology:
    namespace: str
    version: str
    entity_types: dict[str, EntityType]
    relation_types: dict[str, RelationType]
    rules: tuple = ()  # kept, never evaluated

    def supertypes(self, name: str) -> list[str]:
        """Ancestors, nearest first; a parent that isn't defined is named once."""
        out: list[str] = []
        at = self.entity_types.get(name)
        while at and at.parent and at.parent not in out and at.parent != name:
            out.append(at.parent)
            at = self.entity_types.get(at.parent)
        return out

    def is_subtype(self, name: str, of: str) -> bool:
        return name == of or of in self.supertypes(name)

    def subtypes(self, name: str) -> list[str]:
        """The type and its descendants by name; an unknown type alone."""
        return sorted({name} | {t for t in self.entity_types if self.is_subtype(t, name)})

    def properties(self, name: str) -> list[Property]:
        """Own first, then inherited, repeats included."""
        chain = [name, *self.supertypes(name)]
        return [p for t in chain if t in self.entity_types for p in self.entity_types[t].properties]

    def check(self) -> None:
        """Raises the first error: a cycle, a missing parent, a relation's unknown domain, range or inverse."""
        for t in self.entity_types.values():
            seen, at = {t.id}, t
            while at.parent:
                if at.parent in seen:
                    raise OntologyError(f"cycle at {t.id}")
                if at.parent not in self.entity_types:
                    raise OntologyError(f"missing parent {at.parent} of {at.id}")
                seen.add(at.parent)
                at = self.entity_types[at.parent]
        for r in self.relation_types.values():
            for what, name in (("domain", r.domain), ("range", r.range)):
                if name not in self.entity_types:
                    raise OntologyError(f"unknown {what} {name} of {r.id}")
            if r.inverse and r.inverse not in self.relation_types:
                raise OntologyError(f"unknown inverse {r.inverse} of {r.id}")

    def inferred(self, name: str) -> list[dict]:
        """Relations whose domain the type falls under: direct, reversed if symmetric, the inverse if there is one."""
        if name not in self.entity_types:
            raise OntologyError(f"unknown type {name}")
        out = []
        for r in sorted(self.relation_types.values(), key=lambda r: r.id):
            if self.is_subtype(name, r.domain):
                out.append({"relation": r.id, "source": name, "target": r.range, "reason": "SubtypeInheritance"})
                if r.symmetric:
                    out.append({"relation": r.id, "source": r.range, "target": name, "reason": "Symmetric"})
                if r.inverse:
                    out.append({"relation": r.inverse, "source": r.range, "target": name, "reason": "Inverse"})
        return out

    def expand(self, name: str) -> dict:
        if name not in self.entity_types:
            raise OntologyError(f"unknown type {name}")
        types, relations = self.subtypes(name), self.inferred(name)
        return {"types": types, "relations": relations, "metadata": {"type_count": str(len(types)), "relation_count": str(len(relations))}}

    def expand_or_self(self, name: str) -> list[str]:
        """For queries: an unknown type stands for itself."""
        return self.subtypes(name) if name in self.entity_types else [name]

    def compatible(self, source: str, target: str) -> list[str]:
        return sorted(r.id for r in self.relation_types.values() if self.is_subtype(source, r.domain) and self.is_subtype(target, r.range))

    def describe(self, name: str) -> dict:
        t = self.entity_types[name]
        return {"id": t.id, "label": t.label, "parent": t.parent, "properties": [p.name for p in t.properties]}

    # Tables for joins. They have a row per type, pair of types or relation type.
    def closure_table(self, spark: SparkSession) -> DataFrame:
        rows = [(t, s, d) for t in sorted(self.entity_types) for d, s in enumerate([t, *self.supertypes(t)])]
        return spark.createDataFrame(rows, "sub string, super string, depth int")

    def relation_table(self, spark: SparkSession) -> DataFrame:
        rows = [(r.id, r.domain, r.range, r.inverse, r.symmetric, r.transitive) for r in self.relation_types.values()]
        return spark.createDataFrame(rows, "relation_type string, domain string, range string, inverse string, symmetric boolean, transitive boolean")

    def inferred_table(self, spark: SparkSession) -> DataFrame:
        """inferred() of all types, as joins."""
        r, c = self.relation_table(spark), self.closure_table(spark)
        s = lambda rel, a, b, why: F.struct(rel.alias("relation"), a.alias("source"), b.alias("target"), F.lit(why).alias("reason"))
        made = F.array(
            s(F.col("relation_type"), F.col("sub"), F.col("range"), "SubtypeInheritance"),
            F.when(F.col("symmetric"), s(F.col("relation_type"), F.col("range"), F.col("sub"), "Symmetric")),
            F.when(F.col("inverse").isNotNull(), s(F.col("inverse"), F.col("range"), F.col("sub"), "Inverse")),
        )
        return r.join(c, F.col("domain") == F.col("super")).select(F.col("sub").alias("type"), F.explode(F.filter(made, lambda x: x.isNotNull())).alias("i")).select("type", "i.*")

    def compatible_table(self, spark: SparkSession) -> DataFrame:
        """(source_type, target_type, relation_type) for all that compatible() allows."""
        c = self.closure_table(spark)
        left = c.select(F.col("sub").alias("source_type"), F.col("super").alias("domain"))
        right = c.select(F.col("sub").alias("target_type"), F.col("super").alias("range"))
        return self.relation_table(spark).join(left, "domain").join(right, "range").select("source_type", "target_type", "relation_type")


def parse(text: str) -> Ontology:
    """From JSON, or YAML where a YAML reader is installed; checked."""
    try:
        raw = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise OntologyError("not JSON, and no YAML reader is installed") from e
        try:
            raw = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise OntologyError("neither JSON nor YAML") from e
    if not isinstance(raw, dict) or "entity_types" not in raw:
        raise OntologyError("an ontology needs entity_types")
    types = {}
    for key, t in raw["entity_types"].items():
        props = tuple(Property(p["name"], (p.get("property_type") or {}).get("type", "String"), bool(p.get("required")), p.get("cardinality", "ZeroOrOne")) for p in t.get("properties") or ())
        types[key] = EntityType(t.get("id", key), t.get("parent"), t.get("label", ""), props, tuple(Constraint(c["type"], c.get("config") or {}) for c in t.get("constraints") or ()))
    relations = {k: RelationType(r.get("id", k), r["domain"], r["range"], r.get("inverse"), *(bool(r.get(f)) for f in ("symmetric", "transitive", "functional", "reflexive"))) for k, r in (raw.get("relation_types") or {}).items()}
    made = Ontology(raw.get("namespace", ""), str(raw.get("version", "")), types, relations, tuple(raw.get("rules") or ()))
    made.check()
    return made


def to_json(o: Ontology) -> str:
    """The form that parse() reads."""
    types = {
        k: {
            "id": t.id, "label": t.label, "parent": t.parent,
            "properties": [{"name": p.name, "property_type": {"type": p.kind}, "required": p.required, "cardinality": p.cardinality} for p in t.properties],
            "constraints": [{"type": c.kind, "config": c.config} for c in t.constraints],
        }
        for k, t in o.entity_types.items()
    }
    relations = {k: vars(r) for k, r in o.relation_types.items()}
    return json.dumps({"namespace": o.namespace, "version": o.version, "entity_types": types, "relation_types": relations, "rules": list(o.rules)})
