"""Validation of entities (entity_id, entity_type, properties VARIANT) and relations against an ontology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.plans.ontology import Constraint, Ontology

#: The kind of JSON value that a property type accepts.
ACCEPTS = {"String": "string", "Number": "number", "Boolean": "boolean", "DateTime": "string", "Reference": "string", "Embedding": "array", "Object": "object", "Array": "array"}

ERROR = "struct<kind:string,property:string>"


def json_kind(value: Column) -> Column:
    """string, number, boolean, array, object or null, of a variant; null for SQL null."""
    schema = F.schema_of_variant(value)
    number = schema.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(schema == "STRING", "string").when(number, "number").when(schema == "BOOLEAN", "boolean").when(schema.startswith("ARRAY"), "array").when(schema.startswith("OBJECT"), "object").when(schema == "VOID", "null")


def _error(kind: str, name: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), name.alias("property"))


#: Columns of a property's value and of its kind, which are taken from the properties once.
_VALUE, _KIND = "_value:{}", "_kind:{}"


def _of(form: str, name: str) -> Column:
    return F.col(f"`{form.format(name)}`")


def _property_errors(o: Ontology, name: str) -> list[Column]:
    """Required, type and cardinality errors. A required property is missing only if its key is absent; an explicit null has the wrong type."""
    out, first = [], {}
    for p in o.properties(name):
        if p.required:
            out.append(F.when(_of(_VALUE, p.name).isNull(), _error("MissingRequiredProperty", F.lit(p.name))))
        first.setdefault(p.name, p)
    for p in first.values():
        value, kind = _of(_VALUE, p.name), _of(_KIND, p.name)
        out.append(F.when(kind != ACCEPTS[p.kind.split("(")[0]], _error("InvalidPropertyType", F.lit(p.name))))
        size = F.when(kind == "array", F.size(F.try_variant_get(value, "$", "array<variant>"))).otherwise(1)
        wrong = {"One": size != 1, "ZeroOrOne": size > 1, "OneOrMore": size < 1}.get(p.cardinality)
        if wrong is not None:
            out.append(F.when(value.isNotNull() & wrong, _error("CardinalityViolation", F.lit(p.name))))
    return out


def _constraint_error(c: Constraint, names: list[str]) -> Column | None:
    """The violation with the smallest name. A constraint holds for every property of its type's kind."""
    found = []
    for n in sorted(names):
        value, kind = _of(_VALUE, n), _of(_KIND, n)
        number, text = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
        low, high = c.config.get("min"), c.config.get("max")
        if c.kind == "ValueRange":
            bad = (kind == "number") & ((number < low if low is not None else F.lit(False)) | (number > high if high is not None else F.lit(False)))
        elif c.kind == "Enum":
            bad = (kind == "string") & ~text.isin(*c.config.get("values", []))
        elif c.kind == "StringLength":  # in bytes
            size = F.octet_length(text)
            bad = (kind == "string") & ((size < low if low is not None else F.lit(False)) | (size > high if high is not None else F.lit(False)))
        else:
            return None
        found.append(F.when(bad, _error("ConstraintViolation", F.lit(n))))
    return F.coalesce(*found) if found else None


def validate_entities(entities: DataFrame, o: Ontology, property_names: list[str]) -> DataFrame:
    """entities with errors: array of (kind, property). An unknown type is the only error of its row.

    property_names: the keys that constraints look at, next to those that the ontology declares. Only a type's own constraints run.
    """
    errors, every = F.array(_error("UnknownEntityType", F.lit(None).cast("string"))), set(property_names)
    for name, t in o.entity_types.items():
        names = sorted({*property_names, *(p.name for p in o.properties(name))})
        every |= set(names)
        checks = _property_errors(o, name) + [e for c in t.constraints if (e := _constraint_error(c, names)) is not None]
        made = F.filter(F.array(*checks), lambda e: e.isNotNull()) if checks else F.array().cast(f"array<{ERROR}>")
        errors = F.when(F.col("entity_type") == name, made).otherwise(errors)
    values = entities.withColumns({_VALUE.format(n): F.try_variant_get("properties", f"$['{n}']", "variant") for n in sorted(every)})
    kinds = values.withColumns({_KIND.format(n): json_kind(_of(_VALUE, n)) for n in sorted(every)})
    return kinds.withColumn("errors", errors).select(*[F.col(f"`{c}`") for c in entities.columns], "errors")


def validate_relations(relations: DataFrame, entities: DataFrame, o: Ontology) -> DataFrame:
    """relations with error: MissingSource, MissingTarget, UnknownRelationType, IncompatibleTypes, or null."""
    spark = relations.sparkSession
    types = entities.select("entity_id", "entity_type")
    source = types.select(F.col("entity_id").alias("source_id"), F.col("entity_type").alias("source_type"))
    target = types.select(F.col("entity_id").alias("target_id"), F.col("entity_type").alias("target_type"))
    allowed = o.compatible_table(spark).withColumn("allowed", F.lit(True))
    known = o.relation_table(spark).select("relation_type", F.lit(True).alias("known"))
    rows = relations.join(source, "source_id", "left").join(target, "target_id", "left").join(known, "relation_type", "left").join(allowed, ["source_type", "target_type", "relation_type"], "left")
    error = F.when(F.col("source_type").isNull(), "MissingSource").when(F.col("target_type").isNull(), "MissingTarget").when(F.col("known").isNull(), "UnknownRelationType").when(F.col("allowed").isNull(), "IncompatibleTypes")
    return rows.withColumn("error", error).drop("known", "allowed")
