"""Rules over facts (subject, predicate, object), evaluated to their fixpoint semi-naively.

A rule's conditions are triple patterns whose terms are constants or variables that begin with "?"; each becomes a scan of the facts of its
predicate, and shared variables become join keys. A round joins only what uses at least one fact that the last round found: for each
condition in turn, it reads the new facts there, those from before on its left and all on its right. Rounds end when nothing is new.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.functions.lineage import cut, drop

Triple = tuple[str, str, str]
COLUMNS = ["subject", "predicate", "object"]
#: Predicates of types, of the hierarchy of types, and of what may not be together.
TYPE, SUBCLASS, EQUIVALENT, DISJOINT = "type", "subClassOf", "equivalentTo", "disjointWith"


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    id: str
    conditions: tuple[Triple, ...]
    conclusion: Triple


def is_variable(term: str) -> bool:
    return term.startswith("?")


#: What the kinds SubClassOf and Equivalent mean, and that classes above a thing's type are its types.
HIERARCHY = (
    Rule("subclass_of_subclass", (("?a", SUBCLASS, "?b"), ("?b", SUBCLASS, "?c")), ("?a", SUBCLASS, "?c")),
    Rule("type_of_superclass", (("?x", TYPE, "?a"), ("?a", SUBCLASS, "?b")), ("?x", TYPE, "?b")),
    Rule("equivalent_is_symmetric", (("?a", EQUIVALENT, "?b"),), ("?b", EQUIVALENT, "?a")),
    Rule("equivalent_is_subclass", (("?a", EQUIVALENT, "?b"),), ("?a", SUBCLASS, "?b")),
)


def compile_rules(raw: list[dict]) -> tuple[list[Rule], list[Triple]]:
    """(rules, facts) of an ontology's rule records. Rules of the kinds SubClassOf, Equivalent and Disjoint without conditions state a fact; HIERARCHY says what it means.

    All others are run as they stand. A conclusion must not have a variable that no condition has.
    """
    predicates = {"SubClassOf": SUBCLASS, "Equivalent": EQUIVALENT, "Disjoint": DISJOINT}
    triple = lambda t: (t["subject"], t["predicate"], t["object"])
    rules, facts = list(HIERARCHY), []
    for r in raw:
        conditions, conclusion = tuple(triple(c) for c in r.get("conditions") or ()), triple(r["conclusion"])
        if not conditions:
            if any(is_variable(x) for x in conclusion):
                raise RuleError(f"{r['id']}: a variable without condition")
            kind = r["rule_type"] if isinstance(r["rule_type"], str) else "Custom"
            facts.append((conclusion[0], predicates.get(kind, conclusion[1]), conclusion[2]))
            continue
        if not {x for x in conclusion if is_variable(x)} <= {x for c in conditions for x in c}:
            raise RuleError(f"{r['id']}: a variable of the conclusion is in no condition")
        rules.append(Rule(r["id"], conditions, conclusion))
    return rules, facts


def _scan(facts: DataFrame, pattern: Triple) -> DataFrame:
    """The bindings of a pattern's variables, one column each."""
    terms = list(zip(COLUMNS, pattern))
    rows, seen = facts, {}
    for column, term in terms:
        if not is_variable(term):
            rows = rows.where(F.col(column) == term)
        elif term in seen:
            rows = rows.where(F.col(column) == F.col(seen[term]))
        else:
            seen[term] = column
    return rows.select(*[F.col(column).alias(term) for term, column in seen.items()])


def _bindings(sides: list[DataFrame], patterns: tuple[Triple, ...]) -> DataFrame:
    out = None
    for facts, pattern in zip(sides, patterns):
        found = _scan(facts, pattern)
        keys = [c for c in found.columns if out is not None and c in out.columns]
        if out is not None and not keys:
            raise RuleError("conditions without a variable in common")
        out = found if out is None else out.join(found, keys)
    return out


def _term(term: str) -> Column:
    return F.col(term) if is_variable(term) else F.lit(term)


def infer(facts: DataFrame, rules: list[Rule], rounds: int | None = None) -> DataFrame:
    """(subject, predicate, object, round) of the facts and all that the rules conclude from them; round 0 are the facts themselves.

    Facts are strings; repeats and rows with nulls are dropped. Without a limit of rounds they go on until nothing is new, which they must, as
    rules make no new terms. Conditions of a rule must be connected by variables in the order given.
    """
    known = cut(facts.select(*COLUMNS).dropna().distinct().withColumn("round", F.lit(0)))
    tables, n = [known], 0
    while rounds is None or n < rounds:
        n += 1
        new, every = tables[-1], tables[0]
        for x in tables[1:]:
            every = every.unionByName(x)
        older = tables[0].limit(0)
        for x in tables[:-1]:
            older = older.unionByName(x)
        found = None
        for rule in rules:
            for k in range(len(rule.conditions)):
                sides = [older if i < k else new if i == k else every for i in range(len(rule.conditions))]
                if k and len(tables) == 1:
                    continue  # nothing older than the facts themselves
                made = _bindings(sides, rule.conditions).select(*[_term(x).alias(c) for c, x in zip(COLUMNS, rule.conclusion)])
                found = made if found is None else found.unionByName(made)
        if found is None:
            break
        fresh = cut(found.distinct().join(every.select(*COLUMNS), COLUMNS, "left_anti").withColumn("round", F.lit(n)))
        if fresh.isEmpty():
            drop(fresh)
            break
        tables.append(fresh)
        if len(tables) > 8:  # few files to read in each round; the last round's facts stay apart
            merged = tables[0]
            for x in tables[1:-1]:
                merged = merged.unionByName(x)
            old, tables = tables[:-1], [cut(merged), tables[-1]]
            drop(*old)
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return out


def violations(inferred: DataFrame) -> DataFrame:
    """(subject, first, second): things of two types that are stated to be disjoint, in either order; types in the order of their names."""
    facts = inferred.select(*COLUMNS)
    pairs = facts.where(F.col("predicate") == DISJOINT).select(F.least("subject", "object").alias("first"), F.greatest("subject", "object").alias("second")).distinct()
    of = facts.where(F.col("predicate") == TYPE)
    first, second = of.select("subject", F.col("object").alias("first")), of.select("subject", F.col("object").alias("second"))
    return first.join(pairs, "first").join(second, ["subject", "second"]).select("subject", "first", "second").distinct()
