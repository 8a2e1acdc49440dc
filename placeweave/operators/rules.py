"""Layered rule classification of places.

A rule set is plain data. Every rule becomes one expression that yields its first hit; the matches of all layers are
kept in order, and the decision is a precedence over layers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions.text import SPACE, fold

MATCH = "struct<rule_id:string,layer:string,matched_on:string,matched_value:string>"


@dataclass(frozen=True)
class TypeRule:
    rule_id: str
    types: tuple[str, ...]


@dataclass(frozen=True)
class KeywordRule:
    rule_id: str
    keywords: tuple[str, ...]
    on: str = "name"  # name, website or name_or_website


@dataclass(frozen=True)
class RuleSet:
    reject_types: tuple[TypeRule, ...] = ()
    reject_keywords: tuple[KeywordRule, ...] = ()
    accept_types: tuple[TypeRule, ...] = ()
    accept_keywords: tuple[KeywordRule, ...] = ()
    review_keywords: tuple[KeywordRule, ...] = ()
    review_types: tuple[TypeRule, ...] = ()
    weak_reviews: tuple[str, ...] = ()
    reinforcement: KeywordRule | None = None
    fallback: TypeRule | None = None
    fallback_label: str = "needs_review"
    fallback_reason: str = ""


def resolve_rules(defaults: RuleSet, product: RuleSet, modes: dict[str, str] | None = None) -> RuleSet:
    """The product's rules over the defaults. modes: by field, ``override`` or ``extend``; without one, the default stays."""
    out = product
    for name in ("reject_types", "reject_keywords", "accept_types"):
        own, mode = getattr(product, name), (modes or {}).get(name, "default")
        out = replace(out, **{name: own if mode == "override" else (*getattr(defaults, name), *own) if mode == "extend" else getattr(defaults, name)})
    return out


def _match(rule_id: str, layer: str, on: Column, hit: Column) -> Column:
    return F.when(hit.isNotNull(), F.struct(F.lit(rule_id).alias("rule_id"), F.lit(layer).alias("layer"), on.alias("matched_on"), hit.alias("matched_value")))


def _type_hit(types: Column, rule: TypeRule) -> Column:
    return F.coalesce(*[F.when(F.array_contains(types, t), F.lit(t)) for t in rule.types])


def _folded(text: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def keyword_hit(text: Column, keywords: tuple[str, ...]) -> Column:
    """The first keyword that stands in text as whole words, accents and case aside."""
    folded = fold(text)
    return F.coalesce(*[F.when(folded.rlike(f"(?:^|{SPACE}){re.escape(_folded(k.strip()))}(?:{SPACE}|$)"), F.lit(k)) for k in keywords])


def _keyword_match(rule: KeywordRule, layer: str) -> Column:
    name, site = keyword_hit(F.col("name"), rule.keywords), keyword_hit(F.col("website"), rule.keywords)
    if rule.on == "name_or_website":
        return _match(rule.rule_id, layer, F.when(name.isNotNull(), "name").otherwise("website"), F.coalesce(name, site))
    return _match(rule.rule_id, layer, F.lit(rule.on), name if rule.on == "name" else site)


def all_matches(rules: RuleSet) -> Column:
    """Every match of every layer, in the fixed order of layers."""
    types = F.coalesce(F.col("google_types"), F.array().cast("array<string>"))
    typed = lambda rs, layer: [_match(r.rule_id, layer, F.lit("google_types"), _type_hit(types, r)) for r in rs]
    keyed = lambda rs, layer: [_keyword_match(r, layer) for r in rs]
    parts = typed(rules.reject_types, "reject") + keyed(rules.reject_keywords, "reject") + typed(rules.accept_types, "accept") + keyed(rules.accept_keywords, "accept")
    meant = F.lit(None).cast("string")
    if rules.reinforcement:
        meant = F.when(F.col("source_query_kind") == "activity_intent", keyword_hit(F.col("name"), rules.reinforcement.keywords))
        parts.append(_match(rules.reinforcement.rule_id, "accept", F.lit("name"), meant))
    parts += keyed(rules.review_keywords, "review") + typed(rules.review_types, "review")
    if rules.fallback:
        parts.append(_match(rules.fallback.rule_id, "ambiguity_fallback", F.lit("google_types"), F.when(meant.isNull(), _type_hit(types, rules.fallback))))
    return F.array_compact(F.array(*parts)) if parts else F.array().cast(f"array<{MATCH}>")


LABELS = {"google_types": "tipo", "name": "nome"}


def _reasoning(prefix: str, matches: Column) -> Column:
    where = lambda m: F.when(m["matched_on"] == "google_types", "tipo").when(m["matched_on"] == "name", "nome").otherwise("website")
    text = F.transform(matches, lambda m: F.concat(m["rule_id"], F.lit(" ("), where(m), F.lit(': "'), m["matched_value"], F.lit('")')))
    return F.concat(F.lit(f"{prefix} por: "), F.array_join(text, "; "))


# How reasons begin.
REJECTED, REVIEW, ACCEPTED = "Rejeitado", "Caso intermediário, requer revisão", "Aceito"
NO_RULE = "Nenhuma regra heurística reconheceu este local — enviado para revisão por padrão de segurança."


def classify(venues: DataFrame, rules: RuleSet) -> DataFrame:
    """Adds decision, decisive_layer, reasoning and matches. No row is dropped."""
    out = venues.withColumn("matches", all_matches(rules))
    m = F.col("matches")
    of = lambda layer: F.filter(m, lambda x: x["layer"] == layer)
    any_of = lambda layer: F.exists(m, lambda x: x["layer"] == layer)
    strong = F.exists(m, lambda x: (x["layer"] == "review") & ~x["rule_id"].isin(list(rules.weak_reviews)))
    layer = (
        F.when(any_of("reject"), "reject")
        .when(strong | (any_of("review") & ~any_of("accept")), "review")
        .when(any_of("accept"), "accept")
        .when(any_of("ambiguity_fallback"), "ambiguity_fallback")
        .otherwise("default")
    )
    out = out.withColumn("decisive_layer", layer)
    at = lambda name: F.col("decisive_layer") == name
    decision = F.when(at("reject"), "rejected").when(at("accept"), "accepted").when(at("ambiguity_fallback"), rules.fallback_label).otherwise("needs_review")
    reason = (
        F.when(at("reject"), _reasoning(REJECTED, of("reject")))
        .when(at("review"), _reasoning(REVIEW, of("review")))
        .when(at("accept"), _reasoning(ACCEPTED, of("accept")))
        .when(at("ambiguity_fallback"), _reasoning(rules.fallback_reason, of("ambiguity_fallback")))
        .otherwise(NO_RULE)
    )
    out = out.withColumns({"decision": decision, "reasoning": reason})
    return out.withColumn("matches", F.when(at("default"), F.array().cast(f"array<{MATCH}>")).otherwise(m))


def summarize(classified: DataFrame, *by: str, ambiguous: str = "likely_fitness_generic") -> DataFrame:
    """Counts per decision: total, accepted, needs_review, rejected, and the ambiguous label."""
    count = lambda d: F.count_if(F.col("decision") == d)
    return classified.groupBy(*by).agg(F.count("*").alias("total"), count("accepted").alias("accepted"), count("needs_review").alias("needs_review"), count("rejected").alias("rejected"), count(ambiguous).alias("ambiguous"))
