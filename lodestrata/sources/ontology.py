"""Metric ontologies: closed vocabularies, families that part the metrics, a hash of the content."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from lodestrata.plans.planner import digest

# What the fields of a metric may be.
KINDS = ("kpi", "guidance", "revenue_driver")
VALUE_TYPES = ("money", "ratio", "count", "duration", "text")
REQUIRED = ("id", "canonical_name", "family_id", "kind", "value_type", "unit", "aliases", "comparability_key_fields")
METRICS = "id string, canonical_name string, family_id string, kind string, value_type string, unit string, aliases array<string>, comparability_key_fields array<string>"


def ontology_errors(content: dict) -> list[str]:
    """Codes with the id they concern, in order; an empty list means the content is sound."""
    errors, metrics, families = [], content.get("metrics") or [], content.get("families") or []
    ids = [m.get("id") for m in metrics]
    errors += [f"DUPLICATE_METRIC:{i}" for i in sorted({i for i in ids if ids.count(i) > 1})]
    for m in metrics:
        errors += [f"MISSING_{f.upper()}:{m.get('id')}" for f in REQUIRED if m.get(f) in (None, "", [])]
        if m.get("kind") not in KINDS:
            errors.append(f"BAD_KIND:{m.get('id')}")
        if m.get("value_type") not in VALUE_TYPES:
            errors.append(f"BAD_VALUE_TYPE:{m.get('id')}")
    placed = [i for f in families for i in f.get("metric_ids") or []]
    errors += [f"NOT_IN_A_FAMILY:{i}" for i in sorted(set(ids) - set(placed))]
    errors += [f"UNKNOWN_IN_FAMILY:{i}" for i in sorted(set(placed) - set(ids))]
    errors += [f"IN_SEVERAL_FAMILIES:{i}" for i in sorted({i for i in placed if placed.count(i) > 1})]
    return errors


def load_ontology(spark: SparkSession, text: str) -> tuple[DataFrame, str]:
    """(metrics, hash) of a JSON ontology; an unsound one is an error. A few rows: a dimension table."""
    content = json.loads(text)
    if errors := ontology_errors(content):
        raise ValueError("; ".join(errors))
    names = [c.split()[0] for c in METRICS.split(", ")]
    return spark.createDataFrame([tuple(m[n] for n in names) for m in content["metrics"]], METRICS), digest(content)
