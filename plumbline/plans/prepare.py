"""The whole way from a table of text to a typed, cleaned, related and enriched one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from plumbline.operators.audit import append_audit
from plumbline.operators.cleaning import apply_plan, cleaning_plan
from plumbline.operators.derive import derive_all, suggest_derived, validate_columns
from plumbline.operators.outliers import collect_bounds, iqr_bounds
from plumbline.operators.profile import infer_types
from plumbline.operators.quality import duplicate_rows, quality_columns, quality_summary
from plumbline.operators.relationships import classify_relationships, relationship_candidates
from plumbline.functions.kinds import numeric_columns
from plumbline.session import stored
from plumbline.sources.readers import apply_schema, type_texts


@dataclass
class PreparedTable:
    """Everything that is known about a table after preparing it; all parts are DataFrames."""

    inferred: DataFrame
    typed: DataFrame
    quality: DataFrame
    quality_summary: DataFrame
    cleaned: DataFrame
    candidates: DataFrame
    relationships: DataFrame
    enriched: DataFrame
    validation: DataFrame
    audit: DataFrame


def clean_table(df: DataFrame, min_confidence: float = 0.70) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Profile, plan and clean: ``(quality rows, quality summary, cleaned table, audit rows)``."""
    numbers = numeric_columns(df)
    quality = quality_columns(df)
    duplicates = duplicate_rows(df)
    bounds = collect_bounds(iqr_bounds(df, numbers)) if numbers else {}
    plan = cleaning_plan(quality, df, bounds, duplicates.first()["duplicate_count"])
    cleaned, audit = apply_plan(df, plan, min_confidence)
    return quality, quality_summary(quality, duplicates), cleaned, audit


def prepare(raw: DataFrame, order_by: Sequence[str]) -> PreparedTable:
    """Infer and apply types, clean, relate and derive. ``raw`` usually holds text columns only."""
    read = type_texts(raw)
    inferred = infer_types(read, order_by)
    # Stored once, so that the statistics of later steps do not read and cast the texts again.
    typed = stored(apply_schema(read, [r.asDict() for r in inferred.select("column", "detected_type", "format_spec").collect()]), "typed")
    quality, summary, cleaned, cleaning_audit = clean_table(typed)
    cleaned = stored(cleaned, "cleaned")
    candidates = relationship_candidates(cleaned)
    specs = suggest_derived(cleaned)
    enriched, derive_audit = derive_all(cleaned, specs)
    made = [s for s in specs if s.name in enriched.columns]
    return PreparedTable(
        inferred, typed, quality, summary, cleaned, candidates, classify_relationships(candidates), enriched,
        validate_columns(enriched, made) if made else None, append_audit(cleaning_audit, derive_audit),
    )
