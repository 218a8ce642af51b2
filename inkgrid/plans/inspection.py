"""The whole inspection of forms as one plan: match, resolve, clean, check, review, triage, report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.config import Settings
from inkgrid.operators import clean, match, report, resolve, review, rules, triage


@dataclass(frozen=True)
class Inspection:
    """Lazy results of each step; only what an action needs is computed."""

    candidates: DataFrame
    checks: DataFrame
    planned: DataFrame
    reviewed: DataFrame
    shown: DataFrame
    summary: DataFrame
    reports: DataFrame


def candidates_of(blocks: DataFrame, fields: DataFrame, settings: Settings) -> DataFrame:
    """Ranked candidates after conflicts are resolved and the oil row is read."""
    found = resolve.resolve_conflicts(match.match(blocks, fields, settings))
    return resolve.with_oil_row(found, resolve.oil_row(blocks, fields, settings), fields, settings)


def checked(pages: DataFrame, fields: DataFrame, candidates: DataFrame, settings: Settings, cleaner: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A checked value for every field of every page."""
    rows = clean.local_clean(pages, fields, candidates)
    rows = clean.overlay(rows, cleaner(rows)) if cleaner else rows
    return rules.validate(review.with_ambiguity(rows), settings)


def inspect(blocks: DataFrame, fields: DataFrame, settings: Settings, reviews: DataFrame | None = None, cleaner: Callable[[DataFrame], DataFrame] | None = None) -> Inspection:
    """Inspects all pages that have blocks; `reviews` are second readings, if there are any.

    `cleaner` stands for a model: from the rows of clean.local_clean it makes values as clean.overlay takes them.
    """
    pages = blocks.select("page_id")
    candidates = candidates_of(blocks, fields, settings)
    checks = checked(pages, fields, candidates, settings, cleaner)
    planned = review.budgeted(checks, settings)
    reviewed = review.merge(planned, reviews, settings)
    return Inspection(candidates, checks, planned, reviewed, triage.top_issues(reviewed, settings), report.summary(reviewed), report.documents(reviewed, settings))


def rejected(inspection: Inspection) -> DataFrame:
    """Pages that are not ok, worst first by failures."""
    return inspection.summary.filter(~F.col("ok"))
