"""Search predicates as column conditions; they reach the Parquet scan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

from ..functions.web import LOW_QUALITY_DOMAINS, is_valid_url


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def chunk_filter(method: str | None = None, model: str | None = None, source_file: str = "All Files",
                 mode: str = "semantic") -> Column:
    """Method, model (where vectors matter) and file."""
    out = []
    if method:
        out.append(F.col("chunking_method") == method)
    if model and mode in ("semantic", "mixed"):
        out.append(F.col("embedding_model") == model)
    if source_file and source_file != "All Files":
        out.append(F.col("source_file") == source_file)
    return _all(out)


@dataclass
class ProjectFilter:
    """Metadata filter of a project search; an exact page beats a page range."""

    project_id: str | None = None
    page: int | None = None
    page_from: int | None = None
    page_to: int | None = None
    section: str | None = None
    subsection: str | None = None
    cohort_id: str | int | None = None
    source_type: str | None = None
    speaker_role: str | None = None

    def condition(self) -> Column:
        out = []
        if self.project_id is not None:
            out.append(F.col("project_id") == self.project_id)
        if self.page is not None:
            out.append(F.col("page_number") == self.page)
        else:
            if self.page_from is not None:
                out.append(F.col("page_number") >= self.page_from)
            if self.page_to is not None:
                out.append(F.col("page_number") <= self.page_to)
        for name, value in (("section_number", self.section), ("subsection_number", self.subsection),
                            ("cohort_id", self.cohort_id), ("source_type", self.source_type),
                            ("speaker_role", self.speaker_role)):
            if value is not None:
                out.append(F.col(name) == value)
        return _all(out)


def web_quality() -> Column:
    low = F.lower("url")
    listed = reduce(lambda a, b: a | b, [low.contains(d) for d in LOW_QUALITY_DOMAINS])
    snippet = F.coalesce("snippet", F.lit(""))
    return (
        (F.coalesce("url", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "") & ~listed
        & ((snippet == "") | (F.length(snippet) >= 20))
    )


def up_to_year(max_year: int | None) -> Column:
    return F.lit(True) if max_year is None else F.col("year").isNull() | (F.col("year") <= max_year)


def fresh(ts: Column, now: Column, hours: int = 24) -> Column:
    return ts > now - F.make_dt_interval(F.lit(0), F.lit(hours))


def answer_match(expected: Column, generated: Column) -> Column:
    return (F.coalesce(expected, F.lit("")) != "") & F.contains(F.lower(generated), F.lower(expected))


# What a report must hold and must not hold.
REQUIRED_SECTIONS = ["Abstract", "Introduction", "Research Findings", "Conclusion"]
PLACEHOLDERS = ["[insert", "[Error", "TODO", "FIXME", "Not generated"]


def report_issues(sections: Column, draft: Column, urls: Column) -> Column:
    """Array of issues of a report: ``sections`` map, draft text, reference URLs."""
    missing = F.filter(
        F.array(*map(F.lit, REQUIRED_SECTIONS)),
        lambda s: F.trim(F.coalesce(F.try_element_at(sections, s), F.lit(""))) == "",
    )
    broken = F.filter(F.map_keys(sections), lambda s: (
        (F.trim(F.coalesce(F.try_element_at(sections, s), F.lit(""))) == "")
        | F.try_element_at(sections, s).startswith("[Error")
    ))
    low = F.lower(draft)
    bad_urls = F.filter(urls, lambda u: (u != "") & ~is_valid_url(u))
    singles = F.array_compact(F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit("Missing sections: "), F.array_join(missing, ", "))),
    ))
    later = F.array_compact(F.array(
        F.when(F.size(urls) == 0, "No references found"),
        F.when(F.length(draft) < 500, "Report is too short (less than 500 characters)"),
        *[F.when(low.contains(p.lower()), f"Report contains placeholder text: {p}") for p in PLACEHOLDERS],
    ))
    return F.concat(
        singles,
        F.transform(broken, lambda s: F.concat(F.lit("Section '"), s, F.lit("' is empty or has errors"))),
        later,
        F.transform(bad_urls, lambda u: F.concat(F.lit("Invalid URL in references: "), u)),
    )
