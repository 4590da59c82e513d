"""Declarative job descriptions: what to extract and which types to expect."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.json_values import digest, digest_value, pointer_tokens
from ..functions.texts import SENSITIVE

FIELD_TYPES = {"string": ("string",), "integer": ("integer",), "number": ("integer", "number"),
               "boolean": ("boolean",), "scalar": ("string", "integer", "number", "boolean")}
SQL_TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}

PLAN_SCHEMA = ("source_id bigint, request_id string, items_pointer string, fields map<string,string>, "
               "unique_key string, pagination_location string, page_parameter string, "
               "has_next_pointer string, total_pointer string")
PLAN_COLUMNS = ("request_id", "items_pointer", "fields", "unique_key", "pagination_location",
                "page_parameter", "has_next_pointer", "total_pointer")


def sensitive(text: str) -> bool:
    return re.search(SENSITIVE, text) is not None


def check_pointer(pointer: str | None) -> None:
    if pointer is None:
        return
    pointer_tokens(pointer)
    if pointer and sensitive(pointer):
        raise ValueError("sensitive_pointer")


@dataclass(frozen=True)
class ExtractionPlan:
    """One endpoint's paged JSON layout."""

    request_id: str
    items_pointer: str
    fields: dict[str, str]
    unique_key: str
    page_parameter: str = "page"
    pagination_location: str = "query"
    has_next_pointer: str | None = None
    total_pointer: str | None = None

    def __post_init__(self):
        if not 1 <= len(self.fields) <= 10:
            raise ValueError("invalid_fields")
        if self.pagination_location not in ("query", "json_body"):
            raise ValueError("invalid_pagination_location")
        for pointer in (self.items_pointer, self.has_next_pointer, self.total_pointer):
            check_pointer(pointer)

    def content_hash(self) -> str:
        return digest_value(asdict(self))


@dataclass(frozen=True)
class FieldSpec:
    """Declared output field."""

    name: str
    type: str = "scalar"
    required: bool = True

    def __post_init__(self):
        if not re.fullmatch(r"\w{1,40}", self.name) or sensitive(self.name):
            raise ValueError("invalid_fields")
        if self.type not in FIELD_TYPES:
            raise ValueError("invalid_field_type")


def check_field_names(names: list[str]) -> list[str]:
    """Output names are short words, unique and not sensitive."""
    for name in names:
        FieldSpec(name)
    if len(set(names)) != len(names):
        raise ValueError("invalid_fields")
    return names


@dataclass(frozen=True)
class HtmlField:
    selector: str | None = None
    attribute: str = "text"
    source: str = "list"

    def __post_init__(self):
        if self.attribute not in ("text", "href", "title", "src", "content", "datetime"):
            raise ValueError("invalid_attribute")
        if self.source not in ("list", "detail"):
            raise ValueError("invalid_source")
        if self.selector and (sensitive(self.selector) or re.search(r"[{};]", self.selector)):
            raise ValueError("invalid_or_sensitive_field")


@dataclass(frozen=True)
class HtmlPlan:
    record_selector: str
    fields: dict[str, HtmlField] = field(default_factory=dict)
    detail_link_selector: str | None = None
    next_selector: str | None = None
    unsupported_requirements: tuple[str, ...] = ()

    def __post_init__(self):
        if not 1 <= len(self.fields) <= 10:
            raise ValueError("invalid_fields")
        for name, spec in self.fields.items():
            if sensitive(name):
                raise ValueError("invalid_or_sensitive_field")
            if spec.source == "detail" and not self.detail_link_selector:
                raise ValueError("detail_link_required")


@dataclass(frozen=True)
class TargetPolicy:
    """Which URLs are admissible. ``allowlist`` holds (domain, include_subdomains)."""

    mode: str = "loopback"
    target_kind: str = "http"
    allowlist: tuple[tuple[str, bool], ...] = ()
    schemes: tuple[str, ...] = ("https",)
    entry_url_query_allowed: bool = False

    def __post_init__(self):
        if (self.mode == "loopback") == bool(self.allowlist) or not self.schemes:
            raise ValueError("invalid_policy")
        for domain, _ in self.allowlist:
            labels = domain.split(".")
            if (domain != domain.lower() or not 0 < len(domain) <= 253 or len(labels) < 2
                    or not all(len(x) <= 63 and re.fullmatch(r"[a-z0-9]([a-z0-9-]*[a-z0-9])?", x) for x in labels)
                    or re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", domain)):
                raise ValueError("invalid_allowlist_domain")

    def content_hash(self) -> str:
        return digest_value({
            "schema_version": 1, "mode": self.mode, "target_kind": self.target_kind,
            "allowlist": [{"domain": d, "include_subdomains": s} for d, s in self.allowlist],
            "schemes": list(self.schemes), "entry_url_query_allowed": self.entry_url_query_allowed})


def plan_hash(columns: dict[str, Column] | None = None) -> Column:
    """Content address of a plan row; member order never changes it."""
    columns = columns or {}
    parts = [columns.get(name, F.col(name)).alias(name) for name in PLAN_COLUMNS]
    return digest(F.parse_json(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})))


def attach_plan(df: DataFrame, plan: ExtractionPlan | DataFrame) -> DataFrame:
    """Give every row of ``df`` its plan columns.

    A single plan becomes literals (no shuffle). A plan table is joined on
    ``source_id``; Spark broadcasts it only while it is below the size threshold.
    """
    if isinstance(plan, ExtractionPlan):
        fields = F.create_map(*[F.lit(x) for pair in plan.fields.items() for x in pair])
        values = {name: F.lit(getattr(plan, name)).cast("string") for name in PLAN_COLUMNS if name != "fields"}
        return df.withColumns({**values, "fields": fields})
    return df.join(plan.select("source_id", *PLAN_COLUMNS), "source_id", "left")
