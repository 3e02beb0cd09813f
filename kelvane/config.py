"""The row contract of the master table and what operators are told about other tables' columns."""

from __future__ import annotations

from dataclasses import dataclass

# Field and header of each column, in contract order.
COLUMNS: tuple[tuple[str, str], ...] = (
    ("company_id", "Company_ID"),
    ("last_update", "Last_Update"),
    ("company", "Company"),
    ("product_name", "Product_name"),
    ("row_kind", "Company & Product"),
    ("key_categories", "All_Key_Categories of this company"),
    ("sub_category", "Sub Category B"),
    ("remarks", "Remarks Product/solution"),
    ("sustainability", "Sustainability Features"),
    ("r_strategies", "R-Strategies"),
    ("r_rationale", "R-Strategy: Rationale to categorization"),
    ("lca", "LCA Capabilities"),
    ("compliance", "Regulatory Compliance"),
    ("technology", "Technology/Innovation"),
    ("key_customers", "Key customers"),
    ("strengths", "Strengths"),
    ("weaknesses", "Weaknesses"),
    ("usp", "USP"),
    ("target_market", "Target Market"),
    ("pricing_model", "Pricing Model"),
    ("business_model", "Business Model"),
    ("url", "URL"),
    ("founding_year", "Founding Year"),
    ("stage", "Stage/ Status"),
    ("founding_type", "Founding/ founding type"),
    ("location", "Location"),
    ("employees", "# Employees"),
    ("revenue", "Revenue (Year)"),
    ("lfl_dimension", "LFL_Dimension"),
    ("competitor_tier", "Competitor_Tier"),
    ("beachhead", "Beachhead_Relevanz"),
)
FIELDS = tuple(f for f, _ in COLUMNS)
# Fixed values, also in contract order: kinds, fields of an entity, separators of multi-valued fields, the sheet and thresholds.
COMPANY_KIND, PRODUCT_KIND = "Company information", "Product"
COMPANY_FIELDS = ("key_categories", "founding_year", "stage", "founding_type", "location", "employees", "revenue")
VOCABULARY_FIELDS = ("key_categories", "sub_category", "competitor_tier", "beachhead")
SEPARATORS = {"key_categories": " | ", "sub_category": "; ", "r_strategies": ", ", "lfl_dimension": ", ", "beachhead": ", "}
MASTER_SHEET = "Competitors_All-Master"
MIN_CONFIDENCE, FUZZY_THRESHOLD, DOMAIN_THRESHOLD = 0.35, 0.90, 0.80


class SchemaError(ValueError):
    """The input does not have the contract's columns."""


class IngestError(ValueError):
    """A batch breaks its contract."""


class BalanceError(IngestError):
    """A written version does not have the rows that it should."""


class ConflictError(RuntimeError):
    """Staged edits belong to another version."""


@dataclass(frozen=True)
class RowModel:
    """Column roles of a two-level table: header rows and detail rows of entities, in the order of ``row_idx``."""

    entity_id: str = "company_id"
    entity: str = "company"
    detail: str = "product_name"
    kind: str = "row_kind"
    header_kind: str = COMPANY_KIND
    detail_kind: str = PRODUCT_KIND
    url: str = "url"
    tier: str = "competitor_tier"
    row_idx: str = "row_idx"
    id_is_float: str = "company_id_is_float"


MASTER = RowModel()
