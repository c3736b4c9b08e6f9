"""Business rules: thresholds, class terms and wording, frozen in one object.

Two variants of the rules exist and disagree in places, so both are selectable:

* ``sql``    – rounded decimals decide the classes, a SKU seen in one week only has no CV
  and is graded Z, descriptions are the greatest text, dates are dates.
* ``script`` – unrounded doubles decide the classes, a one-week SKU has CV 0 and is graded
  X, descriptions are the most frequent text, dates keep their time of day.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

SQL = "sql"
SCRIPT = "script"


@dataclass(frozen=True)
class ClassTerms:
    """Supply terms of one revenue class."""

    abc_class: str
    lead_time_weeks: Decimal
    z_score: Decimal
    service_level_pct: int


@dataclass(frozen=True)
class CellTerms:
    """Stocking policy of one ABC-XYZ cell, as shown to managers."""

    abc_xyz: str
    zone: str
    service_level: str
    review_cycle: str
    instruction: str


# --- fixed values: these texts and numbers must stay as they are -------------------------

#: A real SKU code looks like this.
STOCK_CODE_PATTERN = r"^[0-9A-Z]{5,6}\z"

ABC_CLASSES = ("A", "B", "C")
XYZ_CLASSES = ("X", "Y", "Z")

CLASS_TERMS = (
    ClassTerms("A", Decimal("2.0"), Decimal("2.054"), 98),
    ClassTerms("B", Decimal("3.0"), Decimal("1.645"), 95),
    ClassTerms("C", Decimal("4.0"), Decimal("1.281"), 90),
)

ACTIONS_SQL = {
    "AX": "Premium service (≥98% SL). Tight ROP. Forecast-driven replenishment.",
    "AY": "High service (≥95% SL). Safety stock buffer. Weekly review.",
    "AZ": "MANAGEMENT ATTENTION. High value, unpredictable. Demand sensing required.",
    "BX": "Standard replenishment. System-driven ROP. Monthly review.",
    "BY": "Standard replenishment. Moderate safety stock. Monthly review.",
    "BZ": "Monitor closely. Collaborative forecasting with key customers.",
    "CX": "Lean inventory. Minimum order quantities. Quarterly review.",
    "CY": "Lean inventory. Consider make-to-order or VMI. Quarterly review.",
    "CZ": "RATIONALISATION CANDIDATE. Review against loyal account dependencies.",
}

ACTIONS_SCRIPT = {
    "AX": "Premium service (>98%SL). Tight ROP. Forecast-driven.",
    "AY": "High service (>95%SL). Safety stock buffer. Weekly review.",
    "AZ": "MANAGEMENT ATTENTION. High value, unpredictable. Demand sensing.",
    "BX": "Standard replenishment. System-driven ROP. Monthly review.",
    "BY": "Standard replenishment. Moderate safety stock. Monthly review.",
    "BZ": "Monitor closely. Collaborative forecasting with key customers.",
    "CX": "Lean inventory. Min order qty. Quarterly review.",
    "CY": "Lean inventory. Consider make-to-order. Quarterly review.",
    "CZ": "RATIONALISATION CANDIDATES. Unless serving key loyal accounts.",
}

UNCLASSIFIED = "Unclassified"

SINGLE_EVENT_SQL = "SINGLE EVENT — one-off bulk order; manual commercial review required"
SINGLE_EVENT_SCRIPT = "SINGLE EVENT — one-off bulk order; manual review required"
PROTECT = "PROTECT — repeat purchase pattern detected; review before discontinue"
RATIONALISE_SQL = "RATIONALISE CANDIDATE — low revenue, erratic demand, no repeat purchase pattern"
RATIONALISE_SCRIPT = "RATIONALISE — low revenue, erratic demand, no repeat pattern"

CELL_TERMS = (
    CellTerms("AX", "PREMIUM STOCK", "≥98%", "Weekly",
              "Premium service. Tight ROP. MRP/ERP driven. Zero stockout tolerance."),
    CellTerms("AY", "HIGH SERVICE", "≥95%", "Weekly",
              "High service. Safety stock buffer. Weekly demand review. Preferred supplier."),
    CellTerms("AZ", "MGMT ATTENTION", "≥95%", "Daily/M'ly",
              "MANAGEMENT ATTENTION. Demand sensing. Safety stock large. Supplier VMI/consignment."),
    CellTerms("BX", "STANDARD ROP", "≥95%", "Monthly",
              "Standard ROP. MRP driven. Monthly review. Moderate safety stock."),
    CellTerms("BY", "STANDARD BUFFER", "≥90%", "Monthly",
              "Standard ROP. Moderate buffer. Monthly review."),
    CellTerms("BZ", "MONITOR", "≥90%", "Monthly",
              "Monitor demand patterns. Collaborate with key customers on ordering intent."),
    CellTerms("CX", "LEAN", "85%", "Quarterly",
              "Lean inventory. Min order qty. Low safety stock. Quarterly review."),
    CellTerms("CY", "LEAN", "85%", "Quarterly",
              "Lean inventory. Consider make-to-order. Quarterly review."),
    CellTerms("CZ", "RATIONALISE?", "—", "Ad hoc",
              "RATIONALISATION CANDIDATE. Review with commercial team. Loyalty check required."),
)

ABC_IMPLICATIONS = {
    "A": "Premium service (95-98% SL). Tight ROP. Weekly management review. No stockouts tolerated.",
    "B": "Standard service (90-95% SL). Monthly review. Moderate safety stock.",
    "C": "Lean. Minimal inventory. Quarterly review. Consider consolidation.",
}

XYZ_THRESHOLDS = {"X": "≤ 0.5", "Y": "0.5 – 1.0", "Z": "> 1.0"}

XYZ_APPROACHES = {
    "X": "Statistical ROP with tight safety stock. MRP/ERP driven. High forecast accuracy.",
    "Y": "ROP with moderate buffer. Regular forecast review. Supplier collaboration helpful.",
    "Z": "Safety stock alone insufficient. Demand sensing. VMI or consignment stock considered.",
}

METRICS = {
    1: "Total SKUs analysed",
    2: "Total transactions (clean)",
    3: "Date range",
    4: "Total annual revenue",
    5: "A-class SKUs",
    6: "A-class revenue share",
    7: "B-class SKUs",
    8: "C-class SKUs",
    9: "X-class SKUs (predictable)",
    10: "Y-class SKUs (moderate)",
    11: "Z-class SKUs (intermittent)",
    12: "CZ SKUs (rationalisation candidates)",
    13: "CZ → rationalise (low loyalty)",
    14: "CZ → protect (loyal accounts)",
    15: "AZ+BZ SKUs (management attention)",
    16: "AZ+BZ revenue at risk",
    17: "Top {n} ROP model: avg safety stock (A)",
    18: "SKUs with stockout risk flag",
}

TILES = {
    1: "Total SKUs",
    2: "Total Revenue",
    3: "A-Class SKUs",
    4: "AZ+BZ SKUs",
    5: "AZ+BZ Revenue",
    6: "CZ SKUs",
    7: "Z-Class SKUs",
    8: "ROP Model",
    9: "Data Source",
}

# --- end of fixed values -----------------------------------------------------------------


@dataclass(frozen=True)
class Policy:
    """Every adjustable rule of the engine."""

    semantics: str = SQL
    a_share: Decimal = Decimal("0.80")
    b_share: Decimal = Decimal("0.95")
    x_cv: Decimal = Decimal("0.5")
    y_cv: Decimal = Decimal("1.0")
    risk_cv: Decimal = Decimal("1.2")
    rop_min_weeks: int = 3
    rop_top_n: int = 80
    loyal_min_invoices: int = 3
    loyal_min_customers: int = 2
    weeks_per_year: int = 52
    #: What a stock code must look like, and whether another one drops its line or stops the run.
    code_pattern: str = STOCK_CODE_PATTERN
    stop_at_odd_code: bool = False
    class_terms: tuple[ClassTerms, ...] = field(default=CLASS_TERMS)
    #: Size of the sketches that medians and percentiles come from; none: exact ones.
    sketch_k: int | None = None
    #: Extensions: weeks and multiple of a recent spike, deviation of lead times in weeks.
    spike_weeks: int = 4
    spike_factor: int = 2
    #: Extensions: opening stock in weeks of mean demand; events that a class's lead time counts like.
    opening_stock_weeks: int = 4
    lead_time_prior: int = 10
    lead_time_std_weeks: tuple[tuple[str, Decimal], ...] = (("A", Decimal("0.5")), ("B", Decimal("0.75")), ("C", Decimal("1.0")))

    def __post_init__(self) -> None:
        if self.semantics not in (SQL, SCRIPT):
            raise ValueError(f"semantics must be 'sql' or 'script', got {self.semantics!r}")

    @property
    def rounded(self) -> bool:
        """True when rounded decimals, not raw doubles, decide the classes."""
        return self.semantics == SQL

    @property
    def actions(self) -> dict[str, str]:
        return ACTIONS_SQL if self.rounded else ACTIONS_SCRIPT

    @property
    def single_event_text(self) -> str:
        return SINGLE_EVENT_SQL if self.rounded else SINGLE_EVENT_SCRIPT

    @property
    def rationalise_text(self) -> str:
        return RATIONALISE_SQL if self.rounded else RATIONALISE_SCRIPT
