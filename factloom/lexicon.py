"""Word lists, patterns and thresholds of the document pipeline, as one frozen configuration (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass

LABELS = ("O", "chart", "figure", "footer", "header", "ignore", "table", "table_text", "text", "toc")
BLOCK_LABELS = ("text", "figure", "table", "table_text")  # words of these make up text blocks
SCOPES = ("Other", "Scope 1", "Scope 2", "Scope 3")
STEPS = (("convert", "PDF Rendering", 8), ("ocr", "OCR", 25), ("layout", "Layout Analysis", 20), ("tables", "Table Understanding", 18), ("blocks", "Layout Blocks", 5), ("scope", "Scope Classification", 13), ("visualize", "Visualization", 11))


@dataclass(frozen=True)
class Config:
    """Every list and threshold an operator takes; pass another one to change them."""

    table_words: tuple[str, ...] = ("scope 1", "scope 2", "scope 3", "emission", "ghg", "co2", "co2e", "tco2e", "tco2", "energy", "electricity", "fuel", "power", "phat thai", "khi nha kinh", "nang luong", "carbon", "greenhouse gas", "climate")
    invalid_metrics: tuple[str, ...] = ("", "item", "items", "unit", "units", "%", "times", "description", "year", "years", "no", "no.")
    section_words: tuple[str, ...] = ("assets", "liabilities", "equity", "capital", "owner", "shareholders", "balance sheet", "cash flow", "income statement")
    metric_words: tuple[str, ...] = ("metric", "indicator", "description", "item", "particular", "particulars", "category", "parameter", "measure", "kpi", "building")
    unit_words: tuple[str, ...] = ("unit", "units", "uom")
    total_words: tuple[str, ...] = ("total", "subtotal", "grand total")
    header_words: tuple[str, ...] = ("metric", "indicator", "description", "item", "note", "notes", "unit", "year", "scope", "category", "kpi")
    dataset_words: tuple[str, ...] = ("emission", "emissions", "ghg", "greenhouse", "carbon", "climate", "energy", "electricity", "diesel", "fuel", "travel", "waste", "water", "sustainability", "net zero", "renewable", "governance", "strategy", "policy", "environment", "scope", "supply chain", "procurement", "logistics", "commuting", "fleet", "steam", "heat", "cooling", "power")
    rescue_words: tuple[str, ...] = ("scope 1", "scope 2", "scope 3", "emission", "emissions", "ghg", "carbon", "electricity", "diesel", "fuel", "travel", "waste", "water")
    noise_patterns: tuple[str, ...] = ("table of contents", "copyright", "all rights reserved", "page number", "header", "footer", "company address", "contact us", r"www\.", "http", "logo", "chapter", "contents", "index", "title", "slogan", "message from", "chairman", "ceo", "president", "board", "management", "governance", "strategy")
    strong_words: tuple[str, ...] = ("emission", "emissions", "ghg", "carbon", "greenhouse", "climate", "energy", "electricity")
    short_words: tuple[str, ...] = ("emission", "emissions", "scope", "energy", "electricity", "travel", "waste", "water", "carbon")
    other_words: tuple[str, ...] = ("climate", "energy", "emission", "sustainability", "renewable", "net zero", "strategy", "policy", "governance")
    other_topics: tuple[str, ...] = ("waste", "water", "travel", "supply chain", "commuting", "procurement", "logistics")
    class_targets: tuple[tuple[str, int], ...] = (("Scope 1", 1000), ("Scope 2", 1000), ("Scope 3", 1700), ("Other", 1700))
    temperature: float = 5.0
    scope_confidence: float = 0.60
    vertical_gap: float = 3.0
    column_gap: float = 0.05
    expand: int = 40
    most_region_area: float = 0.85
    least_tokens: int = 5
    least_rows: int = 1
    least_cols: int = 2
    chunk_size: int = 1200
    chunk_overlap: int = 200


DEFAULT = Config()

#: Unit and pattern, in the order in which they are tried; N stands for the number.
N = r"([+-]?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)"
UNIT_PATTERNS = (
    ("tCO2e", r"(?:t|tons?|tonnes?|metric\s+tons?)\s*(?:of\s*)?CO(?:2|₂|,)\s*(?:e|equivalent)?"), ("kgCO2e", r"kg\s*CO(?:2|₂)\s*(?:e|equivalent)?"), ("tCO2", r"t\s*CO(?:2|₂)"), ("ppm", "ppm"), ("CO2e", r"CO(?:2|₂)\s*e"),
    ("mg/m3", r"mg\s*/\s*m(?:3|³)"), ("%", r"%|percent(?:age)?"), ("MWh", "MWh"), ("kWh", "kWh"), ("GWh", "GWh"), ("GJ", "GJ"),
)
CONTEXT = r"greenhouse\s+gas|ghg|emissions?|carbon|CO(?:2|₂)e?|electricity|fuel|refrigerant|supply\s+chain|value\s+chain|net\s+zero|climate"
