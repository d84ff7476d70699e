"""Settings in layers: defaults, then a file, then what an owner chose; each cast to its type and kept in range."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace

TRUE, FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}
#: Allowed ranges.
RANGES = {
    "limit": (1, 500), "min_token_size": (1, 10), "generic_df_ratio": (0.0, 1.0), "title_weight": (0.0, 100.0), "tags_weight": (0.0, 100.0), "brand_weight": (0.0, 100.0), "category_weight": (0.0, 100.0),
    "specs_weight": (0.0, 100.0), "description_weight": (0.0, 100.0), "phrase_bonus": (0.0, 100.0), "keyword_weight": (0.0, 1.0), "semantic_weight": (0.0, 1.0), "min_cosine": (-1.0, 1.0), "min_relevance": (0.0, 1.0),
}
#: Keys that had another name once.
RENAMED = {"weight_title": "title_weight", "weight_tags": "tags_weight", "cosine_floor": "min_cosine"}


@dataclass(frozen=True)
class Settings:
    limit: int = 100
    min_token_size: int = 3
    generic_df_ratio: float = 0.15
    require_all_terms: bool = True
    title_weight: float = 10.0
    tags_weight: float = 8.0
    brand_weight: float = 7.0
    category_weight: float = 5.0
    specs_weight: float = 6.0
    description_weight: float = 1.0
    phrase_bonus: float = 5.0
    keyword_weight: float = 0.4
    semantic_weight: float = 0.6
    min_cosine: float = 0.4
    min_relevance: float = 0.45
    stopwords: str = ""

    def layered(self, *layers: dict) -> tuple[Settings, list[str]]:
        """These settings under the layers, the last one on top, and what was wrong with values left out. Blank keeps what is below."""
        out, problems = self, []
        types = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        for layer in layers:
            for key, raw in layer.items():
                name = RENAMED.get(key, key)
                if name not in types:
                    problems.append(f"{key}: unknown")
                elif raw is not None and str(raw).strip() != "":
                    try:
                        out = replace(out, **{name: _checked(name, _cast(raw, types[name]))})
                    except ValueError as e:
                        problems.append(f"{key}: {e}")
        return out, problems


def _cast(raw, kind: type):
    text = str(raw).strip()
    if kind is bool:
        if text.lower() not in TRUE | FALSE:
            raise ValueError("neither true nor false")
        return text.lower() in TRUE
    return kind(text)


def _checked(name: str, value):
    low, high = RANGES.get(name, (None, None))
    if low is not None and not low <= value <= high:
        raise ValueError(f"not within {low} and {high}")
    return value


def read(path: str) -> dict:
    """A layer from a JSON file; none if there's no such file."""
    try:
        with open(path) as f:
            return json.load(f)
    except FileNotFoundError:
        return {}


def page_of(total: int, page: int, size: int) -> tuple[int, int, int, int]:
    """(page, offset, first, last) of a page number kept within the pages that there are; first is 0 of nothing."""
    pages = max(1, -(-total // max(1, size)))
    page = min(max(1, page), pages)
    offset = (page - 1) * size
    return page, offset, offset + 1 if total else 0, min(total, offset + size)
