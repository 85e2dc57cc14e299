"""Settings of an instance of the engine: nothing in the operators names a business domain."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Section:
    """A section of the result: its title and the types of catalogue rows that it shows."""

    name: str
    title: str
    types: tuple[str, ...]


@dataclass(frozen=True)
class Instance:
    """Tag weights, the levels of the entity hierarchy from the top, and the sections."""

    name: str = "default"
    # The weights that rank tags.
    tag_weights: dict[str, float] = field(
        default_factory=lambda: {
            "brand": 10.5, "model": 10.25, "variant": 10.0, "pageType": 9.0, "fuelType": 8.0,
            "sellerType": 7.0, "ownershipType": 6.0, "dealer_name": 5.0, "news_title": 4.0, "city": 3.0,
        }
    )
    levels: tuple[str, ...] = ("brand", "model", "variant")
    place: str = "city"
    page_keyword: str = "PAGETYPE"
    sections: tuple[Section, ...] = (
        Section("new_item", "New", ("new_brand", "new_model", "new_variant", "new_model_page", "new_variant_page")),
        Section("used_item", "Used", ("used_item",)),
        Section("news", "News", ("news",)),
        Section("dealer", "Dealers", ("dealer",)),
    )

    def level_types(self, level: int, page_type: bool) -> tuple[str, ...]:
        """Types that a query of a level searches in the first section."""
        own = tuple(f"new_{name}" for name in self.levels[level:])
        return own + ((f"new_{self.levels[level]}_page",) if page_type and level else ())


INSTANCES = {"default": Instance()}

#: Fixed values of retrieval and matching.
EXACT_BOOST = 2050.0
NGRAM_BOOST, EDGE_BOOST, PHONETIC_BOOST = 100.0, 200.0, 200.0
LEAST_NGRAMS, NGRAM_SHARE = 2, 0.2
EDGE_GRAM_WEIGHT = 0.5
MOST_CANDIDATES = 20
MOST_TOKENS = 8
EXACT_SCORE, EDGE_SCORE = 4.0, 2.0
TOKEN_THRESHOLD, JOINED_THRESHOLD = 50, 40
WIDER = (100, 120, 140)
SAME_SCORE_PERCENT = 20.0
PAGE_SIZE = 10
