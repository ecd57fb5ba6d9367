"""What a user sets: company, terms, detection settings, export and logo settings, with the bounds of each."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, replace

CATEGORIES = ("pii", "company", "financial", "technical", "custom")
LISTED, ENTRY, LONG, DOMAIN = 100, 100, 500, 253


def text(s: object, most: int = LONG) -> str:
    return s.strip()[:most] if isinstance(s, str) else ""


def texts(items: object, most: int = ENTRY) -> list[str]:
    return [t for t in (text(x, most) for x in (items if isinstance(items, (list, tuple)) else [])[:LISTED]) if t]


def confidence(x: object, default: int = 70) -> int:
    """A whole number from 0 to 100; what isn't a number gives the default."""
    if isinstance(x, bool) or not isinstance(x, (int, float)) or math.isnan(x):
        return default
    return int(min(100, max(0, math.floor(min(1e9, max(-1e9, x)) + 0.5))))


@dataclass(frozen=True)
class Named:
    name: str
    aliases: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Company:
    name: str = ""
    aliases: list[str] = field(default_factory=list)
    domains: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Custom:
    keywords: list[str] = field(default_factory=list)
    clients: list[Named] = field(default_factory=list)
    projects: list[Named] = field(default_factory=list)
    products: list[Named] = field(default_factory=list)


@dataclass(frozen=True)
class Detection:
    min_confidence: int = 70
    auto_mask: bool = True
    categories: list[str] = field(default_factory=lambda: list(CATEGORIES))


@dataclass(frozen=True)
class Logo:
    enabled: bool = False
    image_hash: str | None = None
    threshold: int = 85
    placeholder: str = "[LOGO]"


@dataclass(frozen=True)
class Config:
    company: Company = field(default_factory=Company)
    custom: Custom = field(default_factory=Custom)
    detection: Detection = field(default_factory=Detection)
    logo: Logo = field(default_factory=Logo)

    def checked(self) -> Config:
        """All values within their bounds."""
        named = lambda xs: [Named(n, texts(x.aliases)) for x in xs[:LISTED] if (n := text(x.name, ENTRY))]
        return Config(
            Company(text(self.company.name), texts(self.company.aliases), [d.lower() for d in texts(self.company.domains, DOMAIN)]),
            Custom(texts(self.custom.keywords), named(self.custom.clients), named(self.custom.projects), named(self.custom.products)),
            Detection(confidence(self.detection.min_confidence), bool(self.detection.auto_mask), [c for c in CATEGORIES if c in self.detection.categories]),
            Logo(bool(self.logo.enabled), self.logo.image_hash, confidence(self.logo.threshold, 85), text(self.logo.placeholder) or "[LOGO]"),
        )

    def toggled(self, category: str) -> Config:
        on = self.detection.categories
        on = [c for c in on if c != category] if category in on else [*on, category]
        return replace(self, detection=replace(self.detection, categories=on))

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @staticmethod
    def from_json(s: str) -> Config:
        """A saved configuration; what it lacks has its default."""
        d = json.loads(s)
        named = lambda key: [Named(**x) for x in (d.get("custom") or {}).get(key, [])]
        own = lambda kind, key: kind(**{k: v for k, v in (d.get(key) or {}).items() if k in kind.__dataclass_fields__})
        custom = Custom((d.get("custom") or {}).get("keywords", []), named("clients"), named("projects"), named("products"))
        return Config(own(Company, "company"), custom, own(Detection, "detection"), own(Logo, "logo")).checked()
