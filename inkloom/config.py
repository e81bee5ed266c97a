"""Extraction settings and the fixed values every stage shares."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markers written for a scene break.
RULE_BREAK = '<hr class="scene-break"/>'
SPACER_BREAK = '<p class="spacer"></p>'

# Subtree kinds dropped from the content root.
NOISE_TAGS = ("nav", "header", "footer", "script", "style", "figure", "aside", "iframe")
NOISE_CLASSES = (
    "sharedaddy",
    "jp-relatedposts",
    "post-meta",
    "post-navigation",
    "entry-footer",
    "site-footer",
    "adsbygoogle",
)

# Where the content root is looked for when no configured selector matches.
FALLBACK_ROOT = "article, main, .content, #content"

UNTITLED = "Untitled Chapter"


@dataclass(frozen=True)
class ExtractConfig:
    """How a page becomes a chapter; override with :meth:`but`."""

    # The default selectors, link texts, patterns and limits.
    selectors: tuple[str, ...] = (
        "article .entry-content",
        ".entry-content",
        ".post-content",
        "article",
        ".chapter-content",
    )
    next_texts: tuple[str, ...] = ("Next", "Next Chapter", "Next Page", ">>", "»", "→")
    prev_texts: tuple[str, ...] = ("Previous", "Previous Chapter", "Prev", "<<", "«", "←")
    min_text_len: int = 50
    scene_break_patterns: tuple[str, ...] = (
        r"^[-_*]{3,}$",
        r"^\* *\* *\* *$",
        r"^—+$",
        r"^†$",
    )
    scene_break_style: str = "hr"
    br_threshold: int = 3
    # Options beyond the defaults: both off keeps the documented behaviour.
    dedupe_nested: bool = False
    trim_nav_labels: bool = False

    def but(self, **changes) -> "ExtractConfig":
        return replace(self, **changes)

    @property
    def break_html(self) -> str:
        style = self.scene_break_style.lower()
        return {"spacer": SPACER_BREAK, "none": ""}.get(style, RULE_BREAK)


    def choose(self, fields: tuple[str, ...], make: Callable[["ExtractConfig"], Column]) -> Column:
        """What ``make`` gives for these settings; ``fields`` are those it looks at."""
        return make(self)

    def configs(self) -> list["ExtractConfig"]:
        return [self]


DEFAULT = ExtractConfig()
DOCUMENTED = ExtractConfig(min_text_len=800)


@dataclass(frozen=True)
class SitePresets:
    """Settings that differ from row to row: column ``column`` names the preset of a page.

    Used wherever one :class:`ExtractConfig` is: each expression becomes a choice between the
    distinct values of the settings it looks at, so pages of all presets are read and parsed in
    one pass, and presets that differ elsewhere add nothing to it. Null and unknown names use
    ``default``.
    """

    presets: dict[str, ExtractConfig] = field(default_factory=dict)
    default: ExtractConfig = DEFAULT
    column: str = "_preset"

    def choose(self, fields: tuple[str, ...], make: Callable[[ExtractConfig], Column]) -> Column:
        def value(config: ExtractConfig) -> tuple:
            return tuple(getattr(config, name) for name in fields)

        groups: dict[tuple, list[str]] = {}
        for name, config in self.presets.items():
            if value(config) != value(self.default):
                groups.setdefault(value(config), []).append(name)
        out = None
        for names in groups.values():
            here, made = F.col(self.column).isin(*names), make(self.presets[names[0]])
            out = F.when(here, made) if out is None else out.when(here, made)
        return make(self.default) if out is None else out.otherwise(make(self.default))

    def configs(self) -> list[ExtractConfig]:
        return [self.default, *self.presets.values()]


Settings = ExtractConfig | SitePresets
