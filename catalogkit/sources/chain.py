"""Sources as plug-ins: what a site's pages give, which fields it may not contribute, and the order sources are asked in."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogkit.functions.text import normalize
from catalogkit.sources.pages import extract_pages, page_gates

#: what every source observes besides its fields
ALWAYS = ("code", "source_url", "source", "priority")


@dataclass(frozen=True)
class Source:
    """A site: its name, its place in the chain, and a rule (a column over ``html``, ``url`` and the other columns of
    pages) for each field it knows; ``withheld`` fields stay null, and pages with a gate's reason are left out."""

    name: str
    priority: int
    rules: dict[str, Callable[[], Column]]
    withheld: Sequence[str] = ()
    shortest: int = 0
    blocked: Sequence[str] = ()
    options: dict[str, str] = field(default_factory=dict)

    def observe(self, pages: DataFrame) -> DataFrame:
        kept = page_gates(pages, self.shortest, self.blocked).where("reject_reason IS NULL").drop("reject_reason")
        return extract_pages(kept, {f: rule() for f, rule in self.rules.items()}, self.name, self.priority, self.withheld).drop("html")


class Chain:
    """Sources by name.  A source that is registered again replaces the one before."""

    def __init__(self, *sources: Source):
        self.known = {s.name: s for s in sources}

    def add(self, source: Source) -> Source:
        self.known[source.name] = source
        return source

    def select(self, names: Sequence[str] | None = None) -> list[Source]:
        """The named sources in the given order, or all by priority; an unknown name raises an error."""
        if names is None:
            return sorted(self.known.values(), key=lambda s: (s.priority, s.name))
        unknown = [n for n in names if n not in self.known]
        if unknown:
            raise LookupError(f"unknown sources: {', '.join(unknown)}")
        return [self.known[n] for n in names]

    def observe(self, pages: dict[str, DataFrame], names: Sequence[str] | None = None) -> DataFrame:
        """The observations of the selected sources over their pages, with the place in the selection as priority."""
        out = None
        for place, source in enumerate(self.select(names)):
            if source.name not in pages:
                continue
            seen = source.observe(pages[source.name]).withColumn("priority", F.lit(place))
            out = seen if out is None else out.unionByName(seen, allowMissingColumns=True)
        if out is None:
            raise LookupError("no pages of a selected source")
        return out


def entity_items(items: DataFrame, name: str, owner: str = "owner", cast: str | None = "cast") -> DataFrame:
    """The items of an entity, as owner or among the cast."""
    among = F.coalesce(F.array_contains(cast, name), F.lit(False)) if cast and cast in items.columns else F.lit(False)
    return items.where((F.col(owner) == name) | among)


def normalized(values: DataFrame, column: str, variants: dict[str, str] | None = None, out: str = "normalized") -> DataFrame:
    """Adds the canonical form of codes and names."""
    return values.withColumn(out, normalize(F.col(column), variants))
