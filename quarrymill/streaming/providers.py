"""Providers of evidence: a name, what their rows are, and a function from DataFrame to DataFrame, checked where it is used."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What kinds of evidence there are; only the first two may become inputs of a static model. Fixed values.
PROVENANCE = ("deterministic_geometry", "bounded_tactical_proof", "search_derived", "external_oracle", "outcome")
STATIC = PROVENANCE[:2]


class ProviderError(ValueError):
    """A provider that can't be registered, or whose rows aren't what it declares."""


@dataclass(frozen=True)
class Provider:
    """``run`` gives rows of ``schema`` (DDL), which has the ``key`` of the rows that it is asked for.

    ``identity`` names the producing binary or version. ``needs`` are columns that it reads.
    """

    name: str
    provenance: str
    schema: str
    run: Callable[[DataFrame], DataFrame]
    identity: str
    key: str = "id"
    needs: tuple[str, ...] = ()

    def __call__(self, rows: DataFrame) -> DataFrame:
        """Its rows, refused before any of them is made if their columns or types aren't the declared ones, with where they come from."""
        if missing := [c for c in (self.key, *self.needs) if c not in rows.columns]:
            raise ProviderError(f"{self.name} needs columns {missing}")
        got = self.run(rows)
        have, want = ({f.name: f.dataType for f in s.fields} for s in (got.schema, declared(self.schema)))
        wrong = sorted(f"{c}: {have[c].simpleString() if c in have else 'missing'}, declared {want[c].simpleString()}" for c in want if have.get(c) != want[c])
        extra = sorted(set(have) - set(want))
        if wrong or extra:
            raise ProviderError(f"{self.name}: " + "; ".join([*wrong, *(f"{c}: not declared" for c in extra)]))
        return got.select(*want, F.lit(self.provenance).alias("provenance_class"), F.lit(self.name).alias("provider"), F.lit(self.identity).alias("producer"))


def declared(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema)


@dataclass
class Registry:
    """Providers by name."""

    providers: dict[str, Provider] = field(default_factory=dict)

    def register(self, provider: Provider) -> Provider:
        """Keeps a provider; refuses an unknown provenance, a name that another one has, and a schema without its key."""
        if provider.provenance not in PROVENANCE:
            raise ProviderError(f"{provider.name}: no provenance class {provider.provenance!r}")
        if provider.key not in declared(provider.schema).names:
            raise ProviderError(f"{provider.name}: its schema lacks {provider.key}")
        if self.providers.get(provider.name, provider) is not provider:
            raise ProviderError(f"{provider.name} is registered already")
        self.providers[provider.name] = provider
        return provider

    def get(self, name: str, static: bool = False) -> Provider:
        """The provider of a name; ``static`` refuses one whose rows may not become inputs of a static model."""
        if name not in self.providers:
            raise ProviderError(f"no provider {name!r}; there are {sorted(self.providers)}")
        found = self.providers[name]
        if static and found.provenance not in STATIC:
            raise ProviderError(f"{name} gives {found.provenance}, which is no static input")
        return found
