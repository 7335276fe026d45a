"""Adapters at the engine's boundaries, by name."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class Adapter(Protocol):
    def available(self) -> bool: ...

    def cost(self, rows: DataFrame) -> DataFrame: ...


@runtime_checkable
class Ingest(Adapter, Protocol):
    def ingest(self, asset: str) -> DataFrame: ...


@runtime_checkable
class Emit(Adapter, Protocol):
    def emit(self, rows: DataFrame, target: str) -> None: ...


class Registry:
    """(boundary, name) -> adapter; names are unique within a boundary."""

    def __init__(self) -> None:
        self._held: dict[tuple[str, str], Adapter] = {}

    def register(self, boundary: str, name: str, adapter: Adapter) -> None:
        if (boundary, name) in self._held:
            raise ValueError(f"{boundary} has a {name} already")
        self._held[boundary, name] = adapter

    def get(self, boundary: str, name: str) -> Adapter:
        return self._held[boundary, name]

    def available(self, boundary: str) -> list[str]:
        return sorted(n for (b, n), a in self._held.items() if b == boundary and a.available())
