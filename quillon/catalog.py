"""Semantic catalog: tables, columns, joins and metrics from YAML, validated as a closed world, and a join graph over them."""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from quillon.functions.text import IDENTIFIER

DEFAULT = Path(__file__).parent / "catalog.yaml"


class CatalogError(ValueError):
    """The catalog contradicts itself."""


@dataclass(frozen=True)
class Join:
    left: str
    right: str
    left_key: str
    right_key: str
    cardinality: str  # many_to_one or one_to_many, from left to right


@dataclass(frozen=True)
class Catalog:
    version: str
    tables: dict[str, tuple[str, ...]]
    sensitive: frozenset[str]
    joins: tuple[Join, ...]
    aliases: dict[str, tuple[str, ...]]

    def path(self, sources: set[str], target: str) -> list[Join]:
        """Fewest joins from any of the tables to the target; ties in the order of the catalog. CatalogError without one."""
        queue, seen = deque((s, []) for s in sorted(sources)), set(sources)
        while queue:
            at, way = queue.popleft()
            if at == target:
                return way
            for j in self.joins:
                for a, b, k, m, c in ((j.left, j.right, j.left_key, j.right_key, j.cardinality), (j.right, j.left, j.right_key, j.left_key, "one_to_many" if j.cardinality == "many_to_one" else "many_to_one")):
                    if a == at and b not in seen:
                        seen.add(b)
                        queue.append((b, [*way, Join(a, b, k, m, c)]))
        raise CatalogError(f"no join path to {target}")

    def join_path(self, spark: SparkSession, sf_dir: str, source: str, target: str, keep_grain: bool = True) -> DataFrame:
        """The tables on the path, joined; refuses a step that would multiply the source's rows unless told otherwise."""
        df = spark.read.parquet(f"{sf_dir}/{source}.parquet")
        for j in self.path({source}, target):
            if keep_grain and j.cardinality == "one_to_many":
                raise CatalogError(f"{j.left} to {j.right} multiplies rows")
            right = spark.read.parquet(f"{sf_dir}/{j.right}.parquet")
            df = df.join(right, df[j.left_key] == right[j.right_key], "left")
        return df


def _keys(part: dict, allowed: set[str], where: str) -> None:
    if extra := set(part) - allowed:
        raise CatalogError(f"{where}: unknown keys {sorted(extra)}")
    if missing := allowed - set(part):
        raise CatalogError(f"{where}: missing keys {sorted(missing)}")


def load_catalog(path: str | Path = DEFAULT) -> Catalog:
    raw = yaml.safe_load(Path(path).read_text())
    _keys(raw, {"version", "tables", "sensitive", "joins", "aliases"}, "catalog")
    tables = {t: tuple(c) for t, c in raw["tables"].items()}
    for name in [*tables, *(c for cs in tables.values() for c in cs)]:
        if not re.match(IDENTIFIER, name):
            raise CatalogError(f"{name} is no identifier")
    for t, cs in tables.items():
        if len(set(cs)) != len(cs):
            raise CatalogError(f"{t} names a column twice")
    known = {c for cs in tables.values() for c in cs}
    if extra := set(raw["sensitive"]) - known:
        raise CatalogError(f"sensitive columns {sorted(extra)} are in no table")
    joins = []
    for j in raw["joins"]:
        _keys(j, {"left", "right", "left_key", "right_key", "cardinality"}, "join")
        if j["left_key"] not in tables.get(j["left"], ()) or j["right_key"] not in tables.get(j["right"], ()) or j["cardinality"] not in ("many_to_one", "one_to_many"):
            raise CatalogError(f"join {j['left']} to {j['right']} names something unknown")
        joins.append(Join(**j))
    if len({(j.left, j.right, j.left_key) for j in joins}) != len(joins):
        raise CatalogError("a join is listed twice")
    return Catalog(raw["version"], tables, frozenset(raw["sensitive"]), tuple(joins), {k: tuple(v) for k, v in raw["aliases"].items()})


def drift(catalog: Catalog, spark: SparkSession, sf_dir: str) -> dict[str, tuple[list[str], list[str]]]:
    """Tables whose columns differ from the catalog: (only in the catalog, only in the data)."""
    found = {}
    for t, cs in catalog.tables.items():
        have = set(spark.read.parquet(f"{sf_dir}/{t}.parquet").columns)
        if have != set(cs):
            found[t] = (sorted(set(cs) - have), sorted(have - set(cs)))
    return found
