"""What each stage of the work is told, with its defaults; the command line's flags are made from these."""

from __future__ import annotations

import argparse
from dataclasses import MISSING, dataclass, fields
from typing import Any, ClassVar

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Stage:
    """A stage reads tables (Parquet, or CSV by its suffix) and writes Parquet below ``out``; ``csv`` adds CSV
    beside it. ``needs`` names the columns that an input must have, in any case."""

    needs: ClassVar[dict[str, tuple[str, ...]]] = {}
    out: str
    csv: bool = False


@dataclass(frozen=True)
class Harvest(Stage):
    """Candidate documents among XML texts."""

    texts: str = ""
    headers: str = ""
    commentary: bool = False
    any_number: bool = False
    need_unit: bool = False
    snippets: int = 3


@dataclass(frozen=True)
class Extract(Stage):
    """Linked, mention and refused rows of the candidates' texts."""

    needs: ClassVar = {"candidates": ("ddb_id",)}
    candidates: str = ""
    texts: str = ""
    commentary: bool = False
    need_unit: bool = False
    window: int = 80
    least: float = 25.0
    several: bool = False
    top: int = 1
    primary: str = "also"
    max_docs: int = 0


@dataclass(frozen=True)
class Windows(Stage):
    """Windows of the candidates' texts, with a client's answers unless it is a dry run."""

    needs: ClassVar = {"candidates": ("ddb_id",)}
    candidates: str = ""
    texts: str = ""
    width: int = 200
    most: int = 20
    any_window: bool = False
    written_place: bool = False
    client: str = ""
    max_docs: int = 0


@dataclass(frozen=True)
class Clean(Stage):
    """Canonical rows, tiers, outliers, trends, index and review queue of linked rows."""

    needs: ClassVar = {"linked": ("ddb_id", "mention_id", "grain_form", "qty_value", "qty_unit", "price_value", "price_cur", "score", "place", "date_when", "date_notbefore", "date_notafter", "context_window")}
    linked: str = ""
    least: float = 25.0
    drop_ambiguous: bool = False
    any_context: bool = False
    year_bin: int = 25
    smooth: int = 3
    baseline_start: int = 50
    baseline_end: int = 99
    outlier_z: float = 4.0
    review: int = 600


@dataclass(frozen=True)
class Trends(Stage):
    """Robust trends of standard prices of one commodity, by year bin and by place."""

    needs: ClassVar = {"primary": ("ddb_id", "grain", "score", "year", "year_bin", "place_canon", "price_per_artaba")}
    primary: str = ""
    least: float = 0.0
    drop_ambiguous: bool = False
    year_min: float | None = None
    year_max: float | None = None
    grain: str = "wheat (pyros)"
    min_n: int = 3
    places: int = 6
    mad_z: float = 4.0
    winsor: float = 0.0
    extremes: int = 50


@dataclass(frozen=True)
class Sample(Stage):
    """Linked rows for annotation, by score and clarity."""

    needs: ClassVar = {"linked": ("ddb_id", "mention_id", "score", "ambiguous")}
    linked: str = ""
    per_bin: int = 10
    max_score: int = 80
    seed: int = 42
    fill: bool = False


@dataclass(frozen=True)
class Gold(Stage):
    """The annotator's sheet of windows."""

    needs: ClassVar = {"windows": ("ddb_id", "grain_form", "window_text", "has_money", "char_offset"), "linked": ("ddb_id", "is_primary"), "labels": ("ddb_id", "label_form", "label", "priority")}
    windows: str = ""
    linked: str = ""
    labels: str = ""
    n: int = 150
    seed: int = 42


@dataclass(frozen=True)
class Recall(Stage):
    """Which entries of an external list the stages found."""

    needs: ClassVar = {"entries": ("source",), "candidates": ("ddb_id",), "linked": ("ddb_id",), "judged": ("ddb_id", "is_price")}
    entries: str = ""
    candidates: str = ""
    linked: str = ""
    judged: str = ""


STAGES: dict[str, type[Stage]] = {c.__name__.lower(): c for c in (Harvest, Extract, Windows, Clean, Trends, Sample, Gold, Recall)}


def checked(df: DataFrame, stage: Stage, name: str) -> DataFrame:
    """An input with its columns in small letters; ValueError where one that the stage needs is missing."""
    out = df.toDF(*[c.lower() for c in df.columns])
    missing = [c for c in stage.needs.get(name, ()) if c not in out.columns]
    if missing:
        raise ValueError(f"{name}: missing columns: {', '.join(missing)}")
    return out


def _kind(annotation: str) -> Any:
    return {"int": int, "float": float, "float | None": float, "str": str}[annotation]


def parser() -> argparse.ArgumentParser:
    """One command a stage, one flag a field: a field that is empty by default must be given, unless the stage
    can do without it."""
    top = argparse.ArgumentParser(prog="sitometry", description="Commodity prices from marked-up texts, stage by stage.")
    commands = top.add_subparsers(dest="stage", required=True)
    for name, cls in STAGES.items():
        p = commands.add_parser(name, help=cls.__doc__)
        for f in fields(cls):
            flag = "--" + f.name.replace("_", "-")
            if f.type == "bool":
                p.add_argument(flag, action="store_true")
            else:
                must = f.default is MISSING or (f.default == "" and f.name not in ("client", "labels", "judged"))
                p.add_argument(flag, type=_kind(f.type), required=must, default=None if must else f.default)
    return top


def parsed(argv: list[str] | None = None) -> Stage:
    found = vars(parser().parse_args(argv))
    return STAGES[found.pop("stage")](**found)
