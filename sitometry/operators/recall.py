"""Recall against an external list: from printed references to document ids to what was found."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# How collections are printed (letters only) and their names in document ids.
COLLECTIONS = {
    "pberlleigh": "p.berl.leihg", "pberlzill": "p.berl.zill", "pberlfrisk": "p.berl.frisk", "pcairgoodsp": "p.cair.goodsp",
    "pcairisid": "p.cair.isid", "pcairzen": "p.cair.zen", "pcol": "p.col", "perl": "p.erl", "pflor": "p.flor", "pgen2": "p.gen.2",
    "pgrenf": "p.grenf", "piand": "p.iand", "pkellis": "p.kell", "plaur": "p.laur", "plond": "p.lond", "plouvre": "p.louvre",
    "plund": "p.lund", "pmich": "p.mich", "pmilvogl": "p.mil.vogl", "pnyu": "p.nyu", "poxy": "p.oxy", "ppragvarcl": "p.prag.varcl",
    "pprag": "p.prag", "pprinc": "p.princ", "pprince": "p.princ", "prossgoerg": "p.ross.georg", "pryl": "p.ryl", "psarap": "p.sarap",
    "psorb": "p.sorb", "pstras": "p.stras", "pworp": "p.worp", "pabinn": "p.abinn", "pbingen": "p.bingen", "pfay": "p.fay",
    "bgu": "bgu", "sb": "sb", "psi": "psi", "spp": "stud.pal", "cpr": "cpr", "oashm": "o.ashm",
}
# Collections whose ids have no volume.
WITHOUT_VOLUME = ("p.sarap", "p.berl.zill", "p.berl.frisk", "p.erl", "o.ashm", "p.cair.goodsp", "p.cair.isid", "p.abinn", "p.bingen", "p.worp", "p.fay")
_DIGITS = {"i": 1, "v": 5, "x": 10}


def roman(text: str) -> str:
    """A Roman numeral up to 22 as digits; anything else as it is."""
    values = [_DIGITS.get(c, 0) for c in text.lower()]
    total = sum(-v if v < w else v for v, w in zip(values, [*values[1:], 0]))
    plain = "x" * (total // 10) + ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"][total % 10] if 0 < total <= 22 else ""
    return str(total) if plain == text.lower() else text.lower()


#: A collection's letters with points and blanks anywhere between them; the longest name wins.
_COLLECTION = re.compile("(?:" + "|".join("[. ]*".join(k) for k in sorted(COLLECTIONS, key=len, reverse=True)) + ")(?![a-z])")
#: What follows it: ``volume.number`` or ``numeral number``, or without a volume ``number``; more is ignored.
_PLACE = re.compile(r"(?:(?P<numeral>[ivxlcdm]+)\s+(?P<counted>\d+)|(?P<first>[^.]*)(?:\.(?P<second>[^.]*))?)")
_LIST = re.compile(r"\d+(?:,\s*\d+)+")


def document_ids(reference: str | None) -> list[str]:
    """The ids ``collection;volume;number`` of a printed reference; an unknown one is its own id.

    Of equated references the first counts, remarks in brackets do not, and a list of numbers gives an
    id for each.
    """
    text = " ".join(re.sub(r"\([^)]*\)", "", (reference or "").partition(" = ")[0]).lower().split())
    known = _COLLECTION.match(text)
    if not known:
        return [text] if text else []
    name = COLLECTIONS[re.sub("[. ]", "", known.group())]
    tail = text[known.end() :].lstrip(" .;")
    place = _PLACE.match(tail)
    if place["numeral"]:
        volume, numbers = roman(place["numeral"]), place["counted"]
    elif name in WITHOUT_VOLUME or place["second"] is None:
        volume, numbers = "", place["first"].strip()
    else:
        volume, numbers = place["first"].strip(), place["second"].strip()
    # a list ends the reference; if more follows, its comma stays with the first number
    each = re.findall(r"\d+", numbers) if _LIST.fullmatch(numbers) and place.end() == len(tail) else numbers.split()[:1] or [""]
    return [f"{name};{volume};{n}" for n in each]


@F.pandas_udf(ArrayType(StringType()))
def reference_ids(s: pd.Series) -> pd.Series:
    return s.map(lambda x: document_ids(x if isinstance(x, str) else None))


def found_in(ids: DataFrame, known: DataFrame, id_col: str, key_col: str, spare: int = 3) -> DataFrame:
    """Rows of ``ids`` whose id equals a known key, or begins one that has at most ``spare`` more letters.

    Each key is shortened by 0 to ``spare`` letters, so the prefix match is an equi join.
    """
    cut = known.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(spare)), lambda k: F.left(key_col, F.greatest(F.length(key_col) - k, F.lit(0))))).alias(id_col)).filter(F.col(id_col) != "").distinct()
    return ids.join(cut, id_col, "left_semi")


def recall_report(entries: DataFrame, sets: dict[str, DataFrame], source: str = "source") -> DataFrame:
    """``entries(entry, source)``: for each one its ids and whether each set has any of them."""
    ids = entries.withColumn("ids", reference_ids(source))
    each = ids.select("entry", F.explode("ids").alias("id"))
    out = ids
    for name, known in sets.items():
        hit = found_in(each, known, "id", known.columns[0]).select("entry").distinct().withColumn(f"in_{name}", F.lit(True))
        out = out.join(hit, "entry", "left").withColumn(f"in_{name}", F.coalesce(f"in_{name}", F.lit(False)))
    return out


def recall_summary(report: DataFrame) -> DataFrame:
    flags = [c for c in report.columns if c.startswith("in_")]
    return report.agg(F.count(F.lit(1)).alias("entries"), *[F.avg(F.col(c).cast("double")).alias(f"recall_{c[3:]}") for c in flags])
