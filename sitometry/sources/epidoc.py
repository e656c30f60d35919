"""EpiDoc XML: files, metadata and text blocks."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TEI = "{http://www.tei-c.org/ns/1.0}"
BLOCK_TAGS = tuple(TEI + t for t in ("ab", "p", "seg", "l"))
BLOCKS = "array<struct<div_no:int,block_no:int,tag:string,raw:string,value_text:string,bar_text:string,num_tags:int,num_values:array<string>,num_texts:array<string>>>"


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, content`` of every ``*.xml`` below a folder, by any file system Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(root)
    return files.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), "content")


def decoded(content: str) -> Column:
    return F.decode(content, "UTF-8")


def read_xml(spark: SparkSession, root: str) -> DataFrame:
    """``path, xml`` of every ``*.xml`` below a folder."""
    return read_files(spark, root).select("path", decoded("content").alias("xml"))


def of_candidates(candidates: DataFrame, files: DataFrame, root: str, rel_path: str = "rel_path") -> DataFrame:
    """The candidates with the ``path, xml`` of the file at their path below ``root``; both are NULL
    where there is no file, which ``parsed`` reports as not ok."""
    below = F.regexp_replace("path", "^[a-z]+:/*(?=/)", "")
    start = "/" + root.split(":", 1)[-1].strip("/") + "/"
    known = files.select(F.when(below.startswith(start), F.substring(below, len(start) + 1, 1 << 30)).alias("_rel"), "path", "xml")
    return candidates.drop("path", "xml").join(known, F.replace(rel_path, F.lit("\\"), F.lit("/")) == F.col("_rel"), "left").drop("_rel")


HEADER = ("ddb_id", "title", "place", "date_text", "date_when", "date_notbefore", "date_notafter")


def header(xml: str) -> tuple[str, ...] | None:
    """Id, title, place and dates of a document's header, or None where it does not parse."""
    try:
        root = ET.fromstring(xml)
    except (ET.ParseError, ValueError):
        return None
    first = lambda path: next(iter(root.iterfind(path, {"t": TEI[1:-1]})), None)
    text = lambda path: "" if (n := first(path)) is None else _flat(n)
    date = first(".//t:origDate")
    dates = ["" if date is None else (date.get(k) or "").strip() for k in ("when", "notBefore", "notAfter")]
    return (_ident(root), text(".//t:titleStmt/t:title"), text(".//t:origPlace"), text(".//t:origDate"), *dates)


def _ident(root: ET.Element) -> str:
    ids = list(root.iter(TEI + "idno"))
    own = [i for i in ids if i.get("type") == "ddb-hybrid"] or ids
    return _flat(own[0]) if own else ""


def metadata(files: DataFrame) -> DataFrame:
    """Header fields of each document that parses; of files with one id the last by path counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *h) for p, x in zip(b["path"], b["xml"]) if (h := header(x or "")) and h[0]]
            yield pd.DataFrame(rows, columns=["path", *HEADER])

    rows = files.select("path", "xml").mapInPandas(run, ", ".join(f"{c} string" for c in ("path", *HEADER)))
    last = Window.partitionBy("ddb_id").orderBy(F.desc("path"))
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "path")


def _flat(node: ET.Element) -> str:
    return " ".join("".join(node.itertext()).split())


def _valued(node: ET.Element, line: str, other: str) -> str:
    """Text with numbers by value and marks for breaks; pieces are joined by a blank."""
    parts: list[str] = []

    def walk(n: ET.Element) -> None:
        name = n.tag.removeprefix(TEI) if isinstance(n.tag, str) else ""
        if name == "num" and (n.get("value") or "").strip():
            parts.append(n.get("value").strip())
        elif name in ("lb", "cb", "pb"):
            parts.append(line if name == "lb" else other.format(name.upper()))
        elif name or n is node:
            parts.append(n.text or "")
            for child in n:
                walk(child)
                parts.append(child.tail or "")

    walk(node)
    return " ".join(" ".join(parts).split())


def parse(xml: str, commentary: bool = False) -> tuple[str, list[dict]] | None:
    """Id and blocks of a document, or None where it does not parse.

    Blocks within blocks are blocks too; comments are left out.
    """
    try:
        root = ET.fromstring(xml)
    except (ET.ParseError, ValueError):
        return None
    kinds = ("edition", "commentary") if commentary else ("edition",)
    blocks = []
    for d, div in enumerate(x for k in kinds for x in root.iter(TEI + "div") if x.get("type") == k):
        for node in div.iter():
            if node.tag in BLOCK_TAGS:
                tagged = [n for n in node.iter(TEI + "num") if n is not node and n.get("value") is not None]
                blocks.append(
                    {
                        "div_no": d, "block_no": len(blocks), "tag": node.tag.removeprefix(TEI), "raw": _flat(node),
                        "value_text": _valued(node, "__LB__", "__{}__").replace("\U00010175", " 1/2 "), "bar_text": _valued(node, "|", "||"), "num_tags": len(tagged),
                        "num_values": [v for n in tagged if (v := n.get("value").strip())], "num_texts": [t for n in tagged if (t := _flat(n))],
                    }
                )
    return (_ident(root), blocks)


def parsed(files: DataFrame, commentary: bool = False, also: list[str] = []) -> DataFrame:  # noqa: B006
    """``path, ok, ddb_id, blocks`` of ``files(path, xml)``, and the columns of text ``also``: one pass, a bad file is a
    row not ok."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [parse(x or "", commentary) for x in b["xml"]]
            yield pd.DataFrame({"path": b["path"], **{c: b[c] for c in also}, "ok": [f is not None for f in found], "ddb_id": [f[0] if f else None for f in found], "blocks": [f[1] if f else [] for f in found]})

    kinds = "".join(f"{c} string, " for c in also)
    return files.select("path", "xml", *also).mapInPandas(run, f"path string, {kinds}ok boolean, ddb_id string, blocks {BLOCKS}")


def blocks_of(documents: DataFrame) -> DataFrame:
    return documents.filter("ok").select("ddb_id", "path", F.explode("blocks").alias("_b")).select("ddb_id", "path", "_b.*")


def errors_of(documents: DataFrame) -> DataFrame:
    return documents.filter("not ok").select("path")
