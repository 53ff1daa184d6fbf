"""Packages (ZIP files with XML parts) as fact tables.

packages -> members -> nodes, relationships, content types. Each step is a DataFrame; a
package that can't be read becomes a row with a code, never an exception, so one bad file
doesn't fail a batch. Per-row Python only unpacks one archive or parses one part.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from urllib.parse import unquote
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T
from .archive import Limits, part_name  # noqa: F401
from .package_source import PackageSource, rows

# Namespaces by the prefix that tags and attributes get here.
PREFIXES = {
    "http://schemas.openxmlformats.org/wordprocessingml/2006/main": "w",
    "http://purl.oclc.org/ooxml/wordprocessingml/main": "strict",
    "http://schemas.openxmlformats.org/officeDocument/2006/relationships": "r",
    "http://schemas.openxmlformats.org/package/2006/relationships": "rel",
    "http://schemas.openxmlformats.org/package/2006/content-types": "ct",
    "http://schemas.openxmlformats.org/markup-compatibility/2006": "mc",
    "http://schemas.openxmlformats.org/drawingml/2006/main": "a",
    "http://schemas.openxmlformats.org/presentationml/2006/main": "p",
    "http://schemas.microsoft.com/office/word/2010/wordml": "w14",
    "http://schemas.microsoft.com/office/word/2012/wordml": "w15",
    "http://schemas.microsoft.com/office/word/2023/wordml/word16du": "w16du",
    "http://www.w3.org/XML/1998/namespace": "xml",
}
DEPTH = 256

TEXT, INT, LONG, FLAG = pa.string(), pa.int32(), pa.int64(), pa.bool_()
MEMBER_SCHEMA = pa.schema({
    "doc": TEXT, "ord": INT, "name": TEXT, "part": TEXT, "size": LONG, "packed": LONG, "crc": LONG, "is_dir": FLAG, "data": pa.binary(), "code": TEXT, "message": TEXT,
})
NODE_SCHEMA = pa.schema({
    "doc": TEXT, "part": TEXT, "id": INT, "parent": INT, "last": INT, "depth": INT, "sib": INT, "tag": TEXT, "text": TEXT, "tail": TEXT, "attrs": pa.map_(TEXT, TEXT),
    "anc_tags": pa.list_(TEXT), "anc_ids": pa.list_(INT), "xml_space": TEXT, "alt_branch": FLAG, "error": TEXT,
})


MEMBERS = "doc string, ord int, name string, part string, size long, packed long, crc long, is_dir boolean, data binary, code string, message string"
NODES = (
    "doc string, part string, id int, parent int, last int, depth int, sib int, tag string, text string, tail string, "
    "attrs map<string,string>, anc_tags array<string>, anc_ids array<int>, xml_space string, alt_branch boolean, error string"
)


def load(spark: SparkSession, paths: list[str]) -> DataFrame:
    """packages(doc, content) of files and globs; a path that names nothing is a row with
    null content (PKG000 later), a pattern that names none raises ValueError."""
    out, missing = None, []
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop):
            if any(c in path for c in "*?[{"):
                raise ValueError(f"no file matches {path}")
            missing.append((path, None))
            continue
        found = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc"), "content")
        out = found if out is None else out.unionByName(found)
    if missing or out is None:
        empty = spark.createDataFrame(missing, "doc string, content binary")
        out = empty if out is None else out.unionByName(empty)
    return out


def opened(spark: SparkSession, paths: list[str], **options: object) -> DataFrame:
    """The members of the files and patterns by ranges: filters on name and part decide what is
    read of a package. Options are the fields of Limits and inflate."""
    spark.dataSource.register(PackageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("packages").options(path=",".join(paths), **options).load()


def _entries(doc: str, content: bytes | None, limits: Limits, inflate: bool) -> Iterator[tuple]:
    if content is None:
        yield (doc, -1, None, None, None, None, None, None, None, "PKG000", "file is missing")
        return
    yield from rows(doc, lambda at, n: content[at : at + n], len(content), limits, None, inflate)


def members(packages: DataFrame, limits: Limits = Limits(), inflate: bool = True) -> DataFrame:
    """A row for each member, or one row with a code for a package that can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in _entries(doc, content, limits, inflate):  # a member is a batch of its own
                    yield pa.RecordBatch.from_pylist([dict(zip(MEMBER_SCHEMA.names, row))], MEMBER_SCHEMA)

    return packages.select("doc", "content").mapInArrow(run, MEMBERS)


class _Parts:
    """Rows of one part, in document order."""

    def __init__(self, doc: str, part: str):
        self.doc, self.part, self.rows, self.stack = doc, part, [], []

    @staticmethod
    def name(raw: str) -> str:
        ns, _, local = raw.rpartition(" ")
        return f"{PREFIXES.get(ns, '{' + ns + '}')}:{local}" if ns else local

    def start(self, raw: str, attrs: dict[str, str]) -> None:
        if len(self.stack) >= DEPTH:
            raise ValueError(f"deeper than {DEPTH} levels")
        own = {self.name(k): v for k, v in attrs.items()}
        up = self.stack[-1] if self.stack else None
        tag = self.name(raw)
        alt = bool(up and up["alt_branch"])
        if up is not None and up["tag"] == "mc:AlternateContent" and tag in ("mc:Choice", "mc:Fallback"):
            alt = alt or up["branches"] > 0
            up["branches"] += 1
        row = {
            "doc": self.doc, "part": self.part, "id": len(self.rows), "parent": up and up["id"], "last": None, "depth": len(self.stack),
            "sib": up["children"] if up else 0, "tag": tag, "text": "", "tail": "", "attrs": own, "alt_branch": alt, "error": None,
            "anc_tags": [r["tag"] for r in reversed(self.stack)], "anc_ids": [r["id"] for r in reversed(self.stack)],
            "xml_space": own.get("xml:space", up["xml_space"] if up else None), "children": 0, "branches": 0,
        }
        if up is not None:
            up["children"] += 1
            up["at"] = row
        self.rows.append(row)
        self.stack.append(row)

    def end(self, _: str) -> None:
        self.stack.pop()["last"] = len(self.rows) - 1

    def chars(self, text: str) -> None:
        if self.stack:
            top = self.stack[-1]
            if "at" in top:
                top["at"]["tail"] += text
            else:
                top["text"] += text


def _parse(doc: str, part: str, data: bytes) -> list[dict]:
    """Rows of a part, or one row with the error. No DTD, so no entities either."""
    parts, parser = _Parts(doc, part), expat.ParserCreate(namespace_separator=" ")

    def refuse(*_: object) -> None:
        raise ValueError("a document type declaration is not allowed")

    parser.StartDoctypeDeclHandler = refuse
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = parts.start, parts.end, parts.chars
    parser.buffer_text = True
    try:
        parser.Parse(data, True)
    except (expat.ExpatError, ValueError) as e:
        return [{"doc": doc, "part": part, "error": str(e)}]
    return parts.rows


def nodes(members: DataFrame) -> DataFrame:
    """nodes of the XML members of members(doc, part, data); a part that can't be parsed is
    one row with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, part, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                yield pa.RecordBatch.from_pylist([{**r, "attrs": list(r.get("attrs", {}).items())} for r in _parse(doc, part, data)], NODE_SCHEMA)

    xml = members.where("data is not null and not is_dir and (part rlike '[.](xml|rels)$')")
    return xml.select("doc", "part", "data").mapInArrow(run, NODES)


def _candidates(owner: str, target: str) -> list[str]:
    """Names that a relationship target may mean: as written and unescaped."""
    out = []
    for text in dict.fromkeys((target.split("#")[0], unquote(target.split("#")[0]))):
        if not text:
            continue
        path = text[1:] if text.startswith("/") else posixpath.join(posixpath.dirname(owner), text)
        path = posixpath.normpath(path)
        if not path.startswith(".."):
            out.append(re.sub("[A-Z]", lambda m: m[0].lower(), path))
    return list(dict.fromkeys(out))


@F.pandas_udf(ArrayType(StringType()))
def target_candidates(owner: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([_candidates(o or "", t or "") for o, t in zip(owner, target)])


def relationships(tree: DataFrame) -> DataFrame:
    """rels(doc, part, owner, ord, rid, type, target, mode, candidates) of nodes. The owner of
    `_rels/.rels` is the empty name."""
    rows = tree.where("tag = 'rel:Relationship' and part like '%.rels' and depth = 1")
    owner = F.concat(F.regexp_extract("part", r"^(.*?)_rels/[^/]*\.rels$", 1), F.regexp_extract("part", r"_rels/([^/]*)\.rels$", 1))
    out = rows.select(
        "doc", "part", owner.alias("owner"), F.col("id").alias("ord"),
        F.col("attrs")["Id"].alias("rid"), F.coalesce(F.col("attrs")["Type"], F.lit("")).alias("type"),
        F.col("attrs")["Target"].alias("target"), F.col("attrs")["TargetMode"].alias("mode"),
    )
    return out.withColumn("candidates", target_candidates("owner", "target"))


def content_types(tree: DataFrame) -> DataFrame:
    """(doc, ord, kind, raw, covered, part_key, media_type) of `[Content_Types].xml`."""
    rows = tree.where("part = '[content_types].xml' and tag in ('ct:Default', 'ct:Override')")
    raw = F.coalesce(F.col("attrs")["PartName"], F.col("attrs")["Extension"])
    return rows.select(
        "doc", F.col("id").alias("ord"), F.substring("tag", 4, 10).alias("kind"), raw.alias("raw"),
        F.regexp_replace(T.ascii_lower(raw), "^/", "").alias("covered"), T.part_key(raw).alias("part_key"),
        T.media_type(F.col("attrs")["ContentType"]).alias("media_type"),
    )
