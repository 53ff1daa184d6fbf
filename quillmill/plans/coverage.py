"""Which surfaces of a document were looked at, and which were not.

coverage(doc, surface, status, reason, n): a row for each document and surface. A document
without findings is clean only where its surfaces are checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import relations
from . import document_rules as D

# What may be said of a surface.
STATUSES = ["checked", "not-present", "estimated", "skipped", "unsupported"]
# The surfaces that each group of rules covers.
COVERS = {
    "package_rules": ["package.content-types", "package.related-content-types"],
    "entry_rules": ["package.relationships"],
    "relationship_rules": ["package.relationships"],
    "style_rules": ["docx.styles"],
    "numbering_rules": ["docx.numbering"],
    "note_and_comment_rules": ["docx.footnotes", "docx.comments"],
    "body_rules": ["docx.revisions", "docx.tables", "docx.content-controls", "docx.text-whitespace", "docx.literal-entities"],
}
# Surfaces that a comparison with a source covers.
COMPARED = ["main-story", "revision-text", "insertion-attribution", "note-revisions", "note-bodies", "headers-footers"]
REVISIONS = ["w:ins", "w:del", "w:moveFrom", "w:moveTo"]


def _tag(*names: str) -> Column:
    return F.col("tag").isin(*names)


def counts(f: D.Facts) -> DataFrame:
    """A row for each package that was opened, with a number for all that a surface depends on."""
    files = f.members.where("ord >= 0 and part is not null and not is_dir").groupBy("doc").agg(
        F.count("*").alias("members"), F.count_if(F.col("part").rlike("[.](xml|rels)$")).alias("xml"), F.count_if(F.col("part").endswith(".rels")).alias("rels"),
        F.count_if(F.col("part") == "word/styles.xml").alias("style_part"), F.count_if(F.col("part").rlike(r"^word/(header|footer)[^/]*\.xml$")).alias("margins"),
        F.count_if(F.col("part").rlike("^word/(media|embeddings)/")).alias("media"),
    )
    bad = F.col("error").isNotNull()
    parts = f.nodes.where("error is not null or depth = 0").groupBy("doc").agg(
        F.count_if(bad).alias("bad_xml"), F.count_if(bad & F.col("part").endswith(".rels")).alias("bad_rels"), F.count_if(~bad & (F.col("part") == "_rels/.rels")).alias("root_rels"),
        F.count_if(~bad & (F.col("part") == "[content_types].xml")).alias("types"), F.count_if(bad & (F.col("part") == "word/styles.xml")).alias("bad_styles"),
        F.count_if(bad & (F.col("part") == "word/comments.xml")).alias("bad_comments"),
    )
    tags = ["w:pStyle", "w:rStyle", "w:tblStyle"]
    body = f.body.groupBy("doc").agg(
        F.count_if((F.col("depth") == 0) & _tag("w:document")).alias("document"), F.count_if((F.col("depth") == 0) & _tag("strict:document")).alias("strict"),
        F.count_if(_tag(*tags)).alias("style_refs"), F.count_if(_tag("w:numPr")).alias("lists"), F.count_if(_tag("w:footnoteReference")).alias("note_refs"),
        F.count_if(_tag(*REVISIONS)).alias("revisions"), F.count_if(_tag("w:tbl")).alias("tables"), F.count_if(_tag("w:sdt")).alias("controls"), F.count_if(_tag("w:t")).alias("texts"),
    )
    defined = f.nodes.where("depth = 1 and part in ('word/styles.xml', 'word/footnotes.xml', 'word/comments.xml')").groupBy("doc").agg(
        F.count_if(_tag("w:style")).alias("style_defs"), F.count_if(_tag("w:footnote")).alias("notes"), F.count_if(_tag("w:comment")).alias("comments")
    )
    stories = D.story_parts(f)
    told = f.nodes.join(stories, ["doc", "part"]).groupBy("doc").agg(
        F.count_if(bad & F.lit(True)).alias("bad_stories"), F.count_if(_tag("w:commentReference") & ~F.col("alt_branch")).alias("comment_refs"), F.count_if(_tag("w:t", "w:delText")).alias("values")
    )
    levels = f.nodes.where("part = 'word/numbering.xml'").groupBy("doc").agg(F.count_if(_tag("w:lvlText")).alias("levels"), F.count_if(bad).alias("bad_numbering"))
    related = f.rels.join(f.main.withColumnRenamed("part", "owner"), ["doc", "owner"]).where(F.col("type").isin(*D.RELATED)).groupBy("doc").agg(F.count("*").alias("related"))
    out = files
    for table in (parts, body, defined, told, levels, related):
        out = out.join(table, "doc", "left")
    return out.na.fill(0)


def coverage(f: D.Facts, findings: DataFrame, compared: DataFrame | None = None) -> DataFrame:
    """Coverage of all packages of f, given check()'s findings; compared(doc, failed): those that
    were compared with a source, or failed to be."""
    c = F.col
    n = relations.cut(counts(f))
    gap = F.when(c("strict") > 0, "unsupported").when(c("document") == 0, "skipped")
    why = F.when(c("strict") > 0, "the main part is of the strict kind, which no rule reads").otherwise("the main part is missing, can't be parsed, or is no word processing document")
    present = lambda k: F.when(k > 0, "checked").otherwise("not-present")

    def of(surface: str, status: Column, number: Column | None, reason: Column | str) -> Column:
        return F.struct(
            F.lit(surface).alias("surface"), status.alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
            (F.lit(None) if number is None else number).cast("long").alias("n"),
        )

    def in_body(surface: str, number: Column, what: str, unread: Column | None = None, unread_why: str = "") -> Column:
        status, reason = F.coalesce(gap.cast("string"), present(number)), F.when(gap.isNotNull(), why).when(number > 0, F.concat(F.lit("looked at "), number, F.lit(f" {what}"))).otherwise(f"there are no {what}")
        if unread is not None:
            status, reason = F.when(gap.isNull() & unread, "skipped").otherwise(status), F.when(gap.isNull() & unread, unread_why).otherwise(reason)
        return of(surface, F.when(status == "unsupported", "skipped").otherwise(status), F.when(gap.isNull(), number), reason)

    both = lambda a, b: c(a) + c(b)
    rels_ok = (c("root_rels") > 0) & (c("bad_rels") == 0)
    rows = [
        of("package.read", F.lit("checked"), c("members"), F.concat(F.lit("within the budgets, "), "members", F.lit(" members read"))),
        of("package.xml", F.when(c("bad_xml") > 0, "skipped").otherwise("checked"), c("xml"), F.when(c("bad_xml") > 0, F.concat("bad_xml", F.lit(" of "), "xml", F.lit(" XML parts can't be parsed safely"))).otherwise(F.concat(F.lit("parsed "), "xml", F.lit(" XML parts")))),
        of("package.content-types", F.when(c("types") > 0, "checked").otherwise("skipped"), None, F.when(c("types") > 0, "looked at").otherwise("[Content_Types].xml is missing or can't be parsed")),
        of("package.relationships", F.when(rels_ok, "checked").otherwise("skipped"), c("rels"), F.when(rels_ok, "looked at").otherwise("a relationship part is missing or can't be parsed")),
        of("package.related-content-types", F.when(c("strict") > 0, "unsupported").when((c("types") == 0) | ~rels_ok | (c("document") == 0), "skipped").otherwise(present(c("related"))), c("related"), F.when(c("related") > 0, "related parts were compared with their types").otherwise("nothing to compare, or types or relationships can't be read")),
        in_body("docx.styles", both("style_refs", "style_defs"), "style references and definitions", c("bad_styles") > 0, "word/styles.xml can't be parsed"),
        in_body("docx.numbering", c("lists"), "list properties"),
        in_body("docx.footnotes", both("note_refs", "notes"), "footnote references and definitions"),
        in_body("docx.comments", both("comment_refs", "comments"), "comment references and definitions", (c("bad_comments") > 0) | (c("bad_stories") > 0), "the comments or a story with their anchors can't be parsed"),
        in_body("docx.revisions", c("revisions"), "tracked changes"), in_body("docx.tables", c("tables"), "tables"),
        in_body("docx.content-controls", c("controls"), "content controls"), in_body("docx.text-whitespace", c("texts"), "texts"),
        in_body("docx.literal-entities", both("values", "levels"), "texts and list levels", (c("bad_stories") > 0) | (c("bad_numbering") > 0), "a story or the numbering can't be parsed"),
        of("docx.header-footer-semantics", F.when(c("margins") > 0, "unsupported").otherwise("not-present"), c("margins"), F.when(c("margins") > 0, "headers and footers were read, their layout was not").otherwise("there are no headers or footers")),
        of("docx.media-content", F.when(c("media") > 0, "unsupported").otherwise("not-present"), c("media"), F.when(c("media") > 0, "relationships to media were checked, their bytes were not").otherwise("there are no media")),
        of("docx.strict-wordprocessingml", F.when(c("strict") > 0, "unsupported").otherwise("not-present"), F.least(c("strict"), F.lit(1)), F.when(c("strict") > 0, "no rule reads the strict kind").otherwise("not of the strict kind")),
    ]
    told = n.select("doc", F.inline(F.array(*rows)))
    asked = compared if compared is not None else f.members.sparkSession.createDataFrame([], "doc string, failed boolean")
    sides = n.select("doc").join(asked.select("doc", "failed").distinct(), "doc", "left")
    status = F.when(c("failed"), "skipped").when(c("failed").isNull(), "skipped").otherwise("checked")
    reason = F.when(c("failed"), "the comparison could not be run").when(c("failed").isNull(), "no comparison with a source was asked for").otherwise("compared with the source")
    told = told.unionByName(sides.select("doc", F.inline(F.array(*(of(f"docx.fidelity.{s}", status, None, reason) for s in COMPARED)))))
    # rules that were not completed leave what they cover unseen
    covers = F.create_map(*[x for k, v in COVERS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    failed = findings.where("code = 'INT001'").select("doc", F.explode(covers[F.col("subject")]).alias("surface"), F.col("message").alias("failure"))
    failed = failed.groupBy("doc", "surface").agg(F.min("failure").alias("failure"))
    told = told.join(failed, ["doc", "surface"], "left")
    told = told.select("doc", "surface", F.when(c("failure").isNotNull(), "skipped").otherwise(c("status")).alias("status"), F.coalesce("failure", "reason").alias("reason"), "n")
    # a package that can't be opened has one surface, unseen
    whole = f.members.where("ord < 0 or code in ('PKG007', 'PKG008')").groupBy("doc").agg(F.min("message").alias("reason"))
    unread = whole.select("doc", F.lit("package.read").alias("surface"), F.lit("skipped").alias("status"), F.concat(F.lit("the package can't be read: "), "reason").alias("reason"), F.lit(None).cast("long").alias("n"))
    return told.join(whole.select("doc"), "doc", "left_anti").unionByName(unread)


def summary(rows: DataFrame) -> DataFrame:
    """(doc, one column for each status): how many surfaces have it, also none."""
    return rows.groupBy("doc").agg(*(F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in STATUSES))
