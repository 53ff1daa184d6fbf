"""Rules of one package: each is a query over the fact tables and yields findings.

findings(doc, code, severity, where, part, subject, message): `subject` is the id or name
that the finding is about.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relations
from ..sources import packages as P

OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
WORD = "application/vnd.openxmlformats-officedocument.wordprocessingml."
MICROSOFT = "http://schemas.microsoft.com/office/"
COMMENTS = OFFICE + "comments"
# Media types of the parts that the main document is related to, by relationship type.
RELATED = {
    **{OFFICE + k: WORD + k + "+xml" for k in ("styles", "numbering", "settings", "webSettings", "fontTable", "footnotes", "endnotes", "header", "footer", "comments")},
    OFFICE + "theme": "application/vnd.openxmlformats-officedocument.theme+xml",
    MICROSOFT + "2011/relationships/commentsExtended": WORD + "commentsExtended+xml",
    MICROSOFT + "2016/09/relationships/commentsIds": WORD + "commentsIds+xml",
    MICROSOFT + "2018/08/relationships/commentsExtensible": WORD + "commentsExtensible+xml",
    MICROSOFT + "2011/relationships/people": WORD + "people+xml",
}
# Pieces of the relationship types that a part uses without naming their id.
IMPLICIT = [
    "styles", "numbering", "footnotes", "endnotes", "comments", "settings", "fontTable", "theme", "webSettings", "customXml",
    "people", "commentsExtended", "commentsIds", "glossaryDocument",
]
RANK = {"error": 3, "warn": 2, "info": 1}


@dataclass
class Facts:
    members: DataFrame
    nodes: DataFrame
    rels: DataFrame
    types: DataFrame
    main: DataFrame  # (doc, part): the main document part of each package

    @property
    def body(self) -> DataFrame:
        return self.nodes.join(self.main, ["doc", "part"])


def facts(packages: DataFrame, limits: P.Limits = P.Limits()) -> Facts:
    # tables that every rule reads: cut here, or each rule's plan would hold all of them
    members = relations.cut(P.members(packages, limits))
    tree = relations.cut(P.nodes(members))
    rels = relations.cut(P.relationships(tree))
    root = rels.where((F.col("owner") == "") & F.col("type").endswith("/officeDocument") & ~F.col("mode").eqNullSafe("External"))
    named = root.select("doc", F.get("candidates", F.lit(0)).alias("part")).distinct()
    one = named.groupBy("doc").agg(F.min("part").alias("part"), F.count("*").alias("n")).where("n = 1").select("doc", "part")
    usual = members.where("part = 'word/document.xml'").select("doc", "part").join(one.select("doc"), "doc", "left_anti")
    return Facts(members, tree, rels, relations.cut(P.content_types(tree)), relations.cut(one.unionByName(usual)))


def found(df: DataFrame, code: str | Column, severity: str | Column, message: Column | str, subject: Column | str | None = None, part: Column | str | None = None, where: Column | None = None) -> DataFrame:
    def as_column(x: Column | str | None) -> Column:
        return F.lit(x).cast("string") if x is None or isinstance(x, str) else x.cast("string")

    return df.select(
        "doc", as_column(code).alias("code"), as_column(severity).alias("severity"), as_column(where).alias("where"),
        (F.col("part") if part is None and "part" in df.columns else as_column(part)).alias("part"), as_column(subject).alias("subject"), as_column(message).alias("message"),
    )


def _at() -> Column:
    return F.concat(F.col("tag"), F.lit("#"), F.col("id"))


def rels_of_package(f: Facts) -> DataFrame:
    """(doc) of the packages whose `_rels/.rels` was read."""
    return f.nodes.where("part = '_rels/.rels' and depth = 0 and error is null").select("doc")


def wrong_related_types(f: Facts) -> DataFrame:
    """(doc, part, wanted, media_type): parts that a plain main document is related to, whose
    content type isn't that of the relationship; for a part the first relationship counts."""
    over = f.types.where("kind = 'Override'").select("doc", F.col("part_key").alias("part"), "media_type")
    default = f.types.where("kind = 'Default'").groupBy("doc", F.col("covered").alias("ext")).agg(F.max_by("media_type", "ord").alias("by_ext"))

    def declared(parts: DataFrame) -> DataFrame:
        out = parts.withColumn("ext", F.regexp_extract("part", r"\.([^./]*)$", 1)).join(over, ["doc", "part"], "left").join(default, ["doc", "ext"], "left")
        return out.withColumn("media_type", F.coalesce("media_type", "by_ext")).where("media_type is not null")

    once = declared(f.main).groupBy("doc", "part").agg(F.count("*").alias("n"), F.min("media_type").alias("media_type")).where("n = 1")
    plain = once.where(F.col("media_type") == T.media_type(F.lit(WORD + "document.main+xml")))
    plain = plain.join(f.nodes.where("depth = 0 and tag = 'w:document'").select("doc", "part"), ["doc", "part"]).select("doc", F.col("part").alias("owner"))
    wanted = F.create_map(*[F.lit(x) for kv in RELATED.items() for x in kv])[F.col("type")]
    files = f.members.where("part is not null").select("doc", "part")
    rels = f.rels.where("mode is null or mode <> 'External'").join(plain, ["doc", "owner"]).withColumn("wanted", wanted).where("wanted is not null")
    # of the names that a target may mean, the first that exists
    rows = rels.select("doc", "ord", "wanted", F.posexplode("candidates").alias("k", "part")).join(files, ["doc", "part"])
    rows = rows.groupBy("doc", "ord", "wanted").agg(F.min_by("part", "k").alias("part"))
    wrong = declared(rows).where(F.col("media_type") != T.media_type(F.col("wanted")))
    return wrong.groupBy("doc", "part").agg(*(F.min_by(c, F.struct("ord", "media_type")).alias(c) for c in ("wanted", "media_type")))


def entry_rules(f: Facts) -> list[DataFrame]:
    """The package must lead to one main document."""
    docs = f.members.where("ord >= 0 and code is null").select("doc").distinct()
    files = f.members.where("part = '_rels/.rels'").select("doc")
    office = f.rels.where((F.col("owner") == "") & F.col("type").endswith("/officeDocument"))
    inner = office.where("(mode is null or mode <> 'External') and coalesce(target, '') <> ''")
    read = rels_of_package(f)
    several = inner.groupBy("doc").agg(F.count_distinct(F.get("candidates", F.lit(0))).alias("n")).where("n > 1")
    say = lambda df, text: found(df, "REL001", "error", text, None, "_rels/.rels")
    return [
        say(docs.join(files, "doc", "left_anti"), "no _rels/.rels: the package has no entry"),
        say(read.join(office, "doc", "left_anti"), "no officeDocument relationship: the package has no entry"),
        say(office.join(inner, "doc", "left_anti").select("doc").distinct(), "the officeDocument relationship has no internal target"),
        say(several, F.concat(F.lit("officeDocument relationships to "), "n", F.lit(" different parts"))),
    ]


def package_rules(f: Facts) -> list[DataFrame]:
    docs = f.members.where("ord >= 0 and code is null").select("doc").distinct()
    files = f.members.where("part is not null and not is_dir and part <> '[content_types].xml'").select("doc", "part")
    typed = f.nodes.where("part = '[content_types].xml'").select("doc").distinct()
    overrides = f.types.where("kind = 'Override'").select("doc", F.col("covered").alias("part"))
    defaults = f.types.where("kind = 'Default'").select("doc", F.col("covered").alias("ext"))
    checked = files.join(typed, "doc", "left_semi")
    rels_parts = checked.where("part like '%.rels'")
    uncovered_rels = relations.anti_ref(rels_parts, overrides, ["doc", "part"]).select("doc").distinct().withColumn("open", F.lit(True))
    no_default = relations.anti_ref(typed.withColumn("ext", F.lit("rels")), defaults, ["doc", "ext"]).select("doc").join(uncovered_rels, "doc", "left")
    extension = F.regexp_extract("part", r"\.([^./]*)$", 1)
    untyped = relations.anti_ref(relations.anti_ref(checked.where("part not like '%.rels'"), overrides, ["doc", "part"]).withColumn("ext", extension), defaults, ["doc", "ext"])
    repeated = f.types.withColumn("name", F.when(F.col("kind") == "Override", F.col("part_key")).otherwise(F.col("covered")))
    repeated = relations.dup_keys(repeated, ["doc", "kind", "name"])
    roots = f.nodes.where("depth = 0").join(f.main, ["doc", "part"])
    no_main = docs.join(roots.where("tag in ('w:document', 'p:presentation', 'strict:document')").select("doc"), "doc", "left_anti")
    wrong = wrong_related_types(f)
    unread = f.nodes.where("error is not null")
    reach = relations.reachable(
        docs.withColumn("node", F.lit("")),
        f.rels.where("mode is null or mode <> 'External'").select("doc", F.col("owner").alias("src"), F.explode("candidates").alias("dst")),
    ).select("doc", F.col("node").alias("part"), F.lit(True).alias("reached"))
    # a relationship part is reached with its owner; if one can't be read, what it reaches is unknown
    of = F.concat(F.regexp_extract("part", r"^(.*?)_rels/[^/]*\.rels$", 1), F.regexp_extract("part", r"_rels/([^/]*)\.rels$", 1))
    paths = unread.where("part like '%.rels'").select("doc", F.col("part").alias("rels"), of.alias("part")).join(reach, ["doc", "part"])
    unknown = paths.select("doc").unionByName(docs.join(rels_of_package(f), "doc", "left_anti")).distinct().withColumn("unknown", F.lit(True))
    reach = reach.unionByName(docs.select("doc", F.lit("[content_types].xml").alias("part"), F.lit(True).alias("reached"))).distinct()
    unread = unread.join(reach, ["doc", "part"], "left").join(unknown, "doc", "left")
    return [
        found(f.members.where("code is not null"), F.col("code"), "error", F.col("message"), F.col("name"), F.col("name")),
        found(docs.join(f.members.where("part = '[content_types].xml'").select("doc"), "doc", "left_anti"), "PKG003", "error", "no [Content_Types].xml"),
        found(no_default, "PKG004", F.when(F.col("open"), "error").otherwise("warn"), "no Default content type for rels"),
        found(untyped, "PKG005", "error", "member without a content type"),
        found(no_main, "PKG006", "error", "the main part is missing, not parsed or has another root"),
        found(roots.where("tag = 'strict:document'"), "PKG009", "error", "Strict Open XML is not supported"),
        found(wrong, "PKG010", "error", F.concat(F.lit("declared as "), "media_type", F.lit(", expected "), "wanted")),
        found(repeated, "PKG011", "error", F.concat("kind", F.lit(" repeated")), F.col("name"), "[Content_Types].xml"),
        found(f.types.where("kind = 'Override' and raw rlike '%(?![0-9A-Fa-f]{2})'"), "PKG012", "error", "a broken escape in an Override", F.col("raw"), "[Content_Types].xml"),
        found(unread, "XML001", F.when(F.col("reached") | F.col("unknown"), "error").otherwise("warn"), F.concat(F.lit("part could not be parsed: "), "error")),
    ]


def relationship_rules(f: Facts) -> list[DataFrame]:
    used = f.nodes.where("part not like '%.rels' and error is null").select(
        "doc", F.col("part").alias("owner"), "id", "tag", F.explode(F.array(*(F.col("attrs")[F.lit(k)] for k in ("r:id", "r:embed", "r:link")))).alias("rid")
    ).where("rid is not null and rid <> ''")
    missing = relations.anti_ref(used, f.rels, ["doc", "owner", "rid"])
    inner = f.rels.where("mode is null or mode <> 'External'")
    files = f.members.where("part is not null").select("doc", F.col("part").alias("name"))
    good = inner.select("doc", "part", "ord", F.explode("candidates").alias("name")).join(files, ["doc", "name"]).select("doc", "part", "ord").distinct()
    dangling = inner.where("target is not null and target <> ''").join(good, ["doc", "part", "ord"], "left_anti")
    parsed = f.nodes.where("depth = 0 and error is null").select("doc", F.col("part").alias("owner"))
    implicit = reduce(lambda a, b: a | b, (F.col("type").contains(k) for k in IMPLICIT))
    strict = f.nodes.where("depth = 0 and tag = 'strict:document'").select("doc")
    unused = relations.anti_ref(f.rels.where((F.col("owner") != "") & ~implicit).join(strict, "doc", "left_anti"), used, ["doc", "owner", "rid"]).join(parsed, ["doc", "owner"], "left_semi")
    repeated = relations.dup_keys(f.rels.where("rid is not null"), ["doc", "part", "rid"])
    return [
        found(missing, "REL001", "error", "relationship is not declared", F.col("rid"), F.col("owner"), _at()),
        found(inner.where("target is null or target = ''"), "REL002", "error", "no internal target", F.col("rid")),
        found(dangling, "REL002", "error", F.concat(F.lit("points at a missing part: "), "target"), F.col("rid")),
        found(unused, "REL003", "info", "declared but never referenced", F.col("rid")),
        found(repeated, "REL004", "error", "relationship id is repeated", F.col("rid")),
    ]


def style_rules(f: Facts) -> list[DataFrame]:
    styles = f.nodes.where("part = 'word/styles.xml' and tag = 'w:style' and depth = 1")
    defined = styles.select("doc", F.col("attrs")["w:styleId"].alias("style"))
    broken = f.nodes.where("part = 'word/styles.xml' and error is not null").select("doc")
    value = F.col("attrs")["w:val"]
    refs = f.body.where("tag in ('w:pStyle', 'w:rStyle', 'w:tblStyle')").withColumn("style", value).where("style <> ''")
    undefined = relations.anti_ref(refs, defined, ["doc", "style"]).join(broken, "doc", "left_anti")
    links = f.nodes.where("part = 'word/styles.xml' and tag in ('w:basedOn', 'w:next', 'w:link') and anc_tags[0] = 'w:style' and depth = 2").withColumn("style", value)
    lost = relations.anti_ref(links, defined, ["doc", "style"])
    return [
        found(undefined, "STY001", F.when(F.col("tag") == "w:rStyle", "warn").otherwise("error"), "undefined style", F.col("style"), where=_at()),
        found(lost, "STY002", F.when(F.col("tag") == "w:basedOn", "warn").otherwise("info"), F.concat("tag", F.lit(" names an undefined style")), F.col("style"), where=_at()),
    ]


def numbering_rules(f: Facts) -> list[DataFrame]:
    """Three hops; the first that fails is the finding."""
    n = f.nodes.where("part = 'word/numbering.xml'")
    value = F.col("attrs")["w:val"]
    child = lambda tag, parent: f.body.where((F.col("tag") == tag) & (F.get("anc_tags", F.lit(0)) == parent))
    ids = child("w:numId", "w:numPr").select("doc", "part", "id", "tag", "parent", value.alias("num")).where("num <> '0'")
    levels = child("w:ilvl", "w:numPr").select("doc", "parent", value.alias("lvl"))
    refs = ids.join(levels, ["doc", "parent"], "left").withColumn("lvl", F.coalesce("lvl", F.lit("0")))
    has_part = f.members.where("part = 'word/numbering.xml'").select("doc", F.lit(True).alias("has_part"))
    nums = n.where("tag = 'w:num'").select("doc", F.col("id").alias("num_node"), F.col("attrs")["w:numId"].alias("num"))
    to_abstract = n.where("tag = 'w:abstractNumId' and anc_tags[0] = 'w:num'").select("doc", F.col("parent").alias("num_node"), value.alias("abstract"))
    abstracts = n.where("tag = 'w:abstractNum'").select("doc", F.col("id").alias("abs_node"), F.col("attrs")["w:abstractNumId"].alias("abstract"))
    own = n.where("tag = 'w:lvl' and anc_tags[0] = 'w:abstractNum'").select("doc", F.col("parent").alias("abs_node"), F.col("attrs")["w:ilvl"].alias("lvl"))
    style_link = n.where("tag = 'w:styleLink'").select("doc", F.col("parent").alias("abs_node"), value.alias("style"))
    num_link = n.where("tag = 'w:numStyleLink'").select("doc", F.col("parent").alias("to_node"), value.alias("style"))
    inherited = own.join(style_link, ["doc", "abs_node"]).join(num_link, ["doc", "style"]).select("doc", F.col("to_node").alias("abs_node"), "lvl")
    overrides = n.where("tag = 'w:lvlOverride'").select("doc", F.col("parent").alias("num_node"), F.col("attrs")["w:ilvl"].alias("lvl"), F.lit(True).alias("overridden")).distinct()
    known = own.unionByName(inherited).distinct().withColumn("known", F.lit(True))
    out = (
        refs.join(has_part, "doc", "left").join(nums, ["doc", "num"], "left").join(to_abstract, ["doc", "num_node"], "left")
        .join(abstracts, ["doc", "abstract"], "left").join(overrides, ["doc", "num_node", "lvl"], "left").join(known, ["doc", "abs_node", "lvl"], "left")
    )
    code = (
        F.when(F.col("has_part").isNull(), "NUM001").when(F.col("num_node").isNull(), "NUM002").when(F.col("abs_node").isNull(), "NUM003")
        .when(F.col("overridden").isNull() & F.col("known").isNull(), "NUM004")
    )
    out = out.withColumn("code", code).where("code is not null")
    return [found(out, F.col("code"), F.when(F.col("code") == "NUM004", "warn").otherwise("error"), "list numbering is not defined", F.col("num"), where=_at())]


def story_parts(f: Facts) -> DataFrame:
    """(doc, part): the main part and the headers, footers and notes it is related to."""
    related = f.rels.join(f.main.withColumnRenamed("part", "owner"), ["doc", "owner"]).where(F.col("type").rlike("/(header|footer|footnotes|endnotes)$"))
    return f.main.select("doc", "part").unionByName(related.select("doc", F.explode("candidates").alias("part"))).distinct()


def note_and_comment_rules(f: Facts) -> list[DataFrame]:
    wid = F.col("attrs")["w:id"]
    notes = f.nodes.where("part = 'word/footnotes.xml' and tag = 'w:footnote' and depth = 1").withColumn("nid", wid)
    refs = f.body.where("tag = 'w:footnoteReference'").withColumn("nid", wid)
    plain = notes.where("coalesce(attrs['w:type'], 'normal') = 'normal' and not nid <=> '-1'").select("doc", "part", "nid").distinct()
    story = f.nodes.where("tag in ('w:commentRangeStart', 'w:commentRangeEnd', 'w:commentReference') and not alt_branch").withColumn("cid", wid)
    stories = story_parts(f)
    marks = story.join(stories, ["doc", "part"]).groupBy("doc", "part", "cid").agg(
        *(F.count_if(F.col("tag") == f"w:{k}").alias(k) for k in ("commentRangeStart", "commentRangeEnd", "commentReference"))
    )
    s, e, r = (F.col(k) for k in ("commentRangeStart", "commentRangeEnd", "commentReference"))
    comments = f.nodes.where("tag = 'w:comment' and depth = 1").withColumn("cid", wid).select("doc", "part", "cid").distinct()
    undefined = relations.anti_ref(marks.where(r > 0), comments, ["doc", "cid"])
    unread = f.nodes.where("error is not null").join(stories, ["doc", "part"]).select("doc").distinct()
    links = f.rels.join(f.main.withColumnRenamed("part", "owner"), ["doc", "owner"])
    files = f.members.where("part is not null").select("doc", F.col("part").alias("name"))
    ids = links.groupBy("doc", "rid").agg(F.count("*").alias("same"))
    to = links.where(F.col("type") == COMMENTS).join(ids, ["doc", "rid"], "left")
    there = to.select("doc", "part", "ord", F.explode("candidates").alias("name")).join(files, ["doc", "name"]).select("doc", "part", "ord", F.lit(True).alias("there")).distinct()
    to = to.join(there, ["doc", "part", "ord"], "left").withColumn(
        "bad", (F.coalesce("same", F.lit(0)) != 1) | (F.coalesce("mode", F.lit("Internal")) != "Internal") | F.coalesce("target", F.lit("")).rlike("^$|^[A-Za-z][A-Za-z0-9+.-]*:|[?#]") | F.col("there").isNull()
    )
    unresolved = to.groupBy("doc", "part").agg(F.count("*").alias("n"), F.bool_or("bad").alias("bad")).where("n > 1 or bad")
    broken = f.nodes.where("part = 'word/comments.xml'").where("error is not null or (depth = 0 and tag <> 'w:comments')").select("doc").distinct()
    broken = broken.join(to.select("doc", "part").distinct(), "doc").select("doc", "part")
    orphans = relations.anti_ref(comments, marks.where(r > 0), ["doc", "cid"]).join(unread, "doc", "left_anti")
    return [
        found(relations.anti_ref(refs, notes, ["doc", "nid"]), "FTN001", "error", "reference without a footnote", F.col("nid"), where=_at()),
        found(relations.anti_ref(plain, refs, ["doc", "nid"]), "FTN002", "error", "footnote is never referenced", F.col("nid")),
        found(marks.where((s > 0) & (e == 0)), "CMT001", "error", "range start without end", F.col("cid")),
        found(marks.where((e > 0) & (s == 0)), "CMT002", "error", "range end without start", F.col("cid")),
        found(marks.where((s > 0) & (r == 0)), "CMT003", "error", "range without reference", F.col("cid")),
        found(undefined, "CMT004", "error", "reference without definition", F.col("cid")),
        found(orphans, "CMT005", "error", "comment is anchored to nothing", F.col("cid")),
        found(unresolved.select("doc", "part").unionByName(broken).distinct(), "CMT006", "error", "the comments part can't be resolved or parsed"),
        found(marks.where("cid is not null").where((s > 1) | (e > 1) | (r > 1)), "CMT007", "error", "comment is marked more than once", F.col("cid")),
    ]


def paragraph_pairs(body: DataFrame, changes: DataFrame) -> DataFrame:
    """(doc, part, rid) that a paragraph's mark and its whole content share, and nothing else:
    the two are records of different kinds, so one id for both is no collision. The paragraph
    stands in the body and holds its properties and the content alone, both revisions have
    one author and date, and the content is plain runs with some text."""
    key, attr, up = ["doc", "part", "rid"], F.col("attrs"), lambda k: F.get("anc_tags", F.lit(k))
    changes = changes.withColumn("who", F.to_json(F.struct(*(attr[a] for a in ("w:author", "w:date", "w16du:dateUtc")))))
    changes = changes.where("rid rlike '^[0-9]+$' and tag in ('w:ins', 'w:del') and attrs['w:author'] <> '' and attrs['w:date'] <> ''")
    two = changes.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct("tag").alias("tags"), F.count_distinct("who").alias("whos")).where("n = 2 and tags = 1 and whos = 1")
    marks = changes.where((up(0) == "w:rPr") & (up(1) == "w:pPr") & (up(2) == "w:p") & (up(3) == "w:body") & (F.col("last") == F.col("id"))).select(*key, F.get("anc_ids", F.lit(2)).alias("p"))
    content = changes.where((up(0) == "w:p") & (up(1) == "w:body")).select(*key, "tag", F.col("parent").alias("p"), F.col("id").alias("content"))
    pairs = two.select(*key).join(marks, key).join(content, [*key, "p"])
    # every node of the paragraph, each with the pair it stands in
    inside = body.where("array_contains(anc_tags, 'w:p')").select("doc", "part", "id", "tag", "text", "parent", "anc_tags", F.explode("anc_ids").alias("p"))
    inside = inside.join(pairs.withColumnRenamed("tag", "kind"), ["doc", "part", "p"])
    parent = F.get("anc_tags", F.lit(0))
    child, in_run = F.col("parent") == F.col("p"), F.col("parent") == F.col("content")
    words = F.when(F.col("kind") == "w:ins", "w:t").otherwise("w:delText")
    history = F.col("tag").isin("w:ins", "w:del", "w:moveFrom", "w:moveTo") | F.col("tag").rlike("^w:(.*Change|move.*)$")
    below = F.exists("anc_tags", lambda t: t.isin("w:ins", "w:del")) & ~F.array_contains("anc_tags", "w:pPr") & (parent == "w:r")
    checked = inside.groupBy(*key).agg(
        F.count_if(child).alias("children"), F.count_if(child & (F.col("tag") == "w:pPr")).alias("props"), F.count_if(history).alias("changes"),
        F.count_if(in_run & (F.col("tag") != "w:r")).alias("others"), F.count_if(below & ~F.col("tag").isin("w:rPr") & (F.col("tag") != words)).alias("odd"),
        F.count_if(below & (F.col("tag") == words) & (F.coalesce("text", F.lit("")) != "")).alias("texts"), F.count_if(parent.isin("w:t", "w:delText")).alias("nested"),
    )
    return checked.where("children = 2 and props = 1 and changes = 2 and others = 0 and odd = 0 and texts > 0 and nested = 0").select(*key)


def literal_entities(c: Column) -> Column:
    """The distinct spellings in c of punctuation and symbols as numeric references."""
    digits = lambda t: F.regexp_replace(F.regexp_extract(t, "^&#[xX]?([0-9a-fA-F]+);$", 1), "^0+(?=.)", "")

    def symbol(token: Column) -> Column:
        number = F.when(token.rlike("^&#[xX]"), F.when(F.length(digits(token)) <= 6, digits(token))).otherwise(F.when(F.length(digits(token)) <= 7, F.conv(digits(token), 10, 16)))
        value = F.conv(number, 16, 10).cast("int")
        good = value.between(1, 0x10FFFF) & ~value.between(0xD800, 0xDFFF)
        return F.coalesce(F.when(good, F.decode(F.unhex(F.lpad(number, 8, "0")), "UTF-32")).rlike(r"^[\p{P}\p{S}]$"), F.lit(False))

    tokens = F.regexp_extract_all(c, F.lit("&#(?:[0-9]+|[xX][0-9a-fA-F]+);"), F.lit(0))
    return F.filter(F.array_distinct(tokens), symbol)


def body_rules(f: Facts) -> list[DataFrame]:
    body = f.body
    parent = F.get("anc_tags", F.lit(0))
    nearest = F.get(F.filter("anc_tags", lambda t: t.isin("w:ins", "w:del")), F.lit(0))
    changes = body.where("tag in ('w:ins', 'w:del', 'w:moveFrom', 'w:moveTo')").withColumn("rid", F.col("attrs")["w:id"]).where("rid is not null")
    reused = changes.groupBy("doc", "part", "rid").agg(F.count("*").alias("n")).where("n > 1")
    reused = reused.join(paragraph_pairs(body, changes), ["doc", "part", "rid"], "left_anti")
    tables = body.where("tag = 'w:tbl'").select("doc", "part", "tag", "id")
    grid = body.where((F.col("tag") == "w:tblGrid") & (parent == "w:tbl")).select("doc", F.col("id").alias("grid"), F.col("parent").alias("id"))
    cols = body.where((F.col("tag") == "w:gridCol") & (parent == "w:tblGrid")).groupBy("doc", F.col("parent").alias("grid")).agg(F.count("*").alias("cols"))
    rows = body.where((F.col("tag") == "w:tr") & (parent == "w:tbl")).select("doc", "part", "tag", F.col("id"), F.col("parent").alias("tbl"))
    wrappers = F.array(*(F.lit(t) for t in ("w:sdt", "w:sdtContent", "w:customXml")))
    cell = body.where("tag = 'w:tc'").withColumn("up", F.filter(F.arrays_zip("anc_tags", "anc_ids"), lambda x: ~F.array_contains(wrappers, x["anc_tags"])))
    cell = cell.select("doc", "id", F.get("up", F.lit(0))["anc_ids"].alias("row"))
    span = body.where((F.col("tag") == "w:gridSpan") & (parent == "w:tcPr")).select("doc", F.get("anc_ids", F.lit(1)).alias("id"), F.expr("try_cast(attrs['w:val'] as int)").alias("span"))
    widths = cell.join(span, ["doc", "id"], "left").groupBy("doc", F.col("row").alias("id")).agg(F.sum(F.coalesce("span", F.lit(1))).alias("cells"))
    skips = body.where(F.col("tag").isin("w:gridBefore", "w:gridAfter") & (parent == "w:trPr")).select("doc", F.get("anc_ids", F.lit(1)).alias("id"), F.expr("try_cast(attrs['w:val'] as int)").alias("skip"))
    skips = skips.groupBy("doc", "id").agg(F.sum(F.coalesce("skip", F.lit(0))).alias("skip"))
    sized = rows.join(grid.withColumnRenamed("id", "tbl"), ["doc", "tbl"]).join(cols, ["doc", "grid"], "left").join(widths, ["doc", "id"], "left").join(skips, ["doc", "id"], "left")
    sized = sized.withColumn("wide", F.coalesce("cells", F.lit(0)) + F.coalesce("skip", F.lit(0))).where("wide <> coalesce(cols, 0)")
    controls = body.where("tag = 'w:sdt'").select("doc", "part", "tag", "id")
    inside = lambda tag: body.where((F.col("tag") == tag) & (parent == "w:sdt")).select("doc", F.col("parent").alias("id"))
    texts = body.where("tag in ('w:t', 'w:delText')")
    stories = story_parts(f)
    told = f.nodes.where("tag in ('w:t', 'w:delText')").join(stories, ["doc", "part"]).select("doc", "part", "tag", "id", F.coalesce("text", F.lit("")).alias("said"))
    levels = f.nodes.where("part = 'word/numbering.xml' and tag = 'w:lvlText'").select("doc", "part", "tag", "id", F.coalesce(F.col("attrs")["w:val"], F.lit("")).alias("said"))
    spelled = told.unionByName(levels).where("said like '%&#%'").withColumn("tokens", literal_entities(F.col("said"))).where("size(tokens) > 0")
    return [
        found(reused, "REV001", "error", F.concat(F.lit("revision id is used "), "n", F.lit(" times")), F.col("rid")),
        found(texts.where((F.col("tag") == "w:t") & (nearest == "w:del")), "REV002", "error", "text instead of deleted text in a deletion", where=_at()),
        found(texts.where((F.col("tag") == "w:delText") & (nearest == "w:ins")), "REV003", "error", "deleted text in an insertion", where=_at()),
        found(relations.anti_ref(tables, grid, ["doc", "id"]), "TBL001", "error", "table without a grid", where=_at()),
        found(sized, "TBL002", "warn", F.concat("wide", F.lit(" cells, "), F.coalesce("cols", F.lit(0)), F.lit(" grid columns")), where=_at()),
        found(relations.anti_ref(controls, inside("w:sdtPr"), ["doc", "id"]), "SDT001", "error", "content control without properties", where=_at()),
        found(relations.anti_ref(controls, inside("w:sdtContent"), ["doc", "id"]), "SDT002", "error", "content control without content", where=_at()),
        found(texts.where(T.edge_space(F.col("text")) & ~F.col("xml_space").eqNullSafe("preserve")), "TXT001", "warn", "edge white space is not preserved", where=_at()),
        found(spelled, "TXT002", "warn", F.concat(F.lit("spelled out in text: "), F.array_join(F.slice("tokens", 1, 4), ", ")), where=_at()),
    ]


def groups(f: Facts) -> dict[str, Callable[[], list[DataFrame]]]:
    """The rules by name, each a query that isn't planned before it is its turn."""
    rules = (package_rules, entry_rules, relationship_rules, style_rules, numbering_rules, note_and_comment_rules, body_rules)
    return {g.__name__: partial(g, f) for g in rules}


def check(packages: DataFrame, limits: P.Limits = P.Limits()) -> DataFrame:
    """All findings of packages(doc, content)."""
    f = facts(packages, limits)
    return ranked(isolated(groups(f), f.members.select("doc").distinct()))


def together(groups: list[list[DataFrame]]) -> DataFrame:
    """The findings of all rules; each group is worked out by itself, so no plan grows with
    the number of rules."""
    return reduce(DataFrame.unionByName, (relations.cut(reduce(DataFrame.unionByName, g)) for g in groups))


def isolated(groups: dict[str, Callable[[], list[DataFrame]]], docs: DataFrame) -> DataFrame:
    """The findings of all groups; one that can't be planned or run is INT001 for each of
    docs(doc), as nobody looked there, and the others' findings stand."""
    tables = []
    for name, rules in groups.items():
        try:
            tables.append(relations.cut(reduce(DataFrame.unionByName, rules())))
        except Exception as e:  # noqa: BLE001 - whatever stops a rule is its finding
            said = f"{name} was not completed: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
            tables.append(found(docs, "INT001", "error", said[:500], name))
    return reduce(DataFrame.unionByName, tables)


def ranked(findings: DataFrame) -> DataFrame:
    """findings with severity_rank, by which thresholds compare."""
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    return findings.withColumn("severity_rank", rank[F.col("severity")])
