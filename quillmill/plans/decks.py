"""Presentations: slides in their order, shapes with the places they have or inherit, and rules
of geometry. All are joins over the fact tables of document_rules.

A slide inherits from its layout, and that from its master: a placeholder's partner is the one
with its index, or else the first of its type. That is an equal join on each, and the
better one counts. Texts are not measured: that needs fonts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import relations
from ..sources import packages as P
from . import document_rules as D

MAIN, RELS = "ppt/presentation.xml", "ppt/_rels/presentation.xml.rels"
# The size of a slide that says none, and the insets of a text body that says none.
WIDTH, HEIGHT = 9_144_000, 6_858_000
INSETS = {"lIns": 91_440, "tIns": 45_720, "rIns": 91_440, "bIns": 45_720}
# How far over an edge a shape may be, and the least overlap that is told.
EDGE = 2 * V.EMU
OVERLAP = 0.02
# The master's placeholder that stands for another type.
MASTER_TYPE = {"ctrTitle": "title", "subTitle": "body", "obj": "body"}


@dataclass
class Deck:
    """sizes(doc, width, height); slides(doc, slide, part); shapes (see shapes()); failed(doc, part,
    message): decks that can't be read for certain, which have no slides or shapes."""

    sizes: DataFrame
    slides: DataFrame
    shapes: DataFrame
    failed: DataFrame


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def whole(name: str, default: int | None = None) -> Column:
    value = F.expr(f"try_cast(attrs['{name}'] as bigint)")
    return value if default is None else F.coalesce(value, F.lit(default))


def slides(f: D.Facts) -> tuple[DataFrame, DataFrame]:
    """(doc, slide, part) in the order of the slide list, and (doc, part, message) of decks
    whose list leaves any doubt: then none of its slides counts, or they would be misnumbered."""
    docs = f.members.where("ord >= 0").select("doc").distinct()
    root = f.nodes.where((F.col("part") == MAIN) & (F.col("depth") == 0))
    good = root.where("tag = 'p:presentation'").select("doc")
    no_root = docs.join(good, "doc", "left_anti").select("doc", F.lit(MAIN).alias("part"), F.lit("the presentation part is missing, can't be parsed or is of a kind that isn't read").alias("message"))
    top = f.nodes.where((F.col("part") == MAIN) & (F.col("depth") == 1) & (F.col("tag") == "p:sldIdLst")).join(good, "doc")
    several = top.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc", F.lit(MAIN).alias("part"), F.lit("several slide lists").alias("message"))
    rows = f.nodes.where((F.col("part") == MAIN) & (F.col("depth") == 2)).join(top.select("doc", F.col("id").alias("parent")), ["doc", "parent"])
    at = F.row_number().over(Window.partitionBy("doc").orderBy("id"))  # one presentation's slides
    rows = rows.select("doc", at.alias("slide"), "tag", attr("id").alias("sid"), F.coalesce(attr("r:id"), F.lit("")).alias("rid"))
    rels = f.rels.where(F.col("part") == RELS)
    files = f.members.where("part is not null and not is_dir").select("doc", F.col("part").alias("name"))
    named = rels.select("doc", "ord", F.posexplode("candidates").alias("k", "name")).join(files, ["doc", "name"]).groupBy("doc", "ord").agg(F.min_by("name", "k").alias("name"))
    per = rels.join(named, ["doc", "ord"], "left").groupBy("doc", "rid").agg(
        F.count("*").alias("rels"), F.min("type").alias("type"), F.min(F.coalesce("mode", F.lit("Internal"))).alias("mode"), F.min(F.coalesce("target", F.lit(""))).alias("target"), F.min("name").alias("name"),
    )
    kinds = f.nodes.where("depth = 0").select("doc", F.col("part").alias("name"), F.col("tag").alias("root"))
    rows = rows.join(per, ["doc", "rid"], "left").join(kinds, ["doc", "name"], "left")
    same_id, same_part = (F.count("*").over(Window.partitionBy("doc", c)) for c in ("sid", "name"))
    rows = rows.withColumns({"ids": same_id, "parts": same_part})
    wrong = (
        F.when(F.col("tag") != "p:sldId", "an entry of the slide list is no slide").when(~F.coalesce("sid", F.lit("")).rlike("^[0-9]+$"), "a slide has no valid id").when(F.col("ids") > 1, "slide ids repeat")
        .when(F.coalesce("rels", F.lit(0)) != 1, "its relationship is missing or not the only one").when(F.col("type") != D.OFFICE + "slide", "its relationship is no slide's")
        .when(F.col("mode") != "Internal", "its relationship is external").when(F.col("target").rlike(r"^$|^[A-Za-z][A-Za-z0-9+.-]*:|^//|[?#\\]"), "its target is no part's name")
        .when(F.col("name").isNull(), "its part is missing").when(F.col("parts") > 1, "its part is listed twice").when(~F.coalesce("root", F.lit("")).eqNullSafe("p:sld"), "its part can't be read as a slide")
    )
    rows = relations.cut(rows.withColumn("wrong", wrong))
    first = rows.where("wrong is not null").groupBy("doc").agg(F.min(F.struct("slide", "wrong")).alias("x"))
    unsure = first.select("doc", F.lit(MAIN).alias("part"), F.concat(F.lit("slide order is not certain: slide "), F.col("x.slide"), F.lit(": "), F.col("x.wrong")).alias("message"))
    failed = no_root.unionByName(several).unionByName(unsure)
    failed = relations.cut(failed.groupBy("doc").agg(F.min("part").alias("part"), F.min("message").alias("message")))
    return rows.join(failed.select("doc"), "doc", "left_anti").select("doc", F.col("slide"), F.col("name").alias("part")), failed


def related(f: D.Facts, kind: str) -> DataFrame:
    """(doc, owner, to): the first internal relationship of a kind that an owner has."""
    rows = f.rels.where(F.col("type").endswith(f"/{kind}")).where("mode is null or mode <> 'External'")
    files = f.members.where("part is not null").select("doc", F.col("part").alias("to"))
    found = rows.select("doc", "owner", "ord", F.posexplode("candidates").alias("k", "to")).join(files, ["doc", "to"])
    return found.groupBy("doc", "owner").agg(F.min_by("to", F.struct("ord", "k")).alias("to"))


def raw_shapes(nodes: DataFrame) -> DataFrame:
    """(doc, part, id, name, grouped, is_placeholder, idx, kind, has_xfrm, x, y, cx, cy, rot, anchor,
    has_body, wrap, vertical, autofit, insets, has_text) of every shape of the parts of nodes."""
    up = lambda *tags: [F.get("anc_tags", F.lit(k)) == t for k, t in enumerate(tags)]

    def at(tag: str, *tags: str) -> Column:
        out = F.col("tag") == tag
        for c in up(*tags):
            out = out & c
        return out

    own = nodes.where("tag = 'p:sp'").select("doc", "part", F.col("id").alias("sp"), F.array_contains("anc_tags", "p:grpSp").alias("grouped"))
    sp = F.get("anc_ids", F.array_position("anc_tags", "p:sp").cast("int") - 1)
    marks = {
        "is_ph": at("p:ph", "p:nvPr", "p:nvSpPr", "p:sp"), "is_name": at("p:cNvPr", "p:nvSpPr", "p:sp"), "is_xfrm": at("a:xfrm", "p:spPr", "p:sp"),
        "is_off": at("a:off", "a:xfrm", "p:spPr", "p:sp"), "is_ext": at("a:ext", "a:xfrm", "p:spPr", "p:sp"), "is_body": at("a:bodyPr", "p:txBody", "p:sp"),
        "is_fit": F.col("tag").isin("a:normAutofit", "a:spAutoFit") & (F.get("anc_tags", F.lit(0)) == "a:bodyPr"),
        "is_text": (F.col("tag") == "a:t") & F.array_contains("anc_tags", "p:txBody") & (F.trim(F.coalesce("text", F.lit(""))) != ""),
    }
    below = nodes.where("array_contains(anc_tags, 'p:sp')").withColumn("sp", sp).withColumns({k: F.coalesce(c, F.lit(False)) for k, c in marks.items()})
    # the first of a kind counts
    take = lambda mark, value: F.min_by(value, F.when(F.col(mark), F.col("id")))
    told = below.groupBy("doc", "part", "sp").agg(
        F.bool_or("is_ph").alias("is_placeholder"), take("is_ph", attr("idx")).alias("idx"), take("is_ph", F.coalesce(attr("type"), F.lit("body"))).alias("kind"),
        take("is_name", attr("name")).alias("name"), F.bool_or("is_xfrm").alias("has_xfrm"), take("is_xfrm", whole("rot", 0)).alias("rot"),
        F.bool_or("is_off").alias("has_off"), F.bool_or("is_ext").alias("has_ext"), take("is_off", whole("x", 0)).alias("x"), take("is_off", whole("y", 0)).alias("y"),
        take("is_ext", whole("cx", 0)).alias("cx"), take("is_ext", whole("cy", 0)).alias("cy"), F.bool_or("is_body").alias("has_body"),
        take("is_body", F.nullif(attr("anchor"), F.lit(""))).alias("anchor"), take("is_body", attr("wrap")).alias("wrap"), take("is_body", attr("vert")).alias("vert"), take("is_body", whole("rot", 0)).alias("turn"),
        take("is_body", F.struct(*(whole(k, d).alias(k) for k, d in INSETS.items()))).alias("insets"), F.min(F.when(F.col("is_fit"), F.col("tag"))).alias("fit"), F.bool_or("is_text").alias("has_text"),
    )
    rows = own.join(told, ["doc", "part", "sp"], "left")
    no = F.lit(False)
    box = F.coalesce("has_off", no) & F.coalesce("has_ext", no)
    return rows.select(
        "doc", "part", F.col("sp").alias("id"), F.coalesce(F.nullif("name", F.lit("")), F.lit("unnamed")).alias("name"), "grouped", F.coalesce("is_placeholder", no).alias("is_placeholder"), "idx", "kind",
        F.coalesce("has_xfrm", no).alias("has_xfrm"), *(F.when(box, F.col(c)).alias(c) for c in ("x", "y", "cx", "cy")), F.coalesce("rot", F.lit(0)).alias("rot"), "anchor",
        (F.coalesce("wrap", F.lit("square")) != "none").alias("wrap"), ((F.coalesce("vert", F.lit("horz")) != "horz") | (F.coalesce("turn", F.lit(0)) % (180 * 60_000) != 0)).alias("vertical"),
        F.coalesce(F.substring("fit", 3, 20), F.lit("none")).alias("autofit"),
        F.coalesce("insets", F.struct(*(F.lit(d).cast("long").alias(k) for k, d in INSETS.items()))).alias("insets"), F.coalesce("has_text", no).alias("has_text"),
    )


def partners(asking: DataFrame, offered: DataFrame, kind: str) -> DataFrame:
    """(doc, part, id, by_type, p): the placeholders p of offered(doc, to, ...) that those of
    asking(doc, part, id, to, idx, kind) may inherit from: by index, or by type."""
    own = F.struct(*(F.col(c) for c in offered.columns if c not in ("doc", "to"))).alias("p")
    by_index = asking.where("idx is not null").join(offered.select("doc", "to", "idx", own), ["doc", "to", "idx"])
    by_type = asking.withColumn("kind", F.col(kind)).join(offered.select("doc", "to", "kind", own), ["doc", "to", "kind"]).where("idx is null or not p.idx <=> idx")
    columns = ["doc", "part", "id", "p"]
    return by_index.select(*columns, F.lit(False).alias("by_type")).unionByName(by_type.select(*columns, F.lit(True).alias("by_type")))


def shapes(f: D.Facts, listed: DataFrame) -> DataFrame:
    """(doc, slide, part, id, name, x, y, cx, cy, rot, anchor, is_placeholder, kind, wrap, vertical,
    autofit, insets, has_text, grouped) of the slides' shapes; x, y, cx, cy are null where
    neither the shape nor its layout says where it is, or in a group."""
    layout = related(f, "slideLayout").withColumnsRenamed({"owner": "part", "to": "layout"})
    master = related(f, "slideMaster").withColumnsRenamed({"owner": "layout", "to": "master"})
    chain = relations.cut(listed.join(layout, ["doc", "part"], "left").join(master, ["doc", "layout"], "left"))
    used = chain.select("doc", F.explode(F.array("part", "layout", "master")).alias("part")).where("part is not null").distinct()
    every = relations.cut(raw_shapes(f.nodes.join(used, ["doc", "part"], "left_semi")))
    mine = every.join(chain.select("doc", "slide", "part", "layout", "master"), ["doc", "part"])
    offered = every.where("is_placeholder").select("doc", F.col("part").alias("to"), F.col("id").alias("of"), "idx", "kind", "has_xfrm", "x", "y", "cx", "cy", "rot", "anchor")
    asking = mine.where("is_placeholder")
    stand_in = F.coalesce(F.create_map(*[F.lit(x) for kv in MASTER_TYPE.items() for x in kv])[F.col("kind")], F.col("kind"))
    asking = asking.withColumn("master_kind", stand_in)
    names = ["doc", "part", "id", "idx", "kind", "master_kind"]
    from_layout = relations.cut(partners(asking.select(*names, F.col("layout").alias("to")), offered, "kind"))
    from_master = partners(asking.select(*names, F.col("master").alias("to")), offered, "master_kind")
    order = F.struct("by_type", F.col("p.of"))
    # the first partner that has a place gives it; for the anchor there is one partner a part
    place = from_layout.where("p.has_xfrm").groupBy("doc", "part", "id").agg(F.min_by("p", order).alias("lp"))
    anchors = [t.groupBy("doc", "part", "id").agg(F.min_by("p.anchor", order).alias(n)) for t, n in ((from_layout, "la"), (from_master, "ma"))]
    out = mine.join(place, ["doc", "part", "id"], "left")
    for t in anchors:
        out = out.join(t, ["doc", "part", "id"], "left")
    inherits = ~F.col("has_xfrm") & F.col("is_placeholder")
    at = lambda c: F.when(~F.col("grouped"), F.when(inherits, F.col(f"lp.{c}")).when(F.col("has_xfrm"), F.col(c))).alias(c)
    anchor = F.coalesce("anchor", F.when(F.col("is_placeholder"), F.coalesce("la", "ma")), F.lit("t"))
    return out.select(
        "doc", "slide", "part", "id", "name", at("x"), at("y"), at("cx"), at("cy"), F.coalesce(F.when(inherits, F.col("lp.rot")).otherwise(F.col("rot")), F.lit(0)).alias("rot"), anchor.alias("anchor"),
        "is_placeholder", F.when(F.col("is_placeholder"), F.col("kind")).alias("kind"), "wrap", "vertical", "autofit", "insets", "has_text", "grouped",
    )


def read(f: D.Facts) -> Deck:
    listed, failed = slides(f)
    listed = relations.cut(listed)
    size = f.nodes.where((F.col("part") == MAIN) & (F.col("tag") == "p:sldSz") & (F.col("depth") == 1)).groupBy("doc").agg(F.min_by(F.struct(whole("cx").alias("cx"), whole("cy").alias("cy")), "id").alias("s"))
    docs = f.members.where("ord >= 0").select("doc").distinct().join(failed.select("doc"), "doc", "left_anti")
    sizes = docs.join(size, "doc", "left").select("doc", F.coalesce("s.cx", F.lit(WIDTH)).alias("width"), F.coalesce("s.cy", F.lit(HEIGHT)).alias("height"))
    return Deck(sizes, listed, relations.cut(shapes(f, listed)), failed)


def features(f: D.Facts, deck: Deck) -> DataFrame:
    """A row for each deck that was read: how many slides, and how much of what they hold is read
    or left out."""
    on = f.nodes.join(deck.slides, ["doc", "part"]).groupBy("doc").agg(
        F.count_if(F.col("tag") == "p:grpSp").alias("grouped_shapes"), F.count_if(F.col("tag") == "a:tbl").alias("tables"), F.count_if(F.col("tag") == "a:fld").alias("fields"),
        F.count_if((F.col("tag") == "a:graphicData") & F.lower(attr("uri")).contains("diagram")).alias("smartart"),
        F.count_if((F.col("tag") == "a:graphicData") & F.lower(attr("uri")).contains("chart")).alias("charts"),
    )
    free, placed = ~F.col("grouped"), F.col("x").isNotNull()
    told = deck.shapes.groupBy("doc").agg(
        F.count_if(F.col("grouped") & F.col("has_text")).alias("grouped_text_shapes"), F.count_if(free & F.col("has_text")).alias("plain_text_shapes"),
        F.count_if(free & F.col("has_text") & ~placed).alias("unread_text_shapes"), F.count_if(free & placed & (F.col("rot") != 0)).alias("rotated_shapes"),
        F.count_if(free & placed & F.col("vertical") & F.col("has_text")).alias("vertical_text_shapes"),
    )
    behind = raw_shapes(f.nodes.where("part rlike '^ppt/(slidelayouts|slidemasters)/'")).where("not is_placeholder and has_text").groupBy("doc").agg(F.count("*").alias("master_layout_text_shapes"))
    out = deck.sizes.select("doc").join(deck.slides.groupBy("doc").agg(F.count("*").alias("slides")), "doc", "left")
    for t in (on, told, behind):
        out = out.join(t, "doc", "left")
    return out.na.fill(0)


def off_slides(deck: Deck) -> DataFrame:
    """PPT004: shapes that are over an edge of their slide, or off it."""
    rows = deck.shapes.where("x is not null").join(deck.sizes, "doc")
    x, y, r, b = F.col("x"), F.col("y"), F.col("x") + F.col("cx"), F.col("y") + F.col("cy")
    over = {"left": -x, "top": -y, "right": r - F.col("width"), "bottom": b - F.col("height")}
    sides = F.filter(F.array(*(F.when(d > EDGE, F.concat(F.format_number(V.points(d), 0), F.lit(f" pt over the {n} edge"))) for n, d in over.items())), lambda s: s.isNotNull())
    rows = rows.withColumn("sides", sides).where("size(sides) > 0")
    outside = (r <= 0) | (b <= 0) | (x >= F.col("width")) | (y >= F.col("height"))
    said = F.when(outside, "the shape is off the slide").otherwise(F.concat(F.lit("the shape is "), F.array_join("sides", ", ")))
    return D.found(rows, "PPT004", F.when(outside, "info").otherwise("warn"), said, F.col("name"), where=_where())


def _where() -> Column:
    return F.concat(F.lit("slide"), F.col("slide"), F.lit("/"), F.col("name"))


def text_overlaps(deck: Deck) -> DataFrame:
    """PPT006: unrotated shapes with text that cover one another."""
    rows = deck.shapes.where("x is not null and has_text and rot = 0")
    pairs = relations.rectangles_overlap(rows.select("doc", "slide", "id", "x", "y", "cx", "cy"), ["doc", "slide"], "id").where(F.col("share") >= OVERLAP)
    names = rows.select("doc", "slide", F.col("id").alias("a_id"), "part", "name")
    other = rows.select("doc", "slide", F.col("id").alias("b_id"), F.col("name").alias("other"))
    pairs = pairs.join(names, ["doc", "slide", "a_id"]).join(other, ["doc", "slide", "b_id"])
    share = F.format_number(100 * F.col("share"), 0)
    said = F.concat(F.lit("covers or is covered by "), "other", F.lit(" over "), share, F.lit("% of the smaller one; both have text"))
    return D.found(pairs, "PPT006", F.when(F.col("share") < 0.5, "warn").otherwise("error"), said, F.col("other"), where=_where())


def check(packages: DataFrame, limits: P.Limits = P.Limits()) -> DataFrame:
    """Findings on the geometry of packages(doc, content), and on the packages themselves."""
    f = D.facts(packages, limits)
    broken = f.members.where("code is not null")
    deck = read(f)
    groups = {
        "off_slides": lambda: [off_slides(deck)], "text_overlaps": lambda: [text_overlaps(deck)],
        "slides": lambda: [D.found(deck.failed, "PKG002", "error", F.col("message"), None)],
        "packages": lambda: [D.found(broken.withColumn("part", F.col("name")), F.col("code"), "error", F.col("message"), F.col("name"))],
    }
    return D.ranked(D.isolated(groups, f.members.select("doc").distinct()))
