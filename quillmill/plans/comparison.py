"""What an edited document lost of its source: both as node tables, the differences as
bag operations, windows and joins. Findings have the columns of document_rules.

Views: the current text leaves deletions out, the original text leaves insertions out (every
revision rejected). Later branches of alternate content are a view of their own, whose
losses are warnings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bags, matching, relations
from ..sources import packages as P
from . import document_rules as D
from . import references, revisions
from .reading import CHARACTERS, INSERTED, REMOVED, REVISIONS, joined, owner, pieces, shown, symbol, under  # noqa: F401

# Constructs that are counted, and what losing some of them means; the names are ours.
TRACKED = [
    ("commentReference", "marks of comments", "error"),
    ("footnoteReference", "marks of footnotes", "error"),
    ("endnoteReference", "marks of endnotes", "error"),
    ("ins", "insertions under review", "error"),
    ("del", "deletions under review", "error"),
    ("sdt", "fields to fill in (content controls)", "error"),
    ("drawing", "drawings", "error"),
    ("tbl", "tables", "error"),
    ("hyperlink", "links", "warn"),
    ("pStyle", "paragraphs with a named style", "warn"),
    ("rStyle", "text with a named style", "warn"),
    ("numPr", "items of lists", "warn"),
    ("tblHeader", "repeated heading rows", "warn"),
    ("sectPr", "sections", "warn"),
]
# Parts compared item by item, their item, code and name.
BODIES = [
    ("word/comments.xml", "w:comment", "FID004", "comment"),
    ("word/footnotes.xml", "w:footnote", "FID005", "footnote"),
    ("word/endnotes.xml", "w:endnote", "FID006", "endnote"),
]
# Notes that every file has, without an author's words.
HOUSEKEEPING = ["separator", "continuationSeparator", "continuationNotice"]
#: Part of the source's text that must be left.
VOLUME = 0.95

def paragraph_views(nodes: DataFrame) -> DataFrame:
    """(doc, part, p, current, original) of every paragraph; text boxes in it are paragraphs
    of their own. Here a move's text is current at its end only."""
    key = ["doc", "part", "p"]
    rows = pieces(nodes.where("not alt_branch"))
    rows = rows.withColumn("is_current", (F.col("tag") != "w:delText") & ~under(*REMOVED))
    all_p = nodes.where("tag = 'w:p' and not alt_branch").select("doc", "part", F.col("id").alias("p"))

    def view(keep: str, name: str) -> DataFrame:
        told = rows.where(keep).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("id", "shown"))).alias("t"))
        return told.select(*key, T.squeezed(F.array_join(F.transform("t", lambda x: x["shown"]), "")).alias(name))

    out = all_p.join(view("is_current", "current"), key, "left").join(view("is_original", "original"), key, "left")
    return out.na.fill("", ["current", "original"])


def records(nodes: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and `record`: each character with the revisions around it (outermost first), and
    the end of each paragraph with those of its mark. Only for items with revisions.
    keys are doc, part and what else tells items apart; rows are the pieces() of nodes."""
    attr = F.col("attrs")
    name = F.concat_ws("\u001f", "tag", F.coalesce(attr["w:author"], F.lit("\u0000")), F.coalesce(attr["w:date"], F.lit("\u0000")))
    changes = nodes.where(F.col("tag").isin(*REVISIONS)).select(*keys, F.col("id").alias("rev"), "depth", name.alias("w"), "anc_tags", "anc_ids")
    state = rows.select("doc", "part", "id", F.explode("anc_ids").alias("rev"))
    state = state.join(changes.select("doc", "part", "rev", "depth", "w"), ["doc", "part", "rev"])
    state = state.groupBy("doc", "part", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "w"))), lambda x: x["w"]).alias("s"))
    none = F.array().cast("array<string>")
    told = rows.where("shown <> '' and p is not null").join(state, ["doc", "part", "id"], "left").select(
        *keys, F.col("id").cast("double").alias("at"), F.filter(F.split("shown", ""), lambda c: c != "").alias("cs"), F.coalesce("s", none).alias("s")
    )
    marks = changes.where("anc_tags[0] = 'w:rPr' and anc_tags[1] = 'w:pPr' and anc_tags[2] = 'w:p'").groupBy("doc", "part", F.get("anc_ids", F.lit(2)).alias("id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rev", "w"))), lambda x: x["w"]).alias("s")
    )
    ends = nodes.where("tag = 'w:p'").join(marks, ["doc", "part", "id"], "left").select(
        *keys, (F.col("last") + F.lit(0.5)).alias("at"), F.array(F.lit("\n")).alias("cs"), F.coalesce("s", none).alias("s")
    )
    both = told.unionByName(ends).join(changes.select(*keys).distinct(), keys, "left_semi")
    out = both.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "cs", "s"))).alias("t"))
    flat = F.flatten(F.transform("t", lambda x: F.transform(x["cs"], lambda c: F.struct(c.alias("c"), x["s"].alias("s")))))
    return out.select(*keys, flat.alias("record"))


def without_new(record: Column, known: Column) -> Column:
    """record with the revisions that aren't known rejected: their insertions go, and so
    do the marks of their deletions."""
    new = lambda w: ~F.array_contains(known, w)
    kept = F.filter(record, lambda x: ~F.exists(x["s"], lambda w: new(w) & (w.startswith("w:ins") | w.startswith("w:moveTo"))))
    return F.transform(kept, lambda x: F.struct(x["c"].alias("c"), F.filter(x["s"], lambda w: ~new(w)).alias("s")))


def texts_of(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, current, original, record of the items that nodes (with keys) belong to."""
    rows = pieces(nodes)
    out = nodes.select(*keys).distinct().join(joined(rows, keys, "is_current", "current"), keys, "left")
    out = out.join(joined(rows, keys, "is_original", "original"), keys, "left").na.fill("", ["current", "original"])
    return out.join(records(nodes, rows, keys), keys, "left")


def bodies(f: D.Facts) -> DataFrame:
    """(doc, part, item, code, kind, author, current, original, record) of comments and
    notes, a row for each."""
    kinds = f.nodes.sparkSession.createDataFrame(BODIES, "part string, tag string, code string, kind string")
    rows = f.nodes.where("not alt_branch").join(F.broadcast(kinds.select("part", F.col("tag").alias("item_tag"), "code", "kind")), "part")  # three rows
    items = rows.where("tag = item_tag").where(~F.coalesce(F.col("attrs")["w:type"], F.lit("")).isin(HOUSEKEEPING))
    items = items.select("doc", "part", "code", "kind", F.col("id").alias("item"), F.coalesce(F.col("attrs")["w:author"], F.lit("")).alias("author"))
    inside = rows.withColumn("item", F.get("anc_ids", F.array_position("anc_tags", F.col("item_tag")).cast("int") - 1)).where("item is not null")
    keys = ["doc", "part", "item"]
    out = items.join(texts_of(inside.join(items.select(*keys), keys, "left_semi"), keys), keys, "left")
    return out.na.fill("", ["current", "original"]).where("current <> '' or original <> ''")


def slots(f: D.Facts) -> DataFrame:
    """(doc, section, kind, variant, part): the header or footer that each section shows.
    One that names none shows that of the section before."""
    sections = f.body.where("tag = 'w:sectPr'").where(~under("w:sectPrChange")).select("doc", F.col("id").alias("section"))
    refs = f.body.where("tag in ('w:headerReference', 'w:footerReference')").select(
        "doc", F.col("parent").alias("section"), F.when(F.col("tag") == "w:headerReference", "header").otherwise("footer").alias("kind"),
        F.coalesce(F.col("attrs")["w:type"], F.lit("default")).alias("variant"), F.col("attrs")["r:id"].alias("rid"),
    )
    rels = f.rels.join(f.main.withColumnRenamed("part", "owner"), ["doc", "owner"]).where("mode is null or lower(mode) <> 'external'")
    files = f.members.where("part is not null").select("doc", F.col("part").alias("name"))
    good = rels.select("doc", "rid", F.substring_index("type", "/", -1).alias("kind"), F.explode("candidates").alias("name")).join(files, ["doc", "name"])
    direct = refs.join(good.groupBy("doc", "rid", "kind").agg(F.min("name").alias("part")), ["doc", "rid", "kind"])
    direct = direct.groupBy("doc", "section", "kind", "variant").agg(F.max("part").alias("part"))
    every = sections.join(direct.select("doc", "kind", "variant").distinct(), "doc").join(direct, ["doc", "section", "kind", "variant"], "left")
    # a document has few sections, so its window is small
    last = F.last("part", ignorenulls=True).over(Window.partitionBy("doc", "kind", "variant").orderBy("section"))
    return every.withColumn("part", last).where("part is not null")


def unmatched(source: DataFrame, edited: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of source(keys, ord, current, original, record) that no row of edited accounts
    for; each edited row serves once. A row is kept by an equal current text (rather with an
    equal original one), or, without revisions, by an original text that equals it, or, with
    revisions, by a record that equals its own once the new revisions are rejected."""
    s = source.withColumns({"both": F.struct("current", "original"), "plain": F.when(F.col("record").isNull(), F.col("current"))})
    e = edited.withColumns({"both": F.struct("current", "original"), "plain": F.col("original")})
    found = bags.match_texts(s, e, keys, [("both", "both"), ("current", "current"), ("plain", "plain")])
    left = s.join(found.select(*keys, F.col("s_ord").alias("ord")), [*keys, "ord"], "left_anti")
    free = e.where("record is not null").join(found.select(*keys, F.col("e_ord").alias("ord")), [*keys, "ord"], "left_anti")
    known = F.array_distinct(F.flatten(F.transform("record", lambda x: x["s"])))
    x = left.where("record is not null").select(*keys, F.col("ord").alias("s_ord"), F.col("record").alias("_r"), known.alias("_known"))
    y = free.select(*keys, F.col("ord").alias("e_ord"), F.col("record").alias("_e"))
    may = x.join(y, keys).where(without_new(F.col("_e"), F.col("_known")) == F.col("_r")).select(*keys, "s_ord", "e_ord")
    third = matching.first_free(may, keys)
    return left.join(third.select(*keys, F.col("s_ord").alias("ord")), [*keys, "ord"], "left_anti").select(*source.columns)


def counts(f: D.Facts, alternate: bool) -> DataFrame:
    """(doc, tag, n) of the tracked constructs of the body."""
    names = [t for t, _, _ in TRACKED]
    rows = f.body.where(F.col("alt_branch") == F.lit(alternate)).withColumn("name", F.regexp_replace("tag", "^w:", "")).where(F.col("tag").startswith("w:") & F.col("name").isin(names))
    return rows.where("not (name = 'sectPr' and coalesce(anc_tags[0] = 'w:sectPrChange', false))").groupBy("doc", F.col("name").alias("tag")).agg(F.count("*").alias("n"))


def volumes(f: D.Facts, alternate: bool) -> DataFrame:
    rows = f.body.where(F.col("alt_branch") == F.lit(alternate)).where("tag in ('w:t', 'w:delText')")
    size = F.length(F.coalesce("text", F.lit("")))
    return rows.groupBy("doc").agg(
        F.sum(F.when(F.col("tag") == "w:t", size).otherwise(0)).alias("text"), F.sum(F.when(F.col("tag") == "w:delText", size).otherwise(0)).alias("deleted")
    )


def _sides(df: DataFrame, n: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the sources and of the edits, doc being the pair; `n` is renamed on the edits."""
    pair = F.substring("doc", 3, 1 << 30)
    return tuple(df.where(F.col("doc").startswith(side)).withColumn("doc", pair).withColumnsRenamed({n: as_}) for side, as_ in (("s:", n), ("e:", f"{n}_after")))


def construct_changes(per_tag: DataFrame, keys: list[str], codes: tuple[str, str | None], where: Column | None, part: str | None, prefix: Column, excused: DataFrame | None = None) -> DataFrame:
    """A loss (an error if all are lost), and with a second code a gain, for each tag; no loss
    for excused(doc, tag)."""
    before, after = _sides(per_tag, "n")
    both = bags_full(before, after, ["doc", *keys, "tag"])
    table = per_tag.sparkSession.createDataFrame(TRACKED, "tag string, label string, loss string")
    both = both.join(F.broadcast(table), "tag").where("n > 0 and n <> n_after")  # fourteen rows
    lost = F.col("n_after") < F.col("n")
    tail = F.when(F.col("n_after") == 0, "all lost").otherwise(F.concat(F.col("n") - F.col("n_after"), F.lit(" lost")))
    text = F.concat(prefix, "label", F.lit(": "), "n", F.lit(" -> "), "n_after")
    losses = both.where(lost) if excused is None else both.where(lost).join(excused, ["doc", "tag"], "left_anti")
    out = D.found(losses, codes[0], F.when(F.col("n_after") == 0, "error").otherwise(F.col("loss")), F.concat(text, F.lit(" ("), tail, F.lit(")")), F.col("tag"), part, where)
    if codes[1]:
        out = out.unionByName(D.found(both.where(~lost), codes[1], "info", F.concat(text, F.lit(" - added")), F.col("tag"), part, where))
    return out


def bags_full(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    return before.join(after, keys, "full_outer").na.fill(0, [c for c in (*before.columns, *after.columns) if c not in keys])


def demoted(findings: DataFrame) -> DataFrame:
    """Findings on the later branches of alternate content: warnings at a place of their own."""
    place = F.coalesce(F.concat(F.coalesce("where", "part"), F.lit("/")), F.lit(""))
    return findings.withColumns({
        "severity": F.lit("warn"), "message": F.concat(F.lit("Fallback copy: "), "message"),
        "where": F.concat(place, F.lit("mc:AlternateContent/fallback")),
    })


def text_loss(per_doc: DataFrame) -> DataFrame:
    before, after = _sides(per_doc.withColumnRenamed("deleted", "d"), "text")
    both = before.withColumnRenamed("d", "d_before").join(after, "doc", "left").na.fill(0)
    kept = F.greatest(F.lit(0), F.col("d") - F.col("d_before"))
    both = both.withColumn("kept", kept).where((F.col("text") > 0) & (F.col("text_after") + F.col("kept") < F.col("text") * VOLUME))
    share = F.bround(100 * (1 - (F.col("text_after") + F.col("kept")) / F.col("text"))).cast("int")
    return D.found(both, "FID003", "error", F.concat(F.lit("text volume fell from "), "text", F.lit(" to "), "text_after", F.lit(" characters ("), share, F.lit("% lost)")))


def body_losses(items: DataFrame) -> DataFrame:
    keyed = items.withColumnRenamed("item", "ord")
    source, edited = _sides(keyed.withColumn("_", F.lit(0)), "_")
    lost = unmatched(source.where("current <> ''").drop("_"), edited.drop("_after"), ["doc", "part"])
    per_text = lost.groupBy("doc", "part", "code", "kind", "current").agg(F.count("*").alias("n"), F.min("author").alias("author"))
    text = F.concat(F.lit("a "), "kind", F.lit(" of the source is gone"), F.when(F.col("author") != "", F.concat(F.lit(", by "), "author")).otherwise(""), F.lit(": "), T.snippet(F.col("current"), 60))
    return D.found(per_text, F.col("code"), "error", text, F.col("current"))


def story_losses(f: D.Facts, shown_: DataFrame) -> list[DataFrame]:
    """Headers and footers by slot: texts that are gone, and constructs."""
    inside = f.nodes.where("not alt_branch").join(shown_.select("doc", "part").distinct(), ["doc", "part"])
    texts = texts_of(inside, ["doc", "part"])
    placed = shown_.join(texts, ["doc", "part"]).withColumn("slot", F.concat_ws("/", "kind", "variant"))
    placed = relations.cut(placed).withColumn("ord", F.concat_ws(":", F.lpad("section", 9, "0"), "slot")).select("doc", "slot", "ord", "part", "current", "original", "record")
    source, edited = _sides(placed.withColumn("_", F.lit(0)), "_")
    lost = unmatched(source.drop("_"), edited.drop("_after"), ["doc", "slot"]).groupBy("doc", "slot", "current").agg(F.count("*").alias("n"), F.min("part").alias("part"))
    said = F.when(F.col("current") == "", F.lit("an empty story")).otherwise(T.snippet(F.col("current"), 80))
    gone = D.found(lost, "FID007", "error", F.concat(F.lit("a source "), "slot", F.lit(" story is missing or changed: "), said), F.col("current"), where=F.col("slot"))
    names = [t for t, _, _ in TRACKED]
    per_part = inside.withColumn("name", F.regexp_replace("tag", "^w:", "")).where(F.col("name").isin(names) & F.col("tag").startswith("w:")).groupBy("doc", "part", F.col("name").alias("tag")).agg(F.count("*").alias("k"))
    per_slot = shown_.join(per_part, ["doc", "part"]).groupBy("doc", F.concat_ws("/", "kind", "variant").alias("slot"), "tag").agg(F.sum("k").alias("n"))
    return [gone, construct_changes(per_slot, ["slot"], ("FID008", None), F.col("slot"), None, F.concat("slot", F.lit(" ")))]


def story_parts(f: D.Facts, shown_: DataFrame) -> DataFrame:
    """(doc, part, story): the body, each slot's parts and the notes."""
    notes = f.nodes.where("depth = 0 and part in ('word/footnotes.xml', 'word/endnotes.xml')").select("doc", "part", F.regexp_extract("part", r"word/(\w+)\.xml", 1).alias("story"))
    placed = shown_.select("doc", "part", F.concat_ws("/", "kind", "variant").alias("story")).distinct()
    return f.main.select("doc", "part", F.lit("document").alias("story")).unionByName(placed).unionByName(notes)


def revision_additions(f: D.Facts, stories: DataFrame) -> DataFrame:
    """Tracked changes whose kind, author and date the source's story doesn't have."""
    attr = F.col("attrs")
    rows = f.nodes.where(F.col("tag").isin(*REVISIONS)).join(stories, ["doc", "part"])
    rows = rows.select("doc", "story", "tag", F.coalesce(attr["w:author"], F.lit("")).alias("author"), F.coalesce(attr["w16du:dateUtc"], attr["w:date"], F.lit("")).alias("date"), F.lit(1).alias("n"))
    source, edited = _sides(rows, "n")
    added = edited.join(source.drop("n").distinct(), ["doc", "story", "tag", "author", "date"], "left_anti").groupBy("doc", "story", "tag", "author").agg(F.count("*").alias("n"))
    kinds = F.create_map(*[F.lit(x) for kv in REVISIONS.items() for x in kv])
    who = F.when(F.col("author") != "", F.concat(F.lit("by "), "author")).otherwise("with no author")
    return D.found(added, "FID012", "info", F.concat("story", F.lit(": "), "n", F.lit(" new tracked "), kinds[F.col("tag")], F.when(F.col("n") > 1, "s ").otherwise(" "), who), F.col("author"), where=F.col("story"))


def diff_paragraphs(rows: DataFrame) -> DataFrame:
    """(doc, story, change, number, before, after, before_original, after_original) of rows(doc,
    story, side, number, current, original): side s is the source, e the edit.

    Paragraphs that either side has once, and the other too, are the fixed points, as many as
    keep one order. Of a stretch between two of them, what both sides begin and end with is
    equal; the rest is changed, if both have as many, or removed and added. Paragraphs
    without text don't count.
    """
    key = ["doc", "story"]
    in_order = lambda *more: Window.partitionBy(*key, *more)  # noqa: E731 - of one story of a pair
    rows = rows.where("current <> '' or original <> ''").withColumn("h", F.sha2(F.to_json(F.struct("current", "original")), 256))
    rows = relations.cut(rows.withColumn("at", F.row_number().over(in_order("side").orderBy("number"))))
    once = rows.groupBy(*key, "side", "h").agg(F.count("*").alias("n"), F.min("at").alias("at")).where("n = 1")
    i, j = (once.where(F.col("side") == side).select(*key, "h", F.col("at").alias(name)) for side, name in (("s", "i"), ("e", "j")))
    points = i.join(j, [*key, "h"]).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("i", "j"))).alias("ps"))
    points = points.withColumn("keep", matching.rising(F.transform("ps", lambda x: x["j"])))
    fixed = points.select(*key, F.posexplode(F.transform("keep", lambda k: F.get("ps", k))).alias("k", "p"))
    fixed = fixed.select(*key, F.explode(F.array(F.struct(F.lit("s").alias("side"), F.col("p.i").alias("at")), F.struct(F.lit("e").alias("side"), F.col("p.j").alias("at")))).alias("x"), (F.col("k") + 1).alias("k")).select(*key, "x.*", "k")
    rows = rows.join(fixed, [*key, "side", "at"], "left")
    stretch = F.coalesce(F.max("k").over(in_order("side").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    rows = rows.withColumn("stretch", stretch).where("k is null")
    item = F.struct("at", "number", "current", "original", "h")
    sides = [rows.where(F.col("side") == side).groupBy(*key, "stretch").agg(F.sort_array(F.collect_list(item)).alias(name)) for side, name in (("s", "a"), ("e", "b"))]
    both = sides[0].join(sides[1], [*key, "stretch"], "full_outer")
    none = F.array().cast("array<struct<at:int,number:int,current:string,original:string,h:string>>")
    both = both.withColumns({"a": F.coalesce("a", none), "b": F.coalesce("b", none)})
    names = lambda c: F.transform(c, lambda x: x["h"])
    both = both.withColumn("head", T.common_prefix(names("a"), names("b")))
    both = both.withColumns({c: F.slice(c, F.col("head") + 1, F.size(c)) for c in "ab"})
    both = both.withColumn("tail", T.common_prefix(F.reverse(names("a")), F.reverse(names("b"))))
    both = both.withColumns({c: F.slice(c, F.lit(1), F.size(c) - F.col("tail")) for c in "ab"})
    empty, nothing = F.lit(""), F.array().cast("array<struct<change:string,number:int,before:string,after:string,before_original:string,after_original:string>>")

    def told(change: str, number: Column, x: Column | None, y: Column | None) -> Column:
        text = lambda v, c: empty if v is None else v[c]
        return F.struct(
            F.lit(change).alias("change"), number.cast("int").alias("number"), text(x, "current").alias("before"), text(y, "current").alias("after"),
            text(x, "original").alias("before_original"), text(y, "original").alias("after_original"),
        )

    changed = F.zip_with("a", "b", lambda x, y: told("changed", y["number"], x, y))
    apart = F.concat(F.transform("a", lambda x: told("removed", x["number"], x, None)), F.transform("b", lambda y: told("added", y["number"], None, y)))
    out = F.when((F.size("a") == 0) & (F.size("b") == 0), nothing).when(F.size("a") == F.size("b"), changed).otherwise(apart)
    return both.select(*key, F.inline(out))


def numbered(f: D.Facts, stories: DataFrame) -> DataFrame:
    """Paragraphs of each story in reading order; a story text that a slot shows twice counts once."""
    views = paragraph_views(f.nodes).join(stories, ["doc", "part"])
    per_part = views.groupBy("doc", "story", "part").agg(F.sort_array(F.collect_list(F.struct("p", "current", "original"))).alias("ps"))
    same = F.transform("ps", lambda x: F.struct(x["current"], x["original"]))
    once = per_part.withColumn("same", F.xxhash64(F.to_json(same))).groupBy("doc", "story", "same").agg(F.min_by("ps", "part").alias("ps"), F.min("part").alias("part"))
    flat = once.groupBy("doc", "story").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "ps"))), lambda x: x["ps"])).alias("ps"))
    rows = flat.select("doc", "story", F.posexplode("ps").alias("at", "x"))
    return rows.select(F.substring("doc", 3, 1 << 30).alias("doc"), "story", F.substring("doc", 1, 1).alias("side"), (F.col("at") + 1).alias("number"), "x.current", "x.original")


def paragraph_changes(f: D.Facts, stories: DataFrame) -> DataFrame:
    rows = diff_paragraphs(numbered(f, stories))
    quote = lambda c: F.concat(F.lit("'"), T.snippet(F.col(c), 120), F.lit("'"))
    n = F.concat(F.lit("paragraph "), "number")
    text = (
        F.when(F.col("change") == "added", F.concat(n, F.lit(" added: "), quote("after")))
        .when(F.col("change") == "removed", F.concat(F.lit("source "), n, F.lit(" removed: "), quote("before")))
        .when(F.col("before") != F.col("after"), F.concat(n, F.lit(" changed: "), quote("before"), F.lit(" -> "), quote("after")))
        .otherwise(F.concat(n, F.lit(" changed with its tracked changes rejected: "), quote("before_original"), F.lit(" -> "), quote("after_original")))
    )
    place = F.concat("story", F.lit("/p"), "number", F.when(F.col("change") == "removed", " (source)").otherwise(""))
    return D.found(rows, "FID014", "info", F.concat("story", F.lit(": "), text), F.col("change"), where=place)


def sided(pairs: DataFrame) -> DataFrame:
    """pairs(pair, source, edited) as packages; a pair's two documents are s:pair and e:pair."""
    both = (pairs.select(F.concat(F.lit(f"{k}:"), "pair").alias("doc"), F.col(c).alias("content")) for k, c in (("s", "source"), ("e", "edited")))
    return reduce(DataFrame.unionByName, both)


def compare(pairs: DataFrame, limits: P.Limits = P.Limits()) -> DataFrame:
    """Findings (doc is the pair) on pairs(pair, source, edited: binary). A pair one of whose
    packages can't be read gets one FID000 and nothing else."""
    f = D.facts(sided(pairs), limits)
    pair = F.substring("doc", 3, 1 << 30)
    unread = f.members.where("code is not null").select("doc").unionByName(f.nodes.where("error is not null").select("doc"))
    unread = unread.unionByName(f.members.select("doc").distinct().join(f.body.where("depth = 0").select("doc"), "doc", "left_anti"))
    failed = unread.select(pair.alias("doc")).distinct()
    shown_ = relations.cut(slots(f))
    stories = relations.cut(story_parts(f, shown_))
    nothing = F.lit("")
    body = f.body
    same = relations.cut(revisions.same_text(body))
    excused = lambda alt: same.where(F.col("alt") == F.lit(alt)).select("doc", "tag")
    texts, other_texts = revisions.payload_losses(body)
    groups = [
        [
            construct_changes(counts(f, False), [], ("FID001", "FID002"), None, None, nothing, excused(False)), text_loss(volumes(f, False)),
            demoted(construct_changes(counts(f, True), [], ("FID001", None), None, None, nothing, excused(True))), demoted(text_loss(volumes(f, True))),
        ],
        [texts, demoted(other_texts), revisions.growth(body), revisions.note_revision_losses(revisions.note_kinds(f.nodes))],
        [revisions.wide_replacements(f.nodes, stories)], references.reference_losses(f.nodes, stories),
        [revision_additions(f, stories)], [paragraph_changes(f, stories.where("story not in ('footnotes', 'endnotes')"))],
        [body_losses(relations.cut(bodies(f)))], story_losses(f, shown_),
    ]
    out = D.together(groups).join(failed, "doc", "left_anti")
    out = out.unionByName(D.found(failed, "FID000", "error", "the comparison could not be run: a package can't be read"))
    return D.ranked(out)
